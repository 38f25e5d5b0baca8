"""Files made byte by byte, independent of the writer."""

import struct


def card(text):
    return text.ljust(80).encode("latin-1")


def header(*cards):
    data = b"".join(card(c) for c in (*cards, "END"))
    return data.ljust(-(-len(data) // 2880) * 2880)


def pad(data):
    return data.ljust(-(-len(data) // 2880) * 2880, b"\0")


PRIMARY = header("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0")


def table(columns, rows, row_bytes, *more, pcount=0, kind="BINTABLE", heap=b"", extname="T"):
    cards = [f"XTENSION= '{kind}'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {row_bytes}", f"NAXIS2  = {len(rows)}", f"PCOUNT  = {pcount}", "GCOUNT  = 1", f"TFIELDS = {len(columns)}"]
    if extname:
        cards.append(f"EXTNAME = '{extname}'")
    for i, (name, form) in enumerate(columns, 1):
        if name:
            cards.append(f"TTYPE{i}".ljust(8) + f"= '{name}'")
        cards.append(f"TFORM{i}".ljust(8) + f"= '{form}'")
    return header(*cards, *more) + pad(b"".join(rows) + heap)


def image(samples, fmt, bitpix, axes, *more, primary=True):
    first = "SIMPLE  = T" if primary else "XTENSION= 'IMAGE'"
    head = header(first, f"BITPIX  = {bitpix}", f"NAXIS   = {len(axes)}", *(f"NAXIS{i}".ljust(8) + f"= {n}" for i, n in enumerate(axes, 1)), *more)
    return head + pad(struct.pack(f">{len(samples)}{fmt}", *samples))
