"""Bytes to Arrow: blocks of table rows, image rows and ASCII rows; only the columns asked for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..layout import LETTERS, UNSIGNED, Field
from .headers import FormatError


def cells(block: np.ndarray, f: Field, mode: str) -> np.ndarray:
    """A column's cells, rows by repeat, as they stand (big-endian, bytes for text)."""
    n = len(block)
    width = f.format.width(mode)
    part = np.ascontiguousarray(block[:, f.offset : f.offset + width])
    _, kind, _ = LETTERS[f.format.letter]
    if f.format.letter == "A":
        return part
    if f.format.letter == "X":
        return part
    return part.view(kind).reshape(n, -1)


def _strings(part: np.ndarray) -> pa.Array:
    """Fixed-width text: UTF-8 without NULs, trimmed at both ends; other bytes are an error."""
    n, width = part.shape
    if not width:
        return pa.array([""] * n)
    raw = pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(part))])
    try:
        text = raw.cast(pa.binary()).cast(pa.string())
    except pa.ArrowInvalid as e:
        raise FormatError(f"text that is not UTF-8: {e}") from e
    if not part.all():
        text = pc.replace_substring(text, "\0", "")
    return pc.ascii_trim_whitespace(text)


def _listed(values: pa.Array, n: int, each: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * each), values)


def _native(x: np.ndarray) -> np.ndarray:
    return x.astype(x.dtype.newbyteorder("="))


def _values(raw: np.ndarray, letter: str, f: Field, mode: str, scaling: bool, nulls: bool) -> pa.Array:
    """Flat cells of a letter as an Arrow array."""
    raw = raw.ravel()
    if letter == "L":
        if mode == "reference":
            return pa.array(raw != 0)
        return pa.array(raw == ord("T"), mask=~np.isin(raw, (ord("T"), ord("F"))))
    if letter in "CM":
        if mode == "reference":  # two values in what the reference takes for one
            raw = raw[: len(raw) // 2 * 2]
        pair = _native(raw).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["re", "im"])
    x = _native(raw)
    mask = x == int(float(f.null)) if nulls and f.null is not None and letter in "BSIUJVK" else None
    kind = to_arrow_type(LETTERS[letter][2])
    if scaling and (f.scale is not None or f.zero is not None):
        scale, zero = 1.0 if f.scale is None else f.scale, f.zero or 0.0
        if scale == 1.0 and (letter, zero) in UNSIGNED:
            return pa.array(x.astype(np.int64) + int(zero), to_arrow_type(UNSIGNED[letter, zero]), mask=mask)
        return pa.array(zero + scale * x.astype(np.float64), pa.float64(), mask=mask)
    return pa.array(x, mask=mask).cast(kind)


def column(block: np.ndarray, f: Field, want: T.DataType, mode: str, scaling: bool, nulls: bool, heap=None) -> pa.Array:
    """One column of a block of rows (rows by stride bytes) in the type that the schema asks for."""
    n, letter, repeat = len(block), f.format.letter, f.format.repeat
    arrays = isinstance(want, T.ArrayType)
    raw = cells(block, f, mode)
    if letter == "A":
        if f.format.items:
            size = repeat if mode == "reference" else f.format.items
            count = raw.shape[1] // size if size else 0
            out = _listed(_strings(raw[:, : count * size].reshape(n * count, size)), n, count)
        else:
            out = _strings(raw)
    elif letter == "X":
        bits = (raw != 0) if mode == "reference" else np.unpackbits(raw, axis=1)[:, :repeat].astype(bool)
        out = _listed(pa.array(bits.ravel()), n, bits.shape[1])
    elif letter in "PQ":
        out = _from_heap(raw, f, mode, scaling, nulls, heap)
    else:
        values = _values(raw, letter, f, mode, scaling, nulls)
        each = len(values) // n if n else repeat
        if arrays:
            out = _listed(values, n, each)
        elif each == 0:
            out = pa.nulls(n, values.type)
        else:
            out = values if each == 1 else values.take(pa.array(np.arange(n) * each))
    kind = to_arrow_type(want)
    return out if out.type == kind else out.cast(kind)


def _from_heap(raw: np.ndarray, f: Field, mode: str, scaling: bool, nulls: bool, heap) -> pa.Array:
    letter = f.format.heap
    size, kind, _ = LETTERS[letter]
    at = _native(raw).astype(np.int64).reshape(len(raw), -1)
    at = at[:, :2] if at.shape[1] >= 2 else np.zeros((len(raw), 2), np.int64)
    parts, counts = [], []
    for count, offset in at.tolist():
        width = -(-count // 8) if letter == "X" else count * size
        data = heap(offset, width) if width else b""
        if len(data) < width:
            raise FormatError(f"heap of column {f.name} ends early")
        if letter == "A":
            parts.append(data.replace(b"\0", b"").strip())
            continue
        x = np.frombuffer(data, kind)
        parts.append(np.unpackbits(x)[:count] if letter == "X" else x)
        counts.append(count)
    if letter == "A":
        return pa.array(parts, pa.binary()).cast(pa.string())
    flat = np.concatenate(parts) if parts else np.empty(0, kind)
    values = pa.array(flat.astype(bool)) if letter == "X" else _values(flat, letter, f, mode, scaling, nulls)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def ascii_column(block: np.ndarray, f: Field, want: T.DataType, scaling: bool) -> pa.Array:
    """Fixed-width text of an ASCII table; blank numbers and the column's null text are null."""
    text = _strings(block[:, f.offset : f.offset + f.format.repeat])
    null = pc.equal(text, "") if f.text != "A" else pa.array(np.zeros(len(block), bool))
    if f.null is not None:
        null = pc.or_(null, pc.equal(text, f.null.strip()))
    text = pc.if_else(null, pa.scalar(None, pa.string()), text)
    if f.text == "A":
        return text
    try:
        if f.text == "I" and not scaling:
            return text.cast(pa.int64())
        out = pc.replace_substring(pc.utf8_upper(text), "D", "E").cast(pa.float64())
    except pa.ArrowInvalid as e:
        raise FormatError(f"column {f.name}: {e}") from e
    if scaling:
        out = pc.add(pc.multiply(out, 1.0 if f.scale is None else f.scale), f.zero or 0.0)
    return out.cast(to_arrow_type(want))
