"""Header cards in Python, for planning and for tasks: the walk over a file's header-data units."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import prod

from ..layout import BITPIX, BLOCK, CARD, LAST_PLANE, padded

_QUOTED = re.compile(r"\s*'((?:[^']|'')*)'\s*(?:/\s*(.*))?$")
_INT = re.compile(r"[+-]?\d+$")
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[EDed][+-]?\d+)?$")
_COMPLEX = re.compile(r"\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*\)$")
_HIERARCH = re.compile(r"HIERARCH\s+(.+?)\s*=\s*(.*)$")
COMMENTS = ("COMMENT", "HISTORY", "")


class FormatError(ValueError):
    """A file that breaks the format; says where."""


@dataclass(frozen=True)
class Card:
    keyword: str
    kind: str
    value: object
    comment: str | None


@lru_cache(16384)
def parse_card(text: str) -> Card:
    """One 80-character card under the format's rules; files have many in common."""
    text = text.ljust(CARD)
    keyword = text[:8].strip()
    if keyword == "END":
        return Card("END", "end", None, None)
    body = text[10:]
    if keyword == "HIERARCH" and (m := _HIERARCH.match(text.rstrip())):
        keyword, body = m[1], m[2]
    elif keyword == "CONTINUE":
        body = text[8:]
    elif keyword in (*COMMENTS, "HIERARCH") or text[8:10] != "= ":
        return Card(keyword, "comment", None, text[8:].strip())
    if m := _QUOTED.match(body.rstrip()):
        return Card(keyword, "string", m[1].replace("''", "'").rstrip(), m[2].strip() if m[2] is not None else None)
    value, slash, comment = body.partition("/")
    value = value.strip()
    said = comment.strip() if slash else None
    if not value:
        return Card(keyword, "undefined", None, said)
    if value in "TF":
        return Card(keyword, "logical", value == "T", said)
    if _INT.match(value):
        return Card(keyword, "integer", int(value), said) if -(2**63) <= int(value) < 2**63 else Card(keyword, "float", float(value), said)
    if _FLOAT.match(value):
        return Card(keyword, "float", float(value.upper().replace("D", "E")), said)
    if (m := _COMPLEX.match(value)) and all(_FLOAT.match(x) for x in m.groups()):
        return Card(keyword, "complex", tuple(float(x.upper().replace("D", "E")) for x in m.groups()), said)
    return Card(keyword, "invalid", value, said)


@dataclass
class Unit:
    """A header-data unit: its place, its cards, and the first value of each keyword."""

    index: int
    offset: int
    cards: list[str]
    first: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        last = None
        for text in self.cards:
            c = parse_card(text)
            if c.keyword == "CONTINUE" and c.kind == "string" and isinstance(self.first.get(last), str):
                self.first[last] = str(self.first[last]).removesuffix("&") + str(c.value)
                continue
            last = None
            if c.kind not in ("comment", "end", "undefined", "invalid") and c.keyword not in self.first:
                self.first[c.keyword] = c.value
                last = c.keyword

    @property
    def header_bytes(self) -> int:
        return padded(CARD * len(self.cards))

    @property
    def data_offset(self) -> int:
        return self.offset + self.header_bytes

    @property
    def axes(self) -> list[int]:
        return [int(self.first.get(f"NAXIS{i}") or 0) for i in range(1, int(self.first.get("NAXIS") or 0) + 1)]

    @property
    def bitpix(self) -> int | None:
        b = self.first.get("BITPIX")
        return int(b) if b in BITPIX else None

    @property
    def data_bytes(self) -> int:
        """|BITPIX| / 8 * GCOUNT * (PCOUNT + product of axes); a first axis of 0 means random groups."""
        axes = self.axes
        if not axes or self.bitpix is None:
            return 0
        if self.first.get("GROUPS") is True and axes[0] == 0:
            axes = axes[1:]
        pcount, gcount = int(self.first.get("PCOUNT") or 0), int(self.first.get("GCOUNT", 1))
        return BITPIX[self.bitpix][0] * gcount * (pcount + prod(axes))

    @property
    def kind(self) -> str:
        x = self.first.get("XTENSION")
        if self.index == 0:
            return "IMAGE"
        x = str(x or "").strip().upper()
        return x if x in ("IMAGE", "TABLE", "BINTABLE") else "OTHER"

    @property
    def name(self) -> str | None:
        n = self.first.get("EXTNAME")
        return n if isinstance(n, str) else None

    @property
    def plane(self) -> tuple[int, int, int]:
        """Width, height and number of planes of an image."""
        axes = self.axes
        if not axes or self.kind != "IMAGE":
            return 0, 0, 0
        return axes[0], axes[1] if len(axes) > 1 else 1, prod(axes[2:]) if axes[0] else 0


def read_cards(file, offset: int) -> list[str] | None:
    """The cards up to and with END, or None where no header with END begins."""
    cards: list[str] = []
    while True:
        block = file.at(offset + CARD * len(cards), BLOCK * 4)
        if not block:
            return None
        block = block.ljust(-(-len(block) // CARD) * CARD, b"\0")
        for i in range(0, len(block), CARD):
            text = block[i : i + CARD].decode("latin-1")
            if not cards and not text.strip("\0 "):
                return None
            cards.append(text.replace("\0", " "))
            if text[:8].rstrip("\0 ") == "END":
                return cards


def units(file, upto: int | str | None = None) -> Iterator[Unit]:
    """Header-data units in order; only headers are read. The file ends where no further header does begin."""
    offset, index = 0, 0
    while offset < file.size:
        cards = read_cards(file, offset)
        if cards is None:
            if index == 0:
                raise FormatError(f"{file.name}: no primary header")
            return
        unit = Unit(index, offset, cards)
        if index == 0 and unit.first.get("SIMPLE") is not True:
            raise FormatError(f"{file.name}: SIMPLE is missing or false")
        if index and "XTENSION" not in unit.first:
            raise FormatError(f"{file.name}: unit {index} has no XTENSION")
        yield unit
        if upto is not None and upto in (index, unit.name):
            return
        offset = unit.data_offset + padded(unit.data_bytes)
        index += 1
    if index == 0:
        raise FormatError(f"{file.name}: no primary header")


def pick(file, hdu: str | None, kinds: tuple[str, ...]) -> Unit | None:
    """The unit of an index or an EXTNAME, or the first of the kinds that has data; None where none is."""
    want = int(hdu) if hdu and re.fullmatch(r"\d+", hdu) else hdu
    for unit in units(file, want):
        if want is None and unit.kind in kinds and (unit.kind != "IMAGE" or unit.axes) or want is not None and want in (unit.index, unit.name):
            return unit if unit.kind in kinds else None
    return None


def last_plane(file, u: Unit) -> Unit | None:
    """The unit after an image with the rows of its last plane, where that isn't full."""
    offset = u.data_offset + padded(u.data_bytes)
    cards = read_cards(file, offset) if offset < file.size else None
    if cards is None:
        return None
    rest = Unit(u.index + 1, offset, cards)
    return rest if rest.first.get(LAST_PLANE) is True and rest.kind == "IMAGE" and rest.bitpix == u.bitpix and rest.plane[0] == u.plane[0] else None
