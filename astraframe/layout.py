"""The file format as pure functions and tables: block padding, column formats, sample types, keywords."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

BLOCK = 2880
CARD = 80
#: A logical of an image extension with the rows of the plane that follows the planes of the unit before it.
LAST_PLANE = "LASTPLAN"

#: Both follow the format's definition, except where "reference" is asked for: then layouts and values
#: are those that the reference implementation's arithmetic gives, wherever it gives a value.
MODES = ("standard", "reference")


def padded(n: int) -> int:
    """Bytes rounded up to whole blocks."""
    return -(-n // BLOCK) * BLOCK


def is_data_file(path: str) -> bool:
    """By suffix, in lower case only."""
    return re.search(r"[.](fit|fits|fts)([.]gz)?$", path) is not None


# Bytes a sample, NumPy and Spark types by BITPIX.
BITPIX: dict[int, tuple[int, str, T.DataType]] = {
    8: (1, "u1", T.ShortType()),
    16: (2, ">i2", T.ShortType()),
    32: (4, ">i4", T.IntegerType()),
    64: (8, ">i8", T.LongType()),
    -32: (4, ">f4", T.FloatType()),
    -64: (8, ">f8", T.DoubleType()),
}

# Bytes an item, NumPy and Spark types by column letter.
LETTERS: dict[str, tuple[int, str, T.DataType]] = {
    "L": (1, "u1", T.BooleanType()),
    "X": (1, "u1", T.BooleanType()),
    "B": (1, "u1", T.ShortType()),
    "S": (1, "i1", T.ByteType()),
    "I": (2, ">i2", T.ShortType()),
    "U": (2, ">u2", T.IntegerType()),
    "J": (4, ">i4", T.IntegerType()),
    "V": (4, ">u4", T.LongType()),
    "K": (8, ">i8", T.LongType()),
    "A": (1, "S", T.StringType()),
    "E": (4, ">f4", T.FloatType()),
    "D": (8, ">f8", T.DoubleType()),
    "C": (8, ">f4", T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())])),
    "M": (16, ">f8", T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])),
    "P": (8, ">i4", T.NullType()),
    "Q": (16, ">i8", T.NullType()),
}

#: Zero offsets that make a signed column unsigned (and B signed), with the type that then holds it.
UNSIGNED: dict[tuple[str, float], T.DataType] = {
    ("B", -128.0): T.ByteType(),
    ("I", 32768.0): T.IntegerType(),
    ("J", 2147483648.0): T.LongType(),
}


@dataclass(frozen=True)
class Format:
    """A column format: repeat count, letter, characters an item (A only), and the letter in a heap (P, Q only)."""

    repeat: int
    letter: str
    items: int = 0
    heap: str = ""

    def width(self, mode: str = "standard") -> int:
        if mode == "reference":
            if self.letter in "XCM":
                return self.repeat * {"X": 1, "C": 4, "M": 8}[self.letter]
            if self.letter == "A" and self.items:
                return self.repeat * self.items
        if self.letter == "X":
            return -(-self.repeat // 8)
        return self.repeat * LETTERS[self.letter][0]

    def __str__(self) -> str:
        return f"{self.repeat}{self.letter}{self.heap}{self.items or ''}"


def parse_format(text: str) -> Format:
    """[repeat]letter[items]; what follows is ignored; an unknown letter is an error."""
    m = re.match(r"\s*(\d*)([A-Z])([A-Z]?)(\d*)", text)
    if not m or m[2] not in LETTERS:
        raise ValueError(f"invalid column format {text!r}")
    repeat = int(m[1]) if m[1] else 1
    if m[2] in "PQ":
        if m[3] not in LETTERS or m[3] in "PQ":
            raise ValueError(f"invalid column format {text!r}")
        return Format(repeat, m[2], heap=m[3])
    return Format(repeat, m[2], int(m[4]) if m[4] and m[2] == "A" and not m[3] else 0)


@dataclass(frozen=True)
class Field:
    """A column of a table: where its cells are, and what its keywords say."""

    name: str
    format: Format
    offset: int
    scale: float | None = None
    zero: float | None = None
    null: str | None = None
    dim: str | None = None
    text: str = ""

    def spark_type(self, scaling: bool = False, arrays: bool = False) -> T.DataType:
        f = self.format
        letter = f.heap or f.letter
        item = LETTERS[letter][2]
        if scaling and (self.scale is not None or self.zero is not None) and letter in "BSIUJVKED":
            item = UNSIGNED.get((letter, self.zero or 0.0), T.DoubleType()) if (self.scale or 1.0) == 1.0 else T.DoubleType()
        if letter == "A":
            return T.ArrayType(item) if f.items else item
        return T.ArrayType(item) if f.heap or f.repeat != 1 or arrays or letter == "X" else item


def unique_names(names: list[str]) -> list[str]:
    """Later columns of a name get _2, _3 ... so that each can be selected; the first keeps its name."""
    seen: set[str] = set()
    out = []
    for name in names:
        k, new = 1, name
        while new.lower() in seen:
            k += 1
            new = f"{name}_{k}"
        seen.add(new.lower())
        out.append(new)
    return out


def _number(text: str | None) -> float | None:
    return None if text is None else float(str(text).upper().replace("D", "E"))


def table_fields(header: dict[str, object], mode: str = "standard") -> list[Field]:
    """Binary-table columns from a header's first values by keyword; unnamed ones are col1, col2 ..."""
    n = int(header.get("TFIELDS") or 0)
    names = unique_names([str(header.get(f"TTYPE{i}") or f"col{i}").strip() for i in range(1, n + 1)])
    out, offset = [], 0
    for i, name in enumerate(names, 1):
        if f"TFORM{i}" not in header:
            raise ValueError(f"TFORM{i} is missing")
        f = parse_format(str(header[f"TFORM{i}"]))
        null = header.get(f"TNULL{i}")
        out.append(Field(name, f, offset, _number(header.get(f"TSCAL{i}")), _number(header.get(f"TZERO{i}")), None if null is None else str(null), header.get(f"TDIM{i}")))
        offset += f.width(mode)
    return out


def ascii_fields(header: dict[str, object]) -> list[Field]:
    """ASCII-table columns: TBCOL is one-based; A, I, F, E and D with widths."""
    n = int(header.get("TFIELDS") or 0)
    names = unique_names([str(header.get(f"TTYPE{i}") or f"col{i}").strip() for i in range(1, n + 1)])
    out = []
    for i, name in enumerate(names, 1):
        text = str(header[f"TFORM{i}"]).strip()
        m = re.match(r"([AIFED])(\d+)(?:\.(\d+))?", text)
        if not m:
            raise ValueError(f"invalid ASCII column format {text!r}")
        null = header.get(f"TNULL{i}")
        out.append(Field(name, Format(int(m[2]), "A"), int(header[f"TBCOL{i}"]) - 1, _number(header.get(f"TSCAL{i}")), _number(header.get(f"TZERO{i}")), None if null is None else str(null), text=m[1]))
    return out


ASCII_TYPES: dict[str, T.DataType] = {"A": T.StringType(), "I": T.LongType(), "F": T.DoubleType(), "E": T.DoubleType(), "D": T.DoubleType()}

# The typed keywords, with the name of their accessor and their kind.
KEYWORDS: tuple[tuple[str, str, str], ...] = (
    ("AUTHOR", "author", "string"),
    ("BITPIX", "bitpix", "int"),
    ("BLANK", "blank", "int"),
    ("BLOCKED", "blocked", "bool"),
    ("BSCALE", "bscale", "float"),
    ("BUNIT", "bunit", "string"),
    ("BZERO", "bzero", "float"),
    ("DATAMAX", "data_max", "float"),
    ("DATAMIN", "data_min", "float"),
    ("DATE", "date", "time"),
    ("DATE-OBS", "date_observed", "time"),
    ("EPOCH", "epoch", "float"),
    ("EQUINOX", "equinox", "float"),
    ("EXTEND", "extend", "bool"),
    ("EXTLEVEL", "extension_level", "int"),
    ("EXTNAME", "extension_name", "string"),
    ("EXTVER", "extension_version", "int"),
    ("GCOUNT", "group_count", "int"),
    ("GROUPS", "groups", "bool"),
    ("INSTRUME", "instrument", "string"),
    ("NAXIS", "naxis", "int"),
    ("OBJECT", "object", "string"),
    ("OBSERVER", "observer", "string"),
    ("ORIGIN", "origin", "string"),
    ("PCOUNT", "pcount", "int"),
    ("REFERENC", "reference", "string"),
    ("SIMPLE", "simple", "bool"),
    ("TELESCOP", "telescope", "string"),
    ("TFIELDS", "table_fields", "int"),
    ("THEAP", "table_heap", "int"),
    ("XTENSION", "extension", "xtension"),
    ("FOCALLEN", "focal_length", "float"),
    ("EXPTIME", "exposure_time", "float"),
    ("CCD-TEMP", "ccd_temperature", "float"),
    ("BAYERPAT", "bayer_pattern", "bayer"),
    ("CREATOR", "creator", "string"),
    ("XORGSUBF", "subframe_x_position_in_binned_pixels", "int"),
    ("YORGSUBF", "subframe_y_position_in_binned_pixels", "int"),
    ("XBINNING", "binned_pixels_x", "int"),
    ("YBINNING", "binned_pixels_y", "int"),
    ("CCDXBIN", "ccd_binned_pixels_x", "int"),
    ("CCDYBIN", "ccd_binned_pixels_y", "int"),
    ("XPIXSZ", "pixel_size_x_with_binning_in_microns", "float"),
    ("YPIXSZ", "pixel_size_y_with_binning_in_microns", "float"),
    ("IMAGETYP", "image_type", "imagetype"),
    ("EXPOSURE", "exposure", "float"),
    ("RA", "ra", "float"),
    ("DEC", "dec", "float"),
    ("GUIDECAM", "guide_cam", "string"),
    ("FOCUSPOS", "focus_position", "int"),
    ("SITELONG", "site_longitude", "float"),
    ("SITELAT", "site_latitude", "float"),
    ("IMAGEW", "image_width", "int"),
    ("IMAGEH", "image_height", "int"),
)

# The indexed families of keywords.
FAMILIES: tuple[tuple[str, str, str], ...] = (
    ("CDELT", "coordinate_delta", "float"),
    ("CROTA", "coordinate_rotation", "float"),
    ("CRPIX", "coordinate_reference_pixel", "float"),
    ("CRVAL", "coordinate_value_at_pixel", "float"),
    ("CTYPE", "coordinate_axis_name", "string"),
    ("NAXIS", "naxis_n", "int"),
    ("PSCAL", "parameter_scaling_factor", "float"),
    ("PTYPE", "parameter_type", "string"),
    ("PZERO", "parameter_scaling_zero_point", "float"),
    ("TBCOL", "table_column", "int"),
    ("TDIM", "table_dimensions", "string"),
    ("TFORM", "table_column_format", "string"),
    ("TDISP", "table_display_format", "string"),
    ("TNULL", "table_null_value", "string"),
    ("TSCAL", "table_scaling_factor", "float"),
    ("TTYPE", "table_column_type", "string"),
    ("TUNIT", "table_unit", "string"),
    ("TZERO", "table_scaling_zero_point", "float"),
)

# Enumerated keyword values.
BAYER_PATTERNS = ("RGGB", "BGGR", "GRBG", "GBRG")
EXTENSIONS = ("IMAGE", "TABLE", "BINTABLE")
IMAGE_TYPES = ("Light", "Bias", "Dark", "Flat", "MasterBias", "MasterDark", "MasterFlat")
