"""Header cards as Column expressions: 80 characters to keyword, typed value and comment.

``mode="standard"`` follows the format: doubled quotes, a slash within a comment, T and F exactly,
complex numbers, HIERARCH keywords. ``mode="reference"`` cuts text at the second quote and comments
at the second slash, and takes anything that begins with T or F for a logical; where the reference
gives up on the whole file, the card has an error and a null value instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..layout import BAYER_PATTERNS, BLOCK, CARD, EXTENSIONS, FAMILIES, IMAGE_TYPES

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[EDed][+-]?\d+)?"
_COMPLEX = rf"^\(\s*({_NUMBER})\s*,\s*({_NUMBER})\s*\)$"


def to_double(text: Column) -> Column:
    """A number with an E or D exponent; null for anything else (Java's suffixes included)."""
    return F.when(text.rlike(f"^{_NUMBER}$"), F.replace(F.upper(text), F.lit("D"), F.lit("E")).try_cast("double"))


#: The columns that parsing adds; kind is string, logical, integer, float, complex, undefined, invalid, comment or end.
PARSED = ("keyword", "kind", "int", "float", "bool", "string", "re", "im", "comment", "error")


def card_steps(card: Column, mode: str = "standard") -> list[dict[str, Column]]:
    """Columns to add step by step, each step using those before it, so that nothing is computed twice.

    The last step has the PARSED columns; the others begin with two underscores.
    """
    reference = mode == "reference"
    c, key, body, rest = (F.col(n) for n in ("__card", "__key", "__body", "__rest"))
    plain, inner, cut, said = (F.col(n) for n in ("__plain", "__inner", "__cut", "__said"))
    hier, has, quoted, closed, numeric = (F.col(n) for n in ("__hier", "__has", "__quoted", "__closed", "__numeric"))
    hierarch = F.lit(False) if reference else (key == "HIERARCH") & c.rlike(r"^HIERARCH\s+.+?=")
    value_key = ~key.isin("COMMENT", "HISTORY", "", "END", "HIERARCH")
    indicated = (F.substring(c, 9, 2) == "= ") if reference else (key == "CONTINUE") | (F.substring(c, 9, 2) == "= ")
    value_key = value_key & (key != "CONTINUE") if reference else value_key
    steps = [
        {"__card": F.rpad(card, CARD, " ")},
        {"__key": F.trim(F.substring(c, 1, 8))},
        {"__hier": hierarch},
        {
            "__has": hier | (value_key & indicated),
            "__body": F.trim(F.when(hier, F.regexp_extract(c, r"^HIERARCH\s+.+?\s*=\s*(.*)$", 1)).when(key == "CONTINUE", F.substring(c, 9, 72)).otherwise(F.substring(c, 11, 70))),
        },
        {"__quoted": F.startswith(body, F.lit("'"))},
    ]
    if reference:  # text up to the second quote, comments up to the second slash
        parts = F.split(body, "'")
        steps += [
            {"__inner": F.when(quoted, F.get(parts, F.lit(1))), "__rest": F.when(quoted, F.get(parts, F.lit(2)))},
            {"__closed": quoted & rest.isNotNull(), "__text": inner, "__said": F.when(quoted, F.trim(F.get(F.split(rest, "/"), F.lit(1)))).otherwise(F.trim(F.get(F.split(body, "/"), F.lit(1))))},
        ]
    else:  # doubled quotes are pairs from the left, so what is single after replacing them closes the text
        steps += [
            {"__inner": F.when(quoted, F.replace(F.substring(body, 2, CARD), F.lit("''"), F.lit("\x01")))},
            {"__cut": F.when(quoted, F.instr(inner, "'"))},
            {"__rest": F.when(cut > 0, F.ltrim(F.substring(inner, cut + 1, F.lit(CARD))))},
            {
                "__closed": F.coalesce((cut > 0) & ((rest == "") | F.startswith(rest, F.lit("/"))), F.lit(False)),
                "__text": F.replace(F.substring(inner, F.lit(1), cut - 1), F.lit("\x01"), F.lit("'")),
                "__said": F.when(quoted, F.when(rest != "", F.trim(F.replace(F.substring(rest, 2, CARD), F.lit("\x01"), F.lit("''"))))).when(F.contains(body, F.lit("/")), F.trim(F.substring(body, F.instr(body, "/") + 1, F.lit(CARD)))),
            },
        ]
    steps += [
        {"__plain": F.when(has & ~quoted, F.trim(F.substring_index(body, "/", 1)))},
        {"__numeric": F.substring(plain, 1, 1).isin(*"0123456789+-.")},
        {"__whole": F.when(numeric, plain.try_cast("bigint"))},
        {"__number": F.when(numeric & F.col("__whole").isNull(), to_double(plain)), "__pair": F.when(F.startswith(plain, F.lit("(")) & F.lit(not reference), F.split(F.regexp_replace(plain, r"^\(\s*|\s*\)$", ""), r"\s*,\s*"))},
        {"__re": F.when(plain.rlike(_COMPLEX), to_double(F.get("__pair", F.lit(0)))), "__im": F.when(plain.rlike(_COMPLEX), to_double(F.get("__pair", F.lit(1))))},
        {
            "__kind": F.when(key == "END", "end").when(~has, "comment").when(quoted & closed, "string").when(quoted, "invalid").when(plain == "", "undefined").when(plain.rlike("^[TF]") if reference else plain.isin("T", "F"), "logical")
            .when(F.col("__whole").isNotNull(), "integer").when(F.col("__number").isNotNull(), "float").when(F.col("__pair").isNotNull() & F.col("__re").isNotNull(), "complex").otherwise("invalid")
        },
    ]
    of = lambda k, x: F.when(F.col("__kind") == k, x)
    error = F.when(has & quoted & ~closed, "text without a closing quote").when(F.startswith(plain, F.lit("(")) & F.lit(reference), "complex values are not supported")
    keyword = F.when(hier, F.regexp_extract(c, r"^HIERARCH\s+(.+?)\s*=", 1)).otherwise(key)
    steps.append({
        "keyword": keyword, "kind": F.col("__kind"), "int": of("integer", F.col("__whole")), "float": of("float", F.col("__number")), "bool": of("logical", F.startswith(plain, F.lit("T"))),
        "string": of("string", F.rtrim(F.col("__text"))), "re": of("complex", F.col("__re")), "im": of("complex", F.col("__im")),
        "comment": F.when(~has & (key != "END"), F.trim(F.substring(c, 9, 72))).when(has, said), "error": error,
    })
    return steps


def as_text(card: Column) -> Column:
    """The value of a parsed card as text: T or F for logicals, empty for none."""
    return F.coalesce(card["string"], F.when(card["bool"], "T").when(~card["bool"], "F"), card["int"].cast("string"), card["float"].cast("string"), F.when(card["re"].isNotNull(), F.concat_ws(",", card["re"], card["im"])), F.lit(""))


def pretty(card: Column) -> Column:
    """A line a card: the keyword padded to 8, the value right-aligned to 72, the comment; END is alone."""
    return F.when(card["kind"] == "end", "END").otherwise(F.format_string("%-8s = %72s / %s", card["keyword"], as_text(card), F.coalesce(card["comment"], F.lit(""))))


def split_cards(header: Column) -> Column:
    """The 80-character cards of a header's text, up to and with END; null without END."""
    n = F.ceil(F.length(header) / CARD).cast("int")
    cards = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.rpad(F.substring(header, i * CARD + 1, F.lit(CARD)), CARD, " "))
    end = F.array_position(F.transform(cards, lambda c: F.rtrim(F.substring(c, 1, 8))), "END").cast("int")
    return F.when(end > 0, F.slice(cards, F.lit(1), end))


def padded_bytes(n: Column) -> Column:
    return (F.ceil(n / BLOCK) * BLOCK).cast("bigint")


def header_bytes(n_cards: Column) -> Column:
    return padded_bytes(n_cards * CARD)


def bitpix_bytes(bitpix: Column) -> Column:
    """Bytes a sample; null for an invalid value."""
    return F.when(bitpix.isin(8, 16, 32, 64, -32, -64), (F.abs(bitpix) / 8).cast("bigint"))


def data_bytes(bitpix: Column, axes: Column, pcount: Column | None = None, gcount: Column | None = None) -> Column:
    """Bytes of a unit's data: sample width, times groups, times parameters and the product of the axes."""
    many = F.aggregate(axes, F.lit(1).cast("bigint"), lambda a, n: a * n)
    pcount = F.coalesce(pcount, F.lit(0)) if pcount is not None else F.lit(0)
    gcount = F.coalesce(gcount, F.lit(1)) if gcount is not None else F.lit(1)
    return F.when(F.size(axes) == 0, F.lit(0).cast("bigint")).otherwise(bitpix_bytes(bitpix) * gcount * (pcount + many))


def parse_format(tform: Column) -> Column:
    """struct(repeat, letter, items, heap) of a column format; letter is empty where it is invalid."""
    g = lambda i: F.regexp_extract(tform, r"^\s*(\d*)([LXBSIUJVKAEDCMPQ])([A-Z]?)(\d*)", i)
    n = lambda x: F.when(x != "", x).try_cast("int")
    return F.struct(F.coalesce(n(g(1)), F.lit(1)).alias("repeat"), g(2).alias("letter"), F.when(g(2) == "A", F.coalesce(n(g(4)), F.lit(0))).otherwise(0).alias("items"), F.when(g(2).isin("P", "Q"), g(3)).otherwise("").alias("heap"))


def format_bytes(f: Column, mode: str = "standard") -> Column:
    """Bytes of a cell of a parsed format."""
    size = F.create_map(*(F.lit(x) for pair in {"L": 1, "X": 1, "B": 1, "S": 1, "A": 1, "I": 2, "U": 2, "J": 4, "V": 4, "E": 4, "K": 8, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}.items() for x in pair))
    width = f["repeat"] * F.element_at(size, f["letter"])
    if mode == "reference":
        half = F.when(f["letter"].isin("C", "M"), F.floor(width / 2).cast("int"))
        return F.when((f["letter"] == "A") & (f["items"] > 0), f["repeat"] * f["items"]).otherwise(F.coalesce(half, width))
    return F.when(f["letter"] == "X", F.ceil(f["repeat"] / 8).cast("int")).otherwise(width)


def format_text(f: Column) -> Column:
    """A parsed format back to text."""
    return F.concat(f["repeat"].cast("string"), f["letter"], f["heap"], F.when(f["items"] > 0, f["items"].cast("string")).otherwise(""))


def bayer_pattern(text: Column) -> Column:
    """In any case; null if unknown."""
    return F.when(F.upper(F.trim(text)).isin(*BAYER_PATTERNS), F.upper(F.trim(text)))


def extension(text: Column) -> Column:
    return F.when(F.upper(F.trim(text)).isin(*EXTENSIONS), F.upper(F.trim(text)))


def image_type(text: Column) -> Column:
    """The known kinds in their spelling, other text as it is."""
    out = F.when(F.lower(text) == IMAGE_TYPES[0].lower(), IMAGE_TYPES[0])
    for t in IMAGE_TYPES[1:]:
        out = out.when(F.lower(text) == t.lower(), t)
    return out.otherwise(text)


def timestamp(text: Column) -> Column:
    """ISO date-times and plain dates, in UTC sessions; null if malformed."""
    return F.try_to_timestamp(F.trim(text))


def family_of(keyword: Column) -> tuple[Column, Column]:
    """The stem and the one-based index of a keyword in an indexed family, null for others such as CRVAL1A or NAXISX."""
    last = F.regexp_extract(keyword, "[1-9][0-9]*$", 0)
    stem = F.when(last != "", F.substring(keyword, F.lit(1), F.length(keyword) - F.length(last)))
    return F.when(stem.isin(*(f for f, _, _ in FAMILIES)), stem), F.when(last != "", last).try_cast("int")
