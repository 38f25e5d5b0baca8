import random

import fixtures as fx
import pytest
from astraframe.functions import header as H
from astraframe.layout import FAMILIES, KEYWORDS
from astraframe.operators import headers
from astraframe.sources.headers import parse_card
from pyspark.sql import functions as F

CARDS = {
    "OBJECT  = 'O''HARA' / name": ("string", "O'HARA", "name"),
    "OBJECT  = '  M31   ' / a/b": ("string", "  M31", "a/b"),
    "EXPTIME =                  600": ("integer", 600, None),
    "EQUINOX = 2.0D3": ("float", 2000.0, None),
    "XFOO    = Text": ("invalid", None, None),
    "XFOO    = T / yes": ("logical", True, "yes"),
    "XFOO    = (1,2)": ("complex", (1.0, 2.0), None),
    "XFOO    =": ("undefined", None, None),
    "XFOO    = 'open": ("invalid", None, None),
    "XFOO    = 99999999999999999999": ("float", 1e20, None),
    "XFOO    = 12D": ("invalid", None, None),
    "COMMENT   so = it / is": ("comment", None, "so = it / is"),
    "HISTORY": ("comment", None, ""),
    "        plain": ("comment", None, "plain"),
    "XTEXT   no indicator": ("comment", None, "no indicator"),
    "HIERARCH ESO TEL ALT = 1.5 / deg": ("float", 1.5, "deg"),
    "CONTINUE  'more&'": ("string", "more&", None),
    "END": ("end", None, None),
}


def parsed(spark, cards, mode="standard"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cards)], "i int, card string")
    return headers.parse(df, mode).orderBy("i").collect()


def value(c):
    return (c["re"], c["im"]) if c["re"] is not None else next((c[k] for k in ("int", "float", "bool", "string") if c[k] is not None), None)


def test_goldens(spark):
    for text, c in zip(CARDS, parsed(spark, CARDS)):
        assert (c["kind"], value(c), c["comment"]) == CARDS[text], text
        own = parse_card(text)
        assert own.kind == c["kind"] and own.comment == c["comment"] and (own.kind == "invalid" or own.value == value(c)) and own.keyword == c["keyword"]


def test_random_cards_agree(spark):
    r = random.Random(1)
    cards = ["".join(r.choice(["KEY", "HIERARCH ", "COMMENT "])).ljust(8)[:8] + r.choice(["= ", "  ", "="]) + "".join(r.choice("'/ TF12.-+eD()a=&") for _ in range(r.randint(0, 20))) for _ in range(800)]
    for text, c in zip(cards, parsed(spark, cards)):
        own = parse_card(text)
        assert (own.kind, own.keyword) == (c["kind"], c["keyword"]), text
        assert own.kind == "invalid" or own.value == value(c), text


def test_reference_mode(spark):
    got = parsed(spark, ["OBJECT  = 'O''HARA' / name", "OBJECT  = '  M31   ' / a/b", "XFOO    = Text", "XFOO    = (1,2)"], "reference")
    assert [value(c) for c in got] == ["O", "  M31", True, None] and [c["comment"] for c in got][1] == "a" and got[3]["error"]


def test_typed_header_of_every_keyword(spark, tmp_path):
    say = {"string": "'text'", "int": "7", "bool": "T", "float": "3", "time": "'2024-01-02'", "bayer": "'grbg'", "xtension": "'bintable'", "imagetype": "'MASTERDARK'"}
    structure = ("SIMPLE", "BITPIX", "NAXIS", "XTENSION", "GROUPS", "PCOUNT", "GCOUNT")
    cards = ["SIMPLE  = T", "BITPIX  = 16", "NAXIS   = 0"]
    cards += [f"{k:<8}= {say[kind]}" for k, _, kind in KEYWORDS if k not in structure]
    cards += [f"{f}{n}".ljust(8) + f"= {say[kind]}" for f, _, kind in FAMILIES if f != "NAXIS" for n in (1, 12)]
    cards += ["AUTHOR  = 'second'", "CRVAL1A = 9", "TZERO0  = 5"]
    path = tmp_path / "a.fits"
    path.write_bytes(fx.header(*cards))
    row = headers.typed_header(headers.cards(spark, str(path))).first()
    assert len(KEYWORDS) + len(FAMILIES) == 72
    want = {"string": "text", "int": 7, "bool": True, "float": 3.0, "bayer": "GRBG", "imagetype": "MasterDark"}
    for k, name, kind in KEYWORDS:
        if k not in structure and kind != "time":
            assert row[name] == want[kind], k
    assert str(row["date"]) == "2024-01-02 00:00:00" and row["simple"] is True and row["bitpix"] == 16 and row["naxis"] == 0
    for f, name, kind in FAMILIES:
        if f != "NAXIS":
            assert row[name] == {1: want[kind], 12: want[kind]}, f
    assert headers.images_exposure_time(headers.typed_header(headers.cards(spark, str(path)))).first()["images_exposure_time"] == 3.0


def test_lookup_continue_render(spark, tmp_path):
    path = tmp_path / "a.fits"
    path.write_bytes(fx.header("SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0", "LONG    = 'one &'", "CONTINUE  'two &'", "CONTINUE  'three' / end", "OBJECT  = 'a'", "OBJECT  = 'b'"))
    cards = headers.cards(spark, str(path))
    assert [r["string"] for r in headers.raw_card(cards, "OBJECT").orderBy("card_index").collect()] == ["a", "b"]
    assert headers.raw_card(headers.stitch(cards), "LONG").first()["string"] == "one two three"
    lines = [r["line"] for r in headers.render(cards).orderBy("card_index").collect()]
    assert lines[0] == f"{'SIMPLE':<8} = {'T':>72} / " and lines[-1] == "END"


def test_failfast(spark):
    df = headers.parse(spark.createDataFrame([(0, "XFOO    = Text")], "card_index int, card string"))
    assert df.count() == 1
    with pytest.raises(Exception, match="card 0"):
        headers.failfast(df).collect()


def test_sizes(spark):
    cards = "".join(f"KEY{i}".ljust(80) for i in range(35))
    df = spark.createDataFrame([(cards + "END".ljust(80),), (cards + "X".ljust(80) + "END",), (cards,)], "h string")
    n = [r[0] for r in df.select(F.size(H.split_cards(F.col("h")))).collect()]
    assert n[:2] == [36, 37] and n[2] in (-1, None)
    got = spark.range(1).select(H.header_bytes(F.lit(36)), H.header_bytes(F.lit(37)), H.data_bytes(F.lit(16), F.array(F.lit(10), F.lit(3)).cast("array<bigint>")), H.data_bytes(F.lit(8), F.array(F.lit(10), F.lit(3)).cast("array<bigint>"), F.lit(5), F.lit(2)), H.bitpix_bytes(F.lit(12))).first()
    assert tuple(got) == (2880, 5760, 60, 70, None)
