"""Personal data beyond the base patterns: determinism, overlaps, and recall of formats that training has not."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest

pytest.importorskip("astraframe.llm")

from astraframe.llm import pii  # noqa: E402

SF = "/root/testdata/sf0.01"

_MADE = """
import numpy as np
from astraframe.llm.pii import boost
r = np.random.default_rng(3)
x = r.integers(0, 12, (400, 8)).astype(float)
y = ((x[:, 0] > 5) ^ (x[:, 3] > 7) | (r.random(400) < 0.1)).astype(float)
"""


def test_training_is_the_same_in_any_order_and_on_any_cpu():
    made: dict = {}
    exec(_MADE, made)
    x, y, want = made["x"], made["y"], pii.boost(made["x"], made["y"])
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(y))
        assert pii.boost(x[order], y[order]) == want
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"NPY_DISABLE_CPU_FEATURES": "AVX2 FMA3 AVX512F AVX512CD AVX512_SKX", "PYTHONPATH": root}
    plain = subprocess.run([sys.executable, "-W", "ignore", "-c", _MADE + "print(boost(x, y))"], env=env, capture_output=True, text=True, timeout=300, check=True)
    assert plain.stdout.strip() == repr(want)


def test_scores_of_the_jvm_are_those_of_training(spark):
    """Every candidate that calibration selects is selected."""
    from pyspark.sql import functions as F

    trees, cut = pii.model(spark)
    held_out = pii.training_sentences()[1::2]
    df = spark.createDataFrame(held_out, "text string, y int").select(F.explode(pii.candidates(F.col("text"))).alias("c")).select(pii.features(F.col("c")).alias("x"))
    rows = df.select("x", pii.compiled(trees, F.col("x")).alias("score")).collect()
    assert len(rows) > 1000 and all(r["score"] == sum(pii.leaf(t, r["x"]) for t in trees) for r in rows)
    assert set(cut) == set(range(len(pii.KINDS))) and all(c < pii.NEVER for c in cut.values())


def brute_resolved(spans):
    kept = [x for x in spans if x[3] == pii.NEVER]
    for x in sorted((x for x in spans if x[3] < pii.NEVER), key=lambda x: (-x[3], x[2], x[0], x[1])):
        if not any(a < x[1] and x[0] < b for a, b, *_ in kept):
            kept.append(x)
    return sorted((k, s, e) for s, e, k, score in kept if score < pii.NEVER)


def test_overlaps_go_to_the_higher_score(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    cases = [[], [(0, 5, 1, 3)]]
    for _ in range(150):
        width = r.choice((30, 300))
        own = {(s := r.randint(0, width), s + r.randint(1, 12), r.randint(0, 5), r.choice((pii.NEVER, *range(6)))) for _ in range(r.randint(1, 40))}
        cases.append(sorted(own))
    cases.append([(i, i + 3, 0, i % 7) for i in range(0, 900)])
    df = spark.createDataFrame(list(enumerate(cases)), "i int, spans array<struct<s: int, e: int, k: int, score: int>>")
    for row in df.select("i", pii.resolved(F.col("spans")).alias("got")).collect():
        assert sorted(map(tuple, row["got"])) == brute_resolved(cases[row["i"]])


def planted(r):
    """Things in formats that no training template has, and what stands before them."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    return r.choice((
        lambda: ("my mobile number is", f"({n(3)}){n(3)}.{n(4)}"), lambda: ("fax", f"{n(3)}/{n(3)}-{n(4)}"),
        lambda: ("please mail", f"Kim.{r.randint(1, 99)}(at)some-lab.ac.uk"), lambda: ("contact", f"h.o+x [at] news{n(2)} dot info"),
        lambda: ("iban", f"NO{n(2)} {n(4)} {n(4)} {n(3)}"), lambda: ("bank account", f"AT{n(2)} {n(4)} {n(4)} {n(4)} {n(4)}"),
        lambda: ("SSN:", f"{r.randint(100, 899)}-{n(2)}-{n(4)}"),
        lambda: ("login from ip", f"fd{hexes(2)}:{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}"),
        lambda: ("host", f"{r.randint(1, 255)}{{.}}{r.randint(0, 255)}{{.}}{r.randint(0, 255)}{{.}}{r.randint(0, 255)}"),
    ))()


def test_recall_in_real_documents(spark):
    """Spans planted between the words of the driver's documents, and the same documents without them."""
    r = random.Random(12)
    docs = [x for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if x["text"]][:400]
    texts, where = [], []
    for d in docs:
        words = d["text"].split(" ")[:400]
        at = r.randint(0, len(words))
        lead, thing = planted(r)
        before = " ".join([*words[:at], lead]) + " "
        texts.append(before + thing + " " + " ".join(words[at:]))
        where.append((len(before), len(before) + len(thing)))
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    caught = 0
    for row in found.collect():
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in row["spans"].split(",") if s)
        a, b = where[row["doc_id"]]
        caught += any(s < b and a < e and min(b, e) - max(a, s) >= 0.6 * (b - a) for s, e in spans)
        if row["n_added"]:
            added = sum(y[0] < x[1] for x, y in zip(spans, spans[1:]))
            base = row["n_email"] + row["n_ip"] + row["n_card"] + row["n_phone"]
            assert added <= max(0, base - 1)  # only base spans may overlap each other
    assert caught >= 0.9 * len(docs)
    clean = pii.find_pii(spark.createDataFrame([(i, " ".join(d["text"].split(" ")[:400])) for i, d in enumerate(docs)], "doc_id long, text string"))
    assert clean.where("n_added > 0").count() <= 0.02 * len(docs)
