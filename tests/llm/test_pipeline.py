"""The pipeline against a brute-force version of its stages, on the whole smallest table."""

import collections
import hashlib
import zlib

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from astraframe.llm.queries import tokenizer_path  # noqa: E402
from astraframe.llm.tokens import Encoder  # noqa: E402
from test_llm import SF, brute_near, words  # noqa: E402


def brute_lines(docs):
    keys = [[line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)}) for line in t.split("\n")] for _, t, _ in docs]
    held = collections.defaultdict(set)
    for (i, *_), own in zip(docs, keys):
        for k in own:
            if len(k) >= 20:
                held[k].add(i)
    lost = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return [(i, "\n".join(line for line, k in zip(t.split("\n"), own) if lost.get(k, i) == i), s) for (i, t, s), own in zip(docs, keys)]


def brute_mix(docs):
    size, total = {i: len(words(t)) for i, t, _ in docs}, sum(len(words(t)) for _, t, _ in docs)
    names = sorted({s for *_, s in docs})
    weight, source = {s: k % 3 + 1 for k, s in enumerate(names)}, collections.Counter()
    for i, _, s in docs:
        source[s] += size[i]
    target, open_ = {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * source[s]}
        for s in full or open_:
            target[s] = 3 * source[s] if full else weight[s] * level
        open_ -= full or open_
    copies, at = [], collections.Counter()
    for epoch in range(3):
        for h, i, s in sorted((hashlib.md5(str(i).encode()).hexdigest(), i, s) for i, _, s in docs):
            at[s] += size[i]
            copies.append((at[s] / target[s], s, h, i, epoch))
    left, taken = total, []
    for *_, i, _ in sorted(copies):
        n = min(size[i], left)
        left -= n
        if n:
            taken.append((i, n))
    return taken


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns
    kept = sorted((r["doc_id"], r["text"], r["source"]) for r in first.collect())
    deduped = brute_lines(kept)
    near = {d for d, _, _, k in brute_near([(i, t) for i, t, _ in deduped], 5) if k}
    remaining = [x for x in deduped if x[0] in near]
    text, want, e = {i: t for i, t, _ in remaining}, collections.Counter(), Encoder(tokenizer_path())
    for i, n in brute_mix(remaining):
        t = text[i]
        if n < len(words(t)):
            import re

            t = re.match(r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){%d}[^\x20\x09-\x0D]+" % (n - 1), t)[0]
        import numpy as np

        ids = np.array([*e.whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_near_dedup_keeps_one_row_of_a_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (2, a + " more"), (None, b), (None, a + " less"), (3, c), (3, b + " more"), (None, "only one here with six words")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, a), (3, c), (3, b + " more"), (None, "only one here with six words")], key=repr)


def test_stages_on_nulls_repeats_and_further_columns(spark):
    """Each stage on null ids, texts and sources, repeated rows, and columns named as the operators' own."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    line = "A line that stands in many of these documents."
    rows = [(1, a, "s", 1), (1, a, "s", 1), (None, a + " more", None, 2), (None, f"{line}\n{b}", "t", 3), (2, f"{line}\nc", "t", 4), (3, f"{line}\nd", None, 5), (4, None, "s", 6), (5, "", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").selectExpr("*", "'k' AS kept", "1 AS n", "2 AS v", "3 AS rest", "4 AS id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    lines = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, docs, SF).collect())
    assert lines == {(1, a): 2, (None, a + " more"): 1, (None, b): 1, (2, "c"): 1, (3, f"{line}\nd"): 1, (4, ""): 1, (5, ""): 1}
    near = collections.Counter((r["doc_id"], r["size"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert near == {(1, 1): 1, (None, 3): 1, (2, 4): 1, (3, 5): 1, (4, 6): 1, (5, 7): 1}
    mixed = corpus_pipeline.mixing(spark, docs, SF).collect()
    assert sum(len(words(r["text"])) for r in mixed) == sum(len(words(t)) for _, t, *_ in rows)
    packed = corpus_pipeline.packing(spark, docs, SF).collect()
    assert collections.Counter(r["doc_id"] for r in packed) == {1: 2, None: 2, 2: 1, 3: 1, 4: 1, 5: 1}


def test_stages_leave_no_copies_of_the_texts(spark):
    """What the first four stages leave in the shared folder is small beside the texts, since those of later stages come on top of it."""
    import pathlib
    import random

    from astraframe.llm.common import session_folder

    folder = pathlib.Path(session_folder(spark).removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    r = random.Random(7)
    rows = [(i, " ".join(f"{r.getrandbits(40):x}" for _ in range(2000)) + ".", "st"[i % 2]) for i in range(300)]
    path = f"{folder}-texts"
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    docs, texts = spark.read.parquet(path), sum(f.stat().st_size for f in pathlib.Path(path).rglob("*.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = held()
        assert stage(spark, docs, SF).count() > 0
        assert held() - before < 0.2 * texts, (name, held() - before, texts)


def test_rules_keep_what_judge_keeps(spark):
    """Ids that rows of several verdicts share."""
    from pyspark.sql import functions as F

    from astraframe.llm.quality import judge

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("doc_id") % 40))
    docs = docs.unionByName(docs.where("n_chars % 3 = 0")).withColumn("rest", F.col("n_chars") + 1)
    want = collections.Counter((r["doc_id"], r["text"], r["rest"]) for r in judge(docs, carry=("text", "rest")).where("kept").collect())
    got = collections.Counter((r["doc_id"], r["text"], r["rest"]) for r in corpus_pipeline.quality_rules(spark, docs, SF).collect())
    assert got == want and 0 < sum(want.values()) < docs.count()


def test_near_dedup_keeps_the_first_of_one_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(2, a, 0), (1, a + " more", 1), (1, a, 2), (1, a, 3), (None, b + " more", 4), (None, b, 5), (1, b + " other", 6), (1, "", 7), (1, None, 8), (1, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").coalesce(1)
    assert sorted(r["row"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 6, 7, 8, 9]


@pytest.mark.parametrize("equals, others", [(30, 1), (31, 4), (5, 12)])
def test_mix_that_ends_within_equal_rows(spark, equals, others):
    rows = [(None, "a", 7)] * equals + [(None, "b", 5)] * 7 + [(3, None, 11)] * 4 + [(i, "a", i % 5) for i in range(others)] + [(8, "c", 0)]
    total, source = sum(n for *_, n in rows), collections.Counter()
    for _, s, n in rows:
        source[s] += n
    names = sorted(source, key=lambda s: (s is None, s or ""))
    weight, target, open_ = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * source[s]}
        for s in full or open_:
            target[s] = 3 * source[s] if full else weight[s] * level
        open_ -= full or open_
    copies, at = [], collections.Counter()
    for epoch in range(3):
        for h, n, k in sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), n, k) for k, (i, _, n) in enumerate(rows)):
            s = rows[k][1]
            at[s] += n
            copies.append((at[s] / target[s] if target[s] else 0.0, names.index(s), h, n, k, epoch))
    want, left = collections.Counter(), total
    for *_, n, k, _ in sorted(copies):
        if n and left:
            want[rows[k][0], rows[k][1], min(n, left)] += 1
        left -= min(n, left)
    docs = spark.createDataFrame([(i, s, " ".join(f"w{k}" for k in range(n))) for i, s, n in rows], "doc_id long, source string, text string")
    assert collections.Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in corpus_pipeline.mixing(spark, docs, SF).collect()) == want
