"""Quality rules under weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation estimates how often
each rule votes what on good and on bad documents, from the votes alone; a document's posterior
probability of being good, and not whether it passes every rule, decides whether it is kept. The
estimates use all documents, but documents with the same votes are alike, so the iterations run over
the counts of vote patterns, of which there are at most 3 ** len(RULES).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blooms
from .common import lean, mix, raw, rolling, small_batches, stash, text_slices, words_of

#: (feature, good from, good to, bad below, bad above): good inside the first range, bad outside the second, else abstains.
RULES = (
    ("mean_word", 3.0, 9.0, 2.0, 14.0),
    ("symbols_a_word", 0.0, 0.02, 0.0, 0.1),
    ("duplicate_lines", 0.0, 0.1, 0.0, 0.3),
    ("repeated_words", 0.0, 0.2, 0.0, 0.4),
    ("upper_letters", 0.0, 0.15, 0.0, 0.35),
    ("marks_a_word", 0.0, 0.05, 0.0, 0.3),
    ("stop_words", 0.08, 1.0, 0.02, 1.0),
    ("sentence_ends", 0.01, 0.5, 0.002, 0.8),
)

# Frequent words of English, Spanish, French and German.
STOP_WORDS = (
    "the of and to in is that it was for on are as with his they at be this from or by "
    "de la que el en y los del las un por con no una su para es al lo como "
    "et les des le du est dans qui une pour pas au sur par plus ne se ce sont avec "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es"
).split()

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
_MARKS = np.zeros(256, np.int64)
_MARKS[np.frombuffer(b"!?", np.uint8)] = 1
_UPPER, _LETTER = np.zeros(256, np.int64), np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_ENDS = np.zeros(256, bool)
_ENDS[np.frombuffer(b".?", np.uint8)] = True
_WHITE = b" \t\n\r\x0b\x0c"
_EXACT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _stop_hashes() -> np.ndarray:
    data = " ".join(dict.fromkeys(STOP_WORDS)).encode()
    _, _, _, h = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=True)
    return np.sort(h)


def measures(text: pa.Array) -> dict[str, np.ndarray]:
    """Exact counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the rules' features."""
    data, offsets = raw(text)
    n_docs = len(text)
    doc, starts, ends, h = words_of(data, offsets)
    lowered = words_of(data, offsets, lower=True)[3]
    n = np.bincount(doc, minlength=n_docs)

    def per_doc(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    follows = ((np.arange(256) & 0xC0) == 0x80).astype(np.int64)
    in_words = np.bincount(doc, weights=ends - starts, minlength=n_docs).astype(np.int64) - per_doc(follows)
    repeat = np.zeros(n_docs, np.int64)
    if len(h) >= 3:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        _, back, count = np.unique(rolling(h, 3, 0x2545F4914F6CDD1D)[at] ^ mix(doc[at].astype(np.uint64), 3), return_inverse=True, return_counts=True)
        cover = np.zeros(len(h), bool)
        for k in range(3):
            cover[at[count[back] > 1] + k] = True
        repeat = np.bincount(doc[cover], minlength=n_docs)
    dup, lines = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    for i, t in enumerate(text.cast(pa.binary()).to_pylist()):
        full = [x for x in t.split(b"\n") if x.strip(_WHITE)]
        lines[i], dup[i] = len(full), len(full) - len(set(full))
    some = np.maximum(n, 1)
    out = {"n_words": n, "word_chars": in_words, "n_symbols": per_doc(_SYMBOLS), "n_dup_lines": dup, "n_repeat_words": repeat}
    stop = np.bincount(doc[np.isin(lowered, _stop_hashes())], minlength=n_docs)
    stopped = np.bincount(doc[_ENDS[data[ends - 1]]] if len(ends) else doc, minlength=n_docs)
    letters = np.maximum(1, per_doc(_LETTER))
    out |= {"mean_word": in_words / some, "symbols_a_word": out["n_symbols"] / some, "duplicate_lines": dup / np.maximum(lines, 1), "repeated_words": repeat / some}
    return out | {"upper_letters": per_doc(_UPPER) / letters, "marks_a_word": per_doc(_MARKS) / some, "stop_words": stop / some, "sentence_ends": stopped / some}


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """A digit a rule, in base 3: 0 bad, 1 abstains, 2 good."""
    code = np.zeros(len(m["n_words"]), np.int64)
    for name, low, high, below, above in RULES:
        x = m[name]
        vote = np.where((x < below) | (x > above), 0, np.where((x >= low) & (x <= high), 2, 1))
        code = code * 3 + np.where(m["n_words"] > 0, vote, 1)
    return code


def fit(patterns: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Expectation-maximisation over pattern counts; the posterior probability of good of each pattern.

    The start, good documents get good votes twice as often as bad ones and the other way round, names the classes.
    A rule's rates are smoothed by one vote of each kind, and no rule is taken to vote against its name.
    """
    codes = np.array(sorted(patterns), np.int64)
    count = np.array([patterns[c] for c in codes.tolist()], float)
    digit = np.stack([codes // 3 ** (len(RULES) - 1 - r) % 3 for r in range(len(RULES))], 1) if len(codes) else np.empty((0, len(RULES)), int)
    rate = np.tile(np.array([[0.4, 0.4, 0.2], [0.2, 0.4, 0.4]])[:, None, :], (1, len(RULES), 1))
    prior, good = 0.8, np.empty(0)
    for _ in range(rounds):
        score = np.log([1 - prior, prior])[:, None] + np.log(rate)[:, np.arange(len(RULES))[None, :], digit].sum(2)
        now = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
        if len(good) and np.abs(now - good).max() < 1e-9:
            break
        good = now
        for k, weight in enumerate((count * (1 - good), count * good)):
            seen = np.stack([np.bincount(digit[:, r], weights=weight, minlength=3) for r in range(len(RULES))]) + 1.0
            rate[k] = seen / seen.sum(1, keepdims=True)
        against = (rate[1, :, 0] > rate[0, :, 0]) | (rate[1, :, 2] < rate[0, :, 2])  # a rule that tells nothing then
        rate[:, against] = rate[:, against].mean(0, keepdims=True)
        prior = min(0.99, max(0.5, float((count * good).sum() / max(1.0, count.sum()))))
    return dict(zip(codes.tolist(), good.tolist()))


def _failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _measured(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> tuple[DataFrame, dict[int, float]]:
    """(id, the exact counts, base_failed, votes, rest) of each row, and the posterior of each vote pattern."""
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.struct(*(docs[c] for c in carry)).alias("rest") if carry else F.lit(0).alias("rest"))

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                m = measures(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[c].astype(np.int64)) for c in _EXACT), pa.array(_failed(m)), pa.array(votes(m)), part.column(2)], names=["id", *_EXACT, "base_failed", "votes", "rest"])

    schema = f"id long, {', '.join(f'{c} long' for c in _EXACT)}, base_failed boolean, votes long, rest {source.schema['rest'].dataType.simpleString()}"
    measured = stash(source.mapInArrow(measure, schema), "measured")
    patterns = {r[0]: r[1] for r in measured.where("not base_failed").groupBy("votes").agg(F.count("*")).collect()}  # 3 ** len(RULES) rows at most
    return measured, fit(patterns)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept, and carry.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. quality is the
    posterior probability; kept is false if base_failed, else quality >= threshold. Null and empty
    texts have no words and fail; documents that fail take no part in the estimates. Repeated rows
    count each and get the same verdict; null ids stay null; an empty table gives no rows. Carried
    columns named as a result column give way to it.
    """
    carry = tuple(c for c in carry if c not in {id_col, *_EXACT, "base_failed", "quality", "kept"})
    measured, posterior = _measured(docs, id_col, text_col, carry)
    table = docs.sparkSession.createDataFrame(sorted(posterior.items()), "pattern long, quality double")
    out = measured.join(F.broadcast(table), F.col("votes") == F.col("pattern"), "left")
    kept = ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= threshold)
    return out.select(F.col("id").alias(id_col), *_EXACT, "base_failed", "quality", kept.alias("kept"), *(F.col("rest")[c].alias(c) for c in carry))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge keeps, unchanged.

    No text is written or shuffled: rows whose id a Bloom filter of the rejected rows' ids lets pass
    are measured again, the others stay. docs is read twice and must give the same rows each time.
    """
    spark = docs.sparkSession
    measured, posterior = _measured(docs, id_col, text_col, ())
    lost = measured.where(F.col("base_failed") | F.col("votes").isin([v for v, q in posterior.items() if q < threshold])).select(F.xxhash64("id").alias("mark"))
    rejected = spark.sparkContext.broadcast(blooms.build(lost, lost.count()))
    others = [c for c in docs.columns if c != text_col]
    source = docs.select(F.xxhash64(docs[id_col].cast("long")).alias("mark"), docs[text_col].alias("text"), F.struct(*(docs[c] for c in others)).alias("rest"))

    @lean
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                keep = ~blooms.has(rejected.value, part.column("mark").to_numpy().view(np.uint64))
                again = np.flatnonzero(~keep)
                if len(again):
                    m = measures(part.column("text").take(pa.array(again)))
                    keep[again] = ~_failed(m) & np.array([posterior.get(v, 0.0) >= threshold for v in votes(m).tolist()])
                yield part.select(["text", "rest"]).filter(pa.array(keep))

    out = source.mapInArrow(pick, source.select("text", "rest").schema)
    return out.select(*(F.col("text" if c == text_col else f"rest.`{c}`").alias(c) for c in docs.columns))
