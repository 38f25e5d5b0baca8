"""Secret scans with corpus-wide ownership frequency.

Candidates are what the three base patterns and some high-recall generators find in whole texts. A
candidate's value is reduced to a hash, and hashes are counted over the whole corpus by distinct
repositories and distinct owners: a value that many owners hold, or that is in many repositories
of each, is a copied example, one that a single owner holds in few looks live. Base spans always stay; a generator's span is added where its value
is owner-specific and looks random.

Only candidates' hashes are shuffled. Counts are of distinct values, owners and repositories, which
combine before each shuffle; verdicts go back to the occurrences of the most frequent values, of which
there are HOT at most, by broadcast, and to all others by a join. So an example that a third of all
documents copy is in no one's task.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, stash, text_slices

#: A value that more owners than this hold is a widely copied example.
MAX_OWNERS = 2
#: So is one in more repositories an owner than this.
MAX_REPOS = 8
#: The most frequent values are broadcast, so many at most: those with more occurrences than a HOT-th of all, and than COLD.
HOT, COLD = 1 << 16, 1 << 12
#: Bits a character from which a generator's value looks random.
MIN_ENTROPY = 3.0
KINDS = ("assign", "access", "hex", "github", "slack", "jwt", "key", "base64")

# The base patterns (ASCII letters in either case for the keyword of the first).
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

# Generators: public token formats, private key blocks, and long runs of mixed base64 characters.
GENERATORS = {
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "key": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    "base64": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[a-zA-Z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}"),
}
_HINTS = {"github": "gh", "slack": "xox", "jwt": "eyJ", "key": "-----BEGIN", "base64": ""}
_LONG = re.compile(r"[A-Za-z0-9+/_-]{24}")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the base patterns; values are what is secret about them."""
    out = [(m.start(), "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [(m.start(), "hex", m.end(), m[0]) for m in HEX.finditer(text)]


def more_spans(text: str, base: list[tuple[int, str, int, str]]) -> list[tuple[int, str, int, str]]:
    """What the generators propose that looks random and that neither a base span nor an earlier generator's covers."""
    out: list[tuple[int, str, int, str]] = []
    for kind, pattern in GENERATORS.items():
        if _HINTS[kind] not in text or kind == "base64" and not _LONG.search(text):
            continue
        known = sorted((s, e) for s, _, e, _ in (*base, *out))
        starts, reach = [s for s, _ in known], list(accumulate((e for _, e in known), max))
        for m in pattern.finditer(text):
            k = bisect_right(starts, m.start())
            if not (k and reach[k - 1] >= m.end()) and entropy(m[0]) >= MIN_ENTROPY:
                out.append((m.start(), kind, m.end(), m[0]))
    return out


def _text(spans: list[tuple[int, str, int, str]]) -> str:
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row a row: id, n_assign, n_access, n_hex, base_sha256, spans, live_spans, n_live, n_copied, counts.

    Spans are kind:start:end in code points, by start, then by kind as in KINDS. spans holds the base
    spans and those of the generators whose value at most max_owners owners hold; live_spans holds
    those of both whose value is that rare, n_copied counts the other ones. A value is also not rare in
    more than max_repos repositories an owner. counts are all spans, each with :owners:repositories. A null owner or
    repository is one of its own; repeated rows are of the same repository and don't make a value
    frequent. Null and empty texts have no spans; null ids stay null; an empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[owner_col].cast("string").alias("owner"), docs[repo_col].cast("string").alias("repo"), docs[text_col].alias("text"))

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                counts, digest, found = [], [], []
                for text in part.column("text").to_pylist():
                    base = base_spans(text)
                    n = Counter(s[1] for s in base)
                    counts.append((n["assign"], n["access"], n["hex"]))
                    digest.append(hashlib.sha256(_text(base).encode()).hexdigest())
                    both = [(s, False) for s in base] + [(s, True) for s in more_spans(text, base)]
                    both.sort(key=lambda x: (x[0][0], KINDS.index(x[0][1])))
                    found.append([{"start": s, "kind": kind, "end": e, "value": hashlib.sha256(v.encode()).digest()[:16], "added": new} for (s, kind, e, v), new in both])
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("value", pa.binary()), ("added", pa.bool_())]))
                cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("owner"), part.column("repo"), *cols, pa.array(digest, pa.string()), pa.array(found, kinds)], names=["id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    schema = "id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start: long, kind: string, end: long, value: binary, added: boolean>>"
    scanned = stash(source.mapInArrow(scan, schema).withColumn("row", F.monotonically_increasing_id()), "scanned")
    each = scanned.where(F.size("found") > 0).select("row", "owner", "repo", F.inline("found"))
    held = each.select("value", "owner", "repo").distinct()
    held_by = lambda c: held.select("value", c).distinct().groupBy("value").agg(F.count("*").alias(f"{c}s"))
    often = each.groupBy("value").agg(F.count("*").alias("n"))
    owned = stash(often.join(held_by("owner"), "value").join(held_by("repo"), "value"), "owned")
    total = owned.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(COLD, total // HOT)
    widely = F.broadcast(owned.where(hot))  # HOT values at most
    found = each.join(widely, "value").unionByName(each.join(widely.select("value"), "value", "left_anti").join(owned.where(~hot), "value"))
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos * F.col("owners"))
    span = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("nr"), F.concat_ws(":", "kind", "start", "end").alias("span"), (live | ~F.col("added")).alias("shown"), live.alias("live"), F.concat_ws(":", "kind", "start", "end", "owners", "repos").alias("counted"))
    judged = found.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list(span)).alias("judged"))
    out = scanned.join(judged, F.col("row") == F.col("of"), "left")
    of = lambda pick: F.filter(F.coalesce("judged", F.expr("array()").cast(judged.schema["judged"].dataType)), pick)
    said = lambda pick, name="span": F.array_join(F.transform(of(pick), lambda x: x[name]), ",")
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", said(lambda x: x["shown"]).alias("spans"), said(lambda x: x["live"]).alias("live_spans"), F.size(of(lambda x: x["live"])).cast("long").alias("n_live"), F.size(of(lambda x: ~x["live"])).cast("long").alias("n_copied"), said(lambda x: F.lit(True), "counted").alias("counts"))
