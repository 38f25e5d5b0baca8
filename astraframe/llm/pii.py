"""Personal data by candidate gradient boosting, in DataFrame functions only.

The base patterns' spans always stay. High-recall generators propose further spans, which may
overlap; each candidate's format and context give features; boosted trees, compiled to CASE
expressions, score them; and a threshold a kind, calibrated on held-out candidates to a precision of
PRECISION, selects those to redact. Of selected candidates that overlap, those of higher score stay;
candidates that overlap a base span add nothing.

Gradients, leaves and scores are integers, whose sums are the same in any order and on any machine,
in training here and in the JVM.

The trees are trained here, on the driver, once a session, from TRAINING_ROWS labelled sentences that
``training_sentences`` makes by rule (personal data in its formats; dates, versions, order numbers
and the like as counter-examples). The corpus isn't sampled, so results don't depend on it.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, with possessive quantifiers and without starts inside a run, which match the same.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_IP_OK = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"

KINDS = ("email", "ip", "card", "phone", "id", "iban")
_DOT = r"(?:\x20?\.\x20?|\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?|\x20dot\x20)"
_GAP = r"[\x20./_\u00A0-]{0,2}+"
#: Generators: kind, pattern.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,4}+"),
    ("ip", rf"(?<![0-9A-Za-z.:])(?:[0-9]{{1,3}}{_DOT}){{3}}[0-9]{{1,3}}(?![0-9A-Za-z])"),
    ("ip", r"(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{1,4}:){1,7}:?(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("card", rf"(?<![0-9])[0-9]{{4}}{_GAP}(?:[0-9]{{6}}{_GAP}[0-9]{{5}}|[0-9]{{4}}{_GAP}[0-9]{{4}}{_GAP}[0-9]{{1,7}})(?![0-9])"),
    ("phone", r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
)
#: What any match of the email generator holds.
_AT = r"@|\(at\)|\[at\]|\x20at\x20"
#: What any match of the ip generators holds.
_NUMBERED = r"[0-9]{1,3}\x20?(?:[\[({]\x20?)?(?:\.|dot)|[0-9A-Fa-f]:"
#: Rows of training sentences; every other one is held out for calibration.
TRAINING_ROWS = 4000
TREES, DEPTH, RATE, PRECISION = 40, 2, 0.3, 0.97
#: Scores are in units of 2 ** -10, probabilities of 2 ** -20.
SCORE_UNIT, PROBABILITY_UNIT = 1 << 10, 1 << 20
CONTEXT = 24
#: A score that no candidate reaches.
NEVER = 1 << 30
_BLOCK = 256

_SPAN = "struct<s:int,e:int,m:string>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def find(text: Column, pattern: str, maybe: Column) -> Column:
    """Leftmost non-overlapping matches (s, e, m) of whole texts, in code points; maybe: false only where there is none.

    Starts are running sums of the gaps that split leaves and the matches between them; sums are
    taken in blocks, since appending to an array copies it.
    """
    m = F.when(maybe, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(_none("string"))
    pairs = F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("m"), F.length(b).alias("gap")))
    start = lambda pos: F.struct(pos.alias("pos"), _none(_SPAN).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        s = acc["pos"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.array(F.aggregate(part, start(acc["pos"]), one))
        return F.element_at(F.transform(inner, lambda x: F.struct(x["pos"].alias("pos"), F.concat(acc["out"], x["out"]).alias("out"))), 1)

    # zip_with and the split are evaluated where there is a match only
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(F.size(m) > 0, F.aggregate(blocks, start(F.lit(0)), block)["out"]).otherwise(_none(_SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base kinds' spans, those that fail their test dropped."""
    digit = F.regexp_like(text, F.lit("[0-9]"))

    def card(x: Column) -> Column:
        d = _digits(x["m"])
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)

    return {
        "email": find(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(find(text, IP, digit), lambda x: F.regexp_like(x["m"], F.lit(_IP_OK))),
        "card": F.filter(find(text, CARD, digit), card),
        "phone": F.filter(find(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(_digits(x["m"])).between(9, 15)),
    }


FEATURES = ("kind", "length", "digits", "letters", "upper", "spaces", "dots", "dashes", "brackets", "colons", "says_pii", "says_other", "date_like", "glued", "spread", "repeated", "luhn", "bytes")
_SAYS_PII = r"(?i)(?:phone|tel|call|mobile|cell|fax|mail|contact|write|reach|ssn|social|security|iban|account|bank|card|visa|paid|charge|pay|host|login|ip|address|from)[^A-Za-z]{0,3}(?:\w{0,8}[^A-Za-z]{0,3}){0,2}$"
_SAYS_OTHER = r"(?i)(?:version|order|invoice|ref|no|number|build|isbn|page|part|serial|item|ticket|model|meet|look|figure|table|time|section|chapter|total|score|mac)[^A-Za-z]{0,3}(?:\w{0,8}[^A-Za-z]{0,3})?$"


def _placed(k: int, text: Column) -> Callable[[Column], Column]:
    before = lambda x: F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
    return lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), before(x).alias("before"), F.substring(text, x["e"] + 1, F.lit(1)).alias("after"))


def _kept(k: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def candidates(text: Column) -> Column:
    """All generators' spans with kind numbers and contexts: array<struct<k, s, e, m, before, after>>."""
    some = {"email": F.regexp_like(text, F.lit(_AT)), "iban": F.regexp_like(text, F.lit("[A-Z]{2}[0-9]{2}")), "ip": F.regexp_like(text, F.lit(_NUMBERED)), "card": F.regexp_like(text, F.lit("[0-9]{4}"))}
    digit = F.regexp_like(text, F.lit("[0-9]{3}"))
    lists = []
    for kind, pattern in GENERATORS:
        k = KINDS.index(kind)
        lists.append(F.transform(find(text, pattern, some.get(kind, digit)), _placed(k, text)))
    return F.concat(*lists)


def features(c: Column) -> Column:
    """A candidate's numbers, in order of FEATURES."""
    m = c["m"]
    count = lambda cls: F.length(m) - F.length(F.regexp_replace(m, cls, ""))
    says = lambda p: F.regexp_like(c["before"], F.lit(p)).cast("int")
    digits = _digits(m)
    glued = F.regexp_like(c["before"], F.lit("[A-Za-z0-9_/.:=#-]$")) | F.regexp_like(c["after"], F.lit("[A-Za-z0-9_/:=-]"))
    date_like = F.regexp_like(m, F.lit(r"^(?:19|20)[0-9]{2}[ .-]?(?:0[1-9]|1[0-2])|^[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2}"))
    is_card = F.when((c["k"] == KINDS.index("card")) & F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    small = ~F.regexp_like(m, F.lit("[0-9]{4}|25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}"))  # no number above 255
    return F.array(*(x.cast("double") for x in (
        c["k"], F.length(m), F.length(digits), count("[A-Za-z]"), count("[A-Z]"), count(" "), count("[.]"), count("-"), count("[()\\[\\]]"), count(":"),
        says(_SAYS_PII), says(_SAYS_OTHER), date_like.cast("int"), glued.cast("int"), F.size(F.array_distinct(F.split(digits, ""))), F.regexp_like(digits, F.lit("([0-9])\\1{5}")).cast("int"),
        is_card.cast("int"), small.cast("int"),
    )))


def training_sentences(rows: int = TRAINING_ROWS, seed: int = 5) -> list[tuple[str, int]]:
    """Sentences with one thing each, and whether it is personal."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: r.choice(("anna", "j.smith", "li_wei", "maria77", "office", "k.brown", "info", "t-o-m"))
    host = lambda: r.choice(("mail", "example", "corp", "post", "uni-x", "web"))
    dom = lambda: r.choice(("com", "org", "net", "de", "edu"))
    cap = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    byte = lambda: str(r.randint(0, 255))

    def card() -> str:
        d = r.choice("3456") + n(r.choice((14, 14, 13)))
        own = sum(int(c) if i % 2 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
        return d + str(-own % 10)

    def spaced(d: str, gap: str) -> str:
        return gap.join((d[:4], d[4:10], d[10:]) if len(d) == 15 else (d[:4], d[4:8], d[8:12], d[12:]))

    yes = (
        lambda: (r.choice(("card ", "visa ", "paid with ", "charge ", "")), spaced(card(), r.choice((".", "/", "_", "  ", " - ", "\u00a0"))[:2])),
        lambda: (r.choice(("host ", "login from ", "ip ", "address ", "")), r.choice(("[.]", "(.)", " dot ", "[dot]", " . ")).join(byte() for _ in range(4))),
        lambda: (r.choice(("host ", "login from ", "ip ", "address ", "")), r.choice((":".join(hexes(4) for _ in range(8)), f"2001:db8::{hexes(4)}:{hexes(3)}", f"fe80::{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(2)}", f"{hexes(4)}:{hexes(4)}::{hexes(4)}"))),
        lambda: (r.choice(("phone ", "call ", "tel: ", "mobile ", "reach me at ", "contact: ", "", "phone number ", "cell no. ", "call this number: ")), f"({n(3)}) {n(3)}-{n(4)}"),
        lambda: (r.choice(("phone ", "call ", "tel: ", "fax: ", "mobile ", "phone number ", "fax no. ")), r.choice((f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"0{n(2)} {n(4)} {n(4)}", n(10)))),
        lambda: (r.choice(("ssn ", "social security ", "security number: ", "")), f"{r.randint(100, 899)}-{n(2)}-{n(4)}"),
        lambda: (r.choice(("mail ", "write to ", "contact ", "")), r.choice((f"{name()} at {host()} dot {dom()}", f"{name()}(at){host()}(dot){dom()}", f"{name()} [at] {host()} [dot] {dom()}"))),
        lambda: (r.choice(("iban ", "account ", "bank: ", "")), f"{r.choice(('DE', 'FR', 'GB', 'ES', 'NL'))}{n(2)} {n(4)} {n(4)} {n(4)} {n(4)}"),
        lambda: (r.choice(("iban ", "account ", "bank: ")), f"{r.choice(('DE', 'FR', 'GB'))}{n(18)}"),
    )
    no = (
        lambda: (r.choice(("serial ", "item ", "part ", "")), spaced(card()[:-1] + r.choice("0123456789"), r.choice((".", "/", "_", "  "))) if r.random() < 0.5 else f"{n(4)}.{n(4)}.{n(4)}.{n(4)}"),
        lambda: (r.choice(("at ", "time ", "from ", "until ", "")), r.choice((f"{r.randint(0, 23):02d}:{n(2)}:{n(2)}", f"{r.randint(0, 23)}:{r.randint(10, 59)}", f"{r.randint(1, 9)}:{r.randint(1, 9)}", ":".join(hexes(2) for _ in range(6))))),
        lambda: (r.choice(("section ", "version ", "chapter ", "see ")), r.choice((" . ", " dot ")).join((str(r.randint(300, 999)), str(r.randint(0, 20)), str(r.randint(0, 9)), str(r.randint(256, 999))))),
        lambda: (r.choice(("on ", "since ", "until ", "")), r.choice((f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1900, 2099)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}", f"{r.randint(1900, 2099)} {r.randint(1900, 2099)}"))),
        lambda: (r.choice(("order ", "invoice ", "ref ", "ticket ", "serial ", "item no ", "part ", "build ")), r.choice((n(8), n(9), n(10), f"{n(4)}-{n(4)}", f"{n(3)} {n(4)} {n(4)}", f"{n(3)}-{n(2)}-{n(4)}"))),
        lambda: (r.choice(("a total of ", "about ", "and then ", "of ", "")), r.choice((n(8), n(9), n(10), n(11), f"{n(3)} {n(3)} {n(3)}", f"{n(4)} {n(4)}"))),
        lambda: (r.choice(("id=", "v", "x", "/", "#", "sku-")), r.choice((n(9), n(10), f"{n(3)}.{n(3)}.{n(4)}"))),
        lambda: (r.choice(("we meet ", "look ", "they stop ")), f"{r.choice(('here', 'us', 'her'))} at {r.choice(('noon', 'the', 'a', 'one'))} dot {r.choice(('the', 'and', 'of'))}"),
        lambda: (r.choice(("look ", "find it ", "more ")), f"{r.choice(('here', 'us', 'more'))} at {host()}.{dom()}"),
        lambda: (r.choice(("model ", "serial ", "part ", "table ")), f"{cap(2)}{n(2)} {cap(4)} {cap(4)} {cap(3)}"),
        lambda: ("", f"{cap(2)}{n(2)}{cap(12)}"),
        lambda: ("isbn ", f"{n(3)}-{n(2)}-{n(4)}"),
    )
    lead, tail = ("the and that ", "we said so. ", "in the list, ", "Anhe er thion "), (" and so on.", ", they said", ".", " of it all")
    out = []
    for i in range(rows):
        before, thing = r.choice(yes if i // 2 % 2 else no)()
        out.append((r.choice(lead) + before + thing + r.choice(tail), i // 2 % 2))
    return out


def _sigmoid() -> np.ndarray:
    """Probabilities of scores from -8 to 8 in steps of 1 / 64, by exact decimal arithmetic."""
    one = Decimal(1)
    return np.array([int((PROBABILITY_UNIT * one / (one + (Decimal(-k) / 64).exp())).to_integral_value()) for k in range(-512, 513)], np.int64)


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> list:
    """Gradient boosting of the logistic loss; a tree is a leaf's integer or (feature, cut, if at most, else).

    Sums are of integers and so exact; equal gains go to the first feature and the least cut.
    """
    score, out, known = np.zeros(len(y), np.int64), [], _sigmoid()
    target = np.rint(y).astype(np.int64) * PROBABILITY_UNIT

    def part(g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> float:
        total, weight = int(g[rows].sum()), int(h[rows].sum())
        return total * total / (weight + PROBABILITY_UNIT)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        best = (1e-9, None)
        if left:
            whole = part(g, h, rows)
            for f in range(x.shape[1]):
                cuts = np.unique(x[rows, f])
                for cut in (cuts[:-1] + cuts[1:]) / 2:
                    low = x[rows, f] <= cut
                    a, b = rows[low], rows[~low]
                    gain = part(g, h, a) + part(g, h, b) - whole
                    if gain > best[0]:
                        best = (gain, (f, float(cut), a, b))
        if best[1] is None:
            return round(SCORE_UNIT * rate * int(g[rows].sum()) / (int(h[rows].sum()) + PROBABILITY_UNIT))
        f, cut, a, b = best[1]
        return (f, cut, grow(a, g, h, left - 1), grow(b, g, h, left - 1))

    for _ in range(trees):
        p = known[np.clip(score // (SCORE_UNIT // 64), -512, 512) + 512]
        tree = grow(np.arange(len(y)), target - p, p * (PROBABILITY_UNIT - p) // PROBABILITY_UNIT, depth)
        out.append(tree)
        score += np.array([leaf(tree, row) for row in x], np.int64)
    return out


def leaf(tree, row) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def calibrate(score: np.ndarray, y: np.ndarray, kind: np.ndarray, precision: float = PRECISION) -> dict[int, int]:
    """The least integer score of each kind from which held-out candidates have the precision; NEVER where none has."""
    out = {}
    for k in np.unique(kind).astype(int):
        own = kind == k
        order = np.argsort(-score[own], kind="stable")
        s, right = score[own][order], np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        last = np.append(s[1:] < s[:-1], True)  # all of a score together
        good = np.flatnonzero((right >= precision) & last)
        out[k] = int(s[good[-1]]) if len(good) else NEVER
    return out


def compiled(trees: list, x: Column) -> Column:
    """The trees' sum as CASE expressions over a features array."""

    def one(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(F.get(x, F.lit(tree[0])) <= tree[1], one(tree[2])).otherwise(one(tree[3]))

    total = one(trees[0])
    for t in trees[1:]:
        total = total + one(t)
    return total


_trained: dict[int, tuple[list, dict[int, int]]] = {}


def labelled(spark: SparkSession, sentences: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in labelled sentences; a bounded number of rows."""
    quoted = ",".join("({}, {})".format("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'", y) for s, y in sentences)
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(text, y)").select("y", F.explode(candidates(F.col("text"))).alias("c")).select("y", features(F.col("c")).alias("x")).collect()
    return np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)


def model(spark: SparkSession, rows: int = TRAINING_ROWS) -> tuple[list, dict[int, int]]:
    """Trees and thresholds a kind, trained on one half of the sentences and calibrated on the other."""
    if rows not in _trained:
        sentences = training_sentences(rows)
        x, y = labelled(spark, sentences[::2])
        trees = boost(x, y)
        x, y = labelled(spark, sentences[1::2])
        _trained[rows] = trees, calibrate(np.array([sum(leaf(t, r) for t in trees) for r in x], np.int64), y, x[:, 0])
    return _trained[rows]


def resolved(spans: Column) -> Column:
    """Of spans (s, e, k, score) those below NEVER that stay, as (k, s, e): by score, then kind, then start, none overlaps one that stays.

    Spans in order are taken by runs that overlap; a run is resolved by itself, so the work is that
    of the runs. Runs are appended in blocks, since appending to an array copies it.
    """
    kind = "array<struct<s:int,e:int,k:int,score:int>>"
    none = F.array().cast(kind)
    in_order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"), x["k"].cast("int").alias("k"), x["score"].cast("int").alias("score"))))

    def greedy(run: Column) -> Column:
        ranked = F.array_sort(F.transform(run, lambda x: F.struct((-x["score"]).alias("rank"), x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
        take = lambda acc, x: F.when((x["rank"] == -NEVER) | ~F.exists(acc, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), (-x["rank"]).alias("score"))))).otherwise(acc)
        return F.when(F.size(run) > 1, F.aggregate(ranked, none, take)).otherwise(run)

    def state(end: Column, run: Column, out: Column) -> Column:
        return F.struct(end.cast("int").alias("end"), run.alias("run"), out.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        apart = x["s"] >= acc["end"]
        return state(F.greatest(acc["end"], x["e"]), F.when(apart, F.array(x)).otherwise(F.concat(acc["run"], F.array(x))), F.when(apart, F.concat(acc["out"], greedy(acc["run"]))).otherwise(acc["out"]))

    def block(acc: Column, part: Column) -> Column:
        inner = F.array(F.aggregate(part, state(acc["end"], acc["run"], none), one))
        return F.element_at(F.transform(inner, lambda x: state(x["end"], x["run"], F.concat(acc["out"], x["out"]))), 1)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(in_order) - 1) / _BLOCK).cast("int")), lambda b: F.slice(in_order, b * _BLOCK + 1, F.lit(_BLOCK)))
    stay = F.aggregate(blocks, state(F.lit(0), none, none), block, lambda acc: F.concat(acc["out"], greedy(acc["run"])))
    return F.transform(F.filter(stay, lambda x: x["score"] < NEVER), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row a row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; with redact also the text.

    Spans are kind:start:end in code points, by kind as in KINDS, then by start; spans holds the base
    spans and the candidates that the boosted trees select, which overlap neither each other nor those. redact replaces each maximal run of
    overlapping spans by [kind] of the first of them. Null and empty texts have no spans; repeated
    rows are alike; null ids stay null; an empty table gives no rows. Other columns are not read.
    """
    trees, cut = model(docs.sparkSession)
    text = F.col("text")
    df = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    base = base_spans(text)
    df = df.select("id", "text", *(s.alias(k) for k, s in base.items()), F.when(F.regexp_like(text, F.lit(rf"[0-9]|{_AT}|[0-9A-Fa-f]:")), candidates(text)).otherwise(F.filter(candidates(F.lit("")), lambda c: F.lit(False))).alias("proposed"))
    of_base = F.concat(*(F.transform(F.col(k), _kept(KINDS.index(k))) for k in base))
    limit = F.create_map(*(F.lit(v) for k in range(len(KINDS)) for v in (k, cut.get(k, NEVER))))
    scored = F.transform(F.col("proposed"), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), F.element_at(F.transform(F.array(features(c)), lambda x: compiled(trees, x)), 1).alias("score")))
    selected = F.filter(scored, lambda c: c["score"] >= F.element_at(limit, c["k"]))
    df = df.withColumn("base", of_base).withColumn("selected", F.when(F.size("proposed") > 0, selected).otherwise(F.filter(scored, lambda c: F.lit(False))))
    fixed = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["k"].alias("k"), F.lit(NEVER).alias("score")))
    df = df.withColumn("added", F.when(F.size("selected") > 0, resolved(F.concat(fixed, "selected"))).otherwise(F.filter("base", lambda b: F.lit(False))))
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    every = F.array_sort(F.concat("base", "added"))
    out = [F.col("id").alias(id_col), *(F.size(k).cast("long").alias(f"n_{k}") for k in base), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(every).alias("spans"), F.size("added").cast("long").alias("n_added")]
    if redact:
        by_start = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))

        def put(acc: Column, x: Column) -> Column:
            fresh = x["s"] >= acc["pos"]
            piece = F.concat(F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"]), F.lit("["), F.get(names, x["k"]), F.lit("]"))
            return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        out.append(F.aggregate(by_start, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), put, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text)))).alias(text_col))
    return df.select(*out)
