"""Fingerprints on synthetic recordings, and the search against brute force."""

import collections

import numpy as np
import pytest

pytest.importorskip("astraframe.llm")

from astraframe.llm import chroma  # noqa: E402


def tune(seed, seconds=1.0):
    """A melody as 8-bit samples."""
    r = np.random.default_rng(seed)
    t = np.arange(int(400)) / chroma.RATE
    notes = [np.sin(2 * np.pi * 220 * 2 ** (r.integers(0, 36) / 12) * t) for _ in range(int(seconds * chroma.RATE / 400))]
    return (127 + 100 * np.concatenate(notes)).astype(np.uint8)


def test_pitch_classes():
    t = np.arange(4000) / chroma.RATE
    for semitone in (12, 16, 19, 24):
        wave = (127 + 100 * np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t)).astype(np.uint8)
        assert (chroma.frames(wave, np.arange(0, 3000, 500)).argmax(1) == semitone % 12).all()
    assert not chroma.frames(np.full(1000, 7, np.uint8), np.array([0, 100])).any()


def test_pitch_classes_of_every_octave_that_is_folded():
    t = np.arange(4000) / chroma.RATE
    for semitone in range(37):
        f = 440 * 2 ** (semitone / 12)
        assert chroma.LOWEST < f < chroma.HIGHEST
        wave = (127 + 100 * np.sin(2 * np.pi * f * t)).astype(np.uint8)
        assert np.bincount(chroma.frames(wave, np.arange(0, 3000, 32)).argmax(1), minlength=12).argmax() == semitone % 12


def brute_codes(samples):
    """The filters as plain sums over frames."""
    n = (len(samples) - chroma.FRAME) // chroma.HOP + 1
    level = np.rint(chroma.frames(samples, np.arange(n) * chroma.HOP) * 1000).astype(int)
    smooth = [sum(w * level[i + j] for j, w in enumerate(chroma.SMOOTH)) for i in range(n - 4)]
    out = []
    for i in range(len(smooth) - chroma.SPAN + 1):
        code = 0
        for k, (kind, y, h, w) in enumerate(chroma.FILTERS):
            s = lambda a, b, p, q: sum(int(smooth[i + t][p:q].sum()) for t in range(a, b))  # noqa: E731, B023
            z, m = y + h, y + h // 2
            a, b = [
                (s(0, w // 2, y, z), s(w // 2, w, y, z)), (s(0, w, y, m), s(0, w, m, z)),
                (s(0, w // 2, y, m) + s(w // 2, w, m, z), s(w // 2, w, y, m) + s(0, w // 2, m, z)), (2 * s(w // 4, w - w // 4, y, z), 2 * (s(0, w // 4, y, z) + s(w - w // 4, w, y, z))),
            ][kind]
            ratio = (1 + a) / (1 + b)
            code |= (0b00, 0b01, 0b11, 0b10)[(ratio >= 0.8) + (ratio >= 1) + (ratio >= 1.25)] << 2 * k
        out.append(code)
    return out


def test_codes_against_plain_sums():
    wave = tune(1, 0.3)
    assert chroma.fingerprint(wave).tolist() == brute_codes(wave)
    assert len({*chroma.fingerprint(wave).tolist()}) > 20
    assert len(chroma.fingerprint(wave[: chroma.FRAME])) == len(chroma.fingerprint(b"")) == 0
    shifted = (wave.astype("<i2") - 127).tobytes()
    assert (np.bitwise_count(chroma.fingerprint(shifted, "s16") ^ chroma.fingerprint(wave)).mean()) < 1


def test_long_recordings_are_cut_safely(monkeypatch):
    wave = tune(2, 2.0)
    n = (len(wave) - chroma.FRAME) // chroma.HOP + 1
    whole = chroma.codes(chroma.frames(wave, np.arange(n) * chroma.HOP))
    assert chroma.fingerprint(wave).tolist() == whole.tolist() and len(whole) == n - chroma.REACH


def test_align(spark):
    a, b = tune(3), tune(4)
    lead = tune(5, 0.2)[: 40 * chroma.HOP]
    noisy = np.clip(a.astype(int) + np.random.default_rng(0).integers(-2, 3, len(a)), 0, 255).astype(np.uint8)
    table = [(0, a), (100, b), (1, np.concatenate([lead, a])), (2, noisy), (3, a), (3, a), (4, tune(6)), (5, b[50 * chroma.HOP :]), (6, np.full(3000, 9, np.uint8)), (7, b[:500]), (None, tune(7))]
    rows = [(i, w.tobytes(), 1, 2) for i, w in table] + [(8, None, 1, 2), (9, b"", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, media binary, id int, votes int")
    found = collections.defaultdict(list)
    for r in chroma.align(df).collect():
        found[r["doc_id"]].append(r)
    got = {i: v[0] for i, v in found.items()}
    assert len(found[3]) == 2 and got[3]["class_id"] == 0 and got[0]["class_id"] == 0
    assert (got[1]["match_id"], got[1]["match_offset"], got[1]["aligned"]) == (0, 40, True)
    assert (got[2]["match_id"], got[2]["match_offset"], got[2]["aligned"]) == (0, 0, True)
    assert (got[5]["match_id"], got[5]["match_offset"], got[5]["bit_errors"], got[5]["aligned"]) == (100, -50, 0, True)
    for i in (4, 6, 7, 8, 9, None):
        assert not got[i]["aligned"], i
    assert got[8]["n_codes"] == 0 and got[8]["class_id"] is None and got[9]["n_samples"] == 0
    assert chroma.align(df.where("false")).count() == 0
    # brute force: votes of all offsets, of every class against every query class
    c = {i: chroma.fingerprint(w) for i, w in table}
    starts = lambda x: {int(k): (int(x[k]), int(x[k + chroma.GAP])) for k in chroma._run_starts(x[: max(0, len(x) - chroma.GAP)])}
    for i, x in c.items():
        votes = collections.Counter()
        for q in (0, 100):
            if len(x) and c[q].tolist() != x.tolist():
                where = collections.defaultdict(list)
                for k, v in starts(c[q]).items():
                    where[v].append(k)
                for k, v in starts(x).items():
                    votes.update((q, k - at) for at in where[v])
        best = min(((-n, q, o) for (q, o), n in votes.items()), default=None)
        r = got[i]
        assert (None if r["votes"] is None else (-r["votes"], r["match_id"], r["match_offset"])) == best, i


def brute_pairs(recordings, queries):
    """(recording, query) with an offset of few bit errors, of all offsets where LONG codes or all of one overlap."""
    out = set()
    for i, x in enumerate(recordings):
        for j, q in enumerate(queries):
            for offset in range(1 - len(q), len(x)):
                a, b = max(0, offset), min(len(x), len(q) + offset)
                if b - a >= min(chroma.LONG, len(x), len(q)) and np.bitwise_count(x[a:b] ^ q[a - offset : b - offset]).sum() <= chroma.MAX_ERROR * 32 * (b - a):
                    out.add((i, j))
                    break
    return out


@pytest.mark.parametrize("noise", [2, 8, 20])
def test_recall_off_the_grid(noise):
    r = np.random.default_rng(noise)
    tunes = [tune(100 + i) for i in range(40)]
    queries = [chroma.fingerprint(w) for w in tunes]
    copies = []
    for i, w in enumerate(tunes):
        w = np.concatenate([tune(900 + i, 0.3)[: int(r.integers(1, 2000))], w[int(r.integers(0, 3000)) :]])
        copies.append(chroma.fingerprint(np.clip(w.astype(int) + r.integers(-noise, noise + 1, len(w)), 0, 255).astype(np.uint8)))
    s = chroma.search(copies, chroma.indexed(np.arange(40), queries))
    ok = chroma.passing(s)
    got = {*zip(s["own"][ok].tolist(), s["query"][ok].tolist())}
    want = brute_pairs(copies, queries)
    assert len(got & want) >= 0.9 * len(want) and {(i, i) for i in range(40)} & want <= got


def test_few_codes_match(spark):
    a = tune(3)
    rows = [(0, a.tobytes())] + [(n, a[640 : 640 + 864 + 32 * (n - 1)].tobytes()) for n in range(1, 9)]
    got = {r["doc_id"]: r for r in chroma.align(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert all((got[n]["n_codes"], got[n]["match_id"], got[n]["match_offset"], got[n]["bit_errors"], got[n]["aligned"]) == (n, 0, -20, 0, True) for n in range(1, 9))


def test_all_aligned_queries(spark):
    a, b = tune(3), tune(4)
    noisy = lambda w, seed: np.clip(w.astype(int) + np.random.default_rng(seed).integers(-3, 4, len(w)), 0, 255).astype(np.uint8)
    table = [(0, a), (100, noisy(a, 1)), (200, noisy(a, 2)), (300, b), (1, noisy(a, 3)), (2, np.concatenate([noisy(a, 4), noisy(b, 5)])), (3, tune(9))]
    df = spark.createDataFrame([(i, w.tobytes()) for i, w in table], "doc_id long, media binary")
    whole = {r["doc_id"]: r for r in chroma.align(df).collect()}
    of = {i: [m["match_id"] for m in r["matches"]] for i, r in whole.items()}
    assert of == {0: [100, 200], 100: [0, 200], 200: [0, 100], 300: [], 1: [0, 100, 200], 2: [0, 100, 200, 300], 3: []}
    assert all(r["match_id"] in of[i] for i, r in whole.items() if r["aligned"])
    assert {r["doc_id"]: r for r in chroma.align(df, block=100).collect()} == whole
    none = chroma.align(df, query=chroma.F.lit(False)).collect()
    assert len(none) == len(table) and not any(r["aligned"] or r["matches"] for r in none)


def test_best_is_among_those_that_pass(spark):
    """More votes of a passage that both share, but different otherwise, against a short query that is all there."""
    a, b, c = tune(21, 1.0), tune(22, 2.0), tune(23, 2.0)
    table = [(0, np.concatenate([a, b])), (100, a[800:5600]), (1, np.concatenate([a, c]))]
    r = {r["doc_id"]: r for r in chroma.align(spark.createDataFrame([(i, w.tobytes()) for i, w in table], "doc_id long, media binary")).collect()}[1]
    assert (r["match_id"], r["aligned"]) == (100, True)


def test_short_recordings(spark):
    a, b = tune(3), tune(4)
    table = [(0, a[:500]), (1, a[:500]), (2, b[:500]), (3, b[:7]), (4, b[:7]), (5, b[:8]), (6, a[32:500]), (7, a[:1])]
    df = spark.createDataFrame([(i, w.tobytes()) for i, w in table] + [(8, b""), (9, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in chroma.align(df).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: None, 9: None}
    assert [got[i]["n_codes"] for i in range(10)] == [8, 8, 8, 1, 1, 1, 7, 1, 0, 0]
    assert (got[6]["match_id"], got[6]["match_offset"], got[6]["aligned"]) == (0, -1, True)
