"""Quality rules: counts against regular expressions, estimates against a plain repetition, planted outliers."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from veilgrain.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    "", "a", " a\n\n b ", " \n ", "x\x1cy z q r", "é\U0001f600 naïve", "a b c d e a b c d e f", "a a a a a a",
    "l\nl\n l\nl", "a b c d e", "\x0b\x0c\x85q", "A|B *#\n",
]


def brute(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    marks = sum(1 for c in text or "" if c < "\x80" and WORD.match(c) and not re.match("[A-Za-z0-9]", c))
    capitals = len(re.findall("[A-Z]", text or ""))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), capitals, marks


def texts():
    rng = random.Random(1)
    out = ODD + ["".join(rng.choice("ab \n\té|A.") for _ in range(rng.randrange(60))) for _ in range(300)]
    return out + [" ".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(80)]


def test_counts_like_regular_expressions():
    every = texts()
    for part in (every, every[3:50], every[:1], ["", ""], []):
        got = [tuple(int(x) for x in r) for r in zip(*outliers.counts_of(pa.array(part, pa.string())))]
        assert got == [brute(t) for t in part]
    inside = outliers.counts_of(pa.array(every, pa.string()).slice(5, 80))
    assert [tuple(int(x) for x in r) for r in zip(*inside)] == [brute(t) for t in every[5:85]]


@pytest.mark.parametrize("kinds_of_hash", [None, 40, 1])
def test_windows_that_share_a_hash(monkeypatch, kinds_of_hash):
    rng = np.random.default_rng(1)
    codes, doc = rng.integers(0, 3, 4000), np.sort(rng.integers(0, 30, 4000))
    if kinds_of_hash:
        real = outliers.window_hashes
        monkeypatch.setattr(outliers, "window_hashes", lambda *a: real(*a) % np.uint64(kinds_of_hash))
    want, seen = np.zeros(4000, bool), collections.defaultdict(list)
    for i in range(3996):
        if doc[i] == doc[i + 4]:
            seen[(doc[i], *codes[i : i + 5])].append(i)
    for places in seen.values():
        for i in places if len(places) > 1 else ():
            want[i : i + 5] = True
    assert outliers.repeated(codes, doc, 5).tolist() == want.tolist()


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, kept int, grp string, n int"
    )


def sentences(rng, n, words):
    return " ".join(rng.choice(words) + ("." if i % 9 == 8 else "") for i in range(n))


def corpus():
    """Two languages with words of other lengths, planted junk, and odd rows."""
    rng = random.Random(5)
    short = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    long = ["".join(rng.choice("vwxyz") for _ in range(rng.randrange(5, 16))) for _ in range(400)]
    rows = [(i, sentences(rng, rng.randrange(30, 200), short), "aa", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, sentences(rng, rng.randrange(30, 200), long), "bb", "s0") for i in range(200)]
    junk = [(5000 + i, sentences(rng, 60, [w + "%%%" for w in short]), "aa", "s0") for i in range(25)]
    junk += [(6000 + i, sentences(rng, 60, [w.upper() + "!!" for w in long]), "bb", "s0") for i in range(25)]
    junk += [(7000 + i, sentences(rng, 60, long), "aa", "s1") for i in range(10)]
    junk += [(8000 + i, sentences(rng, 60, short), "bb", "s0") for i in range(10)]
    odd = [(9000, None, None, None), (9001, "", "aa", "s0"), (9002, "same " * 50, "aa", "s0"), (None, rows[0][1], None, "s9")]
    odd += [(9003, rows[1][1], "aa", "s1"), (9003, rows[1][1], "aa", "s1"), (9004, " ".join(f"w{i}" for i in range(90000)), "cc", "s0")]
    return rows, junk, odd


def repeat_estimate(vectors):
    """Centre and inverse of one group by the steps of the docstring, in floating point."""
    x = np.array(vectors, float)
    centre = np.median(x, axis=0)
    floors = np.diag((np.array(list(outliers.FLOORS.values())) * outliers.UNIT) ** 2)
    inverse = np.linalg.inv(np.diag((1.4826 * np.median(np.abs(x - centre), axis=0)) ** 2) + floors)
    factor = outliers.consistency(outliers.COVER, outliers.DIM)
    for _ in range(outliers.STEPS):
        d = np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
        level = np.clip(np.floor(16 * np.log(np.maximum(d, 0) + 1e-9)), outliers.LOW_BIN, outliers.HIGH_BIN)
        edge = np.sort(level)[int(np.ceil(outliers.COVER * len(x))) - 1]
        inside = x[level <= edge]
        centre, old = inside.mean(axis=0), centre
        inverse = np.linalg.inv(np.cov(inside.T, bias=True) * factor + floors)
        if np.array_equal(centre, old):
            break
    return np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)


def test_outliers_are_found_and_the_rest_kept(spark):
    rows, junk, odd = corpus()
    got = outliers.judged(frame(spark, rows + junk + odd)).collect()
    assert len(got) == len(rows + junk + odd)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, *_ in rows + junk + odd:
        r, b = by_id[i], brute(text)
        assert tuple(r[c] for c in outliers.COUNTS[:5]) == b[:5]
        assert r["base_failed"] == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert (r["distance"] is None) == r["base_failed"]
    assert not any(by_id[i]["kept"] for i, *_ in junk)
    clean = [i for i, *_ in rows if not by_id[i]["base_failed"]]
    assert len(clean) > 480 and all(by_id[i]["kept"] for i in clean)


def test_distances_like_a_plain_repetition(spark):
    rows, junk, _ = corpus()
    docs = frame(spark, [r for r in rows + junk if r[2] == "bb"])
    got = {r["doc_id"]: r["distance"] for r in outliers.judged(docs).collect() if not r["base_failed"]}
    ids = sorted(got)
    of = {i: brute(t) for i, t, g, _ in rows + junk if g == "bb"}
    c = np.array([of[i] for i in ids], float)
    w, chars, s, d, r, cap, m = c.T
    share = lambda a: 2 * np.arcsin(np.sqrt(np.minimum(1, a)))
    x = np.stack([np.log(chars / w), 2 * np.sqrt(s / w), 2 * np.sqrt(d / w), share(r / w), share(cap / chars), share(m / chars)], 1)
    assert np.allclose([got[i] for i in ids], repeat_estimate(np.floor(x * outliers.UNIT)), rtol=1e-6)


def test_reruns_agree_and_nothing_is_nothing(spark):
    rows, junk, odd = corpus()
    docs = frame(spark, rows + junk + odd)
    first = sorted(map(tuple, outliers.judged(docs).collect()), key=str)
    again = sorted(map(tuple, outliers.judged(docs.repartition(7)).collect()), key=str)
    assert first == again
    assert outliers.judged(docs.limit(0)).count() == 0
    kept = outliers.keep_typical(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[7] for r in first)


@pytest.mark.parametrize("dim,tail,limit", [(6, 0.25, 7.8408), (6, 1e-6, 38.258), (2, 0.05, 5.9915)])
def test_chi_square_limit(dim, tail, limit):
    assert abs(outliers.chi_square_limit(tail, dim) / limit - 1) < 0.05
