"""Importance resampling against brute force, CRCs of joined strings, odd texts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrain.llm import crc, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, most):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def buckets_of(text, most, buckets):
    return [zlib.crc32(r.encode()) % buckets for r in runs(text, most)]


def brute(docs, goals, percent, least_words, buckets):
    """(n_features, weight, score, rank) by row; ranks of equal scores and ids are left to the caller."""
    found = [buckets_of(t, 2, buckets) for _, t in docs]
    source = collections.Counter(b for f in found for b in f)
    target = collections.Counter(b for t in goals for b in buckets_of(t, 2, buckets))
    top, bottom = sum(source.values()) + buckets, sum(target.values()) + buckets
    gain = [math.floor(1000 * math.log((target[b] + 1) * top / ((source[b] + 1) * bottom))) for b in range(buckets)]
    rows = []
    for (i, t), f in zip(docs, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = [k for k, (_, t) in enumerate(docs) if len(words(t)) >= least_words]
    able.sort(key=lambda k: (-rows[k][2], docs[k][0] is None, docs[k][0] or 0))
    rank = {k: n for n, k in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r, rank.get(k)) for k, r in enumerate(rows)]


def test_crc_of_joined_strings():
    rng = np.random.default_rng(1)
    left = [rng.bytes(int(n)) for n in rng.integers(0, 40, 200)]
    right = [rng.bytes(int(n)) for n in [*rng.integers(0, 40, 196), 0, 1, 70_000, 1 << 20]]
    of = lambda parts: np.array([zlib.crc32(p) for p in parts], np.uint32)
    got = crc.joined(of(left), of(right), np.array([len(r) for r in right]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]
    assert crc.with_byte(of(left), 32).tolist() == [zlib.crc32(a + b" ") for a in left]


ODD = [
    (1, None),
    (2, ""),
    (3, " .,\t\n"),
    (4, "One"),
    (4, "One"),
    (5, "naïve \U0001f600 ÄÖ-ü x\x7fy 12a"),
    (6, "a" * 5000 + " b " + "c" * 600 + "d"),
    (7, "word " * 3000),
    (None, "no id at all but twenty words " * 4),
    (None, "no id at all but twenty words " * 4),
    (9, "x" * 513 + "." + "y" * 512),
]


@pytest.mark.parametrize("most_words,buckets", [(1, 7), (2, 10_000), (3, 70_000)])
def test_buckets_of_odd_texts(monkeypatch, most_words, buckets):
    # small bounds: automata start anew, texts are cut
    monkeypatch.setattr(resampling, "PORTION", 700)
    monkeypatch.setattr(resampling, "MOST_WORDS", 5)
    texts = [None if t is None else t.encode() for _, t in ODD]
    crcs, lengths, counts = resampling.words_of(texts)
    flat, sizes = resampling.bucket_numbers(crcs, lengths, counts, most_words, buckets)
    ends = np.cumsum(sizes)
    for (_, t), n, size, end in zip(ODD, counts, sizes, ends):
        assert n == len(words(t))
        assert sorted(flat[end - size : end].tolist()) == sorted(buckets_of(t, most_words, buckets))


def test_draw_like_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(int(i), " ".join(rng.choice(vocabulary, int(n)))) for i, n in enumerate(rng.integers(0, 80, 150))] + ODD
    goals = [" ".join(vocabulary[:40]), None, "w1 w2 w3", ""]
    frame = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, rank int, row string")
    target = spark.createDataFrame([(g,) for g in goals], "text string")
    got = resampling.resampled(frame, target, percent=30, buckets=500).collect()
    want = brute(docs, goals, 30, 20, 500)
    keyed = lambda rows: sorted(rows, key=str)
    assert keyed((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == keyed(
        (i, *w[:3]) for (i, _), w in zip(docs, want)
    )
    ids = [i for i, _ in docs]
    ranks = {r["rank"]: r["doc_id"] for r in got if r["rank"] is not None}
    assert ranks == {w[3]: i for i, w in zip(ids, want) if w[3] is not None}
    drawn = resampling.resample(frame, target, percent=30, buckets=500)
    assert drawn.columns == frame.columns and drawn.count() == len(ranks)


def test_no_documents_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(i, f"a b c {i} " * 6) for i in range(8)], "doc_id long, text string")
    assert resampling.resampled(none, some).count() == 0
    got = resampling.resampled(some, none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


def test_target_texts_are_preferred(spark):
    docs = [(i, (f"good text of the wanted kind {i} " if i % 10 == 0 else f"other words about anything {i} ") * 8) for i in range(400)]
    target = spark.createDataFrame([("good text of the wanted kind " * 5,)], "text string")
    got = resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), target, percent=10)
    drawn = got.where("rank IS NOT NULL").agg(F.avg((F.col("doc_id") % 10 == 0).cast("int"))).first()[0]
    assert drawn > 0.4  # a tenth of the documents, in random order a tenth of the draw
