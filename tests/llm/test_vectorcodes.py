"""Vector codes against plain distances in unbounded whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from veilgrain.llm import vectorcodes


def brute(rows, entries=256, rounds=4, parts=4, scale=1024):
    """{(vec_id, values): (code, error)} and the digest, from the definition."""
    kept = []
    for i, v, _ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(v) for _, v in kept) // parts))
    cut = [[(v + [0] * parts * width)[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for c in cut:
                members.setdefault(near(c[p], book)[0], []).append(c[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m)] if (m := members.get(e)) else old for e, old in enumerate(book)]
    out = []
    for (i, v), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    digest = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(out, key=str), hashlib.sha256(digest.encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 2, 4, 8, 32])
def test_sequency(size):
    rows = vectorcodes.walsh(np.eye(size, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(size))


@pytest.mark.parametrize("width", [1, 3, 16, 20])
@pytest.mark.parametrize("largest", [2, 1000, 1 << 20, 1 << 45])
def test_nearest_is_exact_and_takes_the_lower_of_ties(width, largest):
    rng = np.random.default_rng(width)
    x, e = rng.integers(-largest, largest, (60, width)), rng.integers(-largest, largest, (20, width))
    e[7], x[0] = e[3], e[3]
    which, far = vectorcodes.nearest(x, e)
    plain = ((x.astype(object)[:, None] - e.astype(object)[None]) ** 2).sum(axis=2).tolist()
    assert which.tolist() == [row.index(min(row)) for row in plain]
    assert [int(d) for d in far] == [min(row) for row in plain]


@pytest.mark.parametrize("dim", [8, 10, 3])
def test_codes_like_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, dim)], int(i) % 3) for i in range(320)]
    rows += [(7, rows[7][1], 1), (7, [0.5] * dim, None), (None, [0.25] * dim, None), (900, [], 2), (901, [1.0], 2)]
    rows += [(902, None, 1), (903, [None] + [0.0] * (dim - 1), 1), (904, [math.nan] * dim, 1), (905, [math.inf] * dim, 0)]
    rows += [(1000 + i, [0.125] * dim, 5) for i in range(100)]
    df = spark.createDataFrame(
        [(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, code int, error int, v int"
    )
    got = vectorcodes.compressed(df).collect()
    want, digest = brute(rows)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}
    labels = {}
    for r in df.where("label = 5").collect():
        labels[r["vec_id"]] = True
    assert {r["label_error"] for r in got if r["vec_id"] in labels} == {
        sum(r["error"] for r in got if r["vec_id"] in labels)
    }


def test_few_and_none_and_huge(spark):
    kinds = "vec_id long, embedding array<float>, label string"
    assert vectorcodes.compressed(spark.createDataFrame([], kinds)).count() == 0
    assert vectorcodes.compressed(spark.createDataFrame([(1, None, "a")], kinds)).count() == 0
    rows = [(1, [], None), (2, [], "a")]
    assert [r["code"] for r in vectorcodes.compressed(spark.createDataFrame(rows, kinds)).collect()] == ["00000000"] * 2
    huge = [(i, [3e38 * (-1) ** i, 1.0, float(i), 0.5], "x") for i in range(4)]
    got = vectorcodes.compressed(spark.createDataFrame(huge, kinds)).collect()
    assert len(got) == 4 and all(r["error"] >= 0 for r in got)


def test_decode_gives_the_vector_back(spark):
    rows = [(i, [float(i), 1.0, -float(i), 0.5], 0) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    vectors = vectorcodes.prepared(df, "embedding", ["vec_id"], 1024)
    books = vectorcodes.fit(vectors)
    for r in vectorcodes.encode(vectors, books).collect():  # fewer vectors than entries: nothing is lost
        assert r["error"] == 0
        assert books.decode(r["code"]) == [1024 * r["vec_id"], 1024, -1024 * r["vec_id"], 512]
