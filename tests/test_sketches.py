"""Summaries of fixed size on a skewed stream: bounds, merging in any order, samples."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veilgrain.operators import sketches

ROWS = 60_000


@pytest.fixture(scope="module")
def skewed(spark):
    """One item holds a third of the rows, the rest is heavy-tailed; one group of two holds most of them."""
    rng = random.Random(4)
    rows = []
    for i in range(ROWS):
        item = "hot" if rng.random() < 1 / 3 else f"i{int(rng.paretovariate(0.6)) % 20000}"
        rows.append((i, "big" if i % 10 else "small", i % 7, item))
    return spark.createDataFrame(rows, "id long, grp string, day int, item string").repartition(8).cache()


@pytest.fixture(scope="module")
def exact(skewed):
    return {(r["grp"], r["item"]): r["n"] for r in skewed.groupBy("grp", "item").agg(F.count("*").alias("n")).collect()}


def test_count_min_bounds_and_merging(skewed, exact):
    cm = sketches.CountMin(128, 4)
    whole = cm.summary(skewed, ["grp"], F.col("item"))
    assert whole.count() <= 2 * 128 * 4
    merged = cm.merged(cm.summary(skewed, ["grp", "day"], F.col("item")), ["grp"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    items = skewed.select("grp", "item").distinct()
    got = cm.estimates(items, whole, ["grp"], F.col("item")).collect()
    total = collections.Counter()
    for (group, _), n in exact.items():
        total[group] += n
    assert len(got) == len(exact)
    over = [r["estimate"] - exact[r["grp"], r["item"]] for r in got]
    assert min(over) >= 0
    # a chance of exp(-4) each; the items of a group are not independent, so some slack
    beyond = sum(o > cm.error * total[r["grp"]] for o, r in zip(over, got))
    assert beyond <= 0.05 * len(got)
    absent = cm.estimates(items.limit(1).select("grp", F.lit("never").alias("item")), whole.limit(0), ["grp"], F.col("item"))
    assert absent.first()["estimate"] == 0


def test_frequent_items_finds_every_heavy_one(skewed, exact):
    mg = sketches.FrequentItems(96)
    daily = mg.summary(skewed, ["grp", "day"], F.col("item"))
    got = {(r["grp"], r["item"]): r for r in mg.items(mg.merged(daily, ["grp"]), ["grp"], 96).collect()}
    total = {g: r["n_obs"] for (g, _), r in got.items()}
    assert collections.Counter(g for g, _ in got).most_common(1)[0][1] <= 96
    for key, n in exact.items():
        if n > mg.error * total[key[0]]:
            assert key in got
    for key, r in got.items():
        assert abs(r["summary_count"] - exact[key]) <= mg.error * total[key[0]]
    assert ("big", "hot") in got and ("small", "hot") in got


def test_bottom_k_of_parts_is_that_of_the_whole(skewed):
    def place(i):
        return hashlib.md5(f"sample|{i}".encode()).hexdigest()

    parts = [sketches.bottom_k(skewed.filter(F.col("day") == d), ["grp"], F.col("id"), 20) for d in range(7)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    got = sketches.bottom_k(union, ["grp"], F.col("id"), 20).collect()
    for group in ("big", "small"):
        ids = [i for i in range(ROWS) if (i % 10 != 0) == (group == "big")]
        assert {r["id"] for r in got if r["grp"] == group} == set(sorted(ids, key=place)[:20])


def test_sizes_out_of_range():
    with pytest.raises(ValueError):
        sketches.CountMin(10, 5)
