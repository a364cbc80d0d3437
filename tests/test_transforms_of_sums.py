"""Running totals by range, AUC of many labels and the Hadamard transform against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from veilgrain.operators import local_dp as ld
from veilgrain.operators import stats
from veilgrain.operators.prefix import range_totals


@pytest.mark.parametrize("sparse", [False, True])
def test_range_totals_like_a_loop(spark, sparse):
    rng = random.Random(1)
    keys = [rng.getrandbits(63) - (1 << 62) for _ in range(900)] if sparse else list(range(900))
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(-5, 9)) for k in keys]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    out = range_totals(df, ["g"], "k", ["v"], partitions=7)
    want, run = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        want[g, k] = run.get(g, 0)
        run[g] = run.get(g, 0) + v
    assert {(r.g, r.k): r.before_v for r in out.collect()} == want
    alone = range_totals(df.drop("g"), [], "k", ["v"], partitions=7).collect()
    total = 0
    for r in sorted(alone, key=lambda r: r.k):
        assert r.before_v == total
        total += r.v


def test_ranges_of_sparse_keys_are_even(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("k"), F.lit(1).alias("v"))
    ranged = range_totals(df, [], "k", ["v"], partitions=10)
    sizes = ranged.groupBy(F.floor(F.col("before_v") / 2000)).count().agg(F.min("count"), F.max("count")).first()
    assert sizes[0] == sizes[1] == 2000  # every place occurs once, whatever the gaps between the keys


def test_auc_of_labels_like_counting_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randrange(12)) for _ in range(300)] + [("d", 3)] + [("a", None), (None, 4)]
    got = {r.label: r for r in stats.label_auc(spark.createDataFrame(rows, "label string, v long"), "label", "v").collect()}
    known = [(x, v) for x, v in rows if x is not None and v is not None]
    for label in "abcd":
        pos, neg = [v for x, v in known if x == label], [v for x, v in known if x != label]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert (got[label].n_pos, got[label].n_neg) == (len(pos), len(neg))
        assert got[label].auc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    one = stats.label_auc(spark.createDataFrame([("a", 1)], "label string, v long"), "label", "v").first()
    assert one.n_neg == 0 and one.auc is None


@pytest.mark.parametrize("domain", [2, 5, 16, 100])
def test_hadamard_estimate_like_the_full_sum(spark, domain):
    rng = random.Random(domain)
    order = ld.hadamard_order(domain)
    rows = [("x" if i % 3 else "y", rng.randrange(order), rng.choice([-1, 1])) for i in range(400)]
    df = spark.createDataFrame(rows, "cell string, row int, bit int")
    got = {(r.cell, r.v): r for r in ld.hadamard_estimate(df, ["cell"], "row", "bit", domain, 1.0).collect()}
    scale = 2 * ld.keep_probability(1.0) - 1
    for cell in "xy":
        own = [(r, b) for c, r, b in rows if c == cell]
        for v in range(domain):
            s = sum(b * (1 - 2 * (bin(r & v).count("1") % 2)) for r, b in own)
            assert got[cell, v].n == len(own) and got[cell, v].estimate == pytest.approx(s / scale)
            assert got[cell, v].variance == pytest.approx(len(own) / scale**2)
    assert len(got) == 2 * domain


def test_hadamard_of_a_large_domain(spark):
    domain = 65_536
    df = spark.range(40_000).withColumn("v", F.when(F.col("id") % 4 == 0, 4_242).otherwise(F.col("id") % domain))
    row, bit = ld.hadamard_report(F.col("v"), domain, 4.0, "s", F.col("id"))
    est = ld.hadamard_estimate(df.select(row.alias("row"), bit.alias("bit")), [], "row", "bit", domain, 4.0)
    top = est.orderBy(F.col("estimate").desc()).first()
    assert top.v == 4_242 and abs(top.estimate - 10_000) < 5 * top.variance**0.5 and est.count() == domain
