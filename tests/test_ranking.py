"""Global row numbers against a sort on the driver."""

import random

from pyspark.sql import functions as F

from veilgrain.operators.ranking import with_global_rank


def test_rank_is_the_sorted_place(spark):
    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.4 else rng.randrange(50), i) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "score int, id int").repartition(5)
    out = with_global_rank(df, [F.col("score").desc(), F.col("id").asc()], partitions=6)
    got = {r["id"]: r["rank"] for r in out.collect()}
    want = {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert got == want


def test_rank_of_ties_nulls_and_nothing(spark):
    rows = [(None, "a"), (None, "a"), (3, "b"), (3, "b")]
    df = spark.createDataFrame(rows, "score int, `a.b` string")
    out = with_global_rank(df, [F.col("score").desc_nulls_last()], "place", 3).collect()
    assert sorted((r["score"] is None, r["place"]) for r in out) == [(False, 1), (False, 2), (True, 3), (True, 4)]
    assert with_global_rank(df.limit(0), [F.col("score")], partitions=3).count() == 0
