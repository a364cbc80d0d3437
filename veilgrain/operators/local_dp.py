"""Local randomizers and their unbiased estimators.

All coins come from keyed hashes of the report id, so a re-run of a task randomizes a report the same way.
The estimators work on sums per cell; no report-level data is needed after aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.functions.noise import WORDS_PER_DIGEST, digest_words, keyed_uniform, word_uniform
from veilgrain.operators.transforms import hash_bucket


def keep_probability(epsilon: float) -> float:
    return math.exp(epsilon) / (1.0 + math.exp(epsilon))


# ---- one bit: randomized response --------------------------------------------------------------------------------
def rr_binary(bit: Column, epsilon: float, *key) -> Column:
    keep = keyed_uniform(*key, "rr") < keep_probability(epsilon)
    return F.when(keep, bit).otherwise(1 - bit).cast("int")


def rr_estimate(df: DataFrame, keys: Sequence[str], bit: str, epsilon: float) -> DataFrame:
    """Per cell: reports n, ones Y, estimate (Y - n(1-p))/(2p-1) and its variance."""
    p = keep_probability(epsilon)
    agg = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(bit).alias("y"))
    return agg.withColumn("estimate", (F.col("y") - F.col("n") * (1 - p)) / (2 * p - 1)).withColumn(
        "variance", F.col("n") * (p * (1 - p) / (2 * p - 1) ** 2)
    )


# ---- small domains: unary encoding -------------------------------------------------------------------------------
def unary_probabilities(epsilon: float, optimized: bool = True) -> tuple[float, float]:
    """(p, q): probability of reporting a one for the true and for any other value."""
    if optimized:
        return 0.5, 1.0 / (math.exp(epsilon) + 1.0)
    half = math.exp(epsilon / 2)
    return half / (half + 1.0), 1.0 / (half + 1.0)


def _with_coins(df: DataFrame, n: int, *key) -> tuple[DataFrame, list[Column]]:
    """``n`` keyed uniforms per row at one hash for every eight of them."""
    digests = digest_words(n, *key)
    names = [f"_digest{i}" for i in range(len(digests))]
    df = df.withColumns(dict(zip(names, digests)))
    return df, [word_uniform(F.col(names[i // WORDS_PER_DIGEST]), i % WORDS_PER_DIGEST) for i in range(n)]


def unary_sums(df: DataFrame, keys: Sequence[str], index: Column, domain: int, epsilon: float, *key,
               optimized: bool = True) -> DataFrame:
    """Randomized unary reports summed per cell: n reports and, per domain value v, the ones y.

    Bits stay columns of one aggregate, so reports are never exploded. For domains of a few dozen values; larger ones
    are better served by the Hadamard response.
    """
    p, q = unary_probabilities(epsilon, optimized)
    df, coins = _with_coins(df.withColumn("_v", index), domain, *key)
    bits = [F.when(F.col("_v") == v, u < p).otherwise(u < q).cast("int") for v, u in enumerate(coins)]
    wide = df.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(b) for b in bits]).alias("_y"))
    return wide.select(*keys, "n", F.posexplode("_y").alias("v", "y"))


def unary_estimate(sums: DataFrame, epsilon: float, optimized: bool = True) -> DataFrame:
    p, q = unary_probabilities(epsilon, optimized)
    return sums.withColumn("estimate", (F.col("y") - F.col("n") * q) / (p - q)).withColumn(
        "variance", F.col("n") * (q * (1 - q) / (p - q) ** 2)
    )


# ---- large domains: Hadamard response ----------------------------------------------------------------------------
def hadamard_order(domain: int) -> int:
    return 1 << max(1, math.ceil(math.log2(domain)))


def _sign(row: Column, v: Column) -> Column:
    return 1 - 2 * (F.bit_count(row.bitwiseAND(v)) % 2)


def hadamard_report(index: Column, domain: int, epsilon: float, *key) -> tuple[Column, Column]:
    """(row, bit): a uniform Hadamard row and the randomized +-1 entry of the value in that row."""
    order = hadamard_order(domain)
    row = F.floor(keyed_uniform(*key, "hrow") * order).cast("int")
    keep = keyed_uniform(*key, "hbit") < keep_probability(epsilon)
    sign = _sign(row, index.cast("int"))
    return row, F.when(keep, sign).otherwise(-sign).cast("int")


def hadamard_estimate(df: DataFrame, keys: Sequence[str], row: str, bit: str, domain: int, epsilon: float) -> DataFrame:
    """(keys, v, n, estimate, variance) of every domain value, from sums per row (at most 2 x domain rows per cell).

    The sign of row and value is the product of the signs of the two halves of their bits, so the transform is two grouped passes:
    over the lower half, then over the upper half of the row's bits. Each repeats a row as often as the root of the domain, not as
    often as the domain. The variance is that of a value nobody holds.
    """
    p = keep_probability(epsilon)
    order = hadamard_order(domain)
    low = (order.bit_length() - 1) // 2
    mask = (1 << low) - 1
    per_row = df.groupBy(*keys, F.col(row).cast("int").alias("_row")).agg(F.sum(bit).alias("_s"), F.count("*").alias("_n"))

    def spread(rows: DataFrame, kept: Sequence[str], half: Column, last: int, name: str) -> DataFrame:
        wide = rows.withColumn("_half", half).withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(last))))
        signed = F.col("_s") * _sign(F.col("_half"), F.col(name))
        return wide.groupBy(*kept, name).agg(F.sum(signed).alias("_s"), F.sum("_n").alias("_n"))

    halves = per_row.withColumn("_high", F.shiftright("_row", low))
    first = spread(halves, [*keys, "_high"], F.col("_row").bitwiseAND(F.lit(mask)), mask, "_vlow")
    second = spread(first, [*keys, "_vlow"], F.col("_high"), (domain - 1) >> low, "_vhigh")
    v = (F.col("_vhigh") * (1 << low) + F.col("_vlow")).cast("int")
    return second.withColumn("v", v).filter(F.col("v") < domain).select(
        *keys, "v", F.col("_n").alias("n"), (F.col("_s") / (2 * p - 1)).alias("estimate"),
        (F.col("_n") / (2 * p - 1) ** 2).alias("variance"),
    )


# ---- open domains: count-mean sketch ------------------------------------------------------------------------------
def _sketch_column(row: Column, value: Column, width: int) -> Column:
    return hash_bucket(F.concat_ws("|", row.cast("string"), value.cast("string")), "sketch", width)


def sketch_sums(df: DataFrame, keys: Sequence[str], value: Column, depth: int, width: int, epsilon: float, *key) -> DataFrame:
    """Randomized sketch reports summed per cell, sketch row and column.

    A report is a uniform row and the one-hot vector of the value's column in it, every bit flipped independently.
    """
    p = keep_probability(epsilon / 2)
    row = F.floor(keyed_uniform(*key, "srow") * depth).cast("int")
    df = df.withColumn("row", row).withColumn("_col", _sketch_column(F.col("row"), value, width))
    df, coins = _with_coins(df, width, *key)
    bits = []
    for w, u in enumerate(coins):
        one = (F.col("_col") == w).cast("int")
        bits.append(F.when(u < p, one).otherwise(1 - one))
    wide = df.groupBy(*keys, "row").agg(F.count("*").alias("nj"), F.array(*[F.sum(b) for b in bits]).alias("_y"))
    return wide.select(*keys, "row", "nj", F.posexplode("_y").alias("col", "y"))


def sketch_estimate(sums: DataFrame, keys: Sequence[str], domain: DataFrame, value: str, depth: int, width: int,
                    epsilon: float) -> DataFrame:
    """Estimated count of every value of ``domain`` per cell, with the variance that the randomized bits add.

    ``domain`` is public: a column of the reports themselves must not be passed in a release. Values are placed once per sketch
    row; their few rows meet the sketch, never the reports.
    """
    p = keep_probability(epsilon / 2)
    debiased = sums.withColumn("c", (F.col("y") - F.col("nj") * (1 - p)) / (2 * p - 1))
    rows = F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))
    probes = domain.select(value).distinct().withColumn("row", rows)
    probes = probes.withColumn(
        "col", _sketch_column(F.col("row"), F.col(value), width)
    )
    # a value meets every sketch row once, so the reports of its rows add up to those of the cell
    hits = debiased.join(probes, ["row", "col"]).groupBy(*keys, value).agg(F.sum("c").alias("t"), F.sum("nj").alias("n"))
    scale = width / (width - 1.0)
    return hits.select(
        *keys, value, "n", ((F.col("t") - F.col("n") / width) * scale).alias("estimate"),
        (F.col("n") * (p * (1 - p) / (2 * p - 1) ** 2 * scale**2)).alias("variance"),
    )


def scale_by_sample_rate(c: Column, sample_rate) -> Column:
    return c / sample_rate
