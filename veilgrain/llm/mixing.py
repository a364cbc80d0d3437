"""Mixing sources to target weights by systematic sampling; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.llm.words import WORD
from veilgrain.session import store

BAND_SCALE = 11.541560327111707  # eight size bands per doubling
LEAST_BLOCK = 256  # rows of a block, at least; it grows with the square root of the table


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share_percent: int, cap: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn. They share ``share_percent`` of all sizes by
    weight; a target stops at ``cap`` times its source's size and the rest is shared anew. The level at which that
    ends is found in one pass: with sources ordered by the level at which each stops, those before the level are full
    and the others get weight times level.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("weight", weigh).withColumn("most", F.lit(cap) * F.col("source_size"))
    total = sizes.agg((F.sum("source_size") * share_percent / 100).alias("total"))
    by_stop = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(W.unboundedPreceding, -1)
    after = by_stop.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    s = s.crossJoin(F.broadcast(total)).withColumn("level", level)  # one row
    # the first source that its level does not fill sets the level of all after it
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    held = F.first(open_level, ignorenulls=True).over(by_stop.rowsBetween(W.unboundedPreceding, 0))
    target = F.when(held.isNull(), F.col("most")).otherwise(F.least(held * F.col("weight"), F.col("most")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def offset_of(source: Column, seed: str) -> Column:
    """One uniform number in [0, 1) for each source."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share_percent: int = 150,
    cap: int = 2,
    seed: str = "mix",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """One row per row of ``docs``: ``keep`` columns, source, size, source_size, target, copies, taken.

    A document's expected copies are its source's target over its source's size. Within a source they are summed up
    along the documents in order of size band, block, size and id, one random offset is added, and a document is taken
    once for each integer that its stretch passes. As documents of like size lie together, the words taken come close
    to the target, too. Places in the order come from block counts and places within blocks; a block is cut from one
    size band of one source by the id's hash and holds about ``sqrt(rows)`` rows, so neither a hot source nor many
    equal sizes meet in one task.

    Null or blank texts have size 0 and get copies like others (their taken words are 0). A source of size 0 has
    target 0 and no copies. Null sources form a source of their own, the last. Repeated rows are rows of their own;
    equal ones get adjacent places in any order, which changes no result. An empty table gives no rows.
    """
    named = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    rows = docs.select(
        *named, F.col("doc_id").alias("__id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size")
    )
    band = F.floor(F.ln(F.col("size") + 1) * F.lit(BAND_SCALE) + 1e-9).cast("int")
    digest = F.md5(F.coalesce(F.col("__id").cast("string"), F.lit("")))
    rows = store(
        rows.withColumn("band", band).withColumn("h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")), "sizes"
    )
    bands = rows.groupBy("source", "band").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    total = bands.agg(F.greatest(F.lit(LEAST_BLOCK), F.floor(F.sqrt(F.sum("n")))).cast("long").alias("per_block"))
    cut = bands.crossJoin(F.broadcast(total)).select(  # one row
        F.col("source").alias("s"), F.col("band").alias("b"), F.ceil(F.col("n") / F.col("per_block")).alias("blocks")
    )
    same = rows["source"].eqNullSafe(F.col("s")) & (rows["band"] == F.col("b"))
    placed = rows.join(cut, same).drop("s", "b").withColumn("block", F.pmod(F.col("h"), F.col("blocks"))).drop("blocks", "h")

    blocks = placed.groupBy("source", "band", "block").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("source").orderBy("band", "block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(
        F.col("source").alias("s"), F.col("band").alias("b"), F.col("block").alias("k"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
    )
    share = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share_percent, cap)
    share = share.select(
        F.col("source").alias("t"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        offset_of(F.col("source"), seed).alias("offset"),
    )
    starts = starts.join(share, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    here = W.partitionBy("source", "band", "block").orderBy("size", F.col("__id").asc_nulls_last())
    ranked = placed.withColumn("place", F.row_number().over(here))
    at = ranked["source"].eqNullSafe(F.col("s")) & (ranked["band"] == F.col("b")) & (ranked["block"] == F.col("k"))
    rank = F.col("before") + F.col("place")
    copies = F.floor(F.col("offset") + rank * F.col("rate")) - F.floor(F.col("offset") + (rank - 1) * F.col("rate"))
    return (
        ranked.join(starts, at)
        .withColumn("copies", copies.cast("long"))
        .select(
            *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)),
            "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the same columns.

    Rows that agree in id, text and source get their copies in sum and share them out evenly.
    """
    key = F.xxhash64("doc_id", "text", "source").alias("__key")
    columns = [docs[c] for c in docs.columns]
    counted = mixed(docs.select("doc_id", "text", "source", key), keep=("__key",), **options)
    total = counted.groupBy("__key").agg(F.sum("copies").alias("__n"), F.count("*").alias("__m")).where("__n > 0")
    row = F.row_number().over(W.partitionBy("__key").orderBy("__key"))
    texts = docs.select(*columns, key).withColumn("__i", row)
    share = F.floor(F.col("__i") * F.col("__n") / F.col("__m")) - F.floor((F.col("__i") - 1) * F.col("__n") / F.col("__m"))
    dealt = texts.join(total, "__key").withColumn("__n", share.cast("int")).where("__n > 0")
    return dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(docs.columns)
