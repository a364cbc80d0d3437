"""Exact top-k search by inner product as a Voronoi join.

Vectors are grouped by their nearest pivot. Of each cell a summary is kept: how many vectors it holds, how far the
farthest is from the pivot, and the nearest distances. As ``q.x = q.p + q.(x - p)``, a vector at distance d from the pivot p
scores between ``q.p - |q| d`` and ``q.p + |q| d``. The lower bounds of the summaries give each query a score that at least k
vectors reach; a vector whose upper bound is below that for every query of a block is not sent to that block.
Queries and vectors meet in blocks of bounded size; each block keeps k rows per query, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.operators.ranking import with_global_rank
from veilgrain.session import store

PIVOTS = 256  # pivots, at most
CELL_ROWS = 4096  # vectors of a cell, on average, until the bound on pivots
CHUNK_ROWS = 4096  # vectors of a cell that meet queries in one task
QUERY_ROWS = 1024  # queries of a block
SLACK = 1e-9  # relative allowance for rounding in the bounds


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.array(column.tolist(), np.int64).reshape(len(column), dim)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def scattered(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of a sample, each the farthest from those before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        i = int(far.argmax())
        if far[i] <= 0:
            break
        chosen.append(i)
        far = np.minimum(far, ((sample - sample[i]) ** 2).sum(axis=1))
    return sample[chosen]


def assign(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All columns (the second is the vector), then cell and distance to its pivot."""
    square = (pivots**2).sum(axis=1)
    for batch in batches:
        if not batch.num_rows:
            continue
        v = matrix(batch.column(1), pivots.shape[1]).astype(float)
        near = (square[None, :] - 2 * (v @ pivots.T)).argmin(axis=1)
        dist = np.sqrt(((v - pivots[near]) ** 2).sum(axis=1))
        yield pa.record_batch(
            [*batch.columns, pa.array(near, pa.int32()), pa.array(dist, pa.float64())],
            names=[*batch.schema.names, "cell", "dist"],
        )


def needs(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, cells: pd.DataFrame, k: int) -> Iterator[pa.RecordBatch]:
    """(block, cell, least): vectors of the cell at distance ``least`` or more may be among a block's results."""
    cell = cells["cell"].to_numpy()
    p, radius = pivots[cell], cells["radius"].to_numpy()
    low = [(i, d) for i, near in enumerate(cells["nearest"]) for d in near]
    at, dist = np.array([i for i, _ in low]), np.array([d for _, d in low])
    for batch in batches:
        if not batch.num_rows:
            continue
        q = matrix(batch.column(1), pivots.shape[1]).astype(float)
        block = batch.column(2).to_numpy(zero_copy_only=False)
        size = np.maximum(np.sqrt((q**2).sum(axis=1)), 1e-300)
        inner = q @ p.T
        reached = inner[:, at] - size[:, None] * dist[None, :]
        # one of the k + 1 best may be the query's own vector
        bound = np.sort(reached, axis=1)[:, -(k + 1)] if reached.shape[1] > k else np.full(len(q), -np.inf)
        least = (bound[:, None] - inner) / size[:, None]
        least = least - SLACK * (np.abs(inner) / size[:, None] + np.abs(least) + 1)
        out = pd.DataFrame({"block": np.repeat(block, len(cell)), "cell": np.tile(cell, len(q)), "least": least.ravel()})
        out = out[out["least"] <= np.tile(radius, len(q))]
        out = out.groupby(["block", "cell"], as_index=False)["least"].min()
        yield pa.RecordBatch.from_pandas(out.astype({"block": "int32", "cell": "int32"}), preserve_index=False)


def local_best(vectors: pd.DataFrame, queries: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """The k best vectors of a chunk for each query of a block."""
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    if not len(vectors) or not len(queries):
        return empty
    vectors = vectors.sort_values("vec_id")
    ids, x = vectors["vec_id"].to_numpy(), matrix(vectors["v"], dim)
    asked, q = queries["vec_id"].to_numpy(), matrix(queries["v"], dim)
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(dim, 1)
    exact = most < 2**53  # then floating-point products are exact
    out = []
    xt = x.T.astype(float) if exact else x.T
    for at in range(0, len(asked), 256):
        own = asked[at : at + 256]
        score = (q[at : at + 256].astype(float) @ xt).astype(np.int64) if exact else q[at : at + 256] @ xt
        take = min(k + 1, len(ids))
        # ties go to the smaller id: vectors are sorted by id, and the order is stable
        if take < len(ids):
            edge = np.partition(score, len(ids) - take, axis=1)[:, len(ids) - take]
        else:
            edge = score.min(axis=1)
        for i in range(len(own)):
            near = np.flatnonzero(score[i] >= edge[i])
            near = near[np.argsort(-score[i, near], kind="stable")]
            near = near[ids[near] != own[i]][:k]
            out.append((np.full(len(near), own[i]), ids[near], score[i, near]))
    return pd.DataFrame({c: np.concatenate([o[j] for o in out]) for j, c in enumerate(("query_id", "vec_id", "score"))})


def top_k(
    table: DataFrame,
    k: int = 5,
    query_every: int = 50,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row whose id is divisible by ``query_every``.

    Components are turned into ``floor(scale * x)``; the score is their inner product; ties go to the smaller id and a
    query's own row is no candidate. Rows with a null id, a null vector or a null, NaN or infinite component take no part.
    Vectors only meet vectors of their own length; all lengths that occur are searched one after the other. Of rows that share
    an id each is a query and a candidate of its own, equal ones too, so that such an id has k rows for each of its rows. Fewer
    candidates than k give fewer rows, an empty table none. Inner products must fit in 64 bits. Other columns are not read.
    """
    rows = table.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), whole_components(F.col(vector_col), scale).alias("v")
    )
    # rows are searched by their place in the order of ids: unique, and smaller for smaller ids
    rows = with_global_rank(rows, [F.col("id")], "vec_id")
    rows = store(rows.select("vec_id", "v", (F.col("id") % query_every == 0).alias("asked"), "id"), "vectors")
    ids = rows.select("vec_id", "id")
    rows = rows.drop("id")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"))
    out = None
    for dim, n, asked in sorted((r["dim"], r["n"], r["asked"]) for r in sizes.collect()):  # a row per vector length
        part = _top_k(rows.where(F.size("v") == dim), dim, n, k) if asked else None
        out = part if out is None else out if part is None else out.union(part)
    if out is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    asked = ids.select(F.col("vec_id").alias("query_id"), F.col("id").alias("asked_id"))
    return ranked.join(ids, "vec_id").join(asked, "query_id").select(
        F.col("asked_id").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"
    )


def _top_k(rows: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    wanted = min(PIVOTS, max(1, n // CELL_ROWS))
    # a bounded sample by hash; equal vectors count once
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(8 * wanted).toPandas()
    pivots = scattered(np.unique(matrix(sample["v"], dim), axis=0).astype(float), wanted)
    placed = store(
        rows.mapInArrow(lambda it: assign(it, pivots), "vec_id long, v array<long>, asked boolean, cell int, dist double"), "cells"
    )
    is_query = F.col("asked")
    near = W.partitionBy("cell", "part").orderBy("dist")
    # nearest distances: first within parts of a cell, so that a large cell does not meet in one task
    nearest = (
        placed.select("cell", "dist", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // CHUNK_ROWS))).alias("part"))
        .withColumn("place", F.row_number().over(near))
        .where(F.col("place") <= k + 1)
        .groupBy("cell")
        .agg(F.slice(F.sort_array(F.collect_list("dist")), 1, k + 1).alias("nearest"))
    )
    summary = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("asked"), F.max("dist").alias("radius")
    )
    cells = summary.join(nearest, "cell").orderBy("cell").toPandas()  # a row per pivot
    # cells close to each other share blocks of queries; a cell with many queries has several
    blocks, first, load = {}, 0, 0
    for cell, count in zip(cells["cell"], cells["asked"]):
        if load and load + count > QUERY_ROWS:
            first, load = first + 1, 0
        own = max(1, -(-int(count) // QUERY_ROWS))
        blocks[int(cell)] = (first, own)
        load += int(count)
        if own > 1:
            first, load = first + own, 0
    chunks = {int(c): max(1, -(-int(m) // CHUNK_ROWS)) for c, m in zip(cells["cell"], cells["n"])}

    def by_cell(values: dict[int, int]) -> Column:
        pairs = [F.lit(values.get(c, 1)) for c in range(len(pivots))]
        return F.get(F.array(*pairs), F.col("cell"))

    block = by_cell({c: f for c, (f, _) in blocks.items()}) + F.pmod(
        F.xxhash64("vec_id", F.lit("q")), by_cell({c: o for c, (_, o) in blocks.items()})
    )
    queries = store(placed.where(is_query).select("vec_id", "v", block.cast("int").alias("block")), "queries")
    need = queries.mapInArrow(lambda it: needs(it, pivots, cells, k), "block int, cell int, least double")
    need = store(need.groupBy("block", "cell").agg(F.min("least").alias("least")), "needs")
    chunk = F.explode(F.sequence(F.lit(0), by_cell(chunks) - 1)).alias("chunk")
    met = store(need.select("block", "cell", "least", chunk), "met")
    mine = F.pmod(F.xxhash64("vec_id", F.lit("c")), by_cell(chunks)).cast("int").alias("chunk")
    sent = (
        placed.select("vec_id", "v", "cell", "dist", mine)
        .join(met, ["cell", "chunk"])
        .where("dist >= least")
        .select("block", "cell", "chunk", "vec_id", "v")
    )
    at = ["block", "cell", "chunk"]
    asked_there = queries.join(met.select(*at), "block")
    return sent.groupBy(*at).cogroup(asked_there.groupBy(*at)).applyInPandas(
        lambda x, q: local_best(x, q, dim, k), "query_id long, vec_id long, score long"
    )
