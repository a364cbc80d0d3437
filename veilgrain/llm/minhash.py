"""Near duplicates by bottom-k sketches of one hash function.

1. Every text becomes its set of hashed word shingles. Texts with equal sets form one class; all work below is per class.
2. The ``k`` smallest hashes of a set are its retained values. Inverted lists of them find classes that overlap. Of two
   sets that reach the threshold, the sketches share at least ``least_shared`` values (but for a chance below one in a
   million), so they meet in the list of one of their rarest ``k - least_shared + 1`` values: only those are listed, and
   values that many unrelated texts share list nothing.
3. Every list is compared with one of its members first (a star, linear in the list). Only lists whose members are not
   yet in one component are compared further: short ones pair by pair with the union sketch as a filter, long ones block
   by block on full sets. A block returns a spanning forest of its links, never all pairs.
4. Every link is confirmed on full sets; links give the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.graph import components
from veilgrain.llm.words import slices, word_hashes
from veilgrain.session import store

SHORT_LIST = 256  # lists up to this length are compared in one task; longer ones in blocks of this many members
DENSE = 20_000_000  # cells of a block's membership matrix


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles; a shorter text is one shingle, a blank one none."""
    h = word_hashes(text)
    if not len(h):
        return np.empty(0, np.int64)
    size = min(words, len(h))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        acc ^= h[j : len(h) - size + 1 + j]
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
    return np.unique(acc.view(np.int64))


def least_shared(n: int, k: int, percent: int) -> int:
    """Values that the union sketch of two sets, the larger of ``n``, shares at the threshold, less five deviations.

    Where the union of linked sets cannot exceed ``k`` values, sketches are whole sets and the bound is exact.
    """
    t = percent / 100
    union = n / t
    if union <= k:
        return max(1, -(-percent * n // 100))
    k = min(n, k)
    spread = math.sqrt(k * t * (1 - t) * max(0.0, union - k) / max(1.0, union - 1))
    return max(1, math.ceil(t * k - 5 * spread - 1e-9))


def sketch_rows(batches: Iterator[pa.RecordBatch], words: int, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in slices(batches):
        sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
        low = [s[:k] for s in sets]
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([-least_shared(len(s), k, percent) + 1 for s in sets], pa.int32()),
                pa.array(low, pa.list_(pa.int64())),
                batch.column(2),
            ],
            names=["doc_id", "cid", "n", "extra", "sketch", "text_hash"],
        )


def set_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in slices(batches):
        sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
        cids = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64())
        yield pa.record_batch([cids, pa.array(sets, pa.list_(pa.int64()))], names=["cid", "members"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of distinct-value sets."""
    sizes = np.array([len(s) for s in sets])
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = counts >= 2
    new = np.cumsum(shared) - 1
    keep = shared[where]
    out = np.zeros((len(sets), len(sets)), np.int64)
    step = max(1, DENSE // len(sets))
    col, row = new[where[keep]], row[keep]
    for at in range(0, int(shared.sum()), step):
        here = (col >= at) & (col < at + step)
        dense = np.zeros((len(sets), min(step, int(shared.sum()) - at)), np.float32)
        dense[row[here], col[here] - at] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


def short_list_pairs(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different components whose union sketch allows a link; rows (v, cid, comp, n, need, sketch) by v."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        if not table.num_rows:
            continue
        v = table.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(v)) + 1
        done = int(cuts[-1]) if len(cuts) else 0
        held = table.slice(done).to_batches()
        if done:
            yield list_pairs(table.slice(0, done), np.concatenate([[0], cuts[:-1], [done]]), k, percent)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield list_pairs(table, np.array([0, table.num_rows]), k, percent)


def list_pairs(table: pa.Table, ends: np.ndarray, k: int, percent: int) -> pa.RecordBatch:
    """Pairs of whole lists that lie between ``ends``; a pair that meets in several of them is returned once."""
    cid, comp, n, need = (table.column(i).to_numpy() for i in range(1, 5))
    lists = table.column(5).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    found: dict[tuple[int, int], bool] = {}
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        for i in range(start, end - 1):
            rest = np.arange(i + 1, end)
            big, small = np.maximum(n[i], n[rest]), np.minimum(n[i], n[rest])
            for j in rest[(comp[rest] != comp[i]) & (100 * small >= percent * big)].tolist():
                pair = (int(cid[i]), int(cid[j])) if cid[i] < cid[j] else (int(cid[j]), int(cid[i]))
                if pair in found:
                    continue
                a, b = values[offsets[i] : offsets[i + 1]], values[offsets[j] : offsets[j + 1]]
                both = np.sort(np.concatenate([a, b]))
                twice = np.flatnonzero(both[1:] == both[:-1])
                # the union's k smallest: a value's place among distinct ones is its place less the doubles before it
                shared = int((twice - np.arange(len(twice)) < k).sum())
                found[pair] = shared >= (need[i] if n[i] >= n[j] else need[j])
    pairs = [p for p, ok in found.items() if ok]
    return pa.record_batch([pa.array([p[x] for p in pairs], pa.int64()) for x in (0, 1)], names=["a", "b"])


def block_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges that join what the exact links of one block of a long list join."""
    group = group.sort_values("cid")
    cid, comp, side = (group[c].to_numpy() for c in ("cid", "comp", "side"))
    sets = [np.asarray(s, np.int64) for s in group["members"]]
    n = np.array([len(s) for s in sets])
    shared = overlaps(sets)
    link = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
    link &= comp[:, None] != comp[None, :]
    if group["low"].iat[0] != group["high"].iat[0]:
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, True)
    label = np.arange(len(cid))
    while True:
        new = np.where(link, label[None, :], len(cid)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    joined = label != np.arange(len(cid))
    return pd.DataFrame({"a": cid[joined], "b": cid[label[joined]]}, dtype="int64")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    k: int = 128,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Two texts are linked when ``100 * intersection >= percent * union`` on their shingle sets. Null, empty and blank texts
    have no shingles and link with nothing: their component is their own id. Rows with a null id link others but are
    never a component's id; a component of nulls alone has the id null, and such rows count as kept. Repeated rows of one id are
    all returned. Other columns of ``docs`` are not read. Shingles and classes are told apart by 64-bit hashes.
    """
    return judged(docs, shingle_words, percent, k, id_col, text_col).drop("text_hash", "label")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def judged(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, k: int = 128, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """:func:`near_duplicates` with the hash of the text and a label of the component, as components may share an id."""
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("text_hash")
    )
    rows = store(
        source.mapInArrow(
            lambda it: sketch_rows(it, shingle_words, k, percent),
            "doc_id long, cid long, n long, extra int, sketch array<long>, text_hash long",
        ),
        "sketches",
    )
    classes = (
        rows.where("n > 0")
        .groupBy("cid")
        .agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "extra", "sketch")))
    )
    classes = store(classes, "classes")

    # rarest retained values first; values of one class alone come before all others and need no list
    values = classes.select("cid", "extra", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    shared = (
        values.join(common, "v")
        .groupBy("cid")
        .agg(F.first("extra").alias("extra"), F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vs"))
    )
    length = F.col("extra") + F.size("vs")
    members = (
        shared.where(length > 0)
        .select("cid", F.explode(F.slice("vs", F.lit(1), length)).alias("x"))
        .select("cid", F.col("x.v").alias("v"))
    )
    members = store(members, "members")

    # a star in every list; the pivot depends on the class alone, so that lists of the same classes share it
    lists = members.groupBy("v").agg(
        F.count("*").alias("m"), F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).alias("pivot")
    )
    lists = store(lists.where("m > 1").select("v", "m", F.col("pivot.cid").alias("pivot")), "lists")
    stars = members.join(lists, "v").where("cid != pivot").select(
        F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")
    )
    stars = store(stars.distinct(), "stars")

    nodes = stars.select(F.col("a").alias("cid")).union(stars.select("b")).distinct()
    wanted = classes.join(nodes, "cid", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    texts = source.join(wanted, source["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("doc_id", "text")
    sets = (
        texts.mapInArrow(lambda it: set_rows(it, shingle_words), "cid long, members array<long>")
        .join(nodes, "cid", "left_semi")
        .dropDuplicates(["cid"])
    )
    sets = store(sets, "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("cid").alias(x), F.col("members").alias(f"{x}_set")) for x in "ab")
        both = F.size(F.array_intersect("a_set", "b_set"))
        union = F.size("a_set") + F.size("b_set") - both
        return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * union).select("a", "b")

    links = store(confirmed(stars), "links")
    label = components(links).withColumnRenamed("node", "cid").withColumnRenamed("label", "comp")
    placed = members.join(lists.select("v", "m"), "v").join(label, "cid", "left")
    placed = store(placed.select("v", "m", "cid", F.coalesce("comp", "cid").alias("comp")), "placed")
    spread = placed.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("v")
    left_over = placed.join(spread, "v", "left_semi")

    short = (
        left_over.where(F.col("m") <= SHORT_LIST)
        .join(classes.select("cid", "n", (1 - F.col("extra")).alias("need"), "sketch"), "cid")
        .select("v", "cid", "comp", "n", "need", "sketch")
        .repartition("v")
        .sortWithinPartitions("v")
        .mapInArrow(lambda it: short_list_pairs(it, k, percent), "a long, b long")
        .distinct()
    )
    blocks = F.ceil(F.col("m") / SHORT_LIST).cast("int")
    mine = F.pmod(F.xxhash64("cid", F.lit("block")), blocks).cast("int")
    long = (
        left_over.where(F.col("m") > SHORT_LIST)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "v", "cid", "comp",
            F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
            (F.col("mine") > F.col("other")).alias("side"),
        )
        .join(sets, "cid")
        .groupBy("v", "low", "high")
        .applyInPandas(lambda g: block_links(g, percent), "a long, b long")
    )
    found = links.union(confirmed(short)).union(long)
    label = components(found).withColumnRenamed("node", "cid")
    reps = classes.select("cid", "rep").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = reps.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = store(reps.join(smallest, "label").select("cid", "component_id", "label"), "named")
    ids = rows.select("doc_id", "cid", F.col("n").alias("n_shingles"), "text_hash")
    columns = ["doc_id", "n_shingles", "component_id", "text_hash", "label"]
    out = ids.where("n_shingles > 0").join(named, "cid").select(columns)
    alone = ids.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("label", F.col("cid")).select(columns)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.union(alone).withColumn("kept", kept)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that stand for their component, with all their columns.

    Rows of one id give one row for each component that the id stands for, of texts that differ the one with the least
    hash. Rows without an id stay, exact repeats of their text once.
    """
    verdicts = store(judged(docs, **options).select("doc_id", "text_hash", "label", "kept"), "verdicts").where("kept")
    group = F.when(F.col("doc_id").isNull(), F.col("text_hash")).otherwise(F.col("label"))
    kept = verdicts.groupBy(F.col("doc_id").alias("__kept"), group.alias("__group")).agg(F.min("text_hash").alias("__of"))
    rows = docs.withColumn("__hash", text_hash(F.col("text")))
    same = rows["doc_id"].eqNullSafe(F.col("__kept")) & (F.col("__hash") == F.col("__of"))
    out = rows.join(kept, same, "left_semi")
    if verdicts.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return out.select(docs.columns)  # no row is repeated, so nothing is left to drop
    return out.dropDuplicates(["doc_id", "__hash"]).select(docs.columns)
