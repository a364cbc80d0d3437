"""Context-triggered piecewise hashing of whole texts.

A rolling hash over a few bytes ends a chunk wherever it hits a value that depends on the block size, so chunk ends
move with the text. Each chunk gives one character of the signature. A fingerprint holds the signatures at a block size
and at its double; two fingerprints are compared at a block size that they share, by edit distance of the signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.words import slices

WINDOW = 7
LEAST_BLOCK = 2
TARGET = 64  # chunks that a block size aims at
COMMON = 4  # signatures without a common run of this length are unlike
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
ROLL = np.uint32(0x01000193)  # odd multipliers
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 2**64))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, STEP, np.uint64))
        down = np.cumprod(np.full(size, BACK, np.uint64))
    return up, down


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** (i + 1) and BACK ** (i + 1), modulo 2 ** 64."""
    up, down = _powers(1 << max(12, (size - 1).bit_length()))
    return up[:size], down[:size]


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes that end at each byte; the start is filled up with zeros."""
    b = data.astype(np.uint32)
    out = b.copy()
    factor = np.uint32(1)
    with np.errstate(over="ignore"):
        for j in range(1, min(WINDOW, len(b))):
            factor = np.uint32(factor * ROLL)
            out[j:] += b[:-j] * factor
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x2C1B3C6D)
        out ^= out >> np.uint32(13)
    return out


def signature(weighted: np.ndarray, up: np.ndarray, hashes: np.ndarray, block: int) -> str:
    """One letter for each chunk."""
    ends = np.flatnonzero(hashes % np.uint32(block) == np.uint32(block - 1)) + 1
    if not len(ends) or ends[-1] != len(hashes):
        ends = np.append(ends, len(hashes))
    starts = np.concatenate([[0], ends[:-1]])
    with np.errstate(over="ignore"):
        h = np.add.reduceat(weighted, starts) * up[ends - 1]  # the chunk's polynomial, wherever it lies
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return LETTERS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """``block:signature:signature at twice the block``; the empty text has empty signatures."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    block = LEAST_BLOCK
    while block * TARGET < len(data):
        block *= 2
    if not len(data):
        return f"{block}::"
    hashes = rolling(data)
    # few chunks at this size, as in monotonous texts: go down to smaller blocks
    while block > LEAST_BLOCK and (hashes % np.uint32(block) == np.uint32(block - 1)).sum() < TARGET // 2:
        block //= 2
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        weighted = (data.astype(np.uint64) + np.uint64(1)) * down
    return f"{block}:{signature(weighted, up, hashes, block)}:{signature(weighted, up, hashes, 2 * block)}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row at a time in the bits of one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def alike(a: str, b: str) -> float:
    """1 - edit distance (insertions and deletions) over the total length; 0 without a common run of COMMON letters."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= COMMON:
        runs = {a[i : i + COMMON] for i in range(len(a) - COMMON + 1)}
        if not any(b[i : i + COMMON] in runs for i in range(len(b) - COMMON + 1)):
            return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """Likeness of two fingerprints from 0 to 1; 0 if their block sizes are incompatible, 1 if they are equal."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    if not x1 or not y1:
        return 0.0
    if bx == by:
        return max(alike(x1, y1), alike(x2, y2))
    if int(bx) == 2 * int(by):
        return alike(x1, y2)
    if 2 * int(bx) == int(by):
        return alike(x2, y1)
    return 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every row's whole text; null counts as empty, repeated rows stay."""
    kind = dict(docs.dtypes)[id_col]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = pa.array([fingerprint(t) for t in texts], pa.string())
            more = [pa.array([len(t) for t in texts], pa.int64()), prints]
            yield pa.record_batch([batch.column(0), *more], names=["doc_id", "n_chars", "fingerprint"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(rows, f"doc_id {kind}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order; a row marked ``ahead`` is only the successor of the one before it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: tuple | None = None  # bucket, id, text, fingerprint, ahead
    for batch in slices(batches):
        out: list[tuple] = []
        for bucket, doc_id, text, ahead in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            now = (bucket, doc_id, text, fingerprint(text), ahead)
            if held is not None and not held[4] and held[0] == bucket:
                new = edited(held[2], text)
                print_new = fingerprint(new)
                out.append((
                    held[1], len(held[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), held[3],
                    print_new, likeness(held[3], print_new), likeness(held[3], now[3]),
                ))
            held = now
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)


def edit_robustness(docs: DataFrame, rows_per_bucket: int = 128, most_buckets: int = 16384) -> DataFrame:
    """How fingerprints follow an edit: one row per row of ``docs``.

    Each text is compared with itself after its last half was replaced by the beginning of the next document (in order
    of doc_id, nulls last; rows of one id in order of their text's hash; after the last comes the first), and with that
    next document. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts are empty. A single row is its own successor. An empty table gives no rows.

    Documents are cut into ranges of ids; each range is sorted in one task and gets a copy of the document that follows it,
    so that texts are shuffled once and no range waits for another.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = base.count()
    count = min(most_buckets, max(1, n // rows_per_bucket))
    cuts = base.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.25 / count) if count > 1 else []
    edges = np.array(sorted(set(map(int, cuts))), np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = np.full(len(ids), len(edges) + 1)
        at[known] = np.searchsorted(edges, ids[known].astype("int64").to_numpy(), side="right")
        return pd.Series(at)

    placed = base.withColumn("bucket", bucket("doc_id")).withColumn("h", F.xxhash64("text"))
    # the first row of each range, at most most_buckets of them
    first = placed.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("x")).orderBy("bucket").collect()
    before = [(r["x"]["doc_id"], r["x"]["h"], first[i - 1]["bucket"]) for i, r in enumerate(first)]
    ahead = docs.sparkSession.createDataFrame(before, "id long, key long, to int")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key"))
    # the bound on ranges bounds this table; a repeated first row is wanted once
    copies = (
        base.withColumn("h", F.xxhash64("text")).join(F.broadcast(ahead), same).select("doc_id", "text", "to", "h")
        .dropDuplicates(["to"])
    )
    rows = placed.select("bucket", "doc_id", "h", "text", F.lit(False).alias("ahead")).union(
        copies.select("to", "doc_id", "h", "text", F.lit(True))
    )
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "ahead", "doc_id", "h")
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return ordered.select("bucket", "doc_id", "text", "ahead").mapInArrow(compare_rows, schema)
