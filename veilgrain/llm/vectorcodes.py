"""Product codes of integer vectors with an exact nearest-entry search in the Walsh-Hadamard domain.

Vectors are cut into equal parts, and each part is replaced by the number of the nearest entry of the part's codebook. Parts and
entries are padded with zeros to a power of two and transformed; the transform multiplies every squared distance by that power, so
sums of squared differences of coefficients compare exactly like the distances themselves. They are added in order of sequency,
slow patterns first, and an entry whose sum passes the distance of a candidate is dropped. All numbers are whole.

Each round is one pass over the stored vectors in which every task adds up its own parts; the codebooks, a fixed number of entries
whatever the number of vectors, are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.knn import usable, whole_components
from veilgrain.llm.words import slices
from veilgrain.session import store

PARTS = 4
ENTRIES = 256
ROUNDS = 4
ROWS_AT_ONCE = 2048
BLOCK_ROWS = 128  # rows whose sums are kept for all entries at once
FEW = 16  # one pair in so many left: only these are carried on
LARGEST = (1 << 63) - 1


def padded_size(n: int) -> int:
    """The least power of two that is not below ``n``."""
    return 1 << max(0, n - 1).bit_length()


def sequency_order(size: int) -> np.ndarray:
    """Row of the Hadamard matrix with 0, 1, 2, ... changes of sign: the reversed bits of the Gray code."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    out = np.zeros(size, np.int64)
    for b in range(bits):
        out |= (gray >> b & 1) << (bits - 1 - b)
    return out


def walsh(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row in order of sequency; rows are padded with zeros to a power of two."""
    size = padded_size(parts.shape[1])
    out = np.zeros((len(parts), size), parts.dtype)
    out[:, : parts.shape[1]] = parts
    half = 1
    while half < size:
        pairs = out.reshape(len(out), -1, 2, half)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
        half *= 2
    return out[:, sequency_order(size)]


def fits(largest: int, size: int) -> bool:
    """Whether scaled distances of parts with components up to ``largest`` stay below 2 ** 63."""
    return 4 * largest * largest * size * size <= LARGEST


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """Nearest entry of each row, ties to the lower index, and the squared distance to it.

    Components too large for 64-bit sums are compared in Python's unbounded whole numbers instead.
    """
    largest = max((int(abs(int(m))) for a in (x, entries) if a.size for m in (a.min(), a.max())), default=0)
    size = padded_size(x.shape[1])
    if not fits(largest, size):
        return _nearest_wide(x, entries)
    tx, te = walsh(x), walsh(entries)
    found = [_nearest_block(tx[at : at + BLOCK_ROWS], te) for at in range(0, len(x), BLOCK_ROWS)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([which for which, _ in found]), np.concatenate([far for _, far in found]) // size


def _nearest_block(tx: np.ndarray, te: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and scaled distance of transformed rows.

    Sums are kept for all pairs of rows and entries until few are left, from then on for these alone.
    """
    size = tx.shape[1]
    stops = sorted({max(1, size * q // 8) for q in range(1, 9)})
    columns = np.ascontiguousarray(tx.T), np.ascontiguousarray(te.T)
    total = np.zeros((len(tx), len(te)), np.int64)
    apart = np.empty_like(total)
    limit = np.full(len(tx), LARGEST)
    done = 0
    for stop in stops:
        for j in range(done, stop):
            np.subtract(columns[0][j][:, None], columns[1][j][None, :], out=apart)
            np.multiply(apart, apart, out=apart)
            total += apart
        done = stop
        guess = total.argmin(axis=1)  # a candidate; its whole distance bounds that of the nearest
        limit = np.minimum(limit, ((tx - te[guess]) ** 2).sum(axis=1))
        left = total <= limit[:, None]
        if np.count_nonzero(left) * FEW <= left.size:
            break
    row, entry = np.nonzero(left)
    part = total[row, entry]
    for stop in stops:
        if stop > done:
            part = part + ((tx[row, done:stop] - te[entry, done:stop]) ** 2).sum(axis=1)
            alive = part <= limit[row]
            row, entry, part, done = row[alive], entry[alive], part[alive], stop
    order = np.lexsort((entry, part, row))
    row, entry, part = row[order], entry[order], part[order]
    lead = np.flatnonzero(np.diff(row, prepend=-1))
    return entry[lead], part[lead]


def _nearest_wide(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[int]]:
    tx, te = (walsh(a.astype(object)).tolist() for a in (x, entries))
    found, far = [], []
    for row in tx:
        best, which = None, 0
        for i, entry in enumerate(te):
            total = 0
            for a, b in zip(row, entry):
                total += (a - b) ** 2
                if best is not None and total >= best:
                    break
            else:
                best, which = total, i
        found.append(which)
        far.append(best // len(row))
    return np.array(found, np.int64), far


@dataclass(frozen=True)
class Codebooks:
    """Entries of every part: ``entries[part, entry, position]``, whole numbers."""

    entries: np.ndarray

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The vector that a code stands for, with its padding."""
        numbers = [int(code[i : i + 2], 16) for i in range(0, 2 * self.parts, 2)]
        return np.concatenate([self.entries[p, n] for p, n in enumerate(numbers)]).tolist()


def part_matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """rows x parts x width; vectors shorter than ``parts * width`` end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), parts * width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(len(column), parts, width)


def sum_rows(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """Of a whole task: count and component sums of the parts of each entry, sums as high and low 32 bits."""
    parts, size, width = books.entries.shape
    n = np.zeros((parts, size), np.int64)
    high, low = np.zeros((parts, size, width), np.int64), np.zeros((parts, size, width), np.int64)
    for batch in slices(batches, ROWS_AT_ONCE):
        x = part_matrix(batch.column(0), parts, width)
        for p in range(parts):
            which, _ = nearest(x[:, p], books.entries[p])
            n[p] += np.bincount(which, minlength=size)
            np.add.at(high[p], which, x[:, p] >> 32)
            np.add.at(low[p], which, x[:, p] & 0xFFFFFFFF)
    part, entry = np.nonzero(n)
    sums = [pa.array(list(s), pa.list_(pa.int64())) for s in (high[part, entry], low[part, entry])]
    columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), *sums]
    yield pa.record_batch(columns, names=["part", "entry", "n", "high", "low"])


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry at the floored mean of the parts it is nearest to; unused entries stay."""
    sums = vectors.select("v").mapInArrow(
        lambda it: sum_rows(it, books), "part int, entry int, n long, high array<long>, low array<long>"
    )
    cells = sums.select("part", "entry", "n", F.posexplode(F.arrays_zip("high", "low")).alias("place", "s"))
    total = cells.groupBy("part", "entry", "place").agg(
        F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low")
    )
    entries = books.entries.copy()
    for r in total.collect():  # at most entries x dimension rows
        entries[r["part"], r["entry"], r["place"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    return Codebooks(entries)


def prepared(df: DataFrame, vector: str, columns: list[str], scale: int) -> DataFrame:
    """The usable vectors as whole numbers ``v`` beside ``columns``, stored once; components beyond a long end at its bounds."""
    kept = df.where(usable(F.col(f"`{vector}`")))
    picked = [F.col(f"`{c}`") for c in columns]
    return store(kept.select(*picked, whole_components(F.col(f"`{vector}`"), scale).alias("v")), "vectors")


def fit(
    vectors: DataFrame, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks | None:
    """Codebooks from prepared vectors; None when there are none.

    The first entries are the vectors with the smallest keys (null last, equal keys by vector), fewer if there are fewer.
    Vectors shorter than the longest, or than a multiple of ``parts``, are filled up with zeros.
    """
    longest = vectors.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    chosen = vectors.orderBy(F.col(f"`{key}`").asc_nulls_last(), "v").select("v").limit(entries).toArrow()
    start = part_matrix(chosen.column("v").combine_chunks(), parts, width)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds):
        books = moved(vectors, books)
    return books


def code_rows(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """All columns but the last, the vector; in its place code and error."""
    parts, _, width = books.entries.shape
    for batch in slices(batches, ROWS_AT_ONCE):
        x = part_matrix(batch.column(batch.num_columns - 1), parts, width)
        found = [nearest(x[:, p], books.entries[p]) for p in range(parts)]
        codes = np.stack([which for which, _ in found], axis=1).tolist()
        errors = [min(LARGEST, sum(map(int, e))) for e in zip(*[far for _, far in found])]
        columns = [pa.array(["".join(f"{i:02x}" for i in c) for c in codes], pa.string()), pa.array(errors, pa.int64())]
        yield pa.record_batch([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "code", "error"])


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Prepared vectors with code (two hex digits a part) and error (squared distance to what the code stands for)."""
    kinds = [f"`{c}` {t}" for c, t in vectors.dtypes if c != "v"]
    ordered = vectors.select(*[F.col(f"`{c}`") for c in vectors.columns if c != "v"], "v")
    return ordered.mapInArrow(lambda it: code_rows(it, books), ", ".join([*kinds, "code string", "error long"]))


def compressed(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024
) -> DataFrame:
    """One row per usable vector of ``df``: vec_id, code, error, label_error (summed over equal labels), codebooks_sha256.

    Vectors that are null or hold null, NaN or infinite components are dropped; a vector without components is all zeros.
    Repeated rows and ids are coded each, null labels make one group, an error beyond a long is the largest long. Without a usable
    vector no row is returned. Other columns are not read.
    """
    vectors = prepared(df.select(*[F.col(f"`{c}`") for c in (key, label, vector)]), vector, [key, label], scale)
    vectors = vectors.withColumnsRenamed({key: "vec_id", label: "label"})
    books = fit(vectors)
    kinds = dict(vectors.dtypes)
    if books is None:
        schema = f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string"
        return df.sparkSession.createDataFrame([], schema)
    coded = store(encode(vectors, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle() -> str:
    """SQL for ``compressed`` over embeddings: plain squared distances, every round written out."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, p, e, d, x FROM (
    SELECT r, p, e, x, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
    FROM pieces JOIN book{k} USING (p))
  QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1),""")
        if k < ROUNDS:
            steps.append(f"""
means{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, floor(sum(y)::DOUBLE / count(*))::BIGINT AS m
    FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e)),""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT greatest(1, ceil(max(len(v)) / {PARTS}.0))::BIGINT AS w FROM kept),
pieces AS MATERIALIZED (
  SELECT r, p, list_transform(range(w), lambda i: coalesce(v[p * w + i + 1], 0)) AS x
  FROM kept, width, (SELECT unnest(range({PARTS})) AS p)),
seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM pieces JOIN seeds USING (r)),{''.join(steps)}
coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
digest AS (
  SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), digest
"""
