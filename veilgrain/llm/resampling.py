"""Importance resampling towards a target distribution over hashed word runs.

Every distinct word, with a delimiter on both sides, is a key of an Aho-Corasick automaton whose payload is the CRC-32 and
the length of the word. One scan of a text emits the payloads of its words in order; the CRC of a run of words is composed
from those of its words without touching the text again, and is the bucket of the feature. A worker's automaton
learns the words of each portion of text before it is scanned and starts anew at a fixed size, so its memory is bounded and every
word is in it. The buckets of a document are stored once, two bytes a feature; counts, gains and scores read that table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.llm import crc
from veilgrain.llm.words import slices
from veilgrain.operators.ranking import with_global_rank
from veilgrain.session import store

# A-Z to small letters, every other ASCII character but a-z and 0-9 to the delimiter, other bytes unchanged
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
PORTION = 1 << 21  # bytes of text that are learned and scanned together
MOST_WORDS = 1 << 18  # words after which an automaton starts anew
MOST_BYTES = 1 << 21  # bytes of words, likewise
LONG_WORD = 512  # bytes; longer words are hashed where they stand, as a key's memory grows with its length
BUCKETS = 10_000
SPACE = 32


def number_type(buckets: int) -> str:
    """Little-endian unsigned type of a stored bucket number."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


class Dictionary:
    """Automaton over delimited words; ``scan`` gives CRC and length of all words of a portion in order."""

    def __init__(self):
        self._start()

    def _start(self) -> None:
        self.automaton = ahocorasick.Automaton()
        self.known: set[bytes] = set()
        self.bytes = 0
        self.crc = np.zeros(0, np.uint32)
        self.length = np.zeros(0, np.int64)

    def learn(self, words: set[bytes]) -> None:
        new = words - self.known
        if len(self.known) + len(new) > MOST_WORDS or self.bytes + sum(map(len, new)) > MOST_BYTES:
            self._start()
            new = words
        if not new:
            return
        number = len(self.known)
        for number, word in enumerate(new, number):
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)  # a character for a byte
        self.automaton.make_automaton()
        self.known |= new
        self.bytes += sum(map(len, new))
        self.crc = np.concatenate([self.crc, np.fromiter(map(zlib.crc32, new), np.uint32, len(new))])
        self.length = np.concatenate([self.length, np.fromiter(map(len, new), np.int64, len(new))])

    def scan(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRCs and lengths of the words of all pieces, and the number of words of each piece.

        A piece is a folded text, or one word that is too long for the automaton.
        """
        self.learn({w for w in set(b" ".join(pieces).split()) if len(w) <= LONG_WORD})
        found: list[int] = []
        sizes, far = [], []
        for piece in pieces:
            if len(piece) > LONG_WORD and SPACE not in piece:
                far.append((len(found), zlib.crc32(piece), len(piece)))
                found.append(0)
                sizes.append(1)
            else:
                before = len(found)
                if self.known:
                    found += map(itemgetter(1), self.automaton.iter(f" {piece.decode('latin-1')} "))
                sizes.append(len(found) - before)
        at = np.array(found, np.int64)
        crcs = np.zeros(len(at), np.uint32) if not self.known else self.crc[at]
        lengths = np.zeros(len(at), np.int64) if not self.known else self.length[at]
        for i, c, n in far:
            crcs[i], lengths[i] = c, n
        return crcs, lengths, np.array(sizes, np.int64)


@lru_cache(maxsize=1)
def dictionary() -> Dictionary:
    """The worker's automaton."""
    return Dictionary()


_LONG = re.compile(rb"[^ ]{%d,}" % (LONG_WORD + 1))


def pieces_of(text: bytes) -> Iterator[bytes]:
    """Cut a text, at delimiters only, into folded pieces of about ``PORTION`` bytes and words longer than ``LONG_WORD``."""
    folded = text.translate(FOLD)
    at = 0
    for word in _LONG.finditer(folded) if len(folded) > LONG_WORD else ():
        yield from _cut(folded, at, word.start())
        yield word.group()
        at = word.end()
    yield from _cut(folded, at, len(folded))


def _cut(folded: bytes, at: int, end: int) -> Iterator[bytes]:
    while end - at > PORTION:
        cut = folded.rfind(b" ", at, at + PORTION)  # there is one, as longer words are cut out
        yield folded[at:cut]
        at = cut + 1
    if at < end:
        yield folded[at:end]


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and length of all words of some texts in order, and the number of words of each text."""
    crcs, lengths, owner, counts = [], [], [], np.zeros(len(texts), np.int64)
    held: list[bytes] = []

    def flush() -> None:
        c, n, sizes = dictionary().scan(held)
        crcs.append(c)
        lengths.append(n)
        np.add.at(counts, owner, sizes)
        held.clear()
        owner.clear()

    size = 0
    for i, text in enumerate(texts):
        for piece in pieces_of(text or b""):
            held.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= PORTION:
                flush()
                size = 0
    flush()
    return np.concatenate(crcs), np.concatenate(lengths), counts


def bucket_numbers(
    crcs: np.ndarray, lengths: np.ndarray, counts: np.ndarray, most_words: int, buckets: int
) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``most_words`` words of each text, text after text, and their number by text."""
    n = len(crcs)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - place  # words from here to the end of the text
    table = np.zeros((n, most_words), np.int64)
    run = crcs
    for k in range(most_words):
        if k:
            run = crc.joined(crc.with_byte(run[:-1], SPACE), crcs[k:], lengths[k:])
        table[: len(run), k] = run % np.uint32(buckets)
        if len(run) <= 1:
            break
    inside = np.arange(most_words)[None, :] < left[:, None]
    sizes = sum((np.maximum(counts - k, 0) for k in range(most_words)), np.zeros(len(counts), np.int64))
    return table[inside], sizes


def feature_rows(batches: Iterator[pa.RecordBatch], most_words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The column before the last as it is, then n_words, n_features and the buckets of the text in the last column."""
    kind = np.dtype(number_type(buckets))
    for batch in slices(batches, 1024):
        texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
        crcs, lengths, counts = words_of(texts)
        flat, sizes = bucket_numbers(crcs, lengths, counts, most_words, buckets)
        flat, ends = flat.astype(kind), np.cumsum(sizes)
        packed = [flat[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes.tolist())]
        columns = [pa.array(counts), pa.array(sizes), pa.array(packed, pa.binary())]
        names = [*batch.schema.names[:-1], "n_words", "n_features", "buckets"]
        yield pa.record_batch([*batch.columns[:-1], *columns], names=names)


def features(docs: DataFrame, key: str, text: str = "text", most_words: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_features, buckets (a number of ``number_type`` a feature).

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Null texts have none.
    """
    kinds = dict(docs.dtypes)
    schema = f"`{key}` {kinds[key]}, n_words long, n_features long, buckets binary"
    narrow = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    return narrow.mapInArrow(lambda it: feature_rows(it, most_words, buckets), schema)


def count_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a whole task, at most ``buckets`` rows."""
    total = np.zeros(buckets, np.int64)
    for batch in slices(batches):
        for raw in batch.column(0).to_pylist():
            total += np.bincount(np.frombuffer(raw, number_type(buckets)), minlength=buckets)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of a table by bucket; ``buckets`` numbers reach the driver, whatever the size of the table."""
    counted = found.select("buckets").mapInArrow(lambda it: count_rows(it, buckets), "bucket long, n long")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(buckets, np.int64)
    total[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed target share to the smoothed source share of each bucket, in whole thousandths."""
    size = len(source)
    top, bottom = int(source.sum()) + size, int(target.sum()) + size
    ratio = [float((t + 1) * top) / float((s + 1) * bottom) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weight_rows(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All columns but the last, buckets, in whose place comes the floored mean gain."""
    for batch in slices(batches):
        raws = batch.column(batch.num_columns - 1).to_pylist()
        rows = [np.frombuffer(r, number_type(len(gains))) for r in raws]
        means = [int(gains[r].sum()) // len(r) if len(r) else 0 for r in rows]
        names = [*batch.schema.names[:-1], "weight"]
        yield pa.record_batch([*batch.columns[:-1], pa.array(means, pa.int64())], names=names)


def gumbel_noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the hash of seed and key; a null key hashes as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
    most_words: int = 2,
    buckets: int = BUCKETS,
    key: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (1, 2, ... for drawn rows, else null), n_words.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred with the highest scores are drawn, ties to the
    smaller id, null ids last; rows equal in both are numbered in any fixed order. Texts of ``target`` (column text) give the
    target counts. Null and empty texts have weight 0. With an empty ``docs`` no row is returned; an empty target gives
    every bucket one smoothed count. Other columns are not read. The scored rows are stored once.
    """
    found = store(features(docs, key, most_words=most_words, buckets=buckets), "features")
    wanted = features(target.select("text", F.lit(0).alias("one")), "one", most_words=most_words, buckets=buckets)
    gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    kinds = dict(docs.dtypes)
    weighed = found.mapInArrow(
        lambda it: weight_rows(it, gains), f"`{key}` {kinds[key]}, n_words long, n_features long, weight long"
    )
    scored = weighed.select(
        F.col(f"`{key}`").alias("doc_id"),
        "n_words",
        "n_features",
        "weight",
        (F.col("weight") + gumbel_noise(F.col(f"`{key}`"), seed)).alias("score"),
        F.monotonically_increasing_id().alias("row"),
    )
    scored = store(scored, "scores")
    eligible = F.col("n_words") >= least_words
    draw = scored.where(eligible).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    ranked = with_global_rank(scored.where(eligible), order)
    out = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.where(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*out).unionByName(rest.select(*out))


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns.

    The row travels with its place: rows are numbered in the stored input, so repeated and null ids are kept apart.
    """
    held = store(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")), "rows")
    keyed = held.select(F.col("place").alias("doc_id"), F.col("row").getField("text").alias("text"))
    drawn = resampled(keyed, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("place"))
    return held.join(drawn, "place").select("row.*")


def oracle() -> str:
    """SQL for ``resampled`` over documents and benchmark with its standard parameters.

    The CRC of each distinct feature is taken byte by byte in a recursive query.
    """
    table = ", ".join(str(v) for v in crc.byte_table().tolist())
    capitals, small = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{small}'), '{word}')"
    runs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH RECURSIVE step AS (SELECT unnest(range(256)) AS b, unnest([{table}]::BIGINT[]) AS v),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
goal AS (SELECT {words} AS w FROM benchmark),
doc_features AS (SELECT r, unnest({runs}) AS f FROM docs),
goal_features AS (SELECT unnest({runs}) AS f FROM goal),
kinds AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM doc_features UNION SELECT f FROM goal_features)),
registers AS (
  SELECT f, h, 0 AS pos, 4294967295::BIGINT AS c FROM kinds
  UNION ALL
  SELECT f, h, pos + 1, xor(c >> 8, v) FROM registers
  JOIN step ON b = (xor(c, ('0x' || substr(h, 2 * pos + 1, 2))::BIGINT) & 255) WHERE 2 * pos < length(h)),
numbers AS (SELECT f, xor(c, 4294967295) % {BUCKETS} AS bucket FROM registers WHERE 2 * pos = length(h)),
source AS (SELECT bucket, count(*) AS s FROM doc_features JOIN numbers USING (f) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM goal_features JOIN numbers USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(
    ((coalesce(t, 0) + 1) * (sum(s) OVER () + {BUCKETS}))::DOUBLE
    / ((s + 1) * ((SELECT count(*) FROM goal_features) + {BUCKETS}))::DOUBLE))::BIGINT AS gain
  FROM source LEFT JOIN target USING (bucket)),
weights AS (
  SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM doc_features JOIN numbers USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((
      ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, n_words,
  CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank
FROM placed
"""
