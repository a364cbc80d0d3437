"""Quality rules with robust multivariate outliers.

Counts of every whole text are turned into a short vector of transformed statistics. For each language and source the minimum
covariance determinant estimates centre and covariance from the three quarters of its documents that lie closest together, and
a document is rejected when its Mahalanobis distance from that centre is beyond a tail of the chi-square distribution.

Each step of the estimate is one aggregation over the stored vectors: distances are counted in narrow bins, and every bin keeps the
sums of its vectors and of their products, so the closest three quarters and their covariance follow from at most ``BINS`` rows a
group. Vectors are whole numbers of 1 / ``UNIT``, so sums do not depend on the order of additions and reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.session import store

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks")
WINDOW = 5  # words of a window
PORTION = 1 << 22  # bytes of text looked at together; a longer text is looked at by itself
UNIT = 256
COVER = 0.75  # share of a group's documents that the estimate rests on
STEPS = 12  # concentration steps, at most; they end when no estimate moves
LEAST_GROUP = 50  # documents; smaller groups of a language are estimated together, and all languages' rest likewise
BINS_PER_E, LOW_BIN, HIGH_BIN = 16, -64, 160  # bins of ln(squared distance); both ends are open
BINS = HIGH_BIN - LOW_BIN + 1
TAIL = 1e-6  # share of a normal population beyond the limit
# least standard deviation of each statistic: what hardly varies in a group must not reject small differences
FLOORS = {
    "word_length": 0.15,  # ln of the mean word length
    "symbols": 0.25,  # twice the root of symbols per word
    "dup_lines": 0.15,  # twice the root of repeated lines per word
    "repeats": 0.25,  # arcsine root of the share of words in repeated windows
    "capitals": 0.15,  # likewise of the share of A-Z
    "marks": 0.15,  # likewise of the share of ASCII characters that are neither letter, digit nor space
}
DIM = len(FLOORS)

_BYTES = np.arange(256)
IS_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
IS_CAPITAL = (_BYTES >= 65) & (_BYTES <= 90)
IS_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
IS_LETTER = IS_CAPITAL | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57))
IS_MARK = (_BYTES < 128) & ~IS_LETTER & ~IS_SPACE
IS_CHARACTER = ((_BYTES & 0xC0) != 0x80) & ~IS_SPACE  # first byte of a code point


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``PORTION`` bytes in the last column."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + PORTION, side="right")))
            yield batch.slice(at, end - at)
            at = end


def window_hashes(codes: np.ndarray, doc: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of document and words of each window."""
    h = doc[starts].astype(np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[starts + k].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h


def repeated(codes: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words that occurs twice or more in their document.

    Windows are sorted by a 64-bit hash and neighbours of one hash are compared word by word; a document in which two
    different windows share a hash is counted with its windows themselves.
    """
    out = np.zeros(len(codes), bool)
    n = len(codes) - width + 1
    if n < 2:
        return out
    starts = np.flatnonzero(doc[:n] == doc[width - 1 :])
    h = window_hashes(codes, doc, starts, width)
    order = np.argsort(h, kind="stable")
    near = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(near):
        return out
    a, b = starts[order[near]], starts[order[near + 1]]
    same = doc[a] == doc[b]
    for k in range(width):
        same &= codes[a + k] == codes[b + k]
    hits = np.union1d(a[same], b[same])
    clash = np.unique(doc[np.concatenate([a[~same], b[~same]])])
    if len(clash):
        hits = hits[~np.isin(doc[hits], clash)]
        more = []
        for d in clash.tolist():
            own = starts[doc[starts] == d]
            _, which, times = np.unique(
                np.stack([codes[own + k] for k in range(width)], axis=1), axis=0, return_inverse=True, return_counts=True
            )
            more.append(own[times[which.ravel()] > 1])
        hits = np.concatenate([hits, *more])
    for k in range(width):
        out[hits + k] = True
    return out


def counts_of(texts: pa.Array) -> list[np.ndarray]:
    """The columns ``COUNTS`` of some texts without nulls."""
    n = len(texts)
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    held = raw.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held and n else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    space = IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = ~space[begins]  # whatever stands at the end of the text before
    n_words = per_text(first)
    flat = pc.list_flatten(pc.ascii_split_whitespace(texts.cast(pa.large_string())))
    codes = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(n), n_words)
    again = repeated(codes.astype(np.int64), doc, WINDOW)
    return [
        n_words,
        per_text(IS_CHARACTER[data]),
        per_text(IS_SYMBOL[data]),
        duplicate_lines(texts),
        np.bincount(doc[again], minlength=n).astype(np.int64),
        per_text(IS_CAPITAL[data]),
        per_text(IS_MARK[data]),
    ]


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    flat, doc = pc.list_flatten(lines), pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0)
    doc = doc[full.to_numpy(zero_copy_only=False)]
    codes = flat.filter(full).dictionary_encode()
    key = doc.astype(np.int64) * max(1, len(codes.dictionary)) + codes.indices.to_numpy(zero_copy_only=False)
    kinds = np.unique(key) // max(1, len(codes.dictionary))
    return np.bincount(doc, minlength=len(texts)) - np.bincount(kinds, minlength=len(texts))


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the last, then ``COUNTS`` of the text in the last."""
    for batch in portions(batches):
        found = counts_of(pc.fill_null(batch.column(batch.num_columns - 1), ""))
        columns = [*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in found]]
        yield pa.record_batch(columns, names=[*batch.schema.names[:-1], *COUNTS])


def statistics() -> list[Column]:
    """The transformed statistics in the order of ``FLOORS`` as whole numbers of 1 / ``UNIT``; the text needs a word."""
    words, chars = F.col("n_words"), F.col("word_chars")

    def share(part: Column, whole: Column) -> Column:
        return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), part / whole)))

    parts = (
        F.log(chars / words),
        2 * F.sqrt(F.col("n_symbols") / words),
        2 * F.sqrt(F.col("n_dup_lines") / words),
        share(F.col("n_repeat_words"), words),
        share(F.col("n_capitals"), chars),
        share(F.col("n_marks"), chars),
    )
    return [F.floor(p * UNIT).alias(f"x{i}") for i, p in enumerate(parts)]


def chi_square_limit(tail: float, dim: int) -> float:
    """Squared distance that a share ``tail`` of a normal population exceeds (Wilson and Hilferty's approximation, within 5 %)."""
    part = 2 / (9 * dim)
    return dim * (1 - part + NormalDist().inv_cdf(1 - tail) * math.sqrt(part)) ** 3


def consistency(cover: float, dim: int) -> float:
    """Factor that makes the covariance of the closest share ``cover`` of a normal population that of the whole."""
    limit = chi_square_limit(1 - cover, dim)
    z = ((limit / (dim + 2)) ** (1 / 3) - 1 + 2 / (9 * (dim + 2))) / math.sqrt(2 / (9 * (dim + 2)))
    return cover / NormalDist().cdf(z)


def squared_distance() -> Column:
    """Mahalanobis distance, squared, from columns x0... and the arrays centre and inverse."""
    x = [F.col(f"x{i}") - F.col("centre")[i] for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            total = total + x[i] * x[j] * F.col("inverse")[i * DIM + j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
ESTIMATE = "grp string, n long, centre array<double>, inverse array<double>"


def inverse_of(covariance: np.ndarray) -> list[float]:
    floors = np.array(list(FLOORS.values())) * UNIT
    return np.linalg.inv(covariance + np.diag(floors**2)).ravel().tolist()


def concentrated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre and inverse covariance of the closest ``COVER`` of each group, from the sums of its bins."""
    factor = consistency(COVER, DIM)
    for frame in frames:
        rows = []
        for group, bins in zip(frame["grp"], frame["bins"]):
            bins = sorted(bins, key=lambda b: b["bin"])
            upto = np.cumsum([b["n"] for b in bins])
            last = int(np.searchsorted(upto, COVER * upto[-1]))
            inside = bins[: last + 1]
            n = int(upto[last])
            total = [sum(int(b[f"s{i}"]) for b in inside) for i in range(DIM)]
            spread = np.zeros((DIM, DIM))
            for i, j in PAIRS:  # whole numbers up to the last division
                product = sum(int(b[f"s{i}_{j}"]) for b in inside)
                spread[i, j] = spread[j, i] = (product * n - total[i] * total[j]) / (n * n)
            rows.append((group, int(upto[-1]), [t / n for t in total], inverse_of(spread * factor)))
        yield pd.DataFrame(rows, columns=["grp", "n", "centre", "inverse"])


def started(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first estimate of each group: medians, and spread from the median distance to them."""
    for frame in frames:
        spreads = [inverse_of(np.diag((1.4826 * np.array(list(m), float)) ** 2)) for m in frame["mads"]]
        yield pd.DataFrame({"grp": frame["grp"], "n": frame["n"], "centre": frame["centre"], "inverse": spreads})


def medians(vectors: DataFrame, name: str, parts: list[Column]) -> DataFrame:
    """Exact medians by group; whole numbers have few distinct values, so a group's state is small."""
    return vectors.groupBy("grp").agg(
        F.count("*").alias("n"), F.array(*[F.percentile(p, F.lit(0.5)) for p in parts]).alias(name)
    )


def fit(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """Estimates (``ESTIMATE``, a row per group) from vectors (grp, x0, x1, ...); a stored table."""
    x = [F.col(f"x{i}") for i in range(DIM)]
    centre = store(medians(vectors, "centre", x), "medians")
    off = [F.abs(x[i] - F.col("centre")[i]) for i in range(DIM)]
    spread = medians(vectors.join(centre.select("grp", "centre"), "grp"), "mads", off).select("grp", "mads")
    estimate = store(centre.join(spread, "grp").mapInPandas(started, ESTIMATE), "estimates")
    level = F.floor(BINS_PER_E * F.log(squared_distance() + 1e-9))
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(DIM)]
    sums += [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in PAIRS]
    for _ in range(steps):
        placed = vectors.join(estimate, "grp").withColumn(
            "bin", F.least(F.greatest(level, F.lit(LOW_BIN)), F.lit(HIGH_BIN))
        )
        binned = placed.groupBy("grp", "bin").agg(F.count("*").alias("n"), *sums)
        packed = F.struct("bin", "n", *[f"s{i}" for i in range(DIM)], *[f"s{i}_{j}" for i, j in PAIRS])
        bins = binned.groupBy("grp").agg(F.collect_list(packed).alias("bins"))  # at most BINS rows
        new = store(bins.mapInPandas(concentrated, ESTIMATE), "estimates")
        old = estimate.select("grp", F.col("centre").alias("c"), F.col("inverse").alias("i"))
        moved = new.join(old, "grp").where("centre != c OR inverse != i")
        estimate = new
        if moved.isEmpty():
            break
    return estimate


def grouped(rows: DataFrame) -> DataFrame:
    """Add ``grp``: language and source, or the rest of a language, or the rest of all, where documents are few."""

    def named(column: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("-"))

    own = F.concat(named("lang"), F.lit("\0"), named("source"))
    language = F.concat(F.lit("rest "), named("lang"))
    sizes = rows.groupBy(own.alias("own"), language.alias("language")).agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < LEAST_GROUP)
    rest = small.groupBy("language").agg(F.sum("n").alias("m"))
    names = sizes.join(rest, "language", "left").select(
        "own",
        F.when(F.col("n") >= LEAST_GROUP, F.col("own"))
        .when(F.col("m") >= LEAST_GROUP, F.col("language"))
        .otherwise(F.lit("rest"))
        .alias("grp"),
    )
    return rows.withColumn("own", own).join(names, "own").drop("own")


def judged(
    docs: DataFrame,
    least_words: int = 10,
    most_repeats_percent: int = 20,
    tail: float = TAIL,
    key: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    ``base_failed`` is true for texts of fewer than ``least_words`` words (null and empty ones among them) or with more than
    ``most_repeats_percent`` of their words in repeated windows; these take no part in the estimates and have no distance.
    All others are kept while their squared Mahalanobis ``distance`` within their language and source stays below the
    chi-square limit for ``tail``. A null language or source is a value of its own. Repeated rows get equal results. An empty
    table gives no rows. Other columns are not read.
    """
    kinds = dict(docs.dtypes)
    # the texts are read once; their counts, some hundred bytes a document, serve all later steps
    narrow = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"),
    )
    schema = f"doc_id {kinds[key]}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    failed = (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > most_repeats_percent * F.col("n_words")
    )
    rows = store(narrow.mapInArrow(count_rows, schema).withColumn("base_failed", failed), "counts")
    passed = store(grouped(rows.where("NOT base_failed")).select("*", *statistics()), "vectors")
    estimate = fit(passed.select("grp", *[f"x{i}" for i in range(DIM)]))
    measured = passed.join(estimate.drop("n"), "grp").withColumn("distance", squared_distance())
    good = measured.withColumn("kept", F.col("distance") <= chi_square_limit(tail, DIM))
    bad = rows.where("base_failed").select("*", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return good.select(*out).unionByName(bad.select(*out))


def keep_typical(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns; repeated and null ids are judged by row."""
    held = store(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")), "rows")
    fields = [F.col("row").getField(c).alias(c) for c in ("lang", "source", "text")]
    kept = judged(held.select("place", *fields), key="place", **how).where("kept").select(F.col("doc_id").alias("place"))
    return held.join(kept, "place").select("row.*")
