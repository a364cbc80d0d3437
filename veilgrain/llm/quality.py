"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Their accuracies are estimated by
expectation-maximisation without any hand label: documents are counted by vote pattern, and the pattern counts, at most
``3 ** len(LABELLERS)`` rows whatever the size of the corpus, are all that the estimate needs. The posterior labels then
train a linear scorer over hashed features of the text on a bounded sample of documents, and the scorer judges every
document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from veilgrain.llm.words import CACHE_ENTRIES, CACHES, slices
from veilgrain.session import store

GOOD, BAD, NONE = 2, 1, 0  # votes; a pattern is their number in base 3
BITS = 12  # features are hashed into 2 ** BITS weights
TRAIN_ROWS = 8192  # documents that the scorer is fitted on, at most

# fixed values: what each labeller measures, the share from which it votes bad, the share from which it votes good;
# the order of the two says which way it reads. A labeller of one defect has no vote for good: lack of it proves little
LABELLERS = {
    "plain_words": (0.60, 0.88),  # words of letters, a capital at the front at most, punctuation behind at most
    "symbol_words": (0.30, None),  # words with a run of symbols
    "upper_words": (0.40, None),  # words of capitals only, of two letters or more
    "bars": (0.15, None),  # words that are a lone separator
    "repeats": (0.45, None),  # words equal to the word before
    "top_word": (0.45, None),  # share of the most frequent word
    "few_kinds": (0.80, None),  # lack of distinct words against texts of that length
    "no_letters": (0.45, 0.08),  # words without a letter
    "small_letters": (0.45, 0.80),  # words that hold a small letter
}
SYMBOLS = re.compile(r"[!?#*$%&^~=_<>]{2,}")
LONE = re.compile(r"^[|/\\•·*=_~-]+$")
PLAIN = re.compile(r"^[\"'(]*[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?)\"']*$")


def word_flags(word: str) -> int:
    """What the labellers need of a word: symbols 1, capitals 2, lone separator 4, no letter 8, plain 16, small 32."""
    letters = [c for c in word if c.isalpha()]
    upper = len(letters) >= 2 and all(c.isupper() for c in letters)
    symbols = bool(SYMBOLS.search(word))
    plain = bool(PLAIN.match(word)) and not upper and not symbols
    small = any(not c.isupper() for c in letters)
    return symbols | upper << 1 | bool(LONE.match(word)) << 2 | (not letters) << 3 | plain << 4 | small << 5


def shape(word: str) -> str:
    """Runs of capitals, small letters, digits, other characters by themselves."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    out: list[str] = []
    for k in kinds:
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)


@lru_cache(maxsize=1 << 16)
def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & ((1 << BITS) - 1)


def ending(word: str) -> int:
    """Bucket of the last two characters unless both are letters or plain punctuation, else -1."""
    tail = word[-2:]
    return -1 if all(c.isalpha() or c in ".,;:" for c in tail) else bucket("e" + tail)


class WordCache(dict):
    """(number, flags, shape bucket, ending bucket) of a word; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            raise OverflowError
        number = self[word] = len(self)
        self.rows[number] = word_flags(word), bucket("s" + shape(word)), ending(word)
        return number

    def reset(self) -> None:
        self.clear()
        self.rows = np.zeros((CACHE_ENTRIES, 3), np.int64)


WORDS = WordCache()
WORDS.reset()
CACHES.extend([WORDS.reset, bucket.cache_clear])


def numbered(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number and (flags, shape, ending) of every word of one text."""
    try:
        n = np.fromiter(map(WORDS.__getitem__, words), np.int64, len(words))
    except OverflowError:
        WORDS.reset()
        distinct = dict.fromkeys(words)
        if len(distinct) > CACHE_ENTRIES:  # one text with more distinct words than the cache holds
            rows = [(word_flags(w), bucket("s" + shape(w)), ending(w)) for w in distinct]
            index = {w: i for i, w in enumerate(distinct)}
            n = np.array([index[w] for w in words])
            return n, np.array(rows, np.int64)[n]
        n = np.fromiter(map(WORDS.__getitem__, words), np.int64, len(words))
    return n, WORDS.rows[n]


def look(text: str | None, features_too: bool = True) -> tuple[dict[str, float], np.ndarray]:
    """Labeller shares and sorted distinct feature buckets of a whole text; a text without words has no shares."""
    words = (text or "").split()
    if not words:
        return {}, np.array([bucket("empty")], np.int64)
    n, table = numbered(words)
    total = len(n)
    flags = table[:, 0]
    share = {
        "plain_words": (flags & 16 > 0).sum() / total,
        "small_letters": (flags & 32 > 0).sum() / total,
        "symbol_words": (flags & 1 > 0).sum() / total,
        "upper_words": (flags & 2 > 0).sum() / total,
        "bars": (flags & 4 > 0).sum() / total,
        "repeats": (n[1:] == n[:-1]).sum() / total,
        "no_letters": (flags & 8 > 0).sum() / total,
    }
    if total >= 30:
        ordered = np.sort(n)
        ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]), total - 1)
        share["top_word"] = np.diff(ends, prepend=-1).max() / total
        # long natural texts repeat words, too: count kinds against the kinds a text of this length should have
        share["few_kinds"] = 1 - min(1.0, len(ends) / total * max(1.0, (total / 100) ** 0.35))
    if not features_too:
        return share, np.zeros(0, np.int64)
    features = [bucket(f"{k}:{math.floor(v * 10)}") for k, v in share.items()]
    # shapes and odd endings that occur, and those that make up much of the text
    for column, mark in ((1, 1), (2, 2)):
        part = np.bincount(table[:, column] + 1)
        kinds = np.flatnonzero(part) - 1
        part = part[kinds + 1] / total
        for level, least in enumerate((0.0, 0.1, 0.4)):
            here = kinds[(part > least) & (kinds >= 0)]
            features.extend(((here * 2654435761 + level * 40503 + mark * 97) % (1 << BITS)).tolist())
    return share, np.unique(np.array(features, np.int64))


def pattern(share: dict[str, float]) -> int:
    """Votes of all labellers as one number; no share means no vote."""
    out = 0
    for name, (bad, good) in LABELLERS.items():
        s = share.get(name)
        if s is None:
            vote = NONE
        elif good is not None and good > bad:
            vote = GOOD if s >= good else BAD if s < bad else NONE
        else:
            vote = BAD if s >= bad else GOOD if good is not None and s <= good else NONE
        out = out * 3 + vote
    return out


def votes(patterns: np.ndarray) -> np.ndarray:
    """Matrix patterns x labellers of votes."""
    m = len(LABELLERS)
    return np.stack([patterns // 3 ** (m - 1 - j) % 3 for j in range(m)], axis=1)


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> dict[str, np.ndarray]:
    """EM for a class prior and P(vote | class) of each labeller, from pattern counts.

    Starts from any bad vote, smooths each estimate by one pseudo vote, and keeps a
    labeller's better-than-chance reading: a bad vote never counts in favour of a document. Without any bad vote nothing tells
    the classes apart, and every document keeps the starting value.
    """
    v, counts = votes(patterns), counts.astype(float)
    bad = (v == BAD).sum(axis=1)
    rounds = rounds if counts[bad > 0].sum() else 0
    p = np.where(bad > 0, 0.9, 0.02)  # P(bad)
    onehot = np.stack([v == k for k in (NONE, BAD, GOOD)], axis=2).astype(float)
    prior, table = np.array([0.98, 0.02]), np.full((2, v.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        w = np.stack([counts * (1 - p), counts * p])  # class (good, bad) x pattern
        prior = (w.sum(axis=1) + 1) / (counts.sum() + 2)
        table = np.einsum("cp,pjk->cjk", w, onehot) + 1
        table /= table.sum(axis=2, keepdims=True)
        table[1, :, 1] = np.maximum(table[1, :, 1], table[0, :, 1])
        table[0, :, 2] = np.maximum(table[0, :, 2], table[1, :, 2])
        score = np.log(prior)[:, None] + np.einsum("pjk,cjk->cp", onehot[:, :, 1:], np.log(table[:, :, 1:]))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return {"prior": prior, "table": table, "posterior_bad": p}


def fit_scorer(rows: list[list[int]], bad: np.ndarray, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on binary hashed features with soft labels; weights with the intercept last.

    Plain gradient descent with a per-weight step, both classes given the same total weight.
    """
    size = 1 << BITS
    weights = np.zeros(size + 1)
    if not rows:
        return weights
    lengths = np.array([len(r) for r in rows])
    flat, doc = np.concatenate([np.asarray(r, np.int64) for r in rows]), np.repeat(np.arange(len(rows)), lengths)
    scale = 1 / np.sqrt(np.maximum(lengths, 1))
    mass = np.where(bad > 0.5, 0.5 / max(bad.sum(), 1.0), 0.5 / max((1 - bad).sum(), 1.0))
    past = np.full(size + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(doc, weights=weights[flat], minlength=len(rows)) * scale + weights[size]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - bad) * mass
        grad = np.append(np.bincount(flat, weights=(g * scale)[doc], minlength=size), g.sum()) + ridge * weights
        past += grad**2
        weights -= rate * grad / np.sqrt(past)
    return weights


def score_of(features: np.ndarray, weights: np.ndarray) -> float:
    """P(bad) of one document."""
    z = weights[features].sum() / math.sqrt(max(len(features), 1)) + weights[-1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def look_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the last, then pattern and features of the text in the last."""
    for batch in slices(batches):
        seen = [look(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        more = [pa.array([pattern(s) for s, _ in seen], pa.int32()), pa.array([f for _, f in seen], pa.list_(pa.int32()))]
        yield pa.record_batch([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "pattern", "features"])


def looked(docs: DataFrame, *keep: Column) -> DataFrame:
    """Columns ``keep``, h (hash of id and text), pattern and features of every row of ``docs``; texts are read once."""
    columns = [*keep, F.xxhash64("doc_id", "text").alias("h")]
    narrow = docs.select(*columns, "text")
    kinds = StructType(narrow.schema.fields[:-1]).add("pattern", IntegerType()).add("features", ArrayType(IntegerType()))
    return narrow.mapInArrow(look_rows, kinds)


def scorer(weights: np.ndarray) -> Callable[[str], Column]:
    """P(good) of a column of features."""

    @F.arrow_udf("double")
    def good(features: pa.Array) -> pa.Array:
        sizes = np.diff(features.offsets.to_numpy())
        row = np.repeat(np.arange(len(features)), sizes)
        total = np.bincount(row, weights=weights[features.flatten().to_numpy(zero_copy_only=False)], minlength=len(features))
        z = total / np.sqrt(np.maximum(sizes, 1)) + weights[-1]
        return pa.array(1 - 1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return good


def sample_rows(keyed: DataFrame, rows: int) -> pd.DataFrame:
    """Votes and features of the ``rows`` rows with the smallest ``h``, looked at here if they have not been yet."""
    chosen = keyed.orderBy("h").limit(rows)
    if "features" in keyed.columns:
        return chosen.select("pattern", "features").toPandas()
    return chosen.select("text").mapInArrow(look_rows, "pattern int, features array<int>").toPandas()


def fit_looked(seen: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[int, float]]:
    """Weights of the scorer and P(bad) by vote pattern, from a stored result of ``looked``.

    Pattern counts cover all documents. The sample for the scorer is the ``train_rows`` documents with the smallest hash of
    id and text, so copies of a text under many ids count as often as they occur and no more; both results that reach the
    driver have a fixed bound.
    """
    counted = seen.groupBy("pattern").agg(F.count("*").alias("n")).toPandas().sort_values("pattern")  # at most 3 ** 9 rows
    model = fit_labellers(counted["pattern"].to_numpy(), counted["n"].to_numpy())
    posterior = dict(zip(counted["pattern"].tolist(), model["posterior_bad"].tolist()))
    total = int(counted["n"].sum())
    least = -(1 << 63) + (1 << 64) * 2 * train_rows // max(total, 1)
    narrow = seen.where(F.col("h") < least) if total > 2 * train_rows else seen  # few rows are sorted
    rows = sample_rows(narrow, train_rows)
    if narrow is not seen and len(rows) < train_rows:  # hashes far from even: many rows equal in id and text
        rows = sample_rows(seen, train_rows)
    bad = np.array([posterior[p] for p in rows["pattern"]])
    return fit_scorer(list(rows["features"]), bad), posterior


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[int, float]]:
    """``fit_looked`` of every row of ``docs``."""
    return fit_looked(store(looked(docs), "looked"), train_rows)


def classified(
    docs: DataFrame,
    threshold: float = 0.5,
    train_rows: int = TRAIN_ROWS,
    model: tuple[np.ndarray, dict[int, float]] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, pattern (votes), posterior and score (both P(good)), keep.

    A document is kept when its score reaches the threshold. Null and empty texts get no votes and are judged by the
    class prior like any silent document, so they are kept unless most of the corpus is junk. Repeated rows get equal
    results. With an empty table nothing is fitted and no row returned. Other columns are not read. Votes and features are
    stored once, some hundred bytes a document.
    """
    seen = store(looked(docs, F.col("doc_id")), "looked")
    weights, posterior = model or fit_looked(seen, train_rows)
    table = [(int(p), float(1 - b)) for p, b in posterior.items()]
    by_pattern = F.broadcast(docs.sparkSession.createDataFrame(table, "pattern int, posterior double"))  # 3 ** 9 rows
    scored = seen.join(by_pattern, "pattern", "left").withColumn("score", scorer(weights)("features"))
    return scored.select("doc_id", "pattern", "posterior", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with the same columns, whatever their names.

    Texts are looked at once for the fit and once more for the filter: a row kept beside its features would take the disk of the
    whole corpus.
    """
    weights, _ = fit(docs, train_rows)
    at = docs.columns.index("text")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = [1 - score_of(look(t)[1], weights) >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with a dot cannot be passed on
    return plain.mapInArrow(judged, plain.schema).toDF(*docs.columns)
