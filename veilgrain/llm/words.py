"""Words of whole texts inside tasks, and 64-bit hashes of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# ASCII white space; bytes.split() splits at exactly these
WORD = r"[^\x20\x09-\x0D]+"
CACHE_ENTRIES = 1 << 18
ROWS_AT_ONCE = 256


class HashCache(dict):
    """64-bit hash of a word's bytes, kept until ``CACHE_ENTRIES`` words are known."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = HashCache()
CACHES = [HASHES.clear]  # what empties the caches that tasks leave in a worker


def forget() -> None:
    """Empty the word caches of a worker, which other jobs' tasks have filled and which outlive them."""
    for empty in CACHES:
        empty()


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of every word of a text after lower-casing A-Z; null and blank texts have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a task holds the Python strings of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
