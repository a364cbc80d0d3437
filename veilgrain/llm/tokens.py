"""Token ids of whole texts inside tasks, from a tokenizer file of the tokenizers library.

A space between two characters that are not white space always starts a new piece of a byte-level BPE, so a text is cut
there, each distinct chunk is encoded once by the library, and the ids of a text are put together from its chunks. Texts in which
that does not hold (runs of white space, special tokens) are encoded whole. The ids are the library's in either case.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

CACHE_IDS = 1 << 21  # ids kept per worker
CACHE_CHUNKS = 1 << 19
CHUNKS_TOGETHER = 200  # new chunks that the library encodes as one text
SPACE = "Ġ"  # fixed value: how byte-level vocabularies write a space
ODD = "᠎​⁠﻿"  # white space for some libraries or versions only


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Chunks(dict):
    """Number of a chunk; a new one gets the next number and is noted in ``new``."""

    new: list[str]

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class Encoder:
    """Encodes texts with one tokenizer file; keeps the ids of chunks seen before within fixed bounds.

    A chunk is named by its text without the space before it; the first one of a text, which has none, by FIRST and
    its text.
    """

    FIRST = "\0"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.cuts = bool(byte_level) and spec.get("normalizer") is None and spec.get("post_processor") is None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids whose text begins with a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self.joins = self.cuts and not any(" " in t for t in self.special)
        self._hold(Chunks(), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32))

    def _hold(self, at: Chunks, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        self.at, self.start, self.size, self.ids = at, start, size, ids
        self.at.new = []
        self.seen = np.zeros(len(at), np.int32)
        self.odd = np.array([self._odd(c) for c in at], bool)

    @staticmethod
    def _odd(chunk: str) -> bool:
        """Whether the text must not be cut after this chunk."""
        return chunk in ("", Encoder.FIRST) or chunk[-1].isspace() or chunk[-1] in ODD

    def _forget(self) -> None:
        """Keep the chunks that were met more than once, at most half of the bound."""
        often = np.flatnonzero(self.seen > 1)
        often = often[np.argsort(-self.seen[often], kind="stable")[: CACHE_CHUNKS // 2]]
        size = self.size[often]
        size = size[: int(np.searchsorted(np.cumsum(size), CACHE_IDS // 2))]
        often = np.sort(often[: len(size)])
        size = self.size[often]
        chosen = set(often.tolist())
        at = Chunks((c, i) for i, c in enumerate(c for c, k in self.at.items() if k in chosen))
        ids = self.ids[self._places(self.start[often], size)]
        self._hold(at, (np.cumsum(size) - size).astype(np.int32), size, ids)

    @staticmethod
    def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """start[0], start[0]+1, ... for each chunk in turn; sizes are positive."""
        if not len(size):
            return np.zeros(0, np.int32)
        step = np.ones(int(size.sum()), np.int32)
        step[0] = start[0]
        first = np.cumsum(size[:-1], dtype=np.int64)
        step[first] = start[1:] - start[:-1] - size[:-1] + 1
        return np.cumsum(step, dtype=np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (uint32) without special tokens added; null is empty."""
        texts = [t or "" for t in texts]
        if not self.cuts or not texts:
            return self._library(texts)
        if len(self.ids) > CACHE_IDS or len(self.at) > CACHE_CHUNKS:
            self._forget()
        parts: list[str] = []
        ends = []
        for t in texts:
            cut = t.split(" ")
            cut[0] = self.FIRST + cut[0]
            parts += cut
            ends.append(len(parts))
        k = np.fromiter(map(self.at.__getitem__, parts), np.int32, len(parts))
        if self.at.new:
            self._learn()
        self.seen += np.bincount(k, minlength=len(self.at)).astype(np.int32)
        last = np.array(ends, np.int64) - 1
        odd = self.odd[k]
        odd[last] = False
        whole = np.add.reduceat(odd, np.concatenate([[0], last[:-1] + 1])) > 0
        size = self.size[k]
        full = np.flatnonzero(size)  # the first chunk of a text may have no ids
        ids = self.ids[self._places(self.start[k[full]], size[full])]
        out = np.split(ids, np.cumsum(size, dtype=np.int64)[last[:-1]])
        again = [i for i, t in enumerate(texts) if whole[i] or any(s in t for s in self.special)]
        for i, x in zip(again, self._library([texts[i] for i in again])):
            out[i] = x
        return out

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Take in the ids of the new chunks.

        Most are encoded side by side in longer texts, which spares the library an object for each: a chunk without white
        space at its end begins with the only space of its own, so its ids begin with the only one that holds a space.
        """
        new, self.at.new = self.at.new, []
        odd = [self._odd(c) for c in new]
        alone = [o or c.startswith(self.FIRST) or any(s in c for s in self.special) for c, o in zip(new, odd)]
        together = [i for i, a in enumerate(alone) if not a] if self.joins else []
        apart = [i for i, a in enumerate(alone) if a] if self.joins else list(range(len(new)))
        found: list[np.ndarray] = []
        size = np.zeros(len(new), np.int64)
        order: list[int] = []
        for at in range(0, len(together), CHUNKS_TOGETHER):
            part = together[at : at + CHUNKS_TOGETHER]
            ids = self._library([" " + " ".join([new[i] for i in part])])[0]
            first = np.flatnonzero(self.spaced[ids])
            if len(first) != len(part):
                apart += part
                continue
            found.append(ids)
            size[part] = np.diff(first, append=len(ids))
            order += part
        for i, ids in zip(apart, self._library([new[i][1:] if new[i].startswith(self.FIRST) else " " + new[i] for i in apart])):
            found.append(ids)
            size[i] = len(ids)
            order.append(i)
        start = np.zeros(len(new), np.int64)
        start[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        self.start = np.concatenate([self.start, start.astype(np.int32)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.ids = np.concatenate([self.ids, *found]).astype(np.uint32)
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int32)])
        self.odd = np.concatenate([self.odd, np.array(odd, bool)])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path)


def largest_id(path: str) -> int:
    """The largest id that a tokenizer file can give."""
    return len(encoder(path).spaced) - 1
