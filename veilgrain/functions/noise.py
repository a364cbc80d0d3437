"""Noise drawn from keyed hashes.

A draw is a pure function of (secret, contract, window, cell, metric, draw number), so task retries,
re-reads and replays of a release reproduce the same noise instead of averaging it away.
The secret has to stay unknown to consumers. ``sha2`` is the digest for production; ``md5`` exists
because every SQL engine has it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 48


def _key(parts) -> Column:
    return F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])


def keyed_uniform(*parts, digest: str = "md5") -> Column:
    """Uniform on (0, 1) from the digest of the joined key parts."""
    key = _key(parts)
    hashed = F.md5(key) if digest == "md5" else F.sha2(key, 256)
    head = F.conv(F.substring(hashed, 1, HASH_BITS // 4), 16, 10).cast("bigint")
    return (head + F.lit(0.5)) / F.lit(float(2**HASH_BITS))


WORDS_PER_DIGEST = 8


def digest_words(n: int, *parts) -> list[Column]:
    """The SHA-256 digests needed for ``n`` 32-bit words; put them in columns, then read them with ``word_uniform``."""
    return [F.sha2(_key([*parts, f"w{i}"]), 256) for i in range(-(-n // WORDS_PER_DIGEST))]


def word_uniform(digest: Column, word: int) -> Column:
    """Uniform on (0, 1) from one 32-bit word of a digest: many coins for one hash."""
    head = F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")
    return (head + F.lit(0.5)) / F.lit(float(2**32))


def gaussian(*parts, digest: str = "md5") -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u1 = keyed_uniform(*parts, "g1", digest=digest)
    u2 = keyed_uniform(*parts, "g2", digest=digest)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def laplace(scale, *parts, digest: str = "md5") -> Column:
    """Zero-mean Laplace by inverse CDF."""
    centred = keyed_uniform(*parts, "l1", digest=digest) - 0.5
    return -F.signum(centred) * F.log(1.0 - 2.0 * F.abs(centred)) * scale


def two_sided_geometric(alpha, *parts, digest: str = "md5") -> Column:
    """Difference of two geometric draws, the integer counterpart of Laplace; ``alpha`` = exp(-eps/sensitivity)."""
    log_alpha = F.log(alpha if isinstance(alpha, Column) else F.lit(float(alpha)))
    u1 = keyed_uniform(*parts, "d1", digest=digest)
    u2 = keyed_uniform(*parts, "d2", digest=digest)
    return F.floor(F.log(u1) / log_alpha) - F.floor(F.log(u2) / log_alpha)


def classic_sigma(epsilon: float, delta: float) -> float:
    """Noise multiplier of the classic Gaussian mechanism, valid for epsilon <= 1."""
    if not 0 < epsilon <= 1 or not 0 < delta < 1:
        raise ValueError("the classic calibration needs 0 < epsilon <= 1 and 0 < delta < 1")
    return math.sqrt(2.0 * math.log(1.25 / delta)) / epsilon
