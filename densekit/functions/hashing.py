"""Reproducible integer hashing for samples and draws, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1000003  # hash_bucket yields 0 .. BUCKETS - 1
_PRIME = 998244353


def hash_bucket(key, draw=0, seed: int = 1) -> Column:
    """Bucket of (key, draw, seed).

    Two rounds, as one linear round gives equally spaced draws within a key. Every operand is
    reduced first, so nothing exceeds 2^62 whatever the ids are.
    """
    key = F.col(key) if isinstance(key, str) else key
    draw = draw if isinstance(draw, Column) else F.lit(draw)
    prime = F.lit(_PRIME)
    mixed = F.pmod(
        F.pmod(key.cast("bigint"), prime) * 7919
        + F.pmod(draw.cast("bigint"), prime) * 104729
        + F.lit(seed * 1299709 % _PRIME).cast("bigint"),
        prime,
    )
    return F.pmod(mixed * mixed + mixed * 31, F.lit(BUCKETS))


def hash_wide(key, draw=0, seed: int = 1) -> Column:
    """Two buckets side by side: 0 .. BUCKETS^2 - 1, wide enough to index any table."""
    return hash_bucket(key, draw, seed) * BUCKETS + hash_bucket(key, draw, seed + 1)


def hash_bucket_sql(key: str, draw: str = "0", seed: int = 1) -> str:
    """The same in SQL text for non-negative ids, for checks outside Spark."""
    mixed = (
        f"(((({key}) % {_PRIME}) * 7919 + (({draw}) % {_PRIME}) * 104729"
        f" + {seed * 1299709 % _PRIME}) % {_PRIME})"
    )
    return f"(({mixed} * {mixed} + {mixed} * 31) % {BUCKETS})"


def hash_wide_sql(key: str, draw: str = "0", seed: int = 1) -> str:
    """`hash_wide` in SQL text."""
    return f"({hash_bucket_sql(key, draw, seed)} * {BUCKETS} + {hash_bucket_sql(key, draw, seed + 1)})"
