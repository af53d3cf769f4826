"""Keys, seeded order and seeded uniform numbers.

Randomness is always derived from ``md5(seed || '|' || key)``: it does not
change when a task is retried, does not depend on partitioning, and DuckDB
computes the very same value, so seeded samples can be checked by SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**52: the first 13 hex digits of an md5 give a uniform integer in [0, 2**52).
_U52 = float(2**52)


def _cols(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def seeded_key(seed: int | str, keys: Sequence[str | Column]) -> Column:
    """md5 of ``seed|k1|k2…`` (nulls skipped, as ``concat_ws`` does in both engines)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in _cols(keys)]))


def seeded_order(seed: int | str, keys: Sequence[str | Column]) -> list[Column]:
    """Total seeded order: the md5 key, then the key columns themselves as tie-break."""
    return [seeded_key(seed, keys)] + _cols(keys)


def seeded_uniform(seed: int | str, keys: Sequence[str | Column]) -> Column:
    """A retry-stable uniform number in [0, 1) derived from the seeded md5."""
    h = seeded_key(seed, keys)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(_U52)


def sa_key(state: str | Column, action: str | Column) -> Column:
    """Canonical (state, action) key used to group equal pairs."""
    return joint_key([state, action])


def joint_key(parts: Sequence[str | Column]) -> Column:
    """One text for several values, different for different values: each part is
    ``length:text`` and a null part is ``-``, joined by ``|``."""
    texts = [c.cast("string") for c in _cols(parts)]
    return F.concat_ws("|", *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def bucket_of(key: Column, buckets: int) -> Column:
    """Stable bucket for a key (bucketing and salting only, never identity)."""
    return F.pmod(F.xxhash64(key), F.lit(buckets))
