"""Deterministic pseudo-random numbers from row ids.

``rand()`` and ``randomSplit`` depend on how rows are partitioned.  Hashing the
id gives the same answer for any partitioning, on any retry, and needs no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_digest(row_id: Column | str, seed: int | str = 42) -> Column:
    """md5 of ``seed:id`` as 32 hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(row_id).cast("string")))


def row_hash(row_id: Column | str, seed: int | str = 42) -> Column:
    """The first 32 bits of ``row_digest`` as a bigint in [0, 2**32)."""
    return F.conv(F.substring(row_digest(row_id, seed), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def bucket(row_id: Column | str, seed: int | str, n: int) -> Column:
    """A bucket in [0, n) that depends on the id and the seed only."""
    return row_hash(row_id, seed) % F.lit(n)


def key_digest(key: Column | str) -> Column:
    """SHA-256 of a grouping key, so that long texts are not shuffled as keys.

    Strings are hashed as they are.  For any other type pass ``to_json`` of the
    key (see ``array_key``), which keeps distinct values distinct.
    """
    return F.unhex(F.sha2(_col(key), 256))


def array_key(tokens: Column | str) -> Column:
    """An unambiguous string form of an array, usable with ``key_digest``."""
    return F.to_json(_col(tokens))
