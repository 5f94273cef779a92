"""Random choices as hashes of a stable key.

The same row gives the same draw on any partitioning and after any retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: str, key: Column) -> Column:
    return F.concat(F.lit(f"{seed}:"), key.cast("string"))


def md5_order(seed: str, key: Column) -> Column:
    """A sort key that shuffles rows."""
    return F.md5(seeded(seed, key))


def u32(seed: str, key: Column) -> Column:
    """An unsigned 32-bit number as BIGINT."""
    return F.conv(F.substring(md5_order(seed, key), 1, 8), 16, 10).cast("bigint")


def pick(seed: str, key: Column, n: int) -> Column:
    """A number 0..n-1."""
    return u32(seed, key) % n


def frac(seed: str, key: Column) -> Column:
    """A number in [0, 1)."""
    return u32(seed, key) / F.lit(4294967296.0)


def pick_from(seed: str, key: Column, values: list) -> Column:
    """One value of a fixed list."""
    options = F.array(*[F.lit(v) for v in values])
    return F.get(options, pick(seed, key, len(values)).cast("int"))


def first_byte(key: Column) -> Column:
    """First byte of the md5 digest, 0..255."""
    return F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int")


def held_out(key: Column, n: int) -> Column:
    """Digest byte modulo n. Close to 1/n, not exactly (n=40 gives 7/256)."""
    return first_byte(key) % n == 0
