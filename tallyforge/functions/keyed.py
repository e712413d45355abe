"""Randomness and identity from keys: the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def opaque_id(*parts: Column | str) -> Column:
    """32 hexadecimal digits from a keyed digest."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def shuffle_key(seed: int | str, key: Column) -> Column:
    """A sort key in random order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def uniform(seed: int | str, key: Column) -> Column:
    """A number in (0, 1) from 48 bits of the key's digest."""
    return (F.conv(F.substring(shuffle_key(seed, key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def gumbel(weight: Column, u: Column) -> Column:
    """The key whose largest values are a weighted sample without replacement."""
    return F.ln(weight) - F.ln(-F.ln(u))
