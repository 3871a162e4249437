"""Reproducible randomness: uniforms and orders from hashes of keys, the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, *parts: Column | str) -> Column:
    """Lower-case md5 of seed and parts; sorting by it shuffles."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def uniform(seed: int | str, *parts: Column | str) -> Column:
    """A double in (0, 1) from 48 bits of the md5."""
    return (F.conv(F.substring(order_key(seed, *parts), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def between(low: float, high: float, seed: int | str, *parts: Column | str) -> Column:
    return F.lit(low) + (high - low) * uniform(seed, *parts)


def choice(options: list[float], seed: int | str, *parts: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in options]), (F.floor(uniform(seed, *parts) * len(options)) + 1).cast("int"))
