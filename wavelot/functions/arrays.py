"""Waveform and matrix expressions on array columns; all run in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What features are padded with.
FEATURE_PAD = math.log(1e-10)


def pad_right(values: Column, length: Column, value: float = 0.0) -> Column:
    return F.concat(values, F.array_repeat(F.lit(value).cast("float"), F.greatest(length - F.size(values), F.lit(0)).cast("int")))


def pad_rows(rows: Column, length: Column, width: Column, value: float = FEATURE_PAD) -> Column:
    """Rows (frames) of `width` values each, filled up with rows of `value`."""
    empty = F.array_repeat(F.lit(value).cast("float"), width.cast("int"))
    return F.concat(rows, F.array_repeat(empty, F.greatest(length - F.size(rows), F.lit(0)).cast("int")))


def energy(values: Column) -> Column:
    """Sum of squares, in order, in double precision."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def rms(values: Column) -> Column:
    return F.sqrt(energy(values) / F.size(values))


def fit_noise(noise: Column, length: Column, offset: Column) -> Column:
    """Exactly `length` values: short noise is repeated, long noise cut from offset on (0 .. size - length)."""
    n = F.size(noise)
    tiled = F.slice(F.flatten(F.array_repeat(noise, F.ceil(length / F.greatest(n, F.lit(1))).cast("int"))), F.lit(1), length.cast("int"))
    return F.when(n == 0, F.array_repeat(F.lit(0.0).cast("float"), length.cast("int"))).when(n < length, tiled).otherwise(F.slice(noise, (offset + 1).cast("int"), length.cast("int")))
