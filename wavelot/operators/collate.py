"""Batches as rows: lists of ids and texts, padded matrices and true lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelot.functions.arrays import FEATURE_PAD, pad_right, pad_rows


def collate(df: DataFrame, group: list[str], order: list[str], plain: dict[str, str], arrays: list[str] | None = None, matrices: list[str] | None = None) -> DataFrame:
    """One row per group. plain: output name -> column, collected as it is; arrays: array<float> columns, padded with 0; matrices:
    array<array<float>>, padded with rows of ln(1e-10). Each padded column c comes with c_lens. order: a total order in the batch;
    with several copies it begins with `copy`, so batches are copy-major. A batch is bounded by its budget."""
    arrays, matrices = arrays or [], matrices or []
    fields = [F.col(c) for c in order] + [F.col(c).alias(f"__v{i}") for i, c in enumerate([*plain.values(), *arrays, *matrices])]
    rows = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__b"))
    value = lambda i: F.transform("__b", lambda x: x[f"__v{i}"])
    out = [F.col(c) for c in group] + [value(i).alias(name) for i, name in enumerate(plain)]
    for i, c in enumerate(arrays, len(plain)):
        sizes = F.transform(value(i), lambda x: F.size(x))
        out += [_padded(value(i), F.array_max(sizes)).alias(c), sizes.alias(f"{c}_lens")]
    for i, c in enumerate(matrices, len(plain) + len(arrays)):
        sizes = F.transform(value(i), lambda x: F.size(x))
        width = F.array_max(F.transform(value(i), lambda x: F.coalesce(F.size(F.get(x, F.lit(0))), F.lit(0))))
        out += [_padded(value(i), F.array_max(sizes), width).alias(c), sizes.alias(f"{c}_lens")]
    return rows.select(*out)


def _padded(values: Column, length: Column, width: Column | None = None) -> Column:
    if width is None:
        return F.transform(values, lambda x: pad_right(x, length))
    return F.transform(values, lambda x: pad_rows(x, length, width, FEATURE_PAD))


def fill(batches: DataFrame, lens: str, unit: float, budget: float) -> DataFrame:
    """One row: batches, mean seconds of a batch, fill_factor = budget / mean."""
    total = F.aggregate(lens, F.lit(0).cast("long"), lambda s, x: s + x) / unit
    return batches.agg(F.count("*").alias("batches"), F.avg(total).alias("mean_seconds")).withColumn("fill_factor", F.lit(budget) / F.col("mean_seconds"))
