"""Positions in a global order without bringing the rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_by(df: DataFrame, cell: list, fine: list[str], within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Add the position, from 0, in the order of the cell columns and then of the fine columns, within each group.

    cell: columns (a Column or (Column, descending)) that deal the order into many cells, coarse steps of the order. Only counts of
    cells are summed up over the whole order; rows are numbered inside their cell. Cells must be many and small, which holds for
    prefixes of hashes.
    """
    within = within or []
    pairs = [c if isinstance(c, tuple) else (c, False) for c in cell]
    marked = df.withColumns({f"__c{i}": c for i, (c, _) in enumerate(pairs)})
    names = [f"__c{i}" for i in range(len(pairs))]
    order = [F.desc(n) if down else F.asc(n) for n, (_, down) in zip(names, pairs, strict=True)]
    counts = marked.groupBy(*within, *names).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*within, *names, F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy(*within, *names).orderBy(*fine)) - 1
    keys = [*within, *names]
    right = offsets.select(*[F.col(k).alias(f"{k}__o") for k in keys], "__before")
    same = None
    for k in keys:
        here = F.col(k).eqNullSafe(F.col(f"{k}__o"))
        same = here if same is None else same & here
    joined = marked.withColumn("__in", inside).join(right, same)
    return joined.withColumn(name, (F.col("__in") + F.col("__before")).cast("long")).select(*df.columns, name)


def shuffled_rank(df: DataFrame, key: str, ties: list[str], within: list[str] | None = None, digits: int = 3, name: str = "rank") -> DataFrame:
    """rank_by over a column of md5 hex digits: cells are its first digits, so they are even."""
    return rank_by(df, [F.substring(key, 1, digits)], [key, *ties], within, name)
