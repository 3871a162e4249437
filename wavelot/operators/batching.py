"""Length buckets and batches.

A bucket's samples, in their order, are packed greedily: a sample joins the open batch while the number of samples stays
within the cap and padded length times number within the budget; a sample that is too long for any batch stands
alone. A batch never mixes buckets. Groups are (worker, bucket); rows stream through a task in sorted order with the
open batch as the only state, so a group's size doesn't matter for memory, and more workers spread it over more tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bucket_id(length: Column, low: Column | float, high: Column | float, buckets: int) -> Column:
    """Clamp to low .. high and scale to 0 .. buckets - 1; only `high` itself reaches the last bucket."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    scaled = (F.greatest(low, F.least(length, high)) - low) * (buckets - 1) / (high - low)
    return F.when(high <= low, F.lit(0)).otherwise(F.floor(scaled)).cast("int")


def bucket_midpoint(bucket: Column, low: Column | float, high: Column | float, buckets: int) -> Column:
    """The nominal length of a bucket: the middle of the bucket-th of `buckets` equal parts."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return low + (bucket + 0.5) * ((high - low) / buckets)


def greedy_batches(df: DataFrame, order: list[str], length: str, budget: float, cap: int | None, group: list[str]) -> DataFrame:
    """Add batch_id, from 0 in each group. order: a total order; length and budget: in one unit."""
    n_group = len(group)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, longest, number = None, 0, 0, 0
        for pdf in batches:
            keys = list(zip(*[pdf[c].tolist() for c in group], strict=True)) if n_group else [()] * len(pdf)
            ids = []
            for k, x in zip(keys, pdf[length].tolist(), strict=True):
                if k != key:
                    key, n, longest, number = k, 0, 0, 0
                top = x if x > longest else longest
                if n and not (top * (n + 1) <= budget and (cap is None or n < cap)):
                    n, top, number = 0, x, number + 1
                n, longest = n + 1, top
                ids.append(number)
            yield pdf.assign(batch_id=pd.Series(ids, index=pdf.index, dtype="int64"))

    dealt = df.repartition(*group) if group else df.repartition(1)
    return dealt.sortWithinPartitions(*group, *order).mapInPandas(fold, T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())]))


def fixed_batches(df: DataFrame, order: list[str], rows: int, group: list[str]) -> DataFrame:
    """Exactly `rows` samples in a batch, whatever their lengths; the group's last may hold fewer."""
    return df.withColumn("batch_id", F.floor((F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1) / rows))


def batch_summary(df: DataFrame, length: str, group: list[str]) -> DataFrame:
    """Per batch: samples, their longest and total length, and the padding."""
    done = df.groupBy(*group, "batch_id").agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.sum(length).alias("total"))
    return done.withColumn("padding", F.col("longest") * F.col("n") - F.col("total"))


def drop_tails(df: DataFrame, group: list[str]) -> DataFrame:
    """Without each group's last batch, which training never emits."""
    last = df.groupBy(*group).agg(F.max("batch_id").alias("__last"))
    return df.join(last, group).where(F.col("batch_id") < F.col("__last")).drop("__last")


def flush_tails(tails: DataFrame, order: list[str], length: str, budget: float | None, cap: int | None, group: list[str], bucket: str = "bucket_id") -> DataFrame:
    """Batches of what the buckets still hold when a test pass ends. tails: the samples of each bucket's open batch, with its batch_id; group: without the bucket.

    A batch begins with the longest bucket that has samples left and takes from each bucket, longest first, up to the head that doesn't fit, then goes on
    in the next shorter one, until its budget or cap is reached; a head that is too long for any batch stands alone. bucket and batch_id become those of the
    batch's first sample, from_bucket is the sample's own, and flushed counts a group's batches from 0 in the order of emission.
    A group's tails are one open batch a bucket, so they fit a task."""

    def spill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([bucket, *order], ascending=[False, *[True] * len(order)], ignore_index=True)
        own, size = pdf[bucket].tolist(), pdf[length].tolist()
        left, number, out = list(range(len(pdf))), 0, [(0, 0)] * len(pdf)
        while left:
            n, longest, blocked, kept, first = 0, 0, None, [], left[0]
            for at, i in enumerate(left):
                if n and ((budget is not None and longest * n >= budget) or (cap is not None and n >= cap)):
                    kept += left[at:]
                    break
                top = max(longest, size[i])
                if n and (own[i] == blocked or (budget is not None and top * (n + 1) > budget)):
                    blocked = own[i]
                    kept.append(i)
                else:
                    n, longest, out[i] = n + 1, top, (first, number)
            left, number = kept, number + 1
        first = [x for x, _ in out]
        return pdf.assign(from_bucket=own, flushed=[x for _, x in out], **{bucket: pdf[bucket].to_numpy()[first], "batch_id": pdf["batch_id"].to_numpy()[first]})

    schema = T.StructType([*tails.schema.fields, T.StructField("from_bucket", tails.schema[bucket].dataType), T.StructField("flushed", T.LongType())])
    if not group:
        tails = tails.withColumn("__all", F.lit(0))
        return flush_tails(tails, order, length, budget, cap, ["__all"], bucket).drop("__all")
    return tails.groupBy(*group).applyInPandas(spill, schema)


def flushed_batches(packed: DataFrame, order: list[str], length: str, budget: float | None, cap: int | None, group: list[str], bucket: str = "bucket_id") -> DataFrame:
    """packed: samples with batch_id, each group's last batch being the one that was open at the end. Adds from_bucket and flushed (null for batches that were full
    before the end) and deals the open batches' samples out anew by flush_tails."""
    last = F.max("batch_id").over(W.partitionBy(*group))
    marked = packed.withColumn("__open", F.col("batch_id") == last)
    full = marked.where(~F.col("__open")).drop("__open").withColumns({"from_bucket": F.col(bucket), "flushed": F.lit(None).cast("long")})
    return full.unionByName(flush_tails(marked.where("__open").drop("__open"), order, length, budget, cap, [g for g in group if g != bucket], bucket))


def emission_events(packed: DataFrame, order: list[str], budget: float | Column, nominal: Column, group: list[str], rows: int | None = None, factor: float = 1.5) -> DataFrame:
    """When a running batcher would emit each batch: group, batch_id and event, the order columns (as a struct) of the sample whose arrival fills the bucket.

    packed: samples with batch_id. A bucket is full once its nominal length times the samples it holds is over `factor` budgets (with rows: once it holds more than so many),
    and a full bucket gives up one batch. So batch k goes out at the arrival number (samples of the batches before it) + (samples that fill a bucket) of its bucket, or
    with the batch before it, whichever is later; batches that no arrival brings out have a null event. All of it follows from counts: no step sees two batches at a time."""
    fills = F.lit(rows + 1) if rows is not None else F.floor(F.lit(factor) * budget / nominal).cast("long") + 1
    arrival = F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")
    marked = packed.select(*group, "batch_id", F.struct(*order).alias("__at"), fills.alias("__f"), arrival.alias("__n"))
    due = marked.groupBy(*group, "batch_id").agg((F.min("__n") - 1 + F.first("__f")).alias("__due"))
    due = due.withColumn("__due", F.max("__due").over(W.partitionBy(*group).orderBy("batch_id")))
    arrivals = marked.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__n").alias("__due_n"), F.col("__at").alias("event"))
    same = F.col("__due") == F.col("__due_n")
    for g in group:
        same = same & (F.col(g) == F.col(f"__{g}"))
    return due.join(arrivals, same, "left").select(*group, "batch_id", "event")


def epoch_limit(batches: DataFrame, per_worker: int, order: list[str]) -> DataFrame:
    """The first per_worker batches of each worker."""
    rank = F.row_number().over(W.partitionBy("worker").orderBy(*order))
    return batches.withColumn("__r", rank).where(F.col("__r") <= per_worker).drop("__r")
