"""Mixing datasets by weight, without a serial coin flip.

Categorical draws are distributed as the merge of independent Poisson processes, so each dataset's k-th sample gets an arrival time
and the mix is the order of times. The even mix, time (k - 1/2) / weight, is deterministic, and its positions follow from counts alone.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavelot.functions.random import uniform


def dataset_weights(totals: DataFrame, by: str = "hours", weights: dict[str, float] | None = None) -> DataFrame:
    """Add weight, a dataset's share of `by` (one row per dataset), or the given weights made to sum to 1."""
    share = F.col(by) / F.sum(by).over(W.partitionBy())
    if weights is None:
        return totals.withColumn("weight", share)
    whole = sum(weights.values())
    own = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v / whole)])[F.col("dataset")]
    out = totals.withColumns({"weight": own, "__natural": share})
    off = out.where(F.abs(F.col("weight") - F.col("__natural")) > 0.05 * F.col("__natural")).count()
    if off:
        warnings.warn(f"weights of {off} datasets differ from their shares by more than 5 %", stacklevel=2)
    return out.drop("__natural")


def even_mix(ranked: DataFrame, weights: DataFrame, rank: str = "rank") -> DataFrame:
    """ranked: dataset, rank (from 0 in each dataset); weights: dataset, w (a positive whole number), n (its samples).

    Adds position, from 0, in the order of (2 * rank + 1) / w as doubles, ties by dataset. A row's position is the number of rows before it
    in each dataset, which follows from the datasets' counts: no sort, no shuffle and no join.
    """
    known = [(r["dataset"], float(r["w"]), int(r["n"])) for r in weights.select("dataset", "w", "n").collect()]  # one row per dataset
    own = F.create_map(*[F.lit(x) for d, w, _ in known for x in (d, w)])[F.col("dataset")]
    t = (2 * F.col(rank) + 1).cast("double") / own
    count = F.lit(0).cast("long")
    for d, w, n in known:
        # rows j with (2j + 1) / w before t: t * w says how many but for one, the two next to it decide
        near = F.floor((t * F.lit(w) + 1) / 2)
        reach = near - 1
        for j in (near - 1, near):
            other = (2 * j + 1).cast("double") / F.lit(w)
            reach = reach + F.when((other < t) | ((other == t) & (F.lit(d) < F.col("dataset"))), 1).otherwise(0)
        count = count + F.greatest(F.lit(0).cast("long"), F.least(reach, F.lit(n).cast("long")))
    return ranked.withColumn("position", count)


def random_mix_time(ranked: DataFrame, weights: DataFrame, seed: int, keys: list[str], rank: str = "rank", cells: int = 4096, within: list[str] | None = None) -> DataFrame:
    """Adds t, the arrival time of each sample: sums of -ln(u) / weight in the order of rank. weights: dataset, weight; within: columns whose values are mixes of their own.

    Sums run inside blocks of ranks; blocks' totals are summed up on their own."""
    by = [*(within or []), "dataset"]
    marked = ranked.withColumns({"__g": -F.log(uniform(seed, *keys)), "__b": F.floor(F.col(rank) / cells)})
    totals = marked.groupBy(*by, "__b").agg(F.sum("__g").alias("__s"))
    before = F.sum("__s").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    earlier = totals.select(*by, "__b", F.coalesce(before, F.lit(0.0)).alias("__e"))
    inner = F.sum("__g").over(W.partitionBy(*by, "__b").orderBy(rank).rowsBetween(W.unboundedPreceding, 0))
    timed = marked.withColumn("__i", inner).join(earlier, [*by, "__b"])
    w = weights.select(F.col("dataset").alias("__wd"), F.col("weight").alias("__w"))
    return timed.join(F.broadcast(w), F.col("dataset") == F.col("__wd")).withColumn("t", (F.col("__e") + F.col("__i")) / F.col("__w")).select(*ranked.columns, "t")


def epoch_batches(total_seconds: float, total_samples: int, max_duration: float | None, batch_size: int | None, world_size: int = 1, fill_factor: float = 1.15) -> int:
    """Batches of one node in an epoch."""
    if batch_size is not None:
        return math.ceil(total_samples / batch_size / world_size)
    return math.ceil(total_seconds / world_size / max_duration * fill_factor)


def num_copies(df: DataFrame, copies: int) -> DataFrame:
    """Each row `copies` times, with column copy from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def passes(df: DataFrame, n: int | Column) -> DataFrame:
    """The stream n times over, with column epoch_pass from 0."""
    return df.withColumn("epoch_pass", F.explode(F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)).cast("int") - 1)))


def passes_needed(supply: DataFrame, weights: DataFrame, need: float) -> DataFrame:
    """supply: worker, dataset, content (what one pass gives, in seconds or samples); weights: dataset, weight. Per dataset n, the passes after which every worker has `need`.

    A worker's datasets share its need by their weights; the worker that has least of a dataset decides. As a batch holds no more than its budget, a worker with a
    content of k budgets makes k batches at least. Rows are a dataset and worker each."""
    w = weights.select(F.col("dataset").alias("__d"), F.col("weight").alias("__w"))
    known = supply.where("content > 0").join(F.broadcast(w), F.col("dataset") == F.col("__d"))
    share = F.col("__w") / F.sum("__w").over(W.partitionBy("worker"))
    turns = F.ceil(F.lit(float(need)) * share / F.col("content"))
    return known.withColumn("n", turns).groupBy("dataset").agg(F.greatest(F.lit(1), F.max("n")).cast("int").alias("n"))
