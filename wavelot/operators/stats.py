"""Totals of manifests and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_stats(manifest: DataFrame, by: str = "manifest") -> DataFrame:
    """Per manifest: seconds (a missing or bad duration counts 0) and num_samples."""
    return manifest.groupBy(by).agg(F.sum(F.coalesce("duration", F.lit(0.0))).alias("seconds"), F.count("*").alias("num_samples"))


def complete_shards(shards: DataFrame, stats: DataFrame) -> DataFrame:
    """Fill hours and num_samples that a shard list lacks from its manifests' totals."""
    s = stats.select(F.col("manifest").alias("__m"), (F.col("seconds") / 3600).alias("__h"), F.col("num_samples").alias("__n"))
    filled = shards.join(s, F.col("manifest") == F.col("__m"), "left")
    return filled.withColumns({"hours": F.coalesce("hours", "__h", F.lit(0.0)), "num_samples": F.coalesce("num_samples", "__n", F.lit(0))}).drop("__m", "__h", "__n")


def dataset_totals(shards: DataFrame) -> DataFrame:
    return shards.groupBy("dataset").agg(F.sum("hours").alias("hours"), F.sum("num_samples").alias("num_samples"))


def overall(totals: DataFrame) -> DataFrame:
    """One row over datasets with hours, num_samples, min_length and max_length."""
    return totals.agg(F.sum("hours").alias("hours"), F.sum("num_samples").alias("num_samples"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"), F.array_sort(F.collect_list("dataset")).alias("datasets"))


def duration_histogram(sources: DataFrame, column: str = "duration") -> DataFrame:
    """Samples per whole second; a negative duration raises."""
    checked = F.when(F.col(column) < 0, F.raise_error(F.lit("negative duration"))).otherwise(F.floor(column))
    return sources.groupBy(checked.alias("second")).agg(F.count("*").alias("n"), F.sum(column).alias("seconds"))


def build_summary(shards: DataFrame) -> DataFrame:
    """shards: written (boolean), num_samples, seconds, errors."""
    return shards.agg(F.count("*").alias("shards"), F.sum(F.when(F.col("written"), 1).otherwise(0)).alias("written"), F.sum(F.when(F.col("written"), 0).otherwise(1)).alias("skipped"), F.sum("num_samples").alias("num_samples"), F.sum("seconds").alias("seconds"), F.sum("errors").alias("errors"))
