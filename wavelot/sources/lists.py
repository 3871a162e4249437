"""Text inputs: shard lists, transcript manifests and source tables, read in parallel by Spark's text reader."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavelot.functions.text import sample_key
from wavelot.schemas import MANIFEST

_TRIM = r"^\s+|\s+$"


def parse_shards(lines: DataFrame, dataset: str | Column, *more: str) -> DataFrame:
    """lines: value. Columns of schemas.SHARDS plus ok: at least two fields. Blank lines are dropped; ok = false rows are what to warn of.
    more: columns of lines to keep."""
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    parts = F.split(F.regexp_replace("value", _TRIM, ""), r"\s+")
    rows = lines.withColumn("__p", parts).where(F.element_at("__p", 1) != "")
    field = lambda i: F.get("__p", F.lit(i))
    return rows.select(
        name.alias("dataset"), field(0).alias("audio_tar"), field(1).alias("manifest"),
        field(2).try_cast("double").alias("hours"), field(3).try_cast("long").alias("num_samples"), (F.size("__p") >= 2).alias("ok"), *more,
    )


def read_shards(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A shard list. Of lines that name one tar twice the last stays, so no tar is read twice."""
    # a list is one file, whose parts Spark reads in order, so these ids grow with the line
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("__line"))
    rows = parse_shards(lines, dataset, "__line").where("ok")
    last = rows.groupBy("dataset", "audio_tar").agg(F.max_by(F.struct("manifest", "hours", "num_samples"), "__line").alias("last"))
    return last.select("dataset", "audio_tar", "last.*")


def existing_shards(shards: DataFrame, columns: tuple[str, ...] = ("audio_tar", "manifest")) -> DataFrame:
    """Shards whose files exist, as seen from the tasks (a shard list is one row per file)."""
    @F.pandas_udf("boolean")
    def exists(paths: pd.Series) -> pd.Series:
        from pyarrow import fs

        def found(p: str) -> bool:
            system, inner = fs.FileSystem.from_uri(p if "://" in p else f"file://{p}")
            return system.get_file_info(inner).type == fs.FileType.File

        return paths.map(lambda p: p is not None and found(p)).astype(bool)

    for c in columns:
        shards = shards.where(exists(c))
    return shards


def read_noise_list(spark: SparkSession, path: str) -> DataFrame:
    """First field of each line; the rest is ignored."""
    first = F.element_at(F.split(F.regexp_replace("value", _TRIM, ""), r"\s+"), 1)
    return spark.read.text(path).select(first.alias("audio_tar")).where("audio_tar != ''").distinct()


def parse_manifest(lines: DataFrame, strict: bool = False) -> DataFrame:
    """lines: value and any others. Adds audio_filepath, text, duration and key. strict: a line that isn't JSON raises.

    Otherwise such lines are dropped. A duration that isn't a number is null."""
    body = lines.where(F.col("value").rlike(r"\S"))
    parsed = F.from_json("value", MANIFEST.replace("duration double", "duration string"), {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    rows = body.withColumn("__j", parsed)
    if not strict:
        rows = rows.where(F.try_parse_json("value").isNotNull())
    return rows.select(*lines.columns, F.col("__j.audio_filepath").alias("audio_filepath"), F.col("__j.text").alias("text"), F.col("__j.duration").try_cast("double").alias("duration")).withColumn("key", sample_key(F.col("audio_filepath")))


def read_manifests(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """manifest (path as given by Spark), line (order in the file), and the columns of parse_manifest."""
    lines = spark.read.text(paths).select("value", F.input_file_name().alias("manifest"), F.monotonically_increasing_id().alias("line"))
    return parse_manifest(lines, strict)


def last_labels(manifest: DataFrame, by: list[str], order: str = "line") -> DataFrame:
    """One text per key: the last line wins."""
    return manifest.where(F.col("key").isNotNull() & F.col("text").isNotNull()).groupBy(*by).agg(F.max_by("text", order).alias("text"))


def parse_sources(lines: DataFrame) -> DataFrame:
    """Tab-separated source lines: 3 fields (id, path, text) or 5 (and start, duration). Columns of schemas.SOURCES plus error.

    Blank lines are dropped. error is null for a good line, else says what is wrong."""
    rows = lines.where(F.col("value").rlike(r"\S")).withColumn("__p", F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t", -1))
    n, field = F.size("__p"), lambda i: F.get("__p", F.lit(i))
    trimmed = lambda i: F.regexp_replace(field(i), _TRIM, "")
    start, duration = trimmed(3).try_cast("double"), trimmed(4).try_cast("double")
    error = (
        F.when(~n.isin(3, 5), F.format_string("expected 3 or 5 fields, found %d", n))
        .when(trimmed(0) == "", "empty id")
        .when(trimmed(1) == "", "empty path")
        .when((n == 5) & (start.isNull() | duration.isNull()), "start and duration must be numbers")
    )
    return rows.select(*[c for c in lines.columns if c != "value"], trimmed(0).alias("id"), trimmed(1).alias("audio_path"), trimmed(2).alias("text"), F.when(n == 5, start).alias("start"), F.when(n == 5, duration).alias("duration"), (n == 5).alias("slice_audio"), error.alias("error"))


def read_lines(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Lines of text files: value, file and line_no, from 1 in each file.

    Lines are counted for each piece of a file that a task reads; a piece's first number is the sum of the pieces before it, so no step goes over the lines of a file
    in order. Blank lines count."""
    held = spark.read.options(**options).text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    pieces = held.groupBy(F.col("file").alias("__f"), F.col("__start").alias("__s")).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.sum("__n").over(W.partitionBy("__f").orderBy("__s").rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.withColumn("__before", F.coalesce(before, F.lit(0)))
    rows = held.join(pieces, (F.col("file") == F.col("__f")) & (F.col("__start") == F.col("__s")))
    return rows.select("value", "file", (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("line_no"))


def read_sources(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A source table, gzipped if its name ends in .gz. strict: the first bad line raises when it is read, with its number; else bad lines are dropped."""
    rows = parse_sources(read_lines(spark, path).drop("file"))
    if strict:
        message = F.format_string("bad source line %d: %s", "line_no", "error")
        rows = rows.withColumn("id", F.when(F.col("error").isNotNull(), F.raise_error(message)).otherwise(F.col("id")))
    else:
        rows = rows.where("error is null")
    return rows.drop("error", "line_no")
