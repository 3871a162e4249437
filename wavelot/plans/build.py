"""Building shards from a source table, and listing shards that exist."""

from __future__ import annotations

import json
from dataclasses import asdict

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelot.functions.audio import header_frames
from wavelot.functions.text import base_name, map_prefix, normal_text, sample_ext, shard_key, shard_name
from wavelot.operators import sharding, stats
from wavelot.options import BuildOptions
from wavelot.sources import lists, sinks
from wavelot.sources.files import exists, put_json, read_file, read_head
from wavelot.sources.tarindex import HEAD


def probe(sources: DataFrame) -> DataFrame:
    """Durations of whole files where the source table gives none: from a file's first block, or all of it where that doesn't tell."""

    def seconds(path: str, ext: str) -> float:
        head, size = read_head(path, HEAD)
        frames, rate = header_frames(head, size, ext, lambda: read_file(path)[len(head) :])
        return frames / rate

    @F.pandas_udf("double")
    def run(paths: pd.Series, exts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([k if pd.notna(k) else seconds(p, e) for p, e, k in zip(paths, exts, known, strict=True)], dtype="float64")

    return sources.withColumn("duration", run("audio_path", sample_ext(F.col("audio_path")), "duration"))


def plan_shards(sources: DataFrame, options: BuildOptions) -> tuple[DataFrame, int]:
    """Adds shard and index; returns the number of shards too."""
    if options.by_duration:
        sources = probe(sources)
        seconds = sources.agg(F.sum("duration")).first()[0] or 0.0
        n = sharding.shard_count(0, seconds, options.num_tars, None, options.duration_per_tar)
        return sharding.shards_by_duration(sources, n, options.seed), n
    total = sources.count()
    n = sharding.shard_count(total, 0.0, options.num_tars, options.samples_per_tar)
    return sharding.shards_by_samples(sources, n, options.seed, total=total), n


def stored_plan(sources: DataFrame, options: BuildOptions) -> tuple[DataFrame, dict]:
    """The plan of this input and these options: the one that is stored, or a new one, stored before anything is written.

    The fingerprint in its name covers what shards hold: the options and the rows of the input in any order."""
    spark, folder = sources.sparkSession, f"{options.plan_folder}/context"
    config = {**asdict(options), "prefix": options.prefix, "content": sharding.content_hash(sources)}
    mark = sharding.fingerprint(config, ("input", "output_dir", "tmp_dir", "workers", "wave", "tar_prefix", "plan_only", "split_start", "split_end", "no_lst"))
    wanted = {"mode": "duration" if options.by_duration else "samples", "requested": options.num_tars or options.samples_per_tar or options.duration_per_tar, "split_bits": options.split_bits, "fingerprint": mark}
    path, note = f"{folder}/{mark}.plan", f"{folder}/{mark}.json"
    if exists(note) and sharding.plan_matches(context := context_of(note), wanted):
        return spark.read.parquet(path), {**context, "reused": True}
    planned, n = plan_shards(sources, options)
    planned.withColumn("text", normal_text(F.col("text"))).write.mode("overwrite").parquet(path)
    put_json(note, {**wanted, "shards": n})
    return spark.read.parquet(path), {**wanted, "shards": n, "reused": False}


def finished(spark: SparkSession, options: BuildOptions, mark: str) -> DataFrame:
    """sinks.DONE with audio_tar and manifest of the shards that are whole and come from the plan with this fingerprint."""
    out = options.output_dir.rstrip("/")
    try:
        notes = spark.read.text(f"{out}/done/{options.prefix}.*.done", wholetext=True)
    except AnalysisException:  # nothing is done yet
        notes = spark.createDataFrame([], "value string")
    rows = notes.select(F.from_json("value", sinks.DONE).alias("d")).select("d.*").where(F.col("fingerprint") == mark)
    name = lambda folder, end: F.concat(F.lit(f"{out}/{folder}/"), shard_name(options.prefix, F.col("shard"), options.split_bits), F.lit(end))
    return lists.existing_shards(rows.withColumns({"audio_tar": name("audio", ".tar"), "manifest": name("txt", ".jsonl")}))


def build(spark: SparkSession, options: BuildOptions) -> dict:
    """Plan, write and list.

    Shards are written in waves of `wave`; a wave's shards are there once it has ended. A run goes on where an earlier one of the same plan stopped, and makes anew
    the shards that another plan has left under the same names; the list names shards of this plan alone."""
    out = options.output_dir.rstrip("/")
    planned, context = stored_plan(lists.read_sources(spark, options.input), options)
    n, mark = context["shards"], context["fingerprint"]
    if options.plan_only:
        table = sharding.balance(planned.withColumn("duration", F.coalesce("duration", F.lit(0.0)))).orderBy("shard")
        return {**context, "plan": [r.asDict() for r in table.collect()]}  # one row per shard
    begin, end = options.split_start or 0, min(n, n if options.split_end is None else options.split_end)
    before = {r["shard"] for r in finished(spark, options, mark).select("shard").collect()}  # one row per shard
    missing = planned.join(F.broadcast(spark.createDataFrame([(x,) for x in sorted(before)], "shard int")), "shard", "left_anti")
    for first in range(begin, end, options.wave):
        last = min(end, first + options.wave)
        if all(x in before for x in range(first, last)):
            continue
        wave = sharding.shard_range(missing, first, last)
        sinks.write_tars(sinks.encoded(wave, options.format, options.sample_rate, options.compression_level, options.workers or last - first), out, options.prefix, options.split_bits, mark)
    done = sharding.shard_range(finished(spark, options, mark), options.split_start, options.split_end).withColumn("written", ~F.col("shard").isin(sorted(before)) if before else F.lit(True))
    summary = {k: v or 0 for k, v in stats.build_summary(done).first().asDict().items()}
    if not options.no_lst:
        shards = done.select("audio_tar", "manifest", (F.col("seconds") / 3600).alias("hours"), "num_samples")
        summary["list"] = f"{out}/data.lst"
        sinks.write_list(shards, summary["list"])
    return {**context, **{f"{k}" if k != "shards" else "listed": v for k, v in summary.items()}}


def pair_manifests(tars: DataFrame, manifests: DataFrame, audio_prefix: str | None = None, text_prefix: str | None = None, within: list[str] | None = None) -> DataFrame:
    """tars: path; manifests: path. Left join by shard key, .json before .jsonl. Columns audio_tar, key, manifest (null if none).

    within: columns of both; a tar meets the manifests of its own group only, so a key may come back in other groups."""
    within = within or []
    keyed = tars.select(*within, F.col("path").alias("audio_tar"), map_prefix(shard_key(F.col("path")), audio_prefix, text_prefix).alias("key"))
    name = base_name(F.col("path"))
    found = manifests.where(name.rlike(r"\.jsonl?$")).select(*within, F.regexp_replace(name, r"\.jsonl?$", "").alias("key"), F.col("path").alias("m"), F.when(name.endswith(".json"), 0).otherwise(1).alias("p"))
    best = found.groupBy(*within, "key").agg(F.min_by("m", F.struct("p", "m")).alias("manifest"))
    return keyed.join(best, [*within, "key"], "left").select(*within, "audio_tar", "key", "manifest")


def list_existing(spark: SparkSession, audio_pattern: str, text_dir: str, output: str, audio_prefix: str | None = None, text_prefix: str | None = None, strict: bool = False, sort: bool = True) -> dict:
    """Write a shard list of tars and their manifests. strict: a tar without a manifest raises; else it is left out and counted."""
    frame = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    texts = sinks.find_files(spark, f"{text_dir.rstrip('/')}/*.json*")
    paired = pair_manifests(frame(sinks.find_files(spark, audio_pattern)), frame(texts), audio_prefix, text_prefix)
    lost = [r["audio_tar"] for r in paired.where("manifest is null").collect()]  # shards, not samples
    if lost and strict:
        raise ValueError(f"no manifest for {len(lost)} tars, the first is {min(lost)}")
    totals = stats.manifest_stats(lists.read_manifests(spark, texts)) if texts else None
    shards = paired.where("manifest is not null").withColumns({"hours": F.lit(None).cast("double"), "num_samples": F.lit(None).cast("long")})
    if totals is not None:
        shards = stats.complete_shards(shards, totals.withColumn("manifest", F.regexp_replace("manifest", r"^file:(//)?(?=/)", "")))
    n = sinks.write_list(shards, output, sort=sort)
    return {"shards": n, "skipped": len(lost), "output": output}


def context_of(uri: str) -> dict:
    return json.loads(read_file(uri))
