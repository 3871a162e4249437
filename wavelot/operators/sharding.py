"""Planning of shards: which sample goes to which tar."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelot.functions.random import order_key
from wavelot.operators.ranking import rank_by, shuffled_rank


def power_of_two(n: int) -> int:
    """The least power of two that is n or more."""
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


def shard_count(total_samples: int, total_seconds: float, num_tars: int | None = None, samples_per_tar: int | None = None, duration_per_tar: float | None = None) -> int:
    if num_tars is not None:
        return power_of_two(num_tars)
    if samples_per_tar is not None:
        return power_of_two(math.ceil(total_samples / samples_per_tar))
    return power_of_two(math.ceil(total_seconds / (duration_per_tar * 3600)))


def shards_by_samples(df: DataFrame, shards: int, seed: int, id_col: str = "id", total: int | None = None) -> DataFrame:
    """Shuffle by a hash, then equal runs; the last shards may be empty. Adds shard and index (place in the shuffle)."""
    total = df.count() if total is None else total
    per = max(1, math.ceil(total / shards))
    ranked = shuffled_rank(df.withColumn("__k", order_key(seed, id_col)), "__k", [id_col], name="index").drop("__k")
    return ranked.withColumn("shard", F.least(F.floor(F.col("index") / per), F.lit(shards - 1)).cast("int"))


def shards_by_duration(df: DataFrame, shards: int, seed: int, length: str = "duration", id_col: str = "id") -> DataFrame:
    """Deal samples, longest first, to the shards there and back (serpentine), so that totals and length mixes agree.

    Of two laps one favours each end, and what a lap can favour is the step from its longest to its shortest sample; these steps don't overlap, so totals differ by
    the longest sample at most, and by the one second within which the order is shuffled.

    Equal whole seconds are shuffled by a hash. Positions come from counts of (second, first digits of the hash), so no task
    sees all samples."""
    keyed = df.withColumn("__k", order_key(seed, id_col))
    ranked = rank_by(keyed, [(F.floor(length), True), F.substring("__k", 1, 2)], ["__k", id_col], name="index").drop("__k")
    lap, place = F.floor(F.col("index") / shards), F.pmod("index", F.lit(shards))
    return ranked.withColumn("shard", F.when(lap % 2 == 0, place).otherwise(shards - 1 - place).cast("int"))


def balance(planned: DataFrame, length: str = "duration") -> DataFrame:
    return planned.groupBy("shard").agg(F.count("*").alias("n"), F.sum(length).alias("total"))


def shard_range(df: DataFrame, start: int | None, end: int | None, column: str = "shard") -> DataFrame:
    """start <= shard < end; None leaves a side open."""
    if start is not None:
        df = df.where(F.col(column) >= start)
    return df if end is None else df.where(F.col(column) < end)


def fingerprint(config: dict, without: tuple[str, ...] = ("output_dir", "tmp_dir")) -> str:
    """16 hex digits of a configuration; folders of output don't count."""
    kept = {k: v for k, v in config.items() if k not in without}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:16]


def content_hash(rows: DataFrame) -> str:
    """A hash of a table's rows whatever their order; repeated rows count each time."""
    whole = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(whole, F.lit(salt)).cast("decimal(38,0)")).cast("string") for salt in (1, 2)]
    return hashlib.sha256("/".join(map(str, rows.agg(F.count("*"), *sums).first())).encode()).hexdigest()[:32]


def plan_matches(saved: dict, wanted: dict) -> bool:
    """Whether a saved plan can be used again: same mode, request, name width, and fingerprint of options and input."""
    return all(saved.get(k) == wanted.get(k) for k in ("mode", "requested", "split_bits", "fingerprint"))
