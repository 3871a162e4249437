"""Samples: decode, label, filter, copy and change audio."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelot.functions.audio import change_speed, load_mono
from wavelot.functions.random import between, choice, order_key, uniform
from wavelot.functions.text import text_or_empty
from wavelot.operators.ranking import shuffled_rank
from wavelot.options import Augment


def decode(entries: DataFrame, sample_rate: int = 16000, average: bool = True, data: str = "bytes", ext: str = "ext", audio: str = "audio", length: str | None = "length_s") -> DataFrame:
    """data -> audio (mono float32 at sample_rate), length_s and error (null, or why there is no audio). A bad entry doesn't stop the job.

    data, ext, audio and length: the columns' names; length None leaves that column and sample_rate out."""

    @F.pandas_udf("audio array<float>, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for datas, exts in batches:
            out = []
            for x, kind in zip(datas, exts, strict=True):
                try:
                    out.append((load_mono(x, kind, sample_rate, average), None) if x is not None else (None, "no data"))
                except Exception as e:  # noqa: BLE001  any damaged file is one sample's error
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["audio", "error"])

    rows = entries.withColumn("__d", run(data, ext))
    rows = rows.withColumns({audio: F.coalesce(F.col("__d.audio"), F.array().cast("array<float>")), "error": F.col("__d.error")}).drop("__d", data)
    return rows if length is None else rows.withColumns({length: F.size(audio) / F.lit(float(sample_rate)), "sample_rate": F.lit(sample_rate)})


def join_labels(samples: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Left join with one text per key; a missing or blank text becomes the marker, the sample stays. Spark picks the join by size."""
    return samples.join(labels.select(*on, "text"), on, "left").withColumn("text", text_or_empty(F.col("text")))


def length_filter(samples: DataFrame, low: float, high: float, length: str | Column = "length_s") -> DataFrame:
    """Both ends included; samples without audio go too."""
    return samples.where((F.col(length) if isinstance(length, str) else length).between(low, high))


def apply_map(samples: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The caller's map: DataFrame in, DataFrame out. Runs before the filter."""
    return samples.transform(fn)


def apply_filter(samples: DataFrame, keep: Column | Callable[[dict], bool]) -> DataFrame:
    """A Column where possible; a Python predicate over dicts otherwise."""
    if isinstance(keep, Column):
        return samples.where(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[bool(keep(r)) for r in pdf.to_dict("records")]]

    return samples.mapInPandas(run, samples.schema)


def change_audio(audio: Column | str, speed: Column, db: Column, noise: Column | str, snr: Column, at: Column, sample_rate: int = 16000) -> Column:
    """One pass over the audio: speed, volume (db), then noise at a ratio (snr) from a place on (at, 0 .. 1), each where it isn't null."""
    return _change(sample_rate)(audio, speed, db, noise, snr, at)


def _change(sample_rate: int):

    @F.pandas_udf("array<float>")
    def run(audio: pd.Series, by: pd.Series, db: pd.Series, noise: pd.Series, snr: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for a, s, g, n, r, u in zip(audio, by, db, noise, snr, at, strict=True):
            x = np.asarray(a if a is not None else [], np.float32)
            if pd.notna(s):
                x = change_speed(x, s, sample_rate)
            if pd.notna(g):
                x = (x * np.float64(10 ** (g / 20))).astype(np.float32)  # in double precision, like the mix
            if pd.notna(r) and n is not None and len(n) and len(x):
                x = mix(x, np.asarray(n, np.float32), r, u)
            out.append(x)
        return pd.Series(out, dtype=object)

    return run


def mix(x: np.ndarray, noise: np.ndarray, snr_db: float, at: float) -> np.ndarray:
    """x with noise at the ratio; short noise is repeated, long noise cut at `at` (0 .. 1) of what it has to spare."""
    if len(noise) < len(x):
        noise = np.resize(noise, len(x))
    start = min(int(at * (len(noise) - len(x) + 1)), len(noise) - len(x))
    noise = noise[start : start + len(x)].astype(np.float64)
    level = lambda a: np.sqrt(np.mean(np.square(a, dtype=np.float64)))
    return (x + noise * (level(x) / (10 ** (snr_db / 20) * level(noise) + 1e-8))).astype(np.float32)


# Primes over any pool's size, so each is coprime to it.
STEPS = (2147483659, 2147483693, 2147483713, 2147483743, 2147483777, 2147483783, 2147483813, 2147483857)


def noise_at(position: Column, count: Column, seed: int) -> Column:
    """The noise for the position-th noisy sample: each pass over the pool of `count` (under 2^31) takes every noise once, in an order of its own, i -> (step * i + shift) mod count."""
    turn = F.floor(position / count).cast("long")
    draw = lambda salt: F.conv(F.substring(order_key(f"{salt}{seed}", turn.cast("string")), 1, 15), 16, 10).cast("long")
    step = F.element_at(F.array(*[F.lit(x) for x in STEPS]), (F.pmod(draw("step"), F.lit(len(STEPS))) + 1).cast("int"))
    return F.pmod(F.pmod(step, count) * F.pmod(position, count) + F.pmod(draw("shift"), count), count)


def pair_noise(samples: DataFrame, noise: DataFrame, seed: int, keys: list[str], order: str = "__k") -> DataFrame:
    """Adds noise_<column> for what noise tells of the entry that a sample meets. samples: noise_of, the pool a sample draws from (null: none); noise: dataset (the pool),
    idx 0 .. n - 1, n and any others. Both sides are slim: audio is read after the join.

    A pool's samples are numbered by a hash of their keys and take noises by noise_at, so how often two noises are used differs by one at most."""
    sizes = noise.groupBy(F.col("dataset").alias("__p")).agg(F.max("n").alias("__n"))
    rest = [c for c in noise.columns if c not in ("dataset", "idx", "n")]
    right = noise.select(F.col("dataset").alias("__d"), F.col("idx").alias("__i"), *[F.col(c).alias(f"noise_{c}") for c in rest])
    drawing = samples.where(F.col("noise_of").isNotNull()).withColumn(order, order_key(f"noise{seed}", *keys))
    placed = shuffled_rank(drawing, order, keys, ["noise_of"], name="__r").drop(order).join(F.broadcast(sizes), F.col("noise_of") == F.col("__p"), "left")  # a row per dataset
    drawn = placed.withColumn("__at", noise_at(F.col("__r"), F.col("__n"), seed))
    drawn = drawn.join(right, (F.col("noise_of") == F.col("__d")) & (F.col("__at") == F.col("__i")), "left").drop("__p", "__n", "__at", "__r", "__d", "__i")
    return drawn.unionByName(samples.where(F.col("noise_of").isNull()), allowMissingColumns=True)


def noisy(options: Augment, seed: int, keys: list[str]) -> Column:
    return uniform(f"noise?{seed}", *keys) < options.noise_prob


def speed_of(options: Augment, seed: int, keys: list[str], sample_rate: int) -> Column:
    return choice(list(options.speeds), f"speed{seed}", *keys)


def length_at_speed(samples: Column, speed: Column, sample_rate: int) -> Column:
    """How many samples change_speed leaves of so many."""
    return F.ceil(samples * F.floor(speed * sample_rate) / F.lit(sample_rate)).cast("long")


def change(samples: DataFrame, options: Augment, seed: int, keys: list[str], sample_rate: int = 16000, noise: str | None = None) -> DataFrame:
    """Speed (0.9 makes a sample shorter, a tenth of its length goes), then volume, then the noise in the column of that name, if there is one; length_s follows the audio.

    All draws come from hashes of the keys."""
    none = F.lit(None).cast("double")
    by = speed_of(options, seed, keys, sample_rate) if options.speed else none
    db = F.when(uniform(f"volume?{seed}", *keys) <= options.volume_prob, between(*options.volume_db, f"volume{seed}", *keys)) if options.volume else none
    run = lambda *x: change_audio(*x, sample_rate=sample_rate)
    if noise is not None:
        snr = F.when(noisy(options, seed, keys), between(*options.noise_snr_db, f"snr{seed}", *keys))
        samples = samples.withColumn("audio", run("audio", by, db, noise, snr, uniform(f"offset{seed}", *keys)))
    elif options.speed or options.volume:
        samples = samples.withColumn("audio", run("audio", by, db, F.lit(None).cast("array<float>"), none, none))
    return samples.withColumn("length_s", F.size("audio") / F.lit(float(sample_rate)))


def augment(samples: DataFrame, options: Augment, seed: int, keys: list[str], sample_rate: int = 16000, noise: DataFrame | None = None, noise_count: int = 0) -> DataFrame:
    """change, with noise from a pool of decoded noises: idx 0 .. noise_count - 1 and audio. Samples that are to get noise meet it by an equi-join."""
    if not (options.noise and noise is not None and noise_count):
        return change(samples, options, seed, keys, sample_rate)
    pool = noise.select(F.lit("").alias("dataset"), "idx", F.lit(noise_count).alias("n"), "audio")
    chosen = samples.withColumn("noise_of", F.when(noisy(options, seed, keys), F.lit("")))
    return change(pair_noise(chosen, pool, seed, keys), options, seed, keys, sample_rate, "noise_audio").drop("noise_of", "noise_audio")
