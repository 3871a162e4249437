"""The loader: from shard lists to padded batches, as one lazy plan."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelot.functions.features import Extractor, extractor, features
from wavelot.functions.random import order_key
from wavelot.functions.text import base_name
from wavelot.operators import batching, mux, samples, stats
from wavelot.operators.collate import collate
from wavelot.operators.ranking import rank_by, shuffled_rank
from wavelot.options import LoaderOptions
from wavelot.schemas import NOISE_FORMATS
from wavelot.sources import audiotar, lists, tarindex
from wavelot.sources.scratch import shared_folder


@dataclass(frozen=True)
class Dataset:
    """One shard list with what is done to its samples. map runs before filter."""

    name: str
    shard_list: str
    map: Callable[[DataFrame], DataFrame] | None = None
    filter: Column | Callable[[dict], bool] | None = None
    noise_list: str | None = None
    min_length: float | None = None
    max_length: float | None = None


#: What tells a sample's draws apart.
SAMPLE = ["dataset", "url", "key", "epoch_pass", "copy"]
#: Columns of slim samples that the library itself makes.
KNOWN = {"dataset", "url", "key", "ext", "offset", "size", "packed", "frames", "rate", "text", "samples", "length_s", "epoch_pass", "seq", "worker"}


class Loader:
    """Batches of one or more datasets.

    A catalogue of samples, one slim row each with its transcript, its place in a tar and its length from the header, is made once and kept in the
    shared folder. Filters, mixing, packing and the choice of an epoch's batches run on it, lazily; then the chosen samples' bytes are read by ranges,
    decoded and changed where they were read, and meet in their batches by the only shuffle of audio.

    A map or filter that can't do without audio (it fails on a catalogue without that column, or is a Python predicate) has its dataset decoded once more beforehand."""

    def __init__(self, spark: SparkSession, datasets: list[Dataset | str], options: LoaderOptions | None = None, feature: str | Extractor | None = None):
        self.spark, self.options = spark, options or LoaderOptions()
        self.datasets = [d if isinstance(d, Dataset) else Dataset(base_name_of(d), d) for d in datasets]
        if not self.datasets:
            raise ValueError("no datasets")
        if len({d.name for d in self.datasets}) < len(self.datasets):
            raise ValueError("datasets need different names")
        kind = feature if feature is not None else self.options.feature_type
        self.extractor = None if kind is None else extractor(kind, self.options.sample_rate)
        self._turned: dict[str, int] | None = None
        self._kept: dict[str, tuple[str, int]] = {}  # tables in the shared folder and the bytes of audio that they name

    def __repr__(self) -> str:
        return f"Loader(datasets={self.datasets}, options={self.options}, extractor={self.extractor})"

    def shards(self) -> DataFrame:
        """All shards with hours and counts; what a list lacks is counted from its manifests."""
        found = None
        for d in self.datasets:
            own = lists.read_shards(self.spark, d.shard_list, d.name)
            found = own if found is None else found.unionByName(own)
        bare = lists.existing_shards(found.where("hours is null or num_samples is null").select("manifest").distinct(), ("manifest",))
        bare = sorted(r["manifest"] for r in bare.collect())  # one row per shard
        if bare:
            totals = stats.manifest_stats(lists.read_manifests(self.spark, bare, strict=True))
            found = stats.complete_shards(found, totals.withColumn("manifest", plain_path("manifest")))
        return found

    def totals(self) -> DataFrame:
        return stats.dataset_totals(self.shards())

    def weights(self) -> DataFrame:
        by = "num_samples" if self.options.batching.batch_size else "hours"
        given = dict(zip([d.name for d in self.datasets], self.options.weights, strict=True)) if self.options.weights else None
        return mux.dataset_weights(self.totals(), by, given)

    def epoch_batches(self) -> int:
        """Batches of one rank in an epoch."""
        row = self.totals().agg(F.sum("hours"), F.sum("num_samples")).first()
        b = self.options.batching
        return mux.epoch_batches((row[0] or 0) * 3600, row[1] or 0, b.budget, b.rows, self.options.world_size, self.options.fill_factor)

    def _keep(self, name: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, int]:
        """A slim table, made at its first use, and how many bytes of audio its rows name."""
        if name not in self._kept:
            path = shared_folder(self.spark, name.split("/")[0])
            make().write.parquet(path)
            self._kept[name] = path, self.spark.read.parquet(path).agg(F.sum("size")).first()[0] or 0
        return self.spark.read.parquet(self._kept[name][0]), self._kept[name][1]

    def catalogue(self) -> DataFrame:
        """One row per sample of this rank's shards that exist: dataset, url, key, ext, offset, size, packed, frames, rate and text."""
        return self._keep("catalogue", self._catalogue)[0]

    def _catalogue(self) -> DataFrame:
        o = self.options
        shards = audiotar.rank_shards(self.shards(), o.rank, o.world_size).select("dataset", F.col("audio_tar").alias("url"), "manifest")
        index, _ = self._keep("index", lambda: tarindex.index_tars(shards.select("url").distinct()))
        there = lists.existing_shards(shards, ("manifest",)).join(index.where("error = 'missing'").select("url"), "url", "left_anti")
        manifests, n, of = there.select("manifest").distinct().collect(), there.count(), shards.count()  # one row per shard
        if n < of:
            warnings.warn(f"{of - n} of {of} shards are left out, their files are missing", stacklevel=5)
        if not manifests:
            raise ValueError("no shards for this rank")
        labels = lists.read_manifests(self.spark, sorted(r["manifest"] for r in manifests)).withColumn("manifest", plain_path("manifest"))
        entries = tarindex.choose_formats(index).where("frames > 0").drop("place", "error").join(there, "url")
        return samples.join_labels(entries, lists.last_labels(labels, ["manifest", "key"]), ["manifest", "key"]).drop("manifest")

    def _audio(self, rows: DataFrame, name: str, size: int) -> DataFrame:
        """Rows of the catalogue with their audio, read and decoded where it lies; samples that can't be decoded go."""
        read = tarindex.read_ranges(rows, tasks=size // (64 << 20) + self.spark.sparkContext.defaultParallelism, name=f"{name}_bytes")
        return samples.decode(read, self.options.sample_rate, data=f"{name}_bytes", audio=name).drop("error").where(F.size(name) > 0)

    def _chosen(self, d: Dataset) -> tuple[DataFrame, bool]:
        """A dataset's slim rows after its length filter, map and filter, with samples (their number) and length_s; and whether map or filter need audio."""
        o = self.options
        low = d.min_length if d.min_length is not None else o.batching.min_length
        high = d.max_length if d.max_length is not None else o.batching.max_length
        rows = self.catalogue().where(F.col("dataset") == d.name).withColumn("samples", tarindex.samples_at(o.sample_rate))
        rows = samples.length_filter(rows.withColumn("length_s", F.col("samples") / float(o.sample_rate)), low, high)
        try:
            if d.filter is None or isinstance(d.filter, Column):
                slim = samples.apply_map(rows, d.map) if d.map else rows
                slim = slim.where(d.filter) if d.filter is not None else slim
                if "audio" not in slim.columns:
                    return slim, False
        except AnalysisException:  # a column that only decoded samples have
            pass

        def full() -> DataFrame:
            heard = self._audio(rows, "audio", self._kept["catalogue"][1])
            heard = samples.apply_map(heard, d.map) if d.map else heard
            heard = samples.apply_filter(heard, d.filter) if d.filter is not None else heard
            heard = heard.withColumn("samples", F.size("audio").cast("long")).withColumn("length_s", F.col("samples") / float(o.sample_rate))
            return heard.drop("audio", "sample_rate")

        return self._keep(f"chosen/{d.name}", full)[0], True

    def keys(self, epoch: int = 0, passes: int | None = None) -> DataFrame:
        """Slim samples of an epoch, or of so many passes: all columns of _chosen, epoch_pass, seq (a total order), worker, and length_s as it will be after the first copy's change of speed."""
        o, out, self.again = self.options, None, []
        for d in self.datasets:
            rows, again = self._chosen(d)
            if again and d.map:
                self.again.append(d)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        rows = out.withColumn("worker", F.pmod(F.xxhash64("url"), F.lit(o.workers)).cast("int"))
        if o.is_test or (passes or o.passes) is not None:
            rows = mux.passes(rows, 1 if o.is_test else passes or o.passes)
        else:
            turns = self._turns(rows)
            rows = mux.passes(rows, F.create_map(*[x for k, n in turns.items() for x in (F.lit(k), F.lit(n))])[F.col("dataset")]) if turns else mux.passes(rows, 1)
        if o.augment.speed and not o.is_test:
            by = samples.speed_of(o.augment, o.seed + epoch, SAMPLE, o.sample_rate)
            rows = rows.withColumn("copy", F.lit(0)).withColumn("samples", samples.length_at_speed(F.col("samples"), by, o.sample_rate)).drop("copy")
            rows = rows.withColumn("length_s", F.col("samples") / float(o.sample_rate))
        seed = "test" if o.is_test else f"{o.seed}/{epoch}/{o.rank}"
        key = F.concat_ws("/", F.lpad(F.col("epoch_pass").cast("string"), 6, "0"), F.col("url"), F.col("key")) if o.is_test else F.concat(F.lpad(F.col("epoch_pass").cast("string"), 6, "0"), order_key(seed, "dataset", "url", "key", "epoch_pass"))
        return rows.withColumn("seq", key)

    def _turns(self, rows: DataFrame) -> dict[str, int]:
        """How often each dataset is gone through, so that every worker that has samples makes its batches of the epoch, beside the open one of each bucket."""
        if self._turned is not None:
            return self._turned
        o, b = self.options, self.options.batching
        need = (self.epoch_batches() // o.workers + b.buckets) * (b.rows if b.rows is not None else b.budget)
        supply = rows.groupBy("worker", "dataset").agg((F.count("*") if b.rows is not None else F.sum("length_s")).alias("content"))
        self._turned = {r["dataset"]: r["n"] for r in mux.passes_needed(supply, self.weights(), need).collect()}  # one row per dataset
        return self._turned

    def samples(self, epoch: int = 0) -> DataFrame:
        """Decoded, labelled, filtered and augmented samples of one pass (or as many as the options say), with a total order (seq) in each dataset."""
        return self._decoded(self.keys(epoch, self.options.passes or 1), epoch)

    def _decoded(self, keys: DataFrame, epoch: int) -> DataFrame:
        """keys with audio: copies, noise and changes included. No row is shuffled once it has its bytes."""
        o, keys = self.options, mux.num_copies(keys, self.options.batching.num_copies)
        size = self._kept["catalogue"][1] * o.batching.num_copies
        noise = None if o.is_test or not o.augment.noise else self.noise()
        if noise is not None:
            chosen = samples.noisy(o.augment, o.seed + epoch, SAMPLE)
            keys = keys.withColumn("noise_of", F.when(chosen, F.col("dataset")))
            keys = samples.pair_noise(keys, noise, o.seed + epoch, SAMPLE)
        rows = self._audio(keys, "audio", size)
        for d in self.again:
            known = F.col("dataset") == d.name
            rows = rows.where(~known).unionByName(samples.apply_map(rows.where(known), d.map), allowMissingColumns=True)
        if o.is_test:
            return rows.withColumn("length_s", F.size("audio") / float(o.sample_rate))
        if noise is not None:
            there = {c: f"noise_{c}" for c in ("url", "offset", "size", "packed", "ext")}
            rows = tarindex.fetch(rows, there, "noise_bytes")
            rows = samples.decode(rows, o.sample_rate, data="noise_bytes", ext="noise_ext", audio="noise_audio", length=None).drop("error", "noise_of", *there.values())
        return samples.change(rows, o.augment, o.seed + epoch, SAMPLE, o.sample_rate, "noise_audio" if noise is not None else None).drop("noise_audio")

    def noise(self) -> DataFrame | None:
        """The pools of noise: dataset, idx (from 0 in each pool), n (its size) and where each entry lies. Null if no dataset has one."""
        named = [d for d in self.datasets if d.noise_list is not None]
        if not named:
            return None

        def pools() -> DataFrame:
            lines = None
            for d in named:
                own = lists.read_noise_list(self.spark, d.noise_list).select(F.lit(d.name).alias("dataset"), F.col("audio_tar").alias("url"))
                lines = own if lines is None else lines.unionByName(own)
            index = tarindex.choose_formats(tarindex.index_tars(lines.select("url").distinct(), formats=NOISE_FORMATS), NOISE_FORMATS).where("frames > 0")
            keyed = index.join(lines, "url").withColumn("k", order_key(self.options.seed, "url", "key"))
            ranked = shuffled_rank(keyed, "k", ["url", "key"], ["dataset"], name="idx")
            sizes = ranked.groupBy(F.col("dataset").alias("of")).agg(F.count("*").alias("n"))
            return ranked.join(F.broadcast(sizes), F.col("dataset") == F.col("of")).select("dataset", "idx", "n", "url", "offset", "size", "packed", "ext")

        return self._keep("noise", pools)[0]

    def plan_batches(self, epoch: int = 0) -> tuple[DataFrame, list[str]]:
        """The epoch's batches without audio, slim: the keys of each batch's samples with its columns; and these columns."""
        o, b = self.options, self.options.batching
        group = ["worker", "bucket_id"] if b.intra_batch_mux else ["worker", "dataset", "bucket_id"]
        keys = self.keys(epoch)
        low, high = self._bounds(b.intra_batch_mux)
        first = keys.select("dataset", "worker", "seq", "url", "key", "epoch_pass", "length_s").withColumn("bucket_id", batching.bucket_id(F.col("length_s"), low, high, b.buckets))
        slim = self._order(first).select("dataset", *[g for g in group if g != "dataset"], "seq", "place", "url", "key", "epoch_pass", "length_s")
        order = ["place", "seq"]
        if b.rows is not None:
            packed = batching.fixed_batches(slim, order, b.rows, group)
        else:
            packed = batching.greedy_batches(slim, order, "length_s", b.budget, b.cap, group)
        if o.is_test:
            return batching.flushed_batches(packed, order, "length_s", None if b.rows is not None else b.budget, b.rows or b.cap, group).drop("from_bucket"), [*group, "batch_id", "flushed"]
        per_worker = max(1, self.epoch_batches() // o.workers)
        # batches go out in the order in which arriving samples fill their buckets; what is still open at the end comes last
        nominal = F.greatest(batching.bucket_midpoint(F.col("bucket_id"), low, high, b.buckets), F.lit(1e-9))
        events = batching.emission_events(packed, order, F.lit(b.budget), nominal, group, b.rows)
        events = batching.drop_tails(events, group) if b.drop_tail else events
        at = F.when(F.col("event").isNull(), F.lit("~")).otherwise(F.format_string("%032.9f/%s", "event.place", "event.seq"))
        batches = events.select(*group, "batch_id", F.concat_ws("/", at, order_key(f"emit{o.seed}/{epoch}/{o.rank}", *group, "batch_id")).alias("__k"))
        if "dataset" in group and len(self.datasets) > 1:
            # each dataset's batches arrive at a rate that follows its weight
            ties = ["worker", "bucket_id", "batch_id"]
            ranked = rank_by(batches, [F.lit(0)], ["__k", *ties], ["dataset", "worker"], name="__r")
            raced = mux.random_mix_time(ranked, self.weights(), o.seed + epoch, ["dataset", *ties], rank="__r", within=["worker"])
            batches = raced.select(*group, "batch_id", F.col("t").alias("__k"))
        emitted = batching.epoch_limit(batches, per_worker, ["__k"]).drop("__k")
        return packed.join(emitted, [*group, "batch_id"], "left_semi"), [*group, "batch_id"]

    def batches(self, epoch: int = 0) -> DataFrame:
        """Padded batches: worker, bucket_id, batch_id, ids, text, each column that a map added, audio, audio_lens, feature, feature_lens; in a test pass flushed too, the
        place in the flush of what buckets held at the end."""
        packed, group = self.plan_batches(epoch)
        keys = ["dataset", "url", "key", "epoch_pass"]
        rows = self.keys(epoch)
        extra = {c: c for c in rows.columns if c not in KNOWN}
        full = self._decoded(rows.drop("worker", "seq", "length_s").join(packed.drop("length_s"), keys), epoch)
        if self.extractor is not None:
            full = full.withColumn("feature", features(F.col("audio"), self.extractor))
        extra |= {c: c for c in full.columns if c not in {*KNOWN, *packed.columns, "copy", "audio", "feature", "length_s", "sample_rate"}}
        return collate(full, group, ["copy", "place", "seq"], {"ids": "key", "text": "text", **extra}, ["audio"], ["feature"] if self.extractor is not None else [])

    def _bounds(self, together: bool) -> tuple[Column, Column]:
        """Shortest and longest length of the buckets: of all datasets, or of each one's own."""
        b = self.options.batching
        low = {d.name: b.min_length if d.min_length is None else d.min_length for d in self.datasets}
        high = {d.name: b.max_length if d.max_length is None else d.max_length for d in self.datasets}
        if together:
            return F.lit(float(min(low.values()))), F.lit(float(max(high.values())))
        return tuple(F.create_map(*[F.lit(x) for k, v in side.items() for x in (k, float(v))])[F.col("dataset")] for side in (low, high))

    def _order(self, first: DataFrame) -> DataFrame:
        """place: arrival time in the mix of datasets."""
        if len(self.datasets) == 1 or self.options.is_test or not self.options.batching.intra_batch_mux:
            return first.withColumn("place", F.lit(0.0))
        ranked = shuffled_rank(first, "seq", ["key"], ["dataset"], digits=9, name="rank")  # the pass and the first digits of the hash
        return mux.random_mix_time(ranked, self.weights(), self.options.seed, ["seq", "key"]).withColumnRenamed("t", "place")

    def iterate(self, epoch: int = 0, prefetch: bool = True):
        """Rows of batches, one partition at a time, the next one being computed meanwhile."""
        return self.batches(epoch).toLocalIterator(prefetchPartitions=prefetch)

    def with_options(self, **changes) -> Loader:
        return Loader(self.spark, self.datasets, replace(self.options, **changes), self.extractor)


def base_name_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".lst")


def plain_path(column: str) -> Column:
    """A path as lists write it, without Spark's file: scheme."""
    return F.regexp_replace(column, r"^file:(//)?(?=/)", "")


__all__ = ["Dataset", "Loader", "base_name"]
