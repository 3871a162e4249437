"""The audiotar data source: audio entries of tar shards, one partition per shard.

    spark.dataSource.register(AudioTar)
    spark.read.format("audiotar").option("paths", json.dumps([...])).load()

Columns: url, key, ext, bytes. Options: paths (a JSON list of shards, plain or gzipped, local or any URI that pyarrow opens), formats (comma
separated, default flac,wav,mp3), payload (false leaves bytes null, for listings), mode (FAILFAST, or DROPMALFORMED to
leave out the rest of a damaged shard). An entry a/b.c.wav has key a/b.c and ext wav. With pushdown = true, filters url = ...
and url IN ... choose shards before any is opened (needs spark.sql.python.filterPushdown.enabled). Written to, it makes shards; see tarsink. To choose entries
before their bytes are read, and to cut large shards, read through an index; see tarindex.
"""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from wavelot.schemas import LABELLED_FORMATS, TAR_ENTRIES
from wavelot.sources.tarsink import AudioTarWriter


def open_shard(url: str):
    """A readable stream of any file system that pyarrow knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url if "://" in url else f"file://{url}")
    return system.open_input_stream(path, compression=None)


def read_entries(url: str, formats: tuple[str, ...], payload: bool = True) -> Iterator[tuple[str, str, str, bytes | None]]:
    with open_shard(url) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
        for entry in tar:
            stem, dot, ext = entry.name.rpartition(".")
            if entry.isfile() and dot and ext.lower() in formats:
                yield url, stem.removeprefix("./"), ext.lower(), tar.extractfile(entry).read() if payload else None


class Shard(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class AudioTarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.formats = tuple(x.strip().lower() for x in options.get("formats", ",".join(LABELLED_FORMATS)).split(","))
        self.payload = options.get("payload", "true").lower() != "false"
        self.drop = options.get("mode", "FAILFAST").upper() == "DROPMALFORMED"

    def partitions(self) -> list[InputPartition]:
        return [Shard(p) for p in self.paths] or [Shard("")]

    def read(self, partition: Shard) -> Iterator[tuple]:
        if not partition.url:
            return
        try:
            yield from read_entries(partition.url, self.formats, self.payload)
        except (tarfile.TarError, EOFError, OSError):
            if not self.drop:
                raise


class PushingReader(AudioTarReader):
    """Spark takes a reader with this method only where filter pushdown is enabled."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",):
                self.paths = [p for p in self.paths if p == f.value]
            elif isinstance(f, In) and f.attribute == ("url",):
                self.paths = [p for p in self.paths if p in f.value]
            else:
                yield f


class AudioTar(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audiotar"

    def schema(self) -> str:
        return TAR_ENTRIES

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return PushingReader(options) if options.get("pushdown", "false").lower() == "true" else AudioTarReader(options)

    def writer(self, schema, overwrite: bool) -> AudioTarWriter:
        if overwrite:
            raise ValueError("tar shards are written in mode append")
        return AudioTarWriter(dict(self.options))


def read_tars(spark: SparkSession, paths: list[str], formats: tuple[str, ...] = LABELLED_FORMATS, payload: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Tar entries; of several formats of one key the first in the order of `formats` stays."""
    spark.dataSource.register(AudioTar)
    rows = spark.read.format("audiotar").options(paths=json.dumps(paths), formats=",".join(formats), payload=str(payload).lower(), mode=mode).load()
    rank = F.array_position(F.array(*[F.lit(x) for x in formats]), F.col("ext"))
    return rows.groupBy("url", "key").agg(F.min_by(F.struct("ext", "bytes"), rank).alias("e")).select("url", "key", "e.ext", "e.bytes") if len(formats) > 1 else rows


def rank_shards(shards: DataFrame, rank: int, world_size: int, column: str = "audio_tar") -> DataFrame:
    """The shards of one rank."""
    return shards.where(F.pmod(F.xxhash64(column), F.lit(world_size)) == rank)


def pad_shards(shards: DataFrame, slots: int, column: str = "audio_tar") -> DataFrame:
    """Repeat shards in turn until their number is a multiple of slots, sorted. Spark needs no such padding; fixed readers may.

    The catalogue of shards is numbered in one task: it has one row per file."""
    from pyspark.sql import Window as W

    n = shards.count()
    if not n:
        return shards
    want = -(-n // slots) * slots
    numbered = shards.withColumn("__i", F.row_number().over(W.orderBy(column)) - 1)
    copies = (F.lit(want - 1) - F.col("__i")) / n
    return numbered.withColumn("__c", F.explode(F.sequence(F.lit(0), F.floor(copies).cast("int")))).drop("__i", "__c").orderBy(column)
