"""The member index of tar shards, and reading by byte ranges of it.

One slim row per audio entry: where its bytes are and, from its first bytes, how long it plays. Choosing among formats, joining transcripts, filtering by length,
ranking and packing all run on the index; only what is left is read, by ranges: a large tar is cut at multiples of `split_bytes` into tasks
of their own, ranges that nearly touch are read together, and no payload goes through a shuffle.

A gzipped tar can't be entered in the middle: its index has offsets in the unpacked stream (packed = true), and one task reads it from its start.
"""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelot.functions.audio import header_frames
from wavelot.schemas import LABELLED_FORMATS, TAR_INDEX

HEAD = 4096
_NAMES = [x.split()[0] for x in TAR_INDEX.split(", ")]


def open_random(url: str):
    """A file of any file system that pyarrow knows, open at any place."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")
    return system.open_input_file(path)


def _walk(url: str, formats: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of TAR_INDEX. Between two entries of an unpacked tar only a seek is made; of an entry only the head is read, or all of it where the head doesn't tell."""
    with open_random(url) as raw:
        packed = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        file = raw if packed else io.BufferedReader(raw, 1 << 16)
        with tarfile.open(fileobj=file, mode="r|gz" if packed else "r:") as tar:
            for place, entry in enumerate(tar):
                stem, dot, ext = entry.name.rpartition(".")
                if not (entry.isfile() and dot and ext.lower() in formats):
                    continue
                body = tar.extractfile(entry)
                try:
                    told = header_frames(body.read(HEAD), entry.size, ext.lower(), lambda body=body: body.read())
                    error = None
                except Exception as e:  # noqa: BLE001  any damaged file is one entry's error
                    told, error = (None, None), f"{type(e).__name__}: {e}"
                yield url, place, stem.removeprefix("./"), ext.lower(), entry.offset_data, entry.size, packed, *told, error


def index_tars(shards: DataFrame | list[str], spark: SparkSession | None = None, formats: tuple[str, ...] = LABELLED_FORMATS, mode: str = "FAILFAST", tasks: int | None = None) -> DataFrame:
    """shards: url (a DataFrame, or paths with spark). Rows of schemas.TAR_INDEX. A shard that doesn't exist has one row with null key and the error 'missing'.

    mode: FAILFAST, or DROPMALFORMED to leave out the rest of a damaged shard, which then has a row with null key and the error."""
    if isinstance(shards, list):
        shards = spark.createDataFrame([(p,) for p in shards], "url string")
    spark, drop = shards.sparkSession, mode.upper() == "DROPMALFORMED"
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url in pdf["url"]:
                rows = []
                try:
                    for row in _walk(url, formats):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                except FileNotFoundError:
                    rows.append((url, None, None, None, None, None, None, None, None, "missing"))
                except (tarfile.TarError, EOFError, OSError) as e:
                    if not drop:
                        raise
                    rows.append((url, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield _frame(rows)

    return shards.select("url").repartition(tasks, "url").mapInPandas(run, TAR_INDEX)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"place": "Int64", "offset": "Int64", "size": "Int64", "packed": "boolean", "frames": "Int64", "rate": "Int64"}
    return pd.DataFrame(rows, columns=_NAMES).astype(kinds)


def choose_formats(index: DataFrame, formats: tuple[str, ...] = LABELLED_FORMATS) -> DataFrame:
    """Of several entries of one key in a shard the one whose format comes first stays, of equal ones the last in the tar. Rows without a key go."""
    rank = F.array_position(F.array(*[F.lit(x) for x in formats]), F.col("ext"))
    rest = [c for c in index.columns if c not in ("url", "key")]
    best = index.where("key is not null").groupBy("url", "key").agg(F.min_by(F.struct(*rest), F.struct(rank, -F.col("place"))).alias("__e"))
    return best.select("url", "key", "__e.*")


def seconds(sample_rate: int) -> Column:
    """How long an entry of the index plays once it is resampled."""
    return samples_at(sample_rate) / F.lit(float(sample_rate))


def samples_at(sample_rate: int) -> Column:
    return F.expr(f"(frames * {sample_rate} + rate - 1) div rate")


class _Ranges:
    """Reads ranges of one shard after another. Ranges come in order; those of an unpacked tar less than `gap` apart are read together up to `most` bytes."""

    def __init__(self, gap: int = 1 << 16, most: int = 8 << 20):
        self.gap, self.most, self.url, self.file, self.read_bytes = gap, most, None, None, 0

    def open(self, url: str, packed: bool, offset: int) -> None:
        # an unpacked stream can't go back
        if self.url != url or (packed and offset < self.at):
            self.close()
            raw = open_random(url)
            self.url, self.file, self.at = url, gzip.GzipFile(fileobj=raw) if packed else raw, 0
            self.held, self.begin = b"", 0

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.url = self.file = None

    def get(self, url: str, offset: int, size: int, packed: bool, until: int) -> bytes:
        """until: where the ranges end that are wanted next of this shard."""
        self.open(url, packed, offset)
        if not self.begin <= offset <= offset + size <= self.begin + len(self.held):
            end = offset + size if packed else max(offset + size, min(until, offset + self.most))
            self.file.seek(offset)
            self.held, self.begin, self.at = self.file.read(end - offset), offset, end
            self.read_bytes += len(self.held)
        data = self.held[offset - self.begin : offset - self.begin + size]
        if len(data) < size:
            raise EOFError(f"{url} ends before {offset + size}")
        return data


def read_ranges(entries: DataFrame, split_bytes: int = 64 << 20, tasks: int | None = None, name: str = "bytes", batch_bytes: int = 16 << 20) -> DataFrame:
    """entries: url, offset, size, packed and any other columns, one row for each time an entry is wanted. Adds its bytes.

    tasks: how many tasks read; by default one for each split_bytes of what is wanted, which a sum over the slim rows tells."""
    if tasks is None:
        tasks = int((entries.agg(F.sum("size")).first()[0] or 0) // split_bytes) + 1
    cut = F.when(F.col("packed"), F.lit(0)).otherwise(F.floor(F.col("offset") / split_bytes)).cast("long")
    dealt = entries.withColumn("__cut", cut).repartition(max(1, min(tasks, 100_000)), "url", "__cut").sortWithinPartitions("url", "offset").drop("__cut")
    schema = T.StructType([*entries.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges()
        for batch in batches:
            url, offset, size, packed = (batch.column(c).to_pylist() for c in ("url", "offset", "size", "packed"))
            until = [o + s for o, s in zip(offset, size, strict=True)]
            for i in range(len(url) - 2, -1, -1):  # as far as the next ranges nearly touch
                if url[i] == url[i + 1] and offset[i + 1] - (offset[i] + size[i]) <= ranges.gap:
                    until[i] = max(until[i], until[i + 1])
            first, held, total = 0, [], 0
            for i in range(len(url)):
                held.append(ranges.get(url[i], offset[i], size[i], packed[i], until[i]))
                total += size[i]
                if total >= batch_bytes or i == len(url) - 1:
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*part.schema.names, name])
                    first, held, total = i + 1, [], 0
        ranges.close()

    return dealt.mapInArrow(run, schema)


def fetch(rows: DataFrame, columns: dict[str, str], name: str, held: int = 64) -> DataFrame:
    """Adds bytes for rows whose columns (url, offset, size and packed, by their names there) tell where they lie, without moving rows: for small shared pools, such
    as noise. A task remembers the last `held` of them. Null where url is null."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, known = _Ranges(), {}
        for batch in batches:
            out = []
            for url, offset, size, packed in zip(*(batch.column(columns[c]).to_pylist() for c in ("url", "offset", "size", "packed")), strict=True):
                if url is None:
                    out.append(None)
                    continue
                if (url, offset) not in known:
                    if len(known) >= held:
                        known.pop(next(iter(known)))
                    known[url, offset] = ranges.get(url, offset, size, packed, offset + size)
                out.append(known[url, offset])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, name])
        ranges.close()

    return rows.mapInArrow(run, schema)
