"""Writers: samples encoded for tar shards (see tarsink), and shard lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelot.functions.audio import decode, encode, load_segment, resample
from wavelot.sources.audiotar import AudioTar
from wavelot.sources.files import open_random, put_lines, read_file
from wavelot.sources.tarsink import PACKED

DONE = "shard int, fingerprint string, num_samples long, seconds double, errors long"


def encoded(planned: DataFrame, fmt: str = "wav", sample_rate: int | None = None, level: float = 0.65, tasks: int | None = None, batch_bytes: int = 16 << 20) -> DataFrame:
    """planned: shard, index, id, audio_path, text (normalised), start, duration, slice_audio. Rows of tarsink.PACKED, dealt out by shard and in the order of index.

    Of a segment only its own stretch of the file is read. sample_rate: None keeps each source's rate. Of several channels the first is kept. A sample that can't be read is a row with its error."""
    fmt = fmt.lower()

    def one(row) -> tuple[bytes | None, float | None, str | None]:
        try:
            ext = row.audio_path.rsplit(".", 1)[-1]
            if row.slice_audio:
                with open_random(row.audio_path) as file:
                    channels, rate = load_segment(file, ext, row.start, row.duration)
            else:
                channels, rate = decode(read_file(row.audio_path), ext)
            audio = resample(channels[0], rate, sample_rate or rate)
            if not len(audio):
                raise ValueError("no audio")
            return encode(audio, sample_rate or rate, fmt, level), len(audio) / (sample_rate or rate), None
        except Exception as e:  # noqa: BLE001  any damaged file is one sample's error
            return None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PACKED.split(", ")]
        for pdf in batches:
            held, size = [], 0
            for row in pdf.itertuples(index=False):
                data, seconds, error = one(row)
                held.append((row.shard, f"{row.id}.{fmt}", data, row.text, seconds, error))
                size += len(data or b"")
                if size >= batch_bytes:
                    yield pd.DataFrame(held, columns=names)
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=names)

    need = ["shard", "index", "id", "audio_path", "text", "start", "duration", "slice_audio"]
    tasks = max(1, min(tasks or 4 * planned.sparkSession.sparkContext.defaultParallelism, 10_000))
    return planned.select(*need).repartition(tasks, "shard").sortWithinPartitions("shard", "index").mapInPandas(run, PACKED)


def write_tars(rows: DataFrame, folder: str, prefix: str, bits: int = 8, fingerprint: str = "") -> None:
    """rows: tarsink.PACKED, dealt out by shard."""
    rows.sparkSession.dataSource.register(AudioTar)
    rows.write.format("audiotar").options(path=folder, prefix=prefix, bits=str(bits), fingerprint=fingerprint).mode("append").save()


def list_lines(shards: DataFrame, digits: int = 3) -> DataFrame:
    """shards: audio_tar, manifest, hours, num_samples -> value, a list's lines. Paths with white space can't stand in a list and raise."""
    bad = F.col("audio_tar").rlike(r"\s") | F.col("manifest").rlike(r"\s")
    line = F.format_string(f"%s %s %.{digits}f %d", "audio_tar", "manifest", F.coalesce("hours", F.lit(0.0)), F.coalesce("num_samples", F.lit(0)).cast("long"))
    return shards.select("audio_tar", F.when(bad, F.raise_error(F.lit("a path holds white space"))).otherwise(line).alias("value"))


def write_list(shards: DataFrame, uri: str, digits: int = 3, sort: bool = True) -> int:
    """One line per shard, sorted by tar unless told not to; the number of shards bounds what comes to the driver."""
    rows = list_lines(shards, digits)
    lines = [r["value"] for r in (rows.orderBy("audio_tar") if sort else rows).collect()]
    put_lines(uri, lines)
    return len(lines)


def find_files(spark: SparkSession, pattern: str, sort: bool = True) -> list[str]:
    """Paths that match a glob pattern (** reaches into folders), on any file system Spark knows."""
    folder, _, name = pattern.partition("/**/")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", (name or pattern).rsplit("/", 1)[-1])
    if name:
        reader = reader.option("recursiveFileLookup", "true")
    rows = reader.load(folder if name else pattern).select(F.regexp_replace("path", r"^file:(//)?(?=/)", "").alias("p"))
    found = [r["p"] for r in rows.collect()]
    return sorted(found) if sort else found
