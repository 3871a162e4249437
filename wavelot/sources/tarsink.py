"""The audiotar sink: df.write.format("audiotar") makes tar shards, their manifests and their done files.

    rows.repartition(n, "shard").sortWithinPartitions("shard", ...).write.format("audiotar").option("path", folder).mode("append").save()

Rows: shard (int), name (the entry's file name), bytes, text, seconds, error. All rows of a shard come to one task, one after the other; a shard that turns up in
two tasks fails the write. Of equal names in a shard the first row counts, even if it has an error; rows with an error are counted, not written.

A task writes under names of its own in a folder of this run. The commit, on the driver, moves the files that successful tasks
named to their places and writes the done files last, so a shard is there wholly or not at all; the abort, and the end of any commit, takes the
run's folder away with whatever failed or killed attempts left. Memory holds one entry.

Options: path, prefix (set), bits (8, digits of a shard's number), fingerprint (of the plan; it stands in the done file).
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from wavelot.sources.files import filesystem, make_folder, put

PACKED = "shard int, name string, bytes binary, text string, seconds double, error string"


@dataclass
class Written(WriterCommitMessage):
    """The shards of a task: number, files' name in the run's folder, samples, seconds and errors."""

    shards: list[tuple[int, str, int, float, int]]


def shard_files(folder: str, prefix: str, shard: int, bits: int) -> tuple[str, str, str]:
    """Where a shard's tar, manifest and done file are."""
    name = f"{prefix}.{shard:0{bits}d}"
    return tuple(f"{folder.rstrip('/')}/{d}/{name}.{e}" for d, e in (("audio", "tar"), ("txt", "jsonl"), ("done", "done")))


class AudioTarWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.prefix, self.bits = options["path"].rstrip("/"), options.get("prefix", "set"), int(options.get("bits", "8"))
        self.fingerprint = options.get("fingerprint", "")
        self.temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done, now = [], None
        try:
            for batch in batches:
                columns = [batch.column(c) for c in ("shard", "name", "bytes", "text", "seconds", "error")]
                for k in range(batch.num_rows):
                    shard, name, data, text, seconds, error = (c[k].as_py() for c in columns)
                    if now is None or now.shard != shard:
                        if now is not None:
                            done.append(now.close())
                        if any(d[0] == shard for d in done):
                            raise ValueError(f"rows of shard {shard} don't follow each other")
                        now = _Shard(self.temporary, shard)
                    now.add(name, data, text, seconds, error)
            if now is not None:
                done.append(now.close())
                now = None
        finally:
            if now is not None:
                now.drop()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        shards = [x for m in messages if m is not None for x in m.shards]
        if len({x[0] for x in shards}) < len(shards):
            self.abort(messages)
            raise ValueError("a shard came from several tasks; deal rows out by shard before writing")
        system, _ = filesystem(self.folder)
        for d in ("audio", "txt", "done"):
            make_folder(f"{self.folder}/{d}")

        def move(x: tuple[int, str, int, float, int]) -> None:
            shard, name, n, seconds, errors = x
            tar, manifest, done = shard_files(self.folder, self.prefix, shard, self.bits)
            for source, target in ((f"{name}.tar", tar), (f"{name}.jsonl", manifest)):
                system.move(filesystem(f"{self.temporary}/{source}")[1], filesystem(target)[1])
            put(done, json.dumps({"shard": shard, "fingerprint": self.fingerprint, "num_samples": n, "seconds": seconds, "errors": errors}).encode())

        with ThreadPoolExecutor(32) as pool:
            list(pool.map(move, shards))
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        system, path = filesystem(self.temporary)
        system.delete_dir_contents(path, missing_dir_ok=True)
        try:
            system.delete_dir(path)
        except OSError:  # stores without folders
            pass


class _Shard:
    """One attempt's files of one shard."""

    def __init__(self, temporary: str, shard: int):
        make_folder(temporary)
        self.shard, self.name = shard, f"{shard}-{uuid.uuid4().hex}"
        self.system, self.path = filesystem(f"{temporary}/{self.name}")
        self.raw = self.system.open_output_stream(f"{self.path}.tar")
        self.lines = self.system.open_output_stream(f"{self.path}.jsonl")
        self.tar = tarfile.open(fileobj=self.raw, mode="w|")
        self.seen, self.n, self.seconds, self.errors = set(), 0, 0.0, 0

    def add(self, name: str, data: bytes | None, text: str | None, seconds: float | None, error: str | None) -> None:
        if name in self.seen:
            return
        self.seen.add(name)
        if error is not None or data is None:
            self.errors += 1
            return
        entry = tarfile.TarInfo(name)
        entry.size = len(data)
        self.tar.addfile(entry, io.BytesIO(data))
        line = {"audio_filepath": name, "text": text} | ({} if seconds is None else {"duration": round(seconds, 6)})
        self.lines.write(json.dumps(line, ensure_ascii=False, separators=(",", ":")).encode() + b"\n")
        self.n, self.seconds = self.n + 1, self.seconds + (seconds or 0.0)

    def close(self) -> tuple[int, str, int, float, int]:
        self.tar.close()
        self.raw.close()
        self.lines.close()
        return self.shard, self.name, self.n, self.seconds, self.errors

    def drop(self) -> None:
        self.raw.close()
        self.lines.close()
        for end in ("tar", "jsonl"):
            self.system.delete_file(f"{self.path}.{end}")
