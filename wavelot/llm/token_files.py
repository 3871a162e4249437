"""Token-id files: tokenise documents, write packed binary files in document order, read them back.

Documents are dealt into ranges of doc_id and sorted; each task encodes its range and writes files
of packed blocks (see pfor) to the shared folder. The table of contents, a Parquet table with one row
per document, is committed by Spark: only files of tasks that succeeded are named in it, so a lost
executor leaves at most files that nobody reads.

Defined results: a null text counts as empty and gets the end id alone. Null doc_ids come first.
Rows that share a doc_id each get their own ids, one after the other in the order of the texts' hash. An
empty table gives an empty result. A document's ids always lie in one file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavelot.llm import pfor
from wavelot.llm.common import scratch, texts
from wavelot.llm.pieces import encoder, slices

CONTENTS = "part int, doc_id long, file string, first long, n_tokens long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, tokenizer: str, chunks: str = "byte_level", end_id: int | None = 2, folder: str | None = None, file_ids: int = 4_000_000, block: int = 128, percentile: float = 90.0) -> str:
    """Write the files and their table of contents; returns the folder that holds both.

    tokenizer: path of the vocabulary file; chunks: how its pre-tokeniser cuts (pieces.CHUNKS);
    file_ids: a file is closed once it holds so many ids, which bounds a task's memory.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, run = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        enc, held, rows, size, number = encoder(tokenizer, chunks), [], [], 0, 0
        end = np.array([] if end_id is None else [end_id], np.uint32)
        system, base = _filesystem(f"{folder}/files")
        system.create_dir(base, recursive=True)

        def close() -> pd.DataFrame:
            nonlocal held, rows, size, number
            name = f"{part:06d}-{number:06d}-{run}.pfr"
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(pfor.encode(np.concatenate(held) if held else np.zeros(0, np.uint32), block, percentile))
            table = pd.DataFrame(rows, columns=["doc_id", "first", "n_tokens"]).astype({"doc_id": "Int64"})
            table.insert(0, "part", part)
            table.insert(2, "file", name)
            held, rows, size, number = [], [], 0, number + 1
            return table

        for pdf in batches:
            ids_of, text = pdf["doc_id"].astype("Int64").tolist(), pdf["text"].tolist()
            for a, b in slices(text):
                ids, lengths = enc.encode(text[a:b])
                at = 0
                for doc_id, n in zip(ids_of[a:b], lengths.tolist(), strict=True):
                    held += [ids[at : at + n], end]
                    rows.append((doc_id, size, n + len(end)))
                    size, at = size + n + len(end), at + n
                if size >= file_ids:
                    yield close()
        if rows:
            yield close()

    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    dealt.mapInPandas(write, CONTENTS).write.parquet(f"{folder}/contents")
    return folder


def token_contents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: part, doc_id, file, first (place in the file), n_tokens and start (ids of all documents before it)."""
    rows = spark.read.parquet(f"{folder}/contents")
    files = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("ids"))
    # one row per file, in file order: far fewer than documents
    base = files.select("file", (F.coalesce(F.sum("ids").over(W.orderBy("part", "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    return rows.join(base, "file").withColumn("start", F.col("base") + F.col("first")).drop("base")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the files: per document doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian u32)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _filesystem(f"{folder}/files")
        name, reader = None, None
        for pdf in batches:
            sums = np.zeros(len(pdf), np.int64)
            where = pdf["file"].to_numpy()
            first, count = pdf["first"].to_numpy(), pdf["n_tokens"].to_numpy()
            edges = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(pdf)] if len(pdf) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                if where[a] != name:
                    name = where[a]
                    with system.open_input_file(f"{base}/{name}") as f:
                        reader = pfor.Reader(f.read())
                lo = int(first[a:b].min())
                ids = reader.read(lo, int((first[a:b] + count[a:b]).max()) - lo).astype("<u4", copy=False)
                for i in range(a, b):
                    sums[i] = zlib.crc32(ids[first[i] - lo : first[i] - lo + count[i]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "start": pdf["start"], "n_tokens": count, "ids_crc32": sums})

    rows = token_contents(spark, folder)
    return rows.select("doc_id", "file", "first", "n_tokens", "start").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
