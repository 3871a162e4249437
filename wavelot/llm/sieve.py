"""A Bloom filter of fixed size that keeps rows out of a shuffle.

The filter holds 2^bits bits whatever the data, so its broadcast is bounded. It never loses a row: a row that it lets through by chance merely
takes part in the join that follows. Where it fills up, all rows pass, and the join is an ordinary shuffle join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelot.llm.common import giving_back
from wavelot.llm.hashing import mix

_SEEDS = tuple(np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))


def _bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    x = keys.astype(np.int64).view(np.uint64)
    return [(mix(x ^ s) >> np.uint64(64 - bits)).astype(np.int64) for s in _SEEDS]


def _filled(keys: DataFrame, bits: int):
    """Broadcast filter of keys (one long column)."""
    spark = keys.sparkSession

    @giving_back
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 << (bits - 3), np.uint8)
        for pdf in batches:
            for at in _bits(pdf.iloc[:, 0].to_numpy(), bits):
                np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        words = held.view(np.int64)
        some = np.flatnonzero(words)
        yield pd.DataFrame({"word": some, "value": words[some]})

    words = keys.mapInPandas(mark, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()  # 2^bits / 64 rows at most
    held = np.zeros(1 << (bits - 6), np.int64)
    held[words["word"].to_numpy()] = words["value"].to_numpy()
    return spark.sparkContext.broadcast(held.view(np.uint8))


def _held(filled: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for at in _bits(keys, bits):
        hit &= (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit


def sift(rows: DataFrame, column: str, keys: DataFrame, bits: int = 25, keep: bool = False) -> DataFrame:
    """The rows whose column (long) may be among the keys (one long column): all that are, and few others. keep: all rows, with that as column sifted."""
    shared = _filled(keys, bits)

    @F.pandas_udf(T.BooleanType())
    @giving_back
    def maybe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_held(shared.value, batch.to_numpy(), bits))

    return rows.withColumn("sifted", maybe(column)) if keep else rows.where(maybe(column))


def sift_lists(rows: DataFrame, keys: DataFrame, bits: int = 25) -> DataFrame:
    """rows: id, keys (array<long>). id and bucket for each element that may be among the keys (one long column)."""
    shared = _filled(keys, bits)

    @giving_back
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            hit = _held(shared.value, flat, bits) if len(flat) else np.zeros(0, bool)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit], pa.int64()), pa.array(flat[hit], pa.int64())], ["id", "bucket"])

    return rows.select("id", "keys").mapInArrow(pick, "id long, bucket long")
