"""Sum-of-squares packing of token pieces into sequences of fixed capacity.

A bin is an open sequence, its gap the tokens that still fit. Each piece goes where the sum over all
gaps of (number of open bins with that gap)^2 becomes smallest, a new bin being one of the choices. Random
shards of pieces are packed side by side, longest pieces first. Bins that end with a gap above the tolerance are
opened again and their pieces packed anew, in far fewer shards, until one shard holds what is left.

Defined results: a null text counts as empty; an end id follows each document's ids. Only documents longer than the
capacity are cut, into pieces of the capacity and one last shorter piece. Repeated rows are packed one
by one. An empty table gives an empty result. Sequence numbers are arbitrary but distinct.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelot.llm.common import cut, texts
from wavelot.llm.pieces import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, chunks: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length and the crc32 of its ids as little-endian u32."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer, chunks), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            ids_of, text = pdf["doc_id"].astype("Int64").tolist(), pdf["text"].tolist()
            for a, b in slices(text):
                ids, lengths = enc.encode(text[a:b])
                data, at, rows = memoryview(ids.astype("<u4", copy=False).tobytes()), 0, []
                for doc_id, n in zip(ids_of[a:b], lengths.tolist(), strict=True):
                    own, at = data[4 * at : 4 * (at + n)], at + n
                    for k, s in enumerate(range(0, n + 1, capacity)):
                        length = min(capacity, n + 1 - s)
                        crc = zlib.crc32(own[4 * s : 4 * (s + length)])
                        rows.append((doc_id, k, s, length, zlib.crc32(end, crc) if s + length == n + 1 else crc))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(split, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the gap of each bin. Lengths must lie in 1 .. capacity."""
    n = len(lengths)
    bin_of, offset, gap = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; index 0, full bins, always counts as 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        # moving a bin from gap g to g - s changes the sum by 2 * (count[g - s] - count[g] + 1), less 1 where it fills up
        change = 2 * (count[: capacity + 1 - s] - count[s:] + 1)
        change[0] -= 1
        change[count[s:] == 0] = np.iinfo(np.int64).max
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(change.argmin())
        if change[best] <= fresh:
            g = best + s
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b, bins = capacity, bins, bins + 1
        bin_of[i], offset[i], gap[b] = b, capacity - g, g - s
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bin_of, offset, gap[:bins]


def _filler(capacity: int, tolerance: int, r: int, last: bool):
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        b, offset, gap = sum_of_squares(pdf["length"].to_numpy(np.int64), capacity)
        out = pdf.drop(columns="shard")
        # 4 bits for the round, 35 for the shard, 24 for the bin
        ids = (r << 59) + (int(pdf["shard"].iloc[0]) << 24) + b
        return out.assign(doc_id=out["doc_id"].astype("Int64"), sequence_id=ids, offset=offset, closed=last | (gap[b] <= tolerance))

    return fill


def pack(pieces: DataFrame, capacity: int = 4096, shard_pieces: int = 8192, tolerance: int = 8, max_rounds: int = 6) -> DataFrame:
    """Add sequence_id and offset to rows with a length column. shard_pieces: mean pieces in one packing task's group."""
    schema = T.StructType([*pieces.schema.fields, *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")), T.StructField("closed", T.BooleanType())])
    done, left = [], cut(pieces)
    for r in range(max_rounds):
        n = left.count()
        shards = max(1, -(-n // shard_pieces))
        last = shards == 1 or r == max_rounds - 1

        # a stable id of each checkpointed row deals even equal rows to different shards
        dealt = left.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
        placed = cut(dealt.groupBy("shard").applyInPandas(_filler(capacity, tolerance, r, last), schema))
        done.append(placed.where("closed").drop("closed"))
        if last:
            break
        left = placed.where("not closed").select(*pieces.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
