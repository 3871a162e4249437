"""Batches of a live stream: the open batch of each (worker, bucket) is Spark state.

State is a list of the open batch's samples, to which a micro-batch only appends, and one row with its number, size and longest sample; the list is read when its
batch closes. So a micro-batch costs what it brings, and a group's state is one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "worker int, bucket_id int, batch_id long, ids array<string>, n long, longest double, total double, flushed boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenBatches(StatefulProcessor):
    def __init__(self, budget: float, cap: int | None, idle_ms: int | None, ordered: bool):
        self.budget, self.cap, self.idle_ms, self.ordered = budget, cap, idle_ms, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "id string, length double")
        self.sums = handle.getValueState("sums", "n long, longest double, total double, number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, longest, total, number = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0)
        fresh: list[tuple[str, float]] = []  # of the open batch, not yet in the state
        kept = n  # of the open batch, in the state
        for pdf in self._in_order(rows) if self.ordered else rows:
            out = []
            for sample, x in zip(pdf["id"].tolist(), pdf["length"].tolist(), strict=True):
                end = sample is None
                if n and (end or not (max(longest, x) * (n + 1) <= self.budget and (self.cap is None or n < self.cap))):
                    ids = [r[0] for r in self.held.get()] if kept else []
                    out.append((key[0], key[1], number, ids + [i for i, _ in fresh], n, longest, total, end))
                    if kept:
                        self.held.clear()
                    fresh, kept, n, longest, total, number = [], 0, 0, 0.0, 0.0, number + 1
                if not end:
                    fresh.append((sample, x))
                    n, longest, total = n + 1, max(longest, x), total + x
            if out:
                yield _rows(out)
        if fresh:
            self.held.appendList(fresh)
        self.sums.update((n, longest, total, number))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if n:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, longest, total, number = self.sums.get()
        if n:
            yield _rows([(key[0], key[1], number, [r[0] for r in self.held.get()], n, longest, total, True)])
            self.held.clear()
            self.sums.update((0, 0.0, 0.0, number + 1))

    def close(self) -> None:
        pass

    @staticmethod
    def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        last = pdf["id"].isna()
        yield pdf.iloc[np.lexsort((pdf["id"].fillna("").to_numpy(str), pdf["seq"].to_numpy(), last.to_numpy()))]


def stream_batches(samples: DataFrame, budget: float, cap: int | None = None, idle_ms: int | None = None, ordered: bool = True) -> DataFrame:
    """samples: worker, bucket_id, seq, id, length (a stream). A batch is emitted once the next sample of its bucket doesn't fit.

    ordered: the samples that one micro-batch has for a bucket are taken in the order of seq, which holds their seq, id and length in memory (the source's limits on a
    micro-batch bound them); else each is taken as it comes and memory doesn't depend on their number. What an ending stream leaves comes out in two ways: a row with a null
    id gives up its bucket's open batch (in order: after the other rows of its micro-batch), and idle_ms gives up that of a bucket without new samples for so long.

    Takes Spark's RocksDB state store, which it sets for the session."""
    samples.sparkSession.conf.set(PROVIDER, ROCKSDB)
    rows = samples.select("worker", "bucket_id", "seq", F.col("id").cast("string").alias("id"), F.col("length").cast("double").alias("length"))
    processor = OpenBatches(budget, cap, idle_ms, ordered)
    return rows.groupBy("worker", "bucket_id").transformWithStateInPandas(processor, OUT, "Append", "ProcessingTime" if idle_ms is not None else "None")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])
