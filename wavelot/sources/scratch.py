"""The folder that driver and executors share, and feeding a stream part by part into a table there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir. Only a local session may go without that setting: it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='wavelot-')}"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_stream(stream: Callable[[DataFrame], DataFrame], parts: Iterable[DataFrame]) -> DataFrame:
    """Feed the parts one after the other, each as what is new on a live source, to a stream that keeps its state in the shared folder; its whole output."""
    base = None
    for k, part in enumerate(parts):
        spark = part.sparkSession
        base = base or shared_folder(spark, "stream")
        part.write.parquet(f"{base}/in/part{k}")
        live = stream(spark.readStream.schema(part.schema).parquet(f"{base}/in/part*"))
        # started anew for each part, it goes on from its checkpoint
        live.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{base}/out")
