"""Print the batches of an epoch: python examples/batches.py LIST [LIST ...] [--max-duration SECONDS]"""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wavelot import Batching, Loader, LoaderOptions


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("lists", nargs="+")
    args.add_argument("--max-duration", type=float, default=600.0)
    args = args.parse_args()
    spark = SparkSession.builder.appName("batches").getOrCreate()
    loader = Loader(spark, args.lists, LoaderOptions(batching=Batching(max_duration=args.max_duration)), feature="Fbank")
    loader.totals().show()
    for row in loader.iterate():
        print(row["worker"], row["bucket_id"], row["batch_id"], len(row["ids"]), max(row["feature_lens"]))
    loader.samples().agg(F.count("*").alias("samples"), F.sum("length_s").alias("seconds")).show()


if __name__ == "__main__":
    main()
