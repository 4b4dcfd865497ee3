"""The newest version of each key as a stream.

State is one row for each key: the aggregate keeps the largest (seqno, vt, v), so late and repeated rows
change nothing, and a restart from the checkpoint folder goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def newest_stream(log: DataFrame) -> DataFrame:
    best = F.max(F.struct("seqno", "vt", "v")).alias("best")
    return log.groupBy("k").agg(best).select("k", "best.seqno", "best.vt", "best.v")


def write_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append to the table at path the keys that changed in each batch, by batch; a batch that runs again replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = spark.read.schema(f"{schema}, version int").parquet(path)
    return newest_stream(rows.drop("version"))


def merge_table(spark: SparkSession, path: str, schema: str, to: str) -> None:
    """Write the newest rows as a table of one version at another path, so that old batches can be deleted."""
    read_table(spark, path, schema).write.parquet(f"{to}/version=0")
