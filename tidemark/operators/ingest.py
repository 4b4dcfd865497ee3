"""Bulk ingestion: sorted rows, cut into tables of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.sources.storage import running_sums

#: Bytes of a key that ingestion takes at most.
MOST_KEY = 65_536


def entry_bytes():
    return F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))


def split(rows: DataFrame, most_bytes: int) -> DataFrame:
    """rows with `table_no`: the running size in key order, divided by the most a table may hold."""
    ends = running_sums(rows, {"_end": entry_bytes().cast("long")}, F.col("k"), F.desc("seqno"))
    return ends.withColumn("table_no", F.floor((F.col("_end") - entry_bytes()) / most_bytes).cast("long")).drop("_end")


def out_of_order(rows: DataFrame) -> DataFrame:
    """rows(part, pos, k) whose key is not above the one before in their part: refused in strict order."""
    return rows.withColumn("before", F.lag("k").over(Window.partitionBy("part").orderBy("pos"))).where("before is not null and k <= before")


def write(rows: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """Range-partitioned, sorted files of bounded length."""
    rows.repartitionByRange("k").sortWithinPartitions("k", F.desc("seqno")).write.option("maxRecordsPerFile", most_rows).parquet(path)
