"""The changelog: append-only rows (ks, k, seqno, vt, v), the source of truth of all reads.

vt is 0 for a value, 1 for a tombstone, 2 for a weak tombstone, 3 for a handle to a separated value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.sources.storage import in_order, small

SCHEMA = "ks string, k string, seqno long, vt int, v string"
VALUE, TOMBSTONE, WEAK, HANDLE = 0, 1, 2, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where a row of placed_table stands in the table: its file, in the order of their names, and its number there.
PLACE = ("_file", "_row")


def placed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with PLACE, which does not change with the splits and tasks that read it."""
    return table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def events_log(spark: SparkSession, sf_dir: str, run_rows: int = 512) -> DataFrame:
    """The events table as a changelog: a key for each user, a version for each event, in runs."""
    vt = F.when(F.col("event_type") == "error", TOMBSTONE).when(F.col("event_type") == "signup", WEAK).otherwise(VALUE)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("k"),
        (F.col("event_id") + 1).alias("seqno"),
        vt.cast("int").alias("vt"),
        F.col("props").alias("v"),
        F.floor(F.col("event_id") / run_rows).cast("long").alias("run"),
    )


def append(log: DataFrame, path: str) -> None:
    """Append one commit: a file set per keyspace, sorted by key so that row groups can be skipped."""
    log.sortWithinPartitions("k", F.desc("seqno")).write.mode("append").partitionBy("ks").option("parquet.bloom.filter.enabled#k", "true").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select("ks", "k", "seqno", "vt", "v")


def number(rows: DataFrame, start: int, order: list[str]) -> DataFrame:
    """Give each row of a commit the next sequence numbers, in the given order.

    Rows are range-sorted, written and numbered within their range; only one count for each range is
    gathered to offset them, so no task sees more than its range, and a number does not change when a task runs again.
    """
    ranged = in_order(rows, *map(F.col, order))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ranged.groupBy("_part").count().select("_part", before.alias("_base"))
    numbered = ranged.join(F.broadcast(base), "_part").withColumn("seqno", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start)
    return numbered.select(*rows.columns, "seqno")


def last_seqno(log: DataFrame) -> int:
    """The highest sequence number, 0 for an empty log."""
    return log.agg(F.max("seqno")).first()[0] or 0


def published(log: DataFrame) -> DataFrame:
    """seqno, visible_seqno: a commit makes visible what is below the number after its own; neither ever falls."""
    last = F.coalesce(F.max("seqno"), F.lit(0)).cast("long")
    return log.agg(last.alias("seqno"), (last + 1).alias("visible_seqno"))


def keyspaces(log: DataFrame) -> DataFrame:
    """name, entries: the catalogue of a log(ks, ...)."""
    return log.groupBy(F.col("ks").alias("name")).agg(F.count(F.lit(1)).alias("entries"))


def exist(log: DataFrame, names: DataFrame) -> DataFrame:
    """names(name) with `present`."""
    known = log.select(F.col("ks").alias("name")).distinct().withColumn("_p", F.lit(True))
    return names.join(small(known), "name", "left").withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p")


def live(log: DataFrame, clears: DataFrame | None = None) -> DataFrame:
    """Rows newer than their keyspace's last clear marker(ks, cleared)."""
    if clears is None:
        return log
    last = clears.groupBy("ks").agg(F.max("cleared").alias("cleared"))
    return log.join(small(last), "ks", "left").where(F.col("cleared").isNull() | (F.col("seqno") > F.col("cleared"))).drop("cleared")


def is_value(vt: str = "vt") -> Column:
    return F.col(vt) == VALUE
