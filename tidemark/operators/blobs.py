"""Large values apart from their keys: separation, handles, staleness and rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

THRESHOLD, STALE_SHARE = 4096, 0.25


def separate(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """rows(k, v) with vt: 3 and no value where the value is large, else 0."""
    size = F.octet_length(F.coalesce("v", F.lit("")))
    large = size >= threshold
    return rows.select("k", F.when(large, 3).otherwise(0).alias("vt"), F.when(~large, F.col("v")).alias("v"), size.cast("int").alias("bytes"))


def place(values: DataFrame, files: int) -> DataFrame:
    """values(k, seqno, size) with a handle {file_id, off}: each file is filled in key order."""
    w = Window.partitionBy("file_id").orderBy("k", "seqno")
    return values.withColumn("file_id", F.pmod(F.crc32(F.col("k").cast("binary")), F.lit(files)).cast("long")).withColumn("off", (F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).cast("long"))


def read(handles: DataFrame, blobs: DataFrame) -> DataFrame:
    """Dereference: blobs(file_id, off, v)."""
    return handles.join(blobs, ["file_id", "off"])


def statistics(blobs: DataFrame, live: DataFrame) -> DataFrame:
    """Live and stale bytes of every file; live(file_id, off) are the handles still referred to."""
    refs = live.select("file_id", "off").distinct().withColumn("_live", F.lit(True))
    marked = blobs.join(refs, ["file_id", "off"], "left")
    stale = F.sum(F.when(F.col("_live").isNull(), F.col("size")).otherwise(0)).cast("long")
    return marked.groupBy("file_id").agg(F.count(F.lit(1)).alias("blobs"), F.sum("size").cast("long").alias("bytes"), stale.alias("stale"))


def candidates(stats: DataFrame, share: float = STALE_SHARE) -> DataFrame:
    return stats.where(F.try_divide(F.col("stale"), F.col("bytes")) >= share)


def rewritten(blobs: DataFrame, live: DataFrame, files: DataFrame) -> DataFrame:
    """Live blobs of the given files with their new offsets, in the old order."""
    kept = blobs.join(files.select("file_id"), "file_id", "left_semi").join(live.select("file_id", "off"), ["file_id", "off"], "left_semi")
    w = Window.partitionBy("file_id").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return kept.withColumn("new_off", (F.sum("size").over(w) - F.col("size")).cast("long"))


def totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("stale").cast("long").alias("stale"), F.count(F.lit(1)).alias("files"))
