"""Transactions: an overlay of own writes over a snapshot, and validation of what was read.

Overlay rows are (tx, k, ord, vt, v). Read sets are points(tx, k, seqno; 0 if absent), ranges(tx, lo, hi,
seqno) and full scans(tx, seqno). A transaction conflicts if a version newer than what it read exists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import mvcc
from tidemark.sources.storage import in_order, written

#: Ranges that one task compares with a part of the keys.
RANGES = 500_000


def own_writes(overlay: DataFrame) -> DataFrame:
    """The last write of each key in each transaction."""
    w = Window.partitionBy("tx", "k").orderBy(F.desc("ord"))
    return overlay.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "ord")


def read_own_writes(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """base(k, v) as one transaction sees it: its writes win, its deletions hide; sizes fall back to base."""
    mine = own_writes(overlay).select("k", F.col("vt").alias("own_vt"), F.col("v").alias("own_v"))
    seen = base.select("k", "v").join(mine, "k", "full_outer")
    v = F.when(F.col("own_vt").isNull(), F.col("v")).otherwise(F.col("own_v"))
    return seen.where(F.coalesce("own_vt", F.lit(0)) == 0).select("k", v.alias("v"), F.octet_length(v).cast("int").alias("bytes"), F.col("own_vt").isNotNull().alias("own"))


def tracked_reads(log: DataFrame, overlay: DataFrame, reads: DataFrame) -> DataFrame:
    """reads(tx, k, ord, at) of any number of transactions, each at the snapshot `at`: v, own, and the sequence
    number that was read, 0 for a key that is absent and null where the transaction's own write answered."""
    found = mvcc.versions_at(log, reads, ("vt", "v"))
    mine = own_writes(overlay).select("tx", "k", F.col("vt").alias("own_vt"), F.col("v").alias("own_v"))
    seen = found.join(mine, ["tx", "k"], "left")
    own, there = F.col("own_vt").isNotNull(), F.coalesce(F.col("found.vt") == 0, F.lit(False))
    v = F.when(own, F.when(F.col("own_vt") == 0, F.col("own_v"))).when(there, F.col("found.v"))
    return seen.select("tx", "k", "ord", v.alias("v"), own.alias("own"), F.when(~own, F.when(there, F.col("found.seqno")).otherwise(0)).alias("seqno"))


def tracked_update(tracked: DataFrame, change) -> DataFrame:
    """What fetch-and-update, or take where change gives null, does at each tracked read: the old value, the write
    that the transaction now holds, and the sequence number for its read set, null where its own write answered."""
    new: Column = change(F.col("v"))
    return tracked.select("tx", "k", "ord", F.col("v").alias("old_v"), new.alias("new_v"), F.when(new.isNull(), 1).otherwise(0).alias("vt"), "seqno")


def read_set(tracked: DataFrame) -> DataFrame:
    """points(tx, k, seqno) of tracked reads; of repeated reads of a key the first counts."""
    return tracked.where("seqno is not null").groupBy("tx", "k").agg(F.min_by("seqno", "ord").alias("seqno"))


def read_set_size(points: DataFrame, ranges: DataFrame | None = None, scans: DataFrame | None = None) -> DataFrame:
    """tx, reads: tracked keys, ranges and full scans of each transaction."""
    each = [df.select("tx") for df in (points, ranges, scans) if df is not None]
    rows = each[0]
    for df in each[1:]:
        rows = rows.unionByName(df)
    return rows.groupBy("tx").agg(F.count(F.lit(1)).alias("reads"))


def tracked_ranges(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(tx, lo, hi) with the keys they hold and the highest sequence number seen in them, 0 if none: what a
    range or prefix scan reads and what validation needs. Every stored version counts, as the scan sees them all."""
    newest, asked = log.groupBy("k").agg(F.max("seqno").alias("now")), ranges.select("tx", "lo", "hi").distinct()
    held = _within(newest, asked).groupBy("tx", "lo", "hi").agg(F.count(F.lit(1)).alias("keys"), F.max("now").alias("seqno"))
    return asked.join(held, ["tx", "lo", "hi"], "left").na.fill(0, ["keys", "seqno"])


def prefix_range(prefix: Column) -> tuple[Column, Column]:
    """The inclusive range that stands for a prefix: up to the prefix and eight of the highest characters."""
    return prefix, F.concat(prefix, F.lit("\U0010FFFF" * 8))


def tracked_full_scans(log: DataFrame, scans: DataFrame) -> DataFrame:
    """scans(tx, at) with the highest sequence number seen by each full scan."""
    return scans.join(F.broadcast(log.agg(F.max("seqno").alias("_last"))), how="cross").select("tx", F.least("at", F.coalesce("_last", F.lit(0))).alias("seqno"))


def outdated(log: DataFrame, points: DataFrame, commits: DataFrame) -> DataFrame:
    """tx, k of points(tx, k, seqno) whose key had a newer version when the transaction committed; commits(tx, at)."""
    asked = points.join(commits, "tx").select("tx", "k", "at", F.col("seqno").alias("read"))
    return mvcc.versions_at(log, asked).where(F.coalesce("found.seqno", F.lit(0)) > F.col("read")).select("tx", "k")


def validated(overlay: DataFrame, conflicts: DataFrame) -> DataFrame:
    """What the transactions without conflicts(tx, k) append: the last write of each of their keys."""
    return own_writes(overlay).join(conflicts.select("tx").distinct(), "tx", "left_anti")


def take(base: DataFrame, overlay: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values of keys(k) as seen, and the overlay rows that remove them."""
    seen = read_own_writes(base, overlay).join(keys.select("k"), "k", "left_semi")
    return seen.select("k", "v"), seen.select("k", F.lit(1).alias("vt"), F.lit(None).cast("string").alias("v"))


def fetch_update(base: DataFrame, overlay: DataFrame, keys: DataFrame, change) -> DataFrame:
    """k, old and new value; change maps a value column to the new one, null removes the key."""
    seen = read_own_writes(base, overlay).join(keys.select("k"), "k", "right")
    new: Column = change(F.col("v"))
    return seen.select("k", F.col("v").alias("old_v"), new.alias("new_v"), F.when(new.isNull(), 1).otherwise(0).alias("vt"))


def point_conflicts(log: DataFrame, points: DataFrame) -> DataFrame:
    """Point reads whose key has a newer version than the one read; a key read as absent must stay absent."""
    now = log.join(points.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.max("seqno").alias("now"))
    return points.join(now, "k").where(F.col("now") > F.col("seqno")).select("tx", "k")


def _within(latest: DataFrame, ranges: DataFrame) -> DataFrame:
    """tx, lo, hi, k, now of latest(k, now) and ranges(tx, lo, hi) for lo <= k <= hi.

    Keys are range-sorted and written; a range goes to the parts that it overlaps, whose bounds are a row each.
    A task holds the sorted keys of one part and finds each range's slice of them by its two ends. A part that
    many ranges ask for is given to several tasks.
    """
    keys = in_order(latest.select("k", "now"), F.col("k"))
    parts = [tuple(r) for r in keys.groupBy("_part").agg(F.min("k").alias("low"), F.max("k").alias("high")).collect()]  # a row for each part
    spark = latest.sparkSession
    edges = F.broadcast(spark.createDataFrame([(parts,)], "parts array<struct<part: long, low: string, high: string>>"))
    dealt = ranges.select("tx", "lo", "hi").join(edges, how="cross").select("tx", "lo", "hi", F.explode(F.filter("parts", lambda p: (p["low"] <= F.col("hi")) & (p["high"] >= F.col("lo")))["part"]).alias("_part"))
    dealt = written(dealt, "ranges")
    tasks = [(r["_part"], -(-r["count"] // RANGES)) for r in dealt.groupBy("_part").count().collect()]
    of_part = lambda: F.broadcast(spark.createDataFrame(tasks, "_part long, _tasks long"))  # noqa: E731  a row for each part
    dealt = dealt.join(of_part(), "_part").withColumn("_task", F.pmod(F.xxhash64("tx", "lo", "hi"), F.col("_tasks"))).drop("_tasks")
    spread = keys.join(of_part(), "_part").withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1))).drop("_tasks")

    def slices(own: pa.Table, asked: pa.Table) -> pa.Table:
        own = own.sort_by("k")
        # Spark compares strings by their bytes, and so does numpy where they are bytes objects.
        k = np.array([x.encode() for x in own.column("k").to_pylist()], object)
        low = np.searchsorted(k, np.array([x.encode() for x in asked.column("lo").to_pylist()], object))
        high = np.searchsorted(k, np.array([x.encode() for x in asked.column("hi").to_pylist()], object), side="right")
        n = np.maximum(high - low, 0)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]
        found = asked.select(["tx", "lo", "hi"]).take(pa.array(row))
        return found.append_column("k", own.column("k").take(pa.array(at))).append_column("now", own.column("now").take(pa.array(at)))

    schema = f"tx {ranges.schema['tx'].dataType.simpleString()}, lo string, hi string, k string, now long"
    return spread.groupBy("_part", "_task").cogroup(dealt.groupBy("_part", "_task")).applyInArrow(slices, schema)


def range_conflicts(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """Range reads (bounds inclusive) into which newer versions were written; ranges(tx, lo, hi, seqno)."""
    oldest = ranges.agg(F.min("seqno").alias("oldest"))
    newer = log.join(F.broadcast(oldest), F.col("seqno") > F.col("oldest")).select("k", F.col("seqno").alias("now"))
    latest = newer.groupBy("k").agg(F.max("now").alias("now"))
    read = ranges.groupBy("tx", "lo", "hi").agg(F.min("seqno").alias("seqno"))
    return _within(latest, read).join(read, ["tx", "lo", "hi"]).where("now > seqno").select("tx", "k").distinct()


def scan_conflicts(log: DataFrame, scans: DataFrame) -> DataFrame:
    """Full scans: any newer version conflicts."""
    return scans.join(F.broadcast(log.agg(F.max("seqno").alias("now"))), F.col("now") > F.col("seqno")).select("tx")


def merged_ranges(reads: DataFrame) -> DataFrame:
    """reads(tx, lo, hi, seqno): overlapping ranges of a transaction as one, read at the oldest of their
    snapshots so that nothing newer escapes validation."""
    w = Window.partitionBy("tx").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.when(F.col("lo") <= F.max("hi").over(w), 0).otherwise(1)
    islands = reads.withColumn("_new", begins).withColumn("island", F.sum("_new").over(Window.partitionBy("tx").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy("tx", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("seqno").alias("seqno")).drop("island")


def exempt(conflicts: DataFrame, overlay: DataFrame) -> DataFrame:
    """The compatible mode: keys that the transaction wrote itself are not validated."""
    return conflicts.join(overlay.select("tx", "k"), ["tx", "k"], "left_anti")
