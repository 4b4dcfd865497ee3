"""Reads at a snapshot: a snapshot is a sequence number, a version is visible if it is not above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.sources.changelog import is_value
from tidemark.sources.storage import bounds, part_of, written


def versions(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Raw mode: every visible version, tombstones too."""
    return log if snapshot is None else log.where(F.col("seqno") <= snapshot)


def newest(log: DataFrame, snapshot: int | None = None, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """The newest visible version of every key, tombstones too.

    The rank limit is applied before the shuffle, so a key with any number of versions costs one row
    for each task.
    """
    ranked = versions(log, snapshot).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seqno"))))
    return ranked.where("_rn = 1").drop("_rn")


def resolve(log: DataFrame, snapshot: int | None = None, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """Resolved mode: the live value of every key."""
    return newest(log, snapshot, keys).where(is_value())


def get(log: DataFrame, key: str, snapshot: int | None = None) -> DataFrame:
    """The key's live version, if any; the filter on the stored key reaches the scan."""
    return resolve(log.where(F.col("k") == key), snapshot)


def contains(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """keys(k) with `present`."""
    alive = resolve(log.join(keys.select("k"), "k", "left_semi"), snapshot).select("k", F.lit(True).alias("_p"))
    return keys.join(alive, "k", "left").withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p")


def size_of(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return resolve(log, snapshot).select("k", F.octet_length("v").cast("int").alias("bytes"))


def in_range(low: str | None = None, high: str | None = None, low_open: bool = False, high_open: bool = False) -> Column:
    """A bound on k; None is unbounded."""
    out = F.lit(True)
    if low is not None:
        out = out & ((F.col("k") > low) if low_open else (F.col("k") >= low))
    if high is not None:
        out = out & ((F.col("k") < high) if high_open else (F.col("k") <= high))
    return out


def scan(log: DataFrame, snapshot: int | None = None, low: str | None = None, high: str | None = None, prefix: str | None = None, limit: int | None = None, reverse: bool = False, ordered: bool = False, raw: bool = False) -> DataFrame:
    """Range or prefix scan; bounds are inclusive. With a limit the order becomes a top-k, without a full sort."""
    rows = log.where(in_range(low, high))
    if prefix is not None:
        rows = rows.where(F.col("k").startswith(prefix))
    rows = versions(rows, snapshot) if raw else resolve(rows, snapshot)
    if ordered or limit is not None or reverse:
        rows = rows.orderBy(F.desc("k") if reverse else F.asc("k"), F.desc("seqno"))
    return rows if limit is None else rows.limit(limit)


def summary(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """First and last live key, their number, and whether there are none."""
    return resolve(log, snapshot).agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 0).alias("is_empty"))


def approximate_length(log: DataFrame, error: float = 0.02) -> DataFrame:
    return log.agg(F.approx_count_distinct("k", error).alias("n"))


def versions_at(history: DataFrame, asked: DataFrame, columns: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """asked(k, at, ...) with {seqno, other columns} of the newest version of k at or below `at` as `found`, or
    null, and the smallest sequence number of k as `oldest`.

    History and questions are sorted together per key, so a key is never expanded into pairs. A key's rows are
    dealt over parts of the sequence numbers; newest versions go from part to part as one row each.
    """
    cuts = bounds(history, "seqno", parts)
    held = {c: history.schema[c].dataType for c in columns}
    rows = history.select("k", F.col("seqno").alias("_at"), F.lit(0).alias("_kind"), *(F.col(c).alias(f"_v_{c}") for c in held), F.lit(None).cast(asked.schema).alias("_asked")).unionByName(
        asked.select("k", F.col("at").alias("_at"), F.lit(1).alias("_kind"), *(F.lit(None).cast(t).alias(f"_v_{c}") for c, t in held.items()), F.struct(*asked.columns).alias("_asked"))
    )
    version = F.when(F.col("_kind") == 0, F.struct(F.col("_at").alias("seqno"), *(F.col(f"_v_{c}").alias(c) for c in held)))
    rows = written(rows.select("k", "_at", "_kind", version.alias("_version"), "_asked", part_of(F.col("_at"), cuts).alias("_part")), "versions")  # it is read twice
    of_part = rows.groupBy("k", "_part").agg(F.max("_version").alias("_last"), F.min(F.when(F.col("_kind") == 0, F.col("_at"))).alias("_low"))
    before = Window.partitionBy("k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = of_part.select("k", "_part", F.max("_last").over(before).alias("_before"), F.min("_low").over(Window.partitionBy("k")).alias("_oldest"))
    own = Window.partitionBy("k", "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_own", F.max("_version").over(own)).where("_kind = 1").join(carried, ["k", "_part"])
    return found.select("_asked.*", F.coalesce("_own", "_before").alias("found"), F.col("_oldest").alias("oldest"))


def as_of(history: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked(id, k, at): the newest version of k strictly before `at`, else the oldest."""
    found = versions_at(history, asked.select("id", "k", (F.col("at") - 1).alias("at")))
    return found.where("oldest is not null").select("id", "k", (F.col("at") + 1).alias("at"), F.coalesce("found.seqno", "oldest").alias("seqno"))


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows whose key is not among keys(k)."""
    return rows.join(keys.select("k"), "k", "left_anti")


def value_if(log: DataFrame, wanted: Column, snapshot: int | None = None) -> DataFrame:
    """k, and v only of the keys that satisfy `wanted`; without a value column it reads keys alone."""
    return resolve(log, snapshot).select("k", F.when(wanted, F.col("v")).alias("v"))


def watermark(snapshots: DataFrame, current: int) -> DataFrame:
    """snapshots(seqno, change): opens (+1) and closes (-1). What is below the watermark may be collected."""
    held = snapshots.groupBy("seqno").agg(F.sum("change").alias("refs")).where("refs > 0")
    return held.agg(F.coalesce(F.min("seqno") - 1, F.lit(current - 1)).cast("long").alias("watermark"), F.coalesce(F.sum("refs"), F.lit(0)).cast("long").alias("open_snapshots"))
