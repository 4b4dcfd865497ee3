"""Storage metrics and summaries of measured latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.sources.storage import bounds, part_of


def rollup(meta: DataFrame) -> DataFrame:
    """meta(ks, level, bytes, entries): totals for each level, each keyspace and all."""
    return meta.rollup("ks", "level").agg(F.count(F.lit(1)).alias("tables"), F.sum("bytes").cast("long").alias("bytes"), F.sum("entries").cast("long").alias("entries"))


def tombstones(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(F.count_if(F.col("vt") == 0).alias("n_values"), F.count_if(F.col("vt") == 1).alias("n_tombstones"), F.count_if(F.col("vt") == 2).alias("n_weak"))


def evictable(journals: DataFrame) -> DataFrame:
    """journals(journal, ks, persisted, lsn): the oldest journals all of whose keyspaces are persisted, up
    to the first that is not."""
    done = journals.groupBy("journal").agg(F.bool_and(F.col("persisted") >= F.col("lsn")).alias("done"))
    w = Window.orderBy("journal").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each journal
    return done.withColumn("all_done", F.min("done").over(w)).where("all_done").select("journal")


def latencies(samples: DataFrame, by: str, value: str, shares: tuple[int, ...] = (50, 95, 99), parts: int = 64) -> DataFrame:
    """Counts, means, extremes and exact percentiles: the least value that so many hundredths of a group do not exceed.

    A group's values are dealt over parts; counts tell in which part a percentile lies, and only that part's
    distinct values are put in order.
    """
    cuts = bounds(samples, value, parts)
    counted = samples.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_part", part_of(F.col(value), cuts))
    of_part = counted.groupBy(by, "_part").agg(F.sum("_c").alias("_held"))
    ordered = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spread = of_part.select(by, "_part", "_held", F.coalesce(F.sum("_held").over(ordered), F.lit(0)).alias("_below"), F.sum("_held").over(Window.partitionBy(by)).alias("_all"))
    wanted = spread.withColumn("_share", F.explode(F.array(*map(F.lit, shares)))).where("100 * _below < _share * _all and 100 * (_below + _held) >= _share * _all")
    ranked = counted.withColumn("_run", F.sum("_c").over(Window.partitionBy(by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = ranked.join(wanted, [by, "_part"]).where("100 * (_below + _run) >= _share * _all").groupBy(by).agg(*(F.min(F.when(F.col("_share") == p, F.col(value))).alias(f"p{p}") for p in shares))
    whole = samples.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return whole.join(found, by, "left").select(by, "n", "mean", *(f"p{p}" for p in shares), "least", "most")


def throughput(samples: DataFrame, by: str, at: str) -> DataFrame:
    """Operations, seconds from the first to the last, and operations a second (null within one instant)."""
    seconds = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    return samples.groupBy(by).agg(F.count(F.lit(1)).alias("n"), seconds.alias("seconds")).withColumn("per_second", F.try_divide(F.col("n"), F.col("seconds")))


def disk_space(log: DataFrame, by: str) -> DataFrame:
    """Bytes of keys and values of each file or journal."""
    return log.groupBy(by).agg(F.sum(F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))).cast("long").alias("bytes"))
