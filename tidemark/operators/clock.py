"""Clock synchronisation: offsets, outliers, consensus, and compact transaction ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SIGMAS, LEAST_PEERS, MOST_DELAY_NS = 2.0, 2, 100_000_000


def offset(t1: Column, t2: Column, t3: Column, t4: Column) -> Column:
    return ((t2 - t1) + (t3 - t4)) / 2


def delay(t1: Column, t2: Column, t3: Column, t4: Column) -> Column:
    return (t4 - t1) - (t3 - t2)


def confidence(delay_ns: Column) -> Column:
    return 1.0 / (1.0 + F.abs(delay_ns) / 1e6)


def without_outliers(samples: DataFrame, by: str, value: str, sigmas: float = SIGMAS) -> DataFrame:
    """samples within so many population deviations of their group's mean; groups under three pass whole.

    Statistics are grouped before they meet the samples, so a group of any size is spread out.
    """
    stats = samples.groupBy(by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"), F.count(F.lit(1)).alias("_n"))
    return samples.join(stats, by).where((F.col("_n") < 3) | (F.abs(F.col(value) - F.col("_mean")) <= sigmas * F.col("_dev"))).drop("_mean", "_dev", "_n")


def weighted_median(samples: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The lower weighted median of each group; equal values are merged first, so ties are of no account."""
    merged = samples.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumn("_run", F.sum("_w").over(w)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*by)))
    return ranked.where(F.col("_run") * 2 >= F.col("_all")).groupBy(*by).agg(F.min(value).alias("consensus"))


def sync_state(before: Column, after: Column, least: int = LEAST_PEERS) -> Column:
    return F.when((before >= least) & (after >= least), "synchronized").otherwise("failed")


def mean_deviation(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and population deviation of each group."""
    return samples.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def synchronized(samples: DataFrame, by: str, local: str, consensus: DataFrame) -> DataFrame:
    """samples with `synchronized`: the local time plus the consensus offset of the group; without one, the local time."""
    return samples.join(consensus, by, "left").withColumn("synchronized", F.col(local) + F.coalesce("consensus", F.lit(0))).drop("consensus")


def usable(samples: DataFrame, delay_ns: str, most: int = MOST_DELAY_NS) -> DataFrame:
    """samples whose delay is not over the limit, with `confidence`."""
    return samples.where(F.abs(F.col(delay_ns)) <= most).withColumn("confidence", confidence(F.col(delay_ns)))


def last_n(samples: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """What a ring buffer of n holds for each group."""
    return samples.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_rn") <= n).drop("_rn")


def ring(samples: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """What a ring buffer of n holds, with `place`, from 1 for the oldest."""
    return last_n(samples, by, order, n).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def transaction_id(ms: Column, node: Column, counter: Column) -> Column:
    """42 bits of milliseconds, 10 of the node, 12 of the counter."""
    low = F.shiftleft(node.cast("long").bitwiseAND(F.lit(1023)), 12).bitwiseOR(counter.cast("long").bitwiseAND(F.lit(4095)))
    return F.shiftleft(ms.cast("long").bitwiseAND(F.lit((1 << 42) - 1)), 22).bitwiseOR(low)
