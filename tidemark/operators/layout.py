"""Physical layout: runs (tables) and their metadata, what to compact or drop, and compaction itself.

Picking works on metadata, one row for each run; only compaction touches the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ingest import entry_bytes
from tidemark.sources.storage import running_sums, small, written

TABLE_BYTES, L0_RUNS, TIERED_RUNS, FIFO_BYTES = 64 << 20, 4, 4, 1 << 30
THROTTLE_RUNS, HALT_RUNS, HALT_SEALED = 20, 30, 4


def run_metadata(log: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    return log.groupBy(*by).agg(
        F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.min("seqno").alias("min_seqno"), F.max("seqno").alias("max_seqno"), F.count(F.lit(1)).alias("entries"), F.sum(entry_bytes()).cast("long").alias("bytes")
    )


def overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    return (a_min <= b_max) & (a_max >= b_min)


def overlaps(meta: DataFrame) -> DataFrame:
    """Pairs of runs with overlapping key ranges."""
    a, b = meta.alias("a"), meta.alias("b")
    meets = overlap(F.col("a.min_k"), F.col("a.max_k"), F.col("b.min_k"), F.col("b.max_k"))
    return a.join(b, (F.col("a.run") < F.col("b.run")) & meets).select(F.col("a.run").alias("run_a"), F.col("b.run").alias("run_b"))


def overlap_counts(meta: DataFrame, others: DataFrame) -> DataFrame:
    """meta with `overlapping`: how many key ranges of others(min_k, max_k) overlap each run's.

    One sweep over all bounds in order: those that begin at or before a run's end, without those that end
    before its start. No pair is made.
    """

    def points(rows: DataFrame, x: str, turn: int, begins: int, ends: int, asks: int) -> DataFrame:
        run = F.col("run") if asks else F.lit(None)
        return rows.select(F.col(x).alias("x"), F.lit(turn).alias("turn"), F.lit(begins).alias("begins"), F.lit(ends).alias("ends"), run.cast("long").alias("run"), F.lit(asks).alias("asks"))

    # At one key: begins, then a run's own two questions, then ends.
    rows = points(others, "min_k", 0, 1, 0, 0).unionByName(points(others, "max_k", 2, 0, 1, 0)).unionByName(points(meta, "max_k", 1, 0, 0, 1)).unionByName(points(meta, "min_k", 1, 0, 0, -1))
    swept = running_sums(rows, {"begun": F.col("begins"), "ended": F.col("ends")}, F.col("x"), F.col("turn"), F.col("run"))
    counts = swept.where("asks <> 0").groupBy("run").agg(F.sum(F.when(F.col("asks") == 1, F.col("begun")).otherwise(-F.col("ended"))).cast("long").alias("overlapping"))
    return meta.join(counts, "run")


def may_contain(meta: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(k) with the number of runs whose key range holds each."""
    asked = keys.select("k").distinct().withColumn("run", F.monotonically_increasing_id())
    counts = overlap_counts(written(asked, "keys").select("run", "k", F.col("k").alias("min_k"), F.col("k").alias("max_k")), meta)
    return counts.select("k", F.col("overlapping").alias("runs"))


def hull(meta: DataFrame) -> DataFrame:
    return meta.agg(F.min("min_k").alias("min_k"), F.max("max_k").alias("max_k"))


def leveled_pick(meta: DataFrame, level: int = 0) -> DataFrame:
    """All runs of a level and the runs of the next one that overlap any of them."""
    upper = meta.where(F.col("level") == level)
    touched = overlap_counts(meta.where(F.col("level") == level + 1), upper).where("overlapping > 0")
    return upper.unionByName(touched.select(*meta.columns))


def major_compact(log: DataFrame, meta: DataFrame, watermark: int, level: int = 0, all_runs: bool = False) -> DataFrame:
    """What replaces the runs that leveled_pick takes; log rows carry their run. Tombstones go only if no other
    run may hold their keys."""
    picked = leveled_pick(meta, level).select("run")
    return compact(log.join(small(picked), "run", "left_semi"), watermark, all_runs=all_runs)


def reclaimable(log: DataFrame, by: str, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """Weak tombstones that would vanish together with the value right below them, for each run."""
    below = F.lag("vt").over(Window.partitionBy(*keys).orderBy("seqno"))
    return log.withColumn("_below", below).where("vt = 2 and _below = 0").groupBy(by).agg(F.count(F.lit(1)).alias("reclaimable"))


def tiered_pick(meta: DataFrame, most: int = TIERED_RUNS) -> DataFrame:
    """The smallest runs of the lowest level that has enough of them."""
    full = meta.groupBy("level").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).agg(F.min("level").alias("level"))
    w = Window.partitionBy("level").orderBy("bytes", "run")
    return meta.join(F.broadcast(full), "level", "left_semi").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def fifo_drop(meta: DataFrame, most_bytes: int = FIFO_BYTES) -> DataFrame:
    """The oldest runs beyond what the newest ones, up to most_bytes, hold."""
    return running_sums(meta, {"held": F.col("bytes")}, F.desc("run")).where(F.col("held") > most_bytes).drop("held")


def strategy_state(meta: DataFrame) -> DataFrame:
    """Which strategies would compact now."""
    l0 = F.count_if(F.col("level") == 0)
    return meta.agg(
        l0.alias("l0_runs"),
        F.sum("bytes").cast("long").alias("bytes"),
        (l0 >= L0_RUNS).alias("leveled"),
        (F.count(F.lit(1)) >= TIERED_RUNS).alias("tiered"),
        (F.sum("bytes") >= FIFO_BYTES).alias("fifo"),
        F.when(l0 >= HALT_RUNS, "halt").when(l0 >= THROTTLE_RUNS, "throttle").otherwise("go").alias("pressure"),
    )


def droppable(meta: DataFrame, low: str, high: str) -> DataFrame:
    """Runs that lie wholly within a dropped range."""
    return meta.where((F.col("min_k") >= low) & (F.col("max_k") <= high))


def compact(log: DataFrame, watermark: int, keep_snapshots: bool = True, all_runs: bool = True, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """Merge runs: what no snapshot at or above the watermark can see goes.

    With keep_snapshots every version at or above the watermark stays, and the newest below it; without,
    only the newest of all. A tombstone below the watermark goes too if it is what is left of its key, but
    only if all runs that may hold the key take part.
    """
    below = F.col("seqno") < watermark
    if not keep_snapshots:
        rows = log.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seqno")))).where("_rn = 1").drop("_rn")
        return rows.where(~(below & F.col("vt").isin(1, 2))) if all_runs else rows
    old = log.where(below).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seqno")))).where("_rn = 1").drop("_rn")
    if all_runs:
        old = old.where(~F.col("vt").isin(1, 2))
    return log.where(~below).unionByName(old)


def annihilate(log: DataFrame, keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """Weak tombstones vanish together with the value right below them."""
    w = Window.partitionBy(*keys).orderBy("seqno")
    marked = log.withColumn("_above", F.lead("vt").over(w)).withColumn("_below", F.lag("vt").over(w))
    gone = ((F.col("vt") == 0) & (F.coalesce("_above", F.lit(0)) == 2)) | ((F.col("vt") == 2) & (F.coalesce("_below", F.lit(1)) == 0))
    return marked.where(~gone).drop("_above", "_below")


def as_of_merge(*sources: DataFrame) -> DataFrame:
    """Ordered union of runs, all versions kept: keys ascending, of a key the newest first."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy("k", F.desc("seqno"))
