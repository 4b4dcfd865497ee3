"""Analytics over replicated logs: replay, gaps, conflicts, commitment, votes and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def last_entry(log: DataFrame) -> DataFrame:
    """log(term, idx, ...): the last entry of every log."""
    return log.groupBy("term").agg(F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("entries"))


def gaps(log: DataFrame) -> DataFrame:
    """Entries whose index does not follow the one before."""
    w = Window.partitionBy("term").orderBy("idx")
    return log.withColumn("before", F.lag("idx").over(w)).where("before is not null and idx - before <> 1").select("term", "idx", "before")


def valid_prefix(log: DataFrame) -> DataFrame:
    """log(grp, idx, ok): entries before the first that is torn, corrupt or out of sequence."""
    w = Window.partitionBy("grp").orderBy("idx")
    bad = F.when(F.col("ok") & (F.col("idx") - F.coalesce(F.lag("idx").over(w), F.col("idx") - 1) == 1), 0).otherwise(1)
    broken = log.withColumn("bad", bad)
    return broken.withColumn("broken", F.sum("bad").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("broken = 0").drop("bad", "broken")


def complete_batches(records: DataFrame) -> DataFrame:
    """records(batch_id, declared, ...): batches that hold as many items as they declare."""
    full = records.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("declared").alias("declared")).where("n = declared")
    return records.join(full.select("batch_id"), "batch_id", "left_semi")


def first_conflict(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """(grp, idx, term): the first index at which a follower's term differs from the leader's, for each group."""
    both = leader.select("grp", "idx", F.col("term").alias("lead")).join(follower.select("grp", "idx", F.col("term").alias("own")), ["grp", "idx"])
    return both.where("lead <> own").groupBy("grp").agg(F.min("idx").alias("conflict_idx"))


def majority(n: Column) -> Column:
    return F.floor(n / 2).cast("long") + 1


def commit_index(matches: DataFrame, terms: DataFrame | None = None, current: int | None = None) -> DataFrame:
    """matches(grp, node, idx): the highest index that a majority of each group's nodes has reached.

    With terms(grp, idx, term) only entries of the current term count.
    """
    ranked = matches.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("idx"), "node"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("grp")))
    out = ranked.where(F.col("rn") == majority(F.col("n"))).select("grp", F.col("idx").alias("commit_idx"))
    if terms is None:
        return out
    mine = terms.where(F.col("term") == current).select("grp", "idx")
    return out.join(mine, "grp").where("idx <= commit_idx").groupBy("grp").agg(F.max("idx").alias("commit_idx"))


def up_to_date(last_term: Column, last_idx: Column, own_term: Column, own_idx: Column) -> Column:
    """Whether a candidate's log is at least as good as the voter's."""
    return (last_term > own_term) | ((last_term == own_term) & (last_idx >= own_idx))


def elected(votes: DataFrame) -> DataFrame:
    """votes(term, candidate, voter, cluster): candidates with a majority of distinct voters."""
    return votes.groupBy("term", "candidate").agg(F.countDistinct("voter").alias("votes"), F.max("cluster").alias("cluster")).where(F.col("votes") >= majority(F.col("cluster")))


def state(log: DataFrame, commit: int | None = None) -> DataFrame:
    """log(idx, op, k, v): the key-value state; of a key's commands the last wins, deletions drop it."""
    rows = log if commit is None else log.where(F.col("idx") <= commit)
    w = Window.partitionBy("k").orderBy(F.desc("idx"))
    return rows.where("op in ('SET', 'DELETE')").withColumn("rn", F.row_number().over(w)).where("rn = 1 and op = 'SET'").select("k", "v", "idx")


def membership(log: DataFrame) -> DataFrame:
    """log(grp, idx, op, node): members by the last change of each node since the last reconfiguration.

    A RECONFIGURE row names one node of the new set; all rows of one index belong together.
    """
    last = log.where("op = 'RECONFIGURE'").groupBy("grp").agg(F.max("idx").alias("since"))
    recent = log.join(last, "grp", "left").where("since is null or idx >= since")
    w = Window.partitionBy("grp", "node").orderBy(F.desc("idx"))
    return recent.where("op in ('RECONFIGURE', 'ADD', 'REMOVE')").withColumn("rn", F.row_number().over(w)).where("rn = 1 and op <> 'REMOVE'").select("grp", "node")
