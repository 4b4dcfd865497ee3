"""Write batches: atomic, over several keyspaces, with one sequence number; of a key's items the last wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MOST_KEY, MOST_VALUE = 65_535, 2**32


def last_items(items: DataFrame, *ties: str) -> DataFrame:
    """items(batch_id, ord, ks, k, vt, v): what a commit writes. Of items with an equal ord, the first by the columns `ties`."""
    w = Window.partitionBy("batch_id", "ks", "k").orderBy(F.desc("ord"), *ties)
    return items.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", *ties)


def commit(log: DataFrame, items: DataFrame, first_seqno: int) -> DataFrame:
    """The changelog after the batches of items have been appended, each under its own sequence number."""
    wrote = last_items(items).select("ks", "k", (F.col("batch_id") + first_seqno).alias("seqno"), "vt", "v")
    return log.select("ks", "k", "seqno", "vt", "v").unionByName(wrote)


def fault(k: str = "k", v: str = "v", most_key: int = MOST_KEY) -> Column:
    """What is wrong with an item, or null."""
    size = F.octet_length(F.coalesce(F.col(k), F.lit("")))
    return F.when(size == 0, "empty key").when(size > most_key, "long key").when(F.octet_length(v).cast("long") > F.lit(MOST_VALUE), "long value")


def checked(items: DataFrame) -> DataFrame:
    """items, or an error at run time for the first invalid one."""
    return items.where(F.when(fault().isNotNull(), F.raise_error(F.concat(F.lit("invalid item: "), fault())).cast("boolean")).otherwise(True))


def sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("batch_id").agg(F.sum(F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))).cast("long").alias("bytes"), F.count(F.lit(1)).alias("items"))
