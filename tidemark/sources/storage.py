"""Intermediate tables in the folder that all executors share, and sums in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows of a table of few narrow columns that may be broadcast: at most about 16 MB.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name under spark.checkpoint.dir; one is made up only where a single machine does all the work."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: its lineage is cut, and what it holds does not change when a task runs again."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it has at most that many rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """df with `_part` and `_at`: range-sorted and written, so that rows of one key may lie in several ranges."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return written(ranged, "ordered").withColumn("_part", F.shiftright("_at", 33))


def running_sums(df: DataFrame, sums: dict[str, Column], *order: Column) -> DataFrame:
    """df with the sums of all rows up to each, itself included, in that order.

    Sums are two-level: within ranges, and over the ranges' sums, of which there is a row for each range.
    """
    ranged = in_order(df.withColumns({f"_v_{n}": c for n, c in sums.items()}), *order)
    totals = ranged.groupBy("_part").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(bases), "_part")
    out = out.withColumns({n: (F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(own)).cast("long") for n in sums})
    return out.select(*df.columns, *sums)


def bounds(df: DataFrame, column: str, parts: int) -> list[float]:
    """Numbers that cut a numeric column into about equal parts, from a mergeable sketch."""
    found = df.approxQuantile(column, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return sorted(set(found))


def part_of(value: Column, cuts: list[float]) -> Column:
    """The part that a number falls in; equal numbers fall in the same one."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)
