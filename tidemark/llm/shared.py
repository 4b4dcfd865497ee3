"""Helpers the operators share: written intermediate tables, checked broadcasts, text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources.storage import BROADCAST_ROWS, shared_folder, small  # noqa: F401  the operators take them from here

#: The six ASCII white-space characters of the contracts, \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"

#: Code points that one Python step handles at once; a longer single text is a step of its own.
STEP_CHARS = 4_000_000


#: Folders that Scratch has made.
_MADE: list[str] = []


class Scratch:
    """Written tables in the folder that the cluster shares (spark.checkpoint.dir).

    Each table cuts the lineage: a lost executor costs its running tasks, not the rounds before.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.at, self.n = spark, shared_folder(spark, label), 0
        _MADE.append(self.at)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete saved tables that no later step reads."""
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this process; call it once no result that reads them is needed any more."""
    while _MADE:
        _delete(spark, _MADE.pop())


def by_row(docs: DataFrame, work: Callable[[DataFrame], DataFrame], ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """work(docs) where each row counts by itself: if any doc_id is null or repeated, rows have keys instead while
    work runs, in the order of their doc_ids, null ids last, and the columns `ids` of the result get the doc_ids."""
    odd = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("doc_id is null or count > 1")
    if odd.isEmpty():
        return work(docs)
    rows = docs.orderBy(F.col("doc_id").cast("long").asc_nulls_last(), "text").withColumn("__own_id", F.col("doc_id"))
    keyed = Scratch(docs.sparkSession, "keyed").save(rows.withColumn("doc_id", F.monotonically_increasing_id()))
    out = work(keyed.select(*docs.columns))
    columns = out.columns
    for name in ids:
        own = keyed.select(F.col("doc_id").alias(name), F.col("__own_id"))
        out = out.join(own, name).drop(name).withColumnRenamed("__own_id", name)
    return out.select(*columns)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one step hold about `most` bytes, whole texts always."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
        pa.default_memory_pool().release_unused()  # a worker lives on between tasks, and others work beside it


def crc_fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))
