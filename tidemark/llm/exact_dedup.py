"""Exact dedup by skew-safe combining, in DataFrame functions only.

Texts are equal when they are identical without white space. Rows are combined in three steps, each
of which groups on the full content beside its digest: within a map task (partial aggregation), per
salted digest group, and over the salt winners. Only digests that hold at least `hot_share` of all
rows get salts; there are at most 1 / hot_share of them, so the list of hot digests, and their groups in
the end, may be broadcast at any size of input. Cold groups are complete after the salted step and carry no content further.

Defined cases: a null text is the empty text; empty texts form one group; of rows with as many code
points the smallest doc_id stays, null ids last; rows that repeat a doc_id count as members each
and share their decision; an empty table gives an empty result; other columns are not read.
Two contents under one SHA-256 digest would raise an error, never merge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import SPACES, Scratch, text_of

def _whole(digits: str) -> Column:
    return F.lit(digits).cast("decimal(21,0)")


#: Above every count of 64-bit ids, and above the largest id.
_SPAN, _ABOVE = "1" + "0" * 20, str(2**63)


def normalised(text: str = "text") -> Column:
    return F.translate(text_of(text), SPACES, "")


def _rank(text: str, doc_id: str) -> Column:
    """One number that is largest for the longest text, then the smallest id; HashAggregate can hold it."""
    back = _whole(_ABOVE) - F.coalesce(F.col(doc_id).cast("decimal(21,0)"), _whole(_ABOVE))
    return (F.char_length(text_of(text)).cast("decimal(16,0)") * _whole(_SPAN) + back).cast("decimal(38,0)")


def _ranked_id(rank: Column) -> Column:
    back = F.pmod(rank, _whole(_SPAN))
    return F.when(back > 0, (_whole(_ABOVE) - back).cast("long"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_share: float = 1 / 256, salts: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    scratch = Scratch(docs.sparkSession, "exact")
    digest = F.unhex(F.sha2(normalised(text).cast("binary"), 256))
    light = scratch.save(docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest.alias("digest")), "digests")
    hot = scratch.save(light.groupBy("digest").count().where(F.col("count") >= max(2, math.ceil(light.count() * hot_share))).select("digest", F.lit(True).alias("hot")), "hot")

    rows = docs.select(digest.alias("digest"), normalised(text).alias("content"), _rank(text, doc_id).alias("best"))
    rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.when(F.col("hot"), F.spark_partition_id() % salts))
    cells = rows.groupBy("digest", "content", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("best").alias("best"))
    winners = cells.select("digest", F.when(F.col("salt").isNotNull(), F.col("content")).alias("content"), F.when(F.col("salt").isNull(), F.col("best")).alias("done"), "n", "best")
    contents = winners.repartition("digest").groupBy("digest", "content", "done").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    groups = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("n"), F.max("best").alias("best"))
    one = F.when(F.col("contents") > 1, F.raise_error(F.lit("two contents under one digest"))).otherwise(F.col("n"))
    keep = _ranked_id(F.col("best"))
    # Rows of hot digests meet their groups by broadcast, of which there are at most 1 / hot_share; the others shuffle.
    groups = scratch.save(groups, "groups")
    marked = light.join(F.broadcast(hot), "digest", "left")
    warm = marked.where("hot").join(F.broadcast(groups.join(F.broadcast(hot), "digest", "left_semi")), "digest")
    cold = marked.where("hot is null").join(groups, "digest")
    return warm.unionByName(cold).select(
        "doc_id",
        keep.alias("keep_id"),
        one.cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""
