"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its components, cut into segments that index it. Queries probe each
segment with all values within a radius that grows by one a round; where these are more than the values that
the index holds in a segment, those values are compared instead, which finds the same. A code at distance d has a segment
within floor(d / segments), so after radius r every code at distance below segments * (r + 1) has been
met: a query whose k-th verified distance lies below that is done, the others go on, and look no farther
than the k-th distance they have. A pair met by several segments, or in an earlier round, counts once by the
first segment that meets it.

Rows with equal codes are one entry of the index, with their count and their k smallest ids: no top k
by (distance, id) needs more of them, so a code that a third of all rows share costs one row. Queries
with equal codes are one query likewise. Defined cases: null vectors, and vectors of another length than
BITS, are not indexed and have no neighbours, but a table that holds vectors of other lengths only is an error;
null ids are left out; a null component counts as not positive; ties go to the
smaller id; repeated rows are neighbours each, and each query row gets its result; fewer than k rows give
all of them; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import Scratch

SEGMENTS, WIDTH = 4, 16
BITS = SEGMENTS * WIDTH


def code_of(vector: Column) -> Column:
    """The signs of the components, component i at bit i, as a long."""
    bits = F.transform(vector, lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda held, bit: F.shiftleft(held, 1).bitwiseOR(bit))


def _segment(code: Column, i: int) -> Column:
    return F.shiftrightunsigned(code, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def masks(radius: int) -> list[int]:
    """All segment differences of exactly that many bits."""
    return [sum(1 << i for i in own) for own in combinations(range(WIDTH), radius)]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, neighbor_id, distance, rank for rows and queries of (id long, code long)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "hamming")
    # The k smallest ids of each code: windows with a rank limit are cut down before the shuffle.
    ranked = rows.where("code is not null").selectExpr("id", "code", "row_number() over (partition by code order by id) as n").where(F.col("n") <= k)
    entries = scratch.save(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    index = entries.select("code", F.size("ids").alias("held"), F.posexplode(F.array(*[_segment(F.col("code"), i) for i in range(SEGMENTS)])).alias("segment", "value"))
    index = scratch.save(index, "index")
    asked = scratch.save(queries.where("code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query")), "queries")
    open_ = scratch.save(asked.select("query", F.lit(BITS).alias("edge")).distinct(), "open")
    held = {r.segment: r.n for r in index.groupBy("segment").agg(F.count_distinct("value").alias("n")).collect()}  # a row for each segment
    values = scratch.save(index.select("segment", "value").distinct().groupBy("segment").agg(F.collect_list("value").alias("values")), "values")  # 2**WIDTH numbers for a segment at most
    changes = spark.createDataFrame([(r, masks(r)) for r in range(WIDTH + 1)], "radius int, masks array<int>")  # 2**WIDTH numbers
    met = spark.createDataFrame([], "query long, code long, distance int, held int")
    least = F.least(*[F.bit_count(_segment(F.col("query").bitwiseXOR(F.col("code")), i)) for i in range(SEGMENTS)])
    for radius in range(WIDTH + 1):
        # Each task probes for some queries: the small table of open ones is dealt out before it is multiplied.
        probes = open_.select("query", "edge", F.posexplode(F.array(*[_segment(F.col("query"), i) for i in range(SEGMENTS)])).alias("segment", "own")).repartition("query", "segment")
        many = [i for i in range(SEGMENTS) if len(masks(radius)) > held.get(i, 0)]
        few = probes.where(~F.col("segment").isin(many)).withColumn("radius", F.lit(radius)).join(F.broadcast(changes), "radius")
        few = few.select("query", "edge", "segment", F.explode("masks").alias("mask"), "own").select("query", "edge", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        swept = probes.where(F.col("segment").isin(many)).join(F.broadcast(values), "segment")
        swept = swept.select("query", "edge", "segment", F.explode(F.expr(f"filter(values, v -> bit_count(v ^ own) = {radius})")).alias("value"))
        found = few.unionByName(swept).join(index, ["segment", "value"])
        apart = F.col("query").bitwiseXOR(F.col("code"))
        earlier = [(F.col("segment") > i) & (F.bit_count(_segment(apart, i)) <= radius) for i in range(SEGMENTS)]
        near = F.bit_count(apart) <= F.col("edge")  # no farther than the k-th met so far
        once = near & (least >= radius) & ~(earlier[0] | earlier[1] | earlier[2] | earlier[3])
        found = found.where(once).select("query", "code", F.bit_count(apart).cast("int").alias("distance"), "held")
        # Codes with k nearer ones cannot count any more; the limit on the rank also holds before the shuffle.
        best = met.unionByName(found).selectExpr("*", "rank() over (partition by query order by distance) as place").where(F.col("place") <= k)
        met_now = scratch.save(best.drop("place"), "met")
        covered = SEGMENTS * (radius + 1)
        state = met_now.groupBy("query").agg(
            F.coalesce(F.sum(F.when(F.col("distance") < covered, F.col("held"))), F.lit(0)).alias("sure"), F.when(F.sum("held") >= k, F.max("distance")).alias("reach")
        )
        left = open_.select("query").join(state, "query", "left").where(F.coalesce("sure", F.lit(0)) < k)
        left = scratch.save(left.select("query", F.coalesce("reach", F.lit(BITS)).cast("int").alias("edge")), "open")
        scratch.drop(met, open_)
        met, open_ = met_now, left
        if open_.isEmpty():
            break
    pairs = met.join(entries, "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    pairs = pairs.selectExpr("query", "neighbor_id", "distance", "row_number() over (partition by query order by distance, neighbor_id) as rank").where(F.col("rank") <= k)
    # A query code is asked for by any number of rows: its at most k results go to all of them as one row.
    results = pairs.groupBy("query").agg(F.collect_list(F.struct("neighbor_id", "distance", "rank")).alias("found"))
    answered = asked.join(results, "query").select("query_id", F.explode("found").alias("found")).select("query_id", "found.*")
    return answered.select("query_id", "neighbor_id", F.col("distance").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank"))


def embedding_search(embeddings: DataFrame, k: int = 10, every: int = 20) -> DataFrame:
    """The k nearest rows of every row whose vec_id is divisible by `every`, itself among them."""
    sizes = embeddings.agg(F.count("embedding").alias("all"), F.count_if(F.size("embedding") == BITS).alias("fit")).first()
    if sizes["all"] and not sizes["fit"]:
        raise ValueError(f"no vector has {BITS} components")
    codes = embeddings.where(F.size("embedding") == BITS).select(F.col("vec_id").cast("long").alias("id"), code_of(F.col("embedding")).alias("code")).where("id is not null")
    return top_k(codes, codes.where(F.col("id") % every == 0), k)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) AS bits FROM embeddings WHERE len(embedding) = 64),
p AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CAST(z[1] <> z[2] AS INTEGER))) AS INTEGER) AS distance
  FROM v q, v r WHERE q.vec_id % 20 = 0
)
SELECT query_id, neighbor_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) <= 10
"""
