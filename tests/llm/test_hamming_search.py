import random

import duckdb
import pytest

from tidemark.llm import hamming_search as H
from tidemark.llm import registry


def brute(codes, queries, k):
    out = set()
    for q, x in queries:
        near = sorted((bin((x ^ y) & (2**64 - 1)).count("1"), i) for i, y in codes)[:k]
        out |= {(q, i, d, n + 1) for n, (d, i) in enumerate(near)}
    return out


def test_random_and_crowded_codes(spark):
    rng = random.Random(9)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    base = [rng.getrandbits(64) for _ in range(6)]
    codes = [(i, signed(rng.getrandbits(64))) for i in range(150)]
    codes += [(200 + i, signed(rng.choice(base) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))) for i in range(150)]
    codes += [(400 + i, signed(base[0])) for i in range(300)]
    queries = codes[::9] + [(900, 0)]
    rows = spark.createDataFrame(codes, "id long, code long")
    out = H.top_k(rows, spark.createDataFrame(queries, "id long, code long"), 7).collect()
    assert {tuple(r) for r in out} == brute(codes, queries, 7) and len(out) == 7 * len(queries)


def test_fewer_rows_than_k_and_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, rank string"
    rows = [(0, [0.5] * 64, "x"), (20, [-0.5] * 64, "x"), (3, None, "x"), (40, [1.0], "x"), (None, [0.1] * 64, "x"), (5, [None] + [1.0] * 63, "x")]
    out = {tuple(r) for r in H.embedding_search(spark.createDataFrame(rows, schema), 10).collect()}
    assert out == {(0, 0, 0, 1), (0, 5, 1, 2), (0, 20, 64, 3), (20, 20, 0, 1), (20, 5, 63, 2), (20, 0, 64, 3)}
    assert H.embedding_search(spark.createDataFrame([], schema)).count() == 0


def test_query_equals_brute_force_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    known = c.sql("SELECT query_id, neighbor_id, distance, rank FROM (" + H.SQL + ")").fetchall()
    assert sorted(map(tuple, registry.op2_hamming_search(spark, sf).collect())) == sorted(known)


def test_other_lengths_are_an_error(spark):
    rows = spark.createDataFrame([(i, [0.5] * 32) for i in range(5)], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="64"):
        H.embedding_search(rows)


def test_far_neighbours_by_either_way_of_probing(spark):
    """Few codes, far from the queries: late rounds compare the values held; with many codes they probe."""
    rng = random.Random(10)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    for n in (40, 1500):
        codes = [(i, signed(rng.getrandbits(64))) for i in range(n)]
        queries = [(10_000 + i, signed(rng.getrandbits(64))) for i in range(6)]
        out = H.top_k(spark.createDataFrame(codes, "id long, code long"), spark.createDataFrame(queries, "id long, code long"), 3).collect()
        assert {tuple(r) for r in out} == brute(codes, queries, 3)
