"""Operators over one hot key, ties, nulls and many parts, against brute force in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest, layout, metrics, mvcc, transactions
from tidemark.sources import changelog, storage

META = "run long, level int, min_k string, max_k string, entries long"


def test_as_of_with_one_hot_key(spark):
    rng = random.Random(1)
    history = [("hot", s) for s in range(0, 4000, 2)] + [(f"k{rng.randrange(30)}", s) for s in range(1, 400, 2)]
    asked = [(i, rng.choice(["hot", "hot", "k3", "none"]), rng.randrange(-5, 4200)) for i in range(800)]
    out = mvcc.as_of(spark.createDataFrame(history, "k string, seqno long"), spark.createDataFrame(asked, "id long, k string, at long")).collect()
    known = {}
    for i, k, at in asked:
        own = [s for x, s in history if x == k]
        if own:
            known[i] = max((s for s in own if s < at), default=min(own))
    assert {r.id: r.seqno for r in out} == known


def test_versions_at_takes_the_snapshot_itself(spark):
    history = spark.createDataFrame([("a", 5, 0, "x"), ("a", 9, 1, None), ("b", 7, 0, "y")], "k string, seqno long, vt int, v string")
    asked = spark.createDataFrame([(1, "a", 5), (2, "a", 4), (3, "a", 100), (4, "b", 7), (5, "c", 7)], "id long, k string, at long")
    out = {r.id: r.found for r in mvcc.versions_at(history, asked, ("vt", "v")).collect()}
    assert out[1].v == "x" and out[2] is None and (out[3].seqno, out[3].vt) == (9, 1) and out[4].v == "y" and out[5] is None
    assert mvcc.versions_at(history.limit(0), asked).count() == 5 and mvcc.versions_at(history, asked.limit(0)).count() == 0


@pytest.mark.parametrize("most", [500_000, 3])
def test_range_conflicts_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(transactions, "RANGES", most)
    rng = random.Random(2)
    keys = [f"k{i:03}" for i in range(120)] + ["é", "日本", "\U0001f600", "z", ""]
    log = [(rng.choice(keys), s) for s in range(1, 600)] + [("hot", s) for s in range(600, 1500)]
    ranges = [(i % 9, *sorted([rng.choice(keys), rng.choice([*keys, "hot"])]), rng.randrange(0, 1500)) for i in range(60)] + [(50, "x", "a", 0), (51, "", "\U0010ffff", 1400)]
    known = {(tx, k) for tx, lo, hi, at in ranges for k, s in log if lo.encode() <= k.encode() <= hi.encode() and s > at}
    frame = spark.createDataFrame(log, "k string, seqno long").repartition(5)
    out = transactions.range_conflicts(frame, spark.createDataFrame(ranges, "tx long, lo string, hi string, seqno long"))
    assert {(r.tx, r.k) for r in out.collect()} == known
    empty = spark.createDataFrame([], "tx long, lo string, hi string, seqno long")
    assert transactions.range_conflicts(frame, empty).count() == 0
    assert transactions.range_conflicts(frame.limit(0), spark.createDataFrame(ranges, "tx long, lo string, hi string, seqno long")).count() == 0


def test_tracked_reads_and_commit(spark):
    log = spark.createDataFrame([("a", 1, 0, "a1"), ("a", 6, 0, "a6"), ("b", 2, 1, None), ("c", 3, 0, "c3")], "k string, seqno long, vt int, v string")
    overlay = spark.createDataFrame([(1, "c", 1, 0, "mine"), (1, "c", 2, 0, "mine too"), (2, "d", 1, 1, None)], "tx long, k string, ord long, vt int, v string")
    reads = spark.createDataFrame([(1, "a", 1, 5), (1, "a", 2, 9), (1, "b", 3, 5), (1, "c", 4, 5), (1, "x", 5, 5), (2, "c", 1, 5), (2, "d", 2, 5)], "tx long, k string, ord long, at long")
    tracked = transactions.tracked_reads(log, overlay, reads)
    assert {(r.tx, r.ord): (r.v, r.own, r.seqno) for r in tracked.collect()} == {
        (1, 1): ("a1", False, 1), (1, 2): ("a6", False, 6), (1, 3): (None, False, 0), (1, 4): ("mine too", True, None), (1, 5): (None, False, 0), (2, 1): ("c3", False, 3), (2, 2): (None, True, None),
    }
    points = transactions.read_set(tracked)
    assert {(r.tx, r.k): r.seqno for r in points.collect()} == {(1, "a"): 1, (1, "b"): 0, (1, "x"): 0, (2, "c"): 3}  # the first read wins
    commits = spark.createDataFrame([(1, 8), (2, 8)], "tx long, at long")
    bad = transactions.outdated(log, points, commits)
    assert {(r.tx, r.k) for r in bad.collect()} == {(1, "a"), (1, "b")}
    assert [(r.tx, r.k, r.vt) for r in transactions.validated(overlay, bad).collect()] == [(2, "d", 1)]
    assert {r.tx: r.reads for r in transactions.read_set_size(points).collect()} == {1: 3, 2: 1}


def test_percentiles_with_a_hot_group_and_ties(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([1.5, rng.random() * 100])) for _ in range(5000)] + [("few", x) for x in (3.0, 1.0, 2.0)] + [("same", 7.0)] * 50 + [("none", None)]
    out = {r.g: r for r in metrics.latencies(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    for g in ("hot", "few", "same"):
        own = sorted(x for h, x in rows if h == g)
        for p in (50, 95, 99):
            assert out[g][f"p{p}"] == own[-(-p * len(own) // 100) - 1]
        assert (out[g].n, out[g].least, out[g].most) == (len(own), own[0], own[-1])
    assert out["none"].n == 1 and out["none"].p50 is None


def test_overlap_counts_by_brute_force(spark):
    rng = random.Random(4)
    runs = [(i, i % 2, *sorted([f"k{rng.randrange(60):02}", f"k{rng.randrange(60):02}"]), 1) for i in range(80)] + [(100, 0, "k05", "k05", 1), (101, 1, "zz", "zz", 1)]
    meta = spark.createDataFrame(runs, META)
    out = {r.run: r.overlapping for r in layout.overlap_counts(meta, meta).collect()}
    assert out == {r[0]: sum(r[2] <= x[3] and r[3] >= x[2] for x in runs) for r in runs}
    picked = {r.run for r in layout.leveled_pick(meta).collect()}
    assert picked == {r[0] for r in runs if r[1] == 0 or any(x[1] == 0 and r[2] <= x[3] and r[3] >= x[2] for x in runs)}
    keys = spark.createDataFrame([(f"k{i:02}",) for i in range(60)] * 2, "k string")
    assert {r.k: r.runs for r in layout.may_contain(meta, keys).collect()} == {f"k{i:02}": sum(x[2] <= f"k{i:02}" <= x[3] for x in runs) for i in range(60)}


def test_ingestion_of_one_hot_prefix(spark):
    rng = random.Random(5)
    rows = [("prefix-" + str(rng.randrange(5)), s, 0, "v" * rng.randrange(1, 30)) for s in range(2000)]
    out = ingest.split(spark.createDataFrame(rows, "k string, seqno long, vt int, v string").repartition(4), 500).collect()
    held, known = 0, {}
    for k, s, _, v in sorted(rows, key=lambda r: (r[0], -r[1])):
        known[s] = held // 500
        held += len(k) + len(v)
    assert {r.seqno: r.table_no for r in out} == known


def test_ingested_files_follow_each_other(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(700))).alias("k"), F.col("id").alias("seqno"), F.lit(0).alias("vt"), F.lit("v").alias("v"))
    path = str(tmp_path / "files")
    ingest.write(rows, path, most_rows=400)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("low", "high").collect()
    assert sum(f.n for f in files) == 5000 and max(f.n for f in files) <= 400
    assert all(a.high <= b.low for a, b in zip(files, files[1:], strict=False))


def test_running_sums_and_numbers(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), i, rng.randrange(-5, 9)) for i in range(900)]
    frame = spark.createDataFrame(rows, "a long, b long, x long").repartition(7)
    out = {r.b: r.s for r in storage.running_sums(frame, {"s": F.col("x")}, F.col("a"), F.col("b")).collect()}
    held, known = 0, {}
    for _, b, x in sorted(rows):
        held += x
        known[b] = held
    assert out == known
    numbered = changelog.number(frame, 1, ["a", "b"])
    assert numbered.select("b", "seqno").collect() == numbered.select("b", "seqno").collect()  # read again, the same
    assert storage.running_sums(frame.limit(0), {"s": F.col("x")}, F.col("a")).count() == 0


def test_clears_beyond_the_broadcast_bound(spark, monkeypatch):
    log = spark.createDataFrame([("a", "k", 1, 0, "x"), ("a", "k", 5, 0, "y"), ("b", "k", 2, 0, "z")], changelog.SCHEMA)
    clears = spark.createDataFrame([("a", 3), ("a", 1), ("c", 9)], "ks string, cleared long")
    whole = {(r.ks, r.seqno) for r in changelog.live(log, clears).collect()}
    monkeypatch.setattr(changelog, "small", lambda df: df)
    assert whole == {(r.ks, r.seqno) for r in changelog.live(log, clears).collect()} == {("a", 5), ("b", 2)}


def test_catalogue_and_sequence_numbers(spark):
    log = spark.createDataFrame([("a", "k", 1, 0, "x"), ("b", "k", 5, 0, "y")], changelog.SCHEMA)
    asked = spark.createDataFrame([("a",), ("c",)], "name string")
    assert {r.name: r.present for r in changelog.exist(log, asked).collect()} == {"a": True, "c": False}
    assert changelog.last_seqno(log) == 5 and changelog.last_seqno(log.limit(0)) == 0
    assert tuple(changelog.published(log.limit(0)).first()) == (0, 1)


def test_compaction_of_what_was_picked(spark):
    rows = [("a", 1, 0, "x", 1), ("a", 4, 0, "y", 2), ("b", 2, 1, None, 1), ("m", 3, 0, "z", 3)]
    log = spark.createDataFrame(rows, "k string, seqno long, vt int, v string, run long")
    meta = spark.createDataFrame([(1, 1, "a", "b", 2), (2, 0, "a", "a", 1), (3, 1, "m", "m", 1)], META)
    assert {(r.k, r.seqno) for r in layout.major_compact(log, meta, 10).collect()} == {("a", 4), ("b", 2)}
    assert {(r.k, r.seqno) for r in layout.major_compact(log, meta, 10, all_runs=True).collect()} == {("a", 4)}
    assert math.isclose(layout.run_metadata(log).where("run = 1").first().bytes, 3)
