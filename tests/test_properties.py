"""Random operation sequences against a dictionary, at random snapshots and after compaction."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import batch, blobs, clock, ingest, layout, metrics, mvcc, replication, transactions
from tidemark.sources import changelog

SCHEMA = "k string, seqno long, vt int, v string, run long"


def random_log(seed, n=300, keys=25):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys):02d}", s, rng.choice([0, 0, 0, 1, 2]), f"v{s}", s // 40) for s in range(1, n + 1)]


def model(rows, snapshot):
    state = {}
    for k, s, vt, v, _ in rows:
        if s <= snapshot:
            state[k] = (s, v) if vt == 0 else None
    return {k: x for k, x in state.items() if x}


def read(df, snapshot=None):
    return {r.k: (r.seqno, r.v) for r in mvcc.resolve(df, snapshot).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_reads_equal_a_dictionary(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for snapshot in (0, 17, 150, 300):
        assert read(log, snapshot) == model(rows, snapshot)
    known = model(rows, 200)
    got = mvcc.scan(log, 200, low="k05", high="k15", reverse=True, limit=4).collect()
    assert [r.k for r in got] == sorted((k for k in known if "k05" <= k <= "k15"), reverse=True)[:4]
    assert {r.k for r in mvcc.get(log, "k03", 200).collect()} == ({"k03"} & set(known))


@pytest.mark.parametrize("seed", [3, 4])
def test_compaction_changes_no_read_at_or_above_the_watermark(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, SCHEMA)
    merged = layout.compact(log, 180)
    assert merged.count() < log.count()
    for snapshot in (180, 240, 300):
        assert read(merged, snapshot) == model(rows, snapshot)
    # Some runs only: tombstones must stay, or older values would come back.
    older, newer = log.where("run < 3"), log.where("run >= 3")
    both = older.unionByName(layout.compact(newer, 180, all_runs=False))
    assert read(both, 300) == model(rows, 300)


def test_insert_delete_insert_and_versions(spark):
    log = spark.createDataFrame([("a", 0, 0, "v0", 0), ("a", 1, 1, None, 0), ("a", 2, 0, "v2", 0), ("b", 3, 2, None, 0)], SCHEMA)
    assert read(log, 0) == {"a": (0, "v0")} and read(log, 1) == {} and read(log, 2) == {"a": (2, "v2")}
    assert mvcc.summary(log, 1).first().is_empty
    weak = spark.createDataFrame([("a", 0, 0, "v", 0), ("a", 1, 2, None, 0), ("b", 2, 0, "w", 0)], SCHEMA)
    assert [r.k for r in layout.annihilate(weak).collect()] == ["b"]


def test_changelog_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    for first in (1, 4):
        rows = [("users", f"k{i}", first + i, 0, "x") for i in range(3)] + [("items", "k0", first, 1, None)]
        changelog.append(spark.createDataFrame(rows, changelog.SCHEMA), path)
    log = changelog.read(spark, path)
    assert log.count() == 8
    assert {(r.ks, r.k, r.seqno) for r in mvcc.resolve(log, keys=("ks", "k")).collect()} == {("users", "k0", 4), ("users", "k1", 5), ("users", "k2", 6)}
    plan = log.where("k = 'k1' and ks = 'users'")._jdf.queryExecution().toString()
    assert "EqualTo(k,k1)" in plan and "PartitionFilters: [isnotnull(ks" in plan
    cleared = spark.createDataFrame([("users", 5)], "ks string, cleared long")
    assert changelog.live(log, cleared).where("ks = 'users'").count() == 1


def test_numbers_are_dense(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("a"), "id")
    out = changelog.number(rows, 10, ["a", "id"]).orderBy("seqno").collect()
    assert [r.seqno for r in out] == list(range(10, 1010))
    assert [(r.a, r.id) for r in out] == sorted((r.a, r.id) for r in out)


def test_batches(spark):
    items = spark.createDataFrame([(1, 0, "x", "a", 0, "1"), (1, 1, "x", "a", 0, "2"), (1, 2, "y", "a", 1, None)], "batch_id long, ord int, ks string, k string, vt int, v string")
    assert {(r.ks, r.v) for r in batch.last_items(items).collect()} == {("x", "2"), ("y", None)}
    bad = spark.createDataFrame([("", "v"), ("k" * 65_536, "v"), ("k", "v")], "k string, v string")
    assert sorted(str(r[0]) for r in bad.select(batch.fault()).collect()) == ["None", "empty key", "long key"]
    with pytest.raises(Exception, match="invalid item"):
        batch.checked(bad).collect()


def test_ingestion_splits_by_size(spark):
    rows = spark.createDataFrame([(f"key{i:02d}", i, 0, "v" * 15) for i in range(50)], "k string, seqno long, vt int, v string")
    out = ingest.split(rows, 100).groupBy("table_no").count().collect()
    assert sum(r["count"] for r in out) == 50 and len(out) == 10


def test_conflicts(spark):
    log = spark.createDataFrame([("key1", 5, 0, "x", 0), ("key_m", 7, 0, "x", 0), ("old", 1, 0, "x", 0)], SCHEMA)
    points = spark.createDataFrame([(1, "key1", 3), (1, "old", 1), (2, "key_m", 0), (3, "none", 0)], "tx long, k string, seqno long")
    assert {(r.tx, r.k) for r in transactions.point_conflicts(log, points).collect()} == {(1, "key1"), (2, "key_m")}
    ranges = spark.createDataFrame([(1, "key_a", "key_z", 6), (2, "key_a", "key_z", 7)], "tx long, lo string, hi string, seqno long")
    assert [r.tx for r in transactions.range_conflicts(log, ranges).collect()] == [1]
    scans = spark.createDataFrame([(1, 6), (2, 7)], "tx long, seqno long")
    assert [r.tx for r in transactions.scan_conflicts(log, scans).collect()] == [1]
    reads = spark.createDataFrame([(1, 1, 5, 9), (1, 4, 8, 3), (1, 10, 12, 4)], "tx long, lo long, hi long, seqno long")
    assert {(r.lo, r.hi, r.seqno) for r in transactions.merged_ranges(reads).collect()} == {(1, 8, 3), (10, 12, 4)}


def test_clock(spark):
    one = spark.createDataFrame([(100, 200, 300, 400)], "a long, b long, c long, d long")
    r = one.select(clock.offset(*map(F.col, "abcd")).alias("o"), clock.delay(*map(F.col, "abcd")).alias("d")).first()
    assert (r.o, r.d) == (0, 200)
    samples = spark.createDataFrame([(1, x) for x in (1000, 1020, 980, 1010, 990, 10000)], "g int, x long")
    assert clock.without_outliers(samples, "g", "x").count() == 5
    peers = spark.createDataFrame([(1, x, 1.0) for x in (98, 100, 102, 5000, 5001)], "g int, x long, w double")
    assert abs(clock.weighted_median(peers, ["g"], "x", "w").first().consensus - 100) <= 10
    t = one.select(clock.transaction_id(F.lit(1_600_000_000_000), F.lit(7), F.lit(4095)).alias("t")).first().t
    assert (t >> 22, t >> 12 & 1023, t & 4095) == (1_600_000_000_000, 7, 4095)


def test_replication(spark):
    log = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, True), (2, 3, True)], "grp int, idx int, ok boolean")
    assert {(r.grp, r.idx) for r in replication.valid_prefix(log).collect()} == {(1, 1), (2, 1)}
    matches = spark.createDataFrame([(1, n, i) for n, i in enumerate((9, 7, 7, 3, 1))], "grp int, node int, idx int")
    assert replication.commit_index(matches).first().commit_idx == 7
    members = spark.createDataFrame([(1, 1, "ADD", 5), (1, 2, "RECONFIGURE", 1), (1, 2, "RECONFIGURE", 2), (1, 3, "ADD", 3), (1, 4, "REMOVE", 1)], "grp int, idx int, op string, node int")
    assert {r.node for r in replication.membership(members).collect()} == {2, 3}


def test_blobs_and_journals(spark):
    rows = spark.createDataFrame([("a", "x" * 4096), ("b", "x" * 4095), ("c", None)], "k string, v string")
    assert {r.k: r.vt for r in blobs.separate(rows).collect()} == {"a": 3, "b": 0, "c": 0}
    stored = spark.createDataFrame([(1, 0, 10), (1, 10, 5), (1, 15, 5), (2, 0, 9)], "file_id long, off long, size long")
    live = spark.createDataFrame([(1, 10), (2, 0)], "file_id long, off long")
    stats = blobs.statistics(stored, live)
    assert {r.file_id: r.stale for r in stats.collect()} == {1: 15, 2: 0}
    assert [(r.off, r.new_off) for r in blobs.rewritten(stored, live, blobs.candidates(stats)).collect()] == [(10, 0)]
    journals = spark.createDataFrame([(1, "a", 5, 5), (1, "b", 6, 5), (2, "a", 5, 7), (3, "a", 9, 8)], "journal long, ks string, persisted long, lsn long")
    assert [r.journal for r in metrics.evictable(journals).collect()] == [1]
