"""Registered queries over the given tables and the SQL each must agree with.

Every query applies operators to a whole table; constants are snapshots, bounds and limits that the
operator itself takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import sizing
from tidemark.operators import batch, blobs, clock, ingest, layout, metrics, mvcc, replication, transactions
from tidemark.sources import changelog
from tidemark.sources.changelog import PLACE, events_log, placed_table, table
from tidemark.sources.storage import running_sums, shared_folder, written
from tidemark.streaming import latest

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The changelog of events, for the SQL side.
LOG = """log AS (
  SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS k, event_id + 1 AS seqno,
         CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS vt, props AS v,
         event_id // 512 AS run, CASE WHEN event_id // 512 % 4 = 3 THEN 0 ELSE 1 END AS level
  FROM events)"""
#: The snapshot in the middle of the log.
HALF = "(SELECT max(seqno) // 2 FROM log)"
NEWEST = "SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1"
META = """meta AS (SELECT run, any_value(level) AS level, min(k) AS min_k, max(k) AS max_k, min(seqno) AS min_seqno, max(seqno) AS max_seqno,
  count(*) AS entries, CAST(sum(strlen(k) + coalesce(strlen(v), 0)) AS BIGINT) AS bytes FROM log GROUP BY run)"""
ORDER_LOG = """olog AS (SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS k, o_orderkey AS seqno, o_orderstatus AS st, o_orderpriority AS v, o_orderdate FROM orders)"""


def half(log: DataFrame) -> int:
    return changelog.last_seqno(log) // 2


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("run") % 4 == 3, 0).otherwise(1)
    return layout.run_metadata(events_log(spark, sf)).withColumn("level", level)


# Reads


@query(f"WITH {LOG} SELECT k, seqno, v FROM (SELECT * FROM log WHERE seqno <= {HALF} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1) WHERE vt = 0")
def snapshot_read(spark, sf):
    log = events_log(spark, sf)
    return mvcc.resolve(log, half(log)).select("k", "seqno", "v")


@query(f"WITH {LOG} SELECT vt, count(*) AS n FROM ({NEWEST}) GROUP BY vt")
def latest_by_type(spark, sf):
    return mvcc.newest(events_log(spark, sf)).groupBy("vt").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT k, seqno, v FROM ({NEWEST}) WHERE vt = 0 AND k BETWEEN 'u000010' AND 'u000050'")
def range_scan(spark, sf):
    return mvcc.scan(events_log(spark, sf), low="u000010", high="u000050").select("k", "seqno", "v")


@query(f"WITH {LOG} SELECT k, seqno, v FROM ({NEWEST}) WHERE vt = 0 AND k LIKE 'u00000%'")
def prefix_scan(spark, sf):
    return mvcc.scan(events_log(spark, sf), prefix="u00000").select("k", "seqno", "v")


@query(f"WITH {LOG} SELECT k, seqno FROM ({NEWEST}) WHERE vt = 0 ORDER BY k DESC LIMIT 7")
def reverse_limit(spark, sf):
    return mvcc.scan(events_log(spark, sf), limit=7, reverse=True).select("k", "seqno")


@query(f"WITH {LOG} SELECT min(k) AS first_k, max(k) AS last_k, count(*) AS n, count(*) = 0 AS is_empty FROM ({NEWEST}) WHERE vt = 0")
def first_last_len(spark, sf):
    return mvcc.summary(events_log(spark, sf))


@query(f"WITH {LOG} SELECT count(*) AS versions, count(*) FILTER (vt = 0) AS raw_values, count(DISTINCT k) AS n_keys FROM log")
def raw_len(spark, sf):
    return mvcc.versions(events_log(spark, sf)).agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("vt") == 0).alias("raw_values"), F.count_distinct("k").alias("n_keys"))


@query(f"WITH {LOG} SELECT k, seqno, vt FROM log WHERE seqno <= {HALF} AND k >= 'u000100' AND k < 'u000120'")
def raw_scan(spark, sf):
    log = events_log(spark, sf)
    return mvcc.versions(log.where(mvcc.in_range("u000100", "u000120", high_open=True)), half(log)).select("k", "seqno", "vt")


@query(f"WITH {LOG} SELECT k, seqno, v FROM (SELECT * FROM log WHERE k = 'u000042' AND seqno <= {HALF} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1) WHERE vt = 0")
def point_get(spark, sf):
    log = events_log(spark, sf)
    return mvcc.get(log, "u000042", half(log)).select("k", "seqno", "v")


@query("SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey = (SELECT max(o_orderkey) FROM orders x WHERE x.o_custkey = c_custkey) AND o_orderstatus <> 'F') AS present FROM customer")
def contains_many(spark, sf):
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seqno"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("vt"), F.lit("").alias("v"))
    return mvcc.contains(log, table(spark, sf, "customer").select(F.col("c_custkey").alias("k")))


@query(f"WITH {LOG} SELECT k, CAST(strlen(v) AS INTEGER) AS bytes FROM ({NEWEST}) WHERE vt = 0")
def size_of(spark, sf):
    return mvcc.size_of(events_log(spark, sf))


def _orders_log(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("k"), F.col("o_orderkey").alias("seqno"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("v"), "o_orderdate"
    )


@query(
    f"""WITH {ORDER_LOG}, q AS (SELECT l_orderkey * 8 + l_linenumber AS id, k, l_orderkey AS asked FROM lineitem JOIN olog ON l_orderkey = seqno)
SELECT id, k, asked, coalesce((SELECT max(seqno) FROM olog o WHERE o.k = a.k AND o.seqno < a.asked), (SELECT min(seqno) FROM olog o WHERE o.k = a.k)) AS seqno FROM q a"""
)
def version_asof(spark, sf):
    history = _orders_log(spark, sf)
    asked = table(spark, sf, "lineitem").join(history, F.col("l_orderkey") == F.col("seqno")).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "k", F.col("l_orderkey").alias("at"))
    return mvcc.as_of(history, asked).withColumnRenamed("at", "asked")


@query("WITH h AS (SELECT user_id AS seqno, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END) AS refs FROM events GROUP BY 1 HAVING refs > 0) SELECT CAST(coalesce(min(seqno) - 1, (SELECT max(event_id) FROM events)) AS BIGINT) AS watermark, CAST(coalesce(sum(refs), 0) AS BIGINT) AS open_snapshots FROM h")
def gc_watermark(spark, sf):
    change = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    return mvcc.watermark(table(spark, sf, "events").select(F.col("user_id").alias("seqno"), change.alias("change")), changelog.last_seqno(events_log(spark, sf)))


@query("SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 99 AS seqno FROM orders")
def seqno_assign(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    return changelog.number(rows, 100, ["o_orderdate", "k"]).select("k", "seqno")


@query(f"WITH {LOG}, clears AS (SELECT k, max(seqno) AS cleared FROM log WHERE vt = 2 GROUP BY k) SELECT l.k, count(*) AS n FROM log l LEFT JOIN clears c ON l.k = c.k WHERE c.cleared IS NULL OR l.seqno > c.cleared GROUP BY l.k")
def clear_epoch(spark, sf):
    log = events_log(spark, sf).withColumn("ks", F.col("k"))
    clears = log.where("vt = 2").select("ks", F.col("seqno").alias("cleared"))
    return changelog.live(log, clears).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


# Writes, batches, ingestion


@query("SELECT k, vt, v FROM (SELECT l_orderkey AS batch_id, CAST(l_partkey % 4 AS VARCHAR) AS k, l_linenumber AS ord, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS vt, l_linestatus AS v FROM lineitem) QUALIFY row_number() OVER (PARTITION BY batch_id, k ORDER BY ord DESC) = 1")
def batch_lww(spark, sf):
    # (l_orderkey, l_linenumber) is no key of lineitem: of equal line numbers the first row of the table is taken, as DuckDB does with one thread
    items = placed_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.lit("lines").alias("ks"), (F.col("l_partkey") % 4).cast("string").alias("k"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("vt"), F.col("l_linestatus").alias("v"), *PLACE
    )
    return batch.last_items(items, *PLACE).select("k", "vt", "v")


@query(
    """WITH items AS (
  SELECT o_orderkey AS batch_id, o_orderkey AS ord, 'customers' AS ks, CAST(o_custkey AS VARCHAR) AS k, 0 AS vt, o_orderpriority AS v FROM orders
  UNION ALL SELECT o_orderkey, o_orderkey, 'statuses', o_orderstatus, 0, o_orderpriority FROM orders)
SELECT ks, k, seqno, v FROM (SELECT ks, k, batch_id + 1000 AS seqno, v FROM items) QUALIFY row_number() OVER (PARTITION BY ks, k ORDER BY seqno DESC) = 1"""
)
def batch_multi_keyspace(spark, sf):
    orders = table(spark, sf, "orders")

    def items(ks, k):
        return orders.select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderkey").alias("ord"), F.lit(ks).alias("ks"), k.alias("k"), F.lit(0).alias("vt"), F.col("o_orderpriority").alias("v"))

    both = items("customers", F.col("o_custkey").cast("string")).unionByName(items("statuses", F.col("o_orderstatus")))
    empty = spark.createDataFrame([], "ks string, k string, seqno long, vt int, v string")
    return mvcc.resolve(batch.commit(empty, batch.checked(both), 1000), keys=("ks", "k")).select("ks", "k", "seqno", "v")


@query("SELECT coalesce(CASE WHEN strlen(k) = 0 THEN 'empty key' WHEN strlen(k) > 65535 THEN 'long key' END, 'ok') AS fault, count(*) AS n FROM (SELECT regexp_extract(text, '^[A-Z][a-z]+') AS k FROM documents) GROUP BY 1")
def key_limits_check(spark, sf):
    items = table(spark, sf, "documents").select(F.regexp_extract("text", "^[A-Z][a-z]+", 0).alias("k"), F.col("text").alias("v"))
    return items.groupBy(F.coalesce(batch.fault(), F.lit("ok")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS batch_id, CAST(sum(strlen(CAST(o_orderkey AS VARCHAR)) + strlen(o_orderpriority)) AS BIGINT) AS bytes, count(*) AS items FROM orders GROUP BY 1")
def batch_sizes(spark, sf):
    return batch.sizes(table(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").alias("v")))


@query(
    f"""WITH {LOG}, s AS (SELECT k, seqno, strlen(k) + coalesce(strlen(v), 0) AS size, sum(strlen(k) + coalesce(strlen(v), 0)) OVER (ORDER BY k, seqno DESC ROWS UNBOUNDED PRECEDING) AS held FROM log)
SELECT CAST((held - size) // 20000 AS BIGINT) AS table_no, count(*) AS entries, min(k) AS min_k, max(k) AS max_k FROM s GROUP BY 1"""
)
def ingest_split(spark, sf):
    return ingest.split(events_log(spark, sf), 20_000).groupBy("table_no").agg(F.count(F.lit(1)).alias("entries"), F.min("k").alias("min_k"), F.max("k").alias("max_k"))


@query("SELECT part, pos, k FROM (SELECT user_id AS part, event_id AS pos, CAST(floor(value) AS BIGINT) AS k, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE k <= before")
def ingest_order_check(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("part"), F.col("event_id").alias("pos"), F.floor("value").cast("long").alias("k"))
    return ingest.out_of_order(rows).select("part", "pos", "k")


# Layout and compaction


@query(f"WITH {LOG} SELECT k, seqno, vt FROM ({NEWEST}) WHERE vt = 0 OR seqno >= {HALF}")
def compaction_gc(spark, sf):
    log = events_log(spark, sf)
    return layout.compact(log, half(log), keep_snapshots=False).select("k", "seqno", "vt")


@query(
    f"WITH {LOG} SELECT k, seqno, vt FROM log WHERE seqno >= {HALF} UNION ALL SELECT k, seqno, vt FROM (SELECT * FROM log WHERE seqno < {HALF} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1) WHERE vt = 0"
)
def compaction_mvcc(spark, sf):
    log = events_log(spark, sf)
    return layout.compact(log, half(log)).select("k", "seqno", "vt")


@query(f"WITH {LOG}, top AS (SELECT * FROM log WHERE level = 1) SELECT k, seqno, vt FROM top WHERE seqno >= {HALF} UNION ALL SELECT k, seqno, vt FROM (SELECT * FROM top WHERE seqno < {HALF} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1)")
def compaction_partial(spark, sf):
    """The runs of one level only: tombstones must stay, other runs may hold their keys."""
    log = events_log(spark, sf)
    return layout.compact(log.where("run % 4 <> 3"), half(log), all_runs=False).select("k", "seqno", "vt")


@query(f"WITH {LOG}, n AS (SELECT *, lead(vt) OVER w AS above, lag(vt) OVER w AS below FROM log WINDOW w AS (PARTITION BY k ORDER BY seqno)) SELECT k, seqno, vt FROM n WHERE NOT ((vt = 0 AND coalesce(above, 0) = 2) OR (vt = 2 AND coalesce(below, 1) = 0))")
def weak_annihilate(spark, sf):
    return layout.annihilate(events_log(spark, sf)).select("k", "seqno", "vt")


@query(f"WITH {LOG}, {META} SELECT run, min_k, max_k, min_seqno, max_seqno, entries, bytes FROM meta")
def table_meta(spark, sf):
    return _meta(spark, sf).drop("level")


@query(f"WITH {LOG}, {META} SELECT a.run AS run_a, b.run AS run_b FROM meta a JOIN meta b ON a.run < b.run AND a.min_k <= b.max_k AND a.max_k >= b.min_k")
def l0_overlap(spark, sf):
    return layout.overlaps(_meta(spark, sf))


@query(f"WITH {LOG}, {META} SELECT min(min_k) AS min_k, max(max_k) AS max_k FROM meta")
def key_range_hull(spark, sf):
    return layout.hull(_meta(spark, sf))


@query(f"WITH {LOG}, {META} SELECT run, level FROM meta m WHERE level = 0 OR (level = 1 AND EXISTS (SELECT 1 FROM meta u WHERE u.level = 0 AND u.min_k <= m.max_k AND u.max_k >= m.min_k))")
def leveled_pick(spark, sf):
    return layout.leveled_pick(_meta(spark, sf)).select("run", "level")


@query(f"WITH {LOG}, {META}, f AS (SELECT min(level) AS level FROM (SELECT level FROM meta GROUP BY level HAVING count(*) >= 4)) SELECT run, bytes FROM meta SEMI JOIN f USING (level) QUALIFY row_number() OVER (ORDER BY bytes, run) <= 4")
def tiered_pick(spark, sf):
    return layout.tiered_pick(_meta(spark, sf)).select("run", "bytes")


@query(f"WITH {LOG}, {META}, h AS (SELECT run, sum(bytes) OVER (ORDER BY run DESC ROWS UNBOUNDED PRECEDING) AS held FROM meta) SELECT run FROM h WHERE held > 100000")
def fifo_evict(spark, sf):
    return layout.fifo_drop(_meta(spark, sf), 100_000).select("run")


@query(
    f"""WITH {LOG}, {META} SELECT count(*) FILTER (level = 0) AS l0_runs, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (level = 0) >= 4 AS leveled, count(*) >= 4 AS tiered, sum(bytes) >= 1073741824 AS fifo,
CASE WHEN count(*) FILTER (level = 0) >= 30 THEN 'halt' WHEN count(*) FILTER (level = 0) >= 20 THEN 'throttle' ELSE 'go' END AS pressure FROM meta"""
)
def compaction_state(spark, sf):
    return layout.strategy_state(_meta(spark, sf))


@query("WITH m AS (SELECT o_orderkey // 64 AS run, min(o_custkey) AS min_k, max(o_custkey) AS max_k FROM orders GROUP BY 1) SELECT run FROM m WHERE min_k >= 5 AND max_k <= 1495")
def drop_range(spark, sf):
    meta = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 64).cast("long").alias("run")).agg(F.min("o_custkey").alias("min_k"), F.max("o_custkey").alias("max_k"))
    return layout.droppable(meta, 5, 1495).select("run")


# Transactions

OVERLAY = "overlay AS (SELECT event_id // 50 AS tx, 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS k, event_id AS ord, CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS vt, 'own ' || event_type AS v FROM events)"


def _overlay(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.floor(F.col("event_id") / 50).cast("long").alias("tx"), F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("k"), F.col("event_id").alias("ord"), F.when(F.col("event_type").isin("error", "signup"), 1).otherwise(0).alias("vt"), F.concat(F.lit("own "), F.col("event_type")).alias("v")
    )


#: The overlay of one transaction: all events from the middle on, its writes in their order.
SEEN = f"""{LOG}, base AS (SELECT k, v FROM (SELECT * FROM log WHERE seqno <= {HALF} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1) WHERE vt = 0),
mine AS (SELECT k, CASE WHEN vt = 0 THEN 0 ELSE 1 END AS vt, 'own ' || v AS v FROM log WHERE seqno > {HALF} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1),
seen AS (SELECT coalesce(m.k, b.k) AS k, CASE WHEN m.k IS NULL THEN b.v ELSE m.v END AS v, m.k IS NOT NULL AS own FROM base b FULL JOIN mine m ON b.k = m.k WHERE coalesce(m.vt, 0) = 0)"""


def _one_transaction(spark, sf):
    log = events_log(spark, sf)
    middle = half(log)
    own = log.where(F.col("seqno") > middle).select(F.lit(1).alias("tx"), "k", F.col("seqno").alias("ord"), F.when(F.col("vt") == 0, 0).otherwise(1).alias("vt"), F.concat(F.lit("own "), "v").alias("v"))
    return log, mvcc.resolve(log, middle), own


@query(f"WITH {SEEN} SELECT k, v, CAST(strlen(v) AS INTEGER) AS bytes, own FROM seen")
def tx_ryow(spark, sf):
    _, base, own = _one_transaction(spark, sf)
    return transactions.read_own_writes(base, own)


@query(f"WITH {SEEN} SELECT k, v, 1 AS vt FROM seen SEMI JOIN (SELECT k FROM log WHERE level = 0) USING (k)")
def tx_take(spark, sf):
    """The values taken, each with the deletion that the transaction now holds."""
    log, base, own = _one_transaction(spark, sf)
    seen, gone = transactions.take(base, own, log.where("run % 4 = 3").select("k").distinct())
    return seen.join(gone.select("k", "vt"), "k")


@query(f"WITH {SEEN} SELECT l.k, s.v AS old_v, upper(s.v) AS new_v, CASE WHEN s.v IS NULL THEN 1 ELSE 0 END AS vt FROM (SELECT DISTINCT k FROM log) l LEFT JOIN seen s ON l.k = s.k")
def tx_fetch_update(spark, sf):
    log, base, own = _one_transaction(spark, sf)
    return transactions.fetch_update(base, own, log.select("k").distinct(), F.upper)


@query(f"WITH {LOG}, {OVERLAY} SELECT tx, k, vt, v FROM overlay QUALIFY row_number() OVER (PARTITION BY tx, k ORDER BY ord DESC) = 1")
def tx_commit_rows(spark, sf):
    return transactions.own_writes(_overlay(spark, sf))


def _points(spark, sf):
    log = events_log(spark, sf)
    middle = half(log)
    read = mvcc.versions(log, middle).groupBy("k").agg(F.max("seqno").alias("seqno"))
    absent = log.where(F.col("seqno") > middle).select("k").distinct().join(read, "k", "left_anti").withColumn("seqno", F.lit(0).cast("long"))
    return read.unionByName(absent).withColumn("tx", F.pmod(F.col("seqno"), F.lit(5)))


@query(f"WITH {LOG}, r AS (SELECT k, coalesce(max(seqno) FILTER (seqno <= {HALF}), 0) AS seqno, max(seqno) AS latest FROM log GROUP BY k) SELECT seqno % 5 AS tx, k FROM r WHERE latest > seqno")
def occ_point(spark, sf):
    return transactions.point_conflicts(events_log(spark, sf), _points(spark, sf))


RANGES = "ranges AS (SELECT user_id % 5 AS tx, 'u' || lpad(CAST(min(user_id) AS VARCHAR), 6, '0') AS lo, 'u' || lpad(CAST(min(user_id) + 9 AS VARCHAR), 6, '0') AS hi, max(event_id) - 50 AS seqno FROM events GROUP BY user_id // 10, user_id % 5)"


def _ranges(spark, sf):
    def key(c):
        return F.concat(F.lit("u"), F.lpad(c.cast("string"), 6, "0"))

    e = table(spark, sf, "events")
    g = e.groupBy(F.floor(F.col("user_id") / 10).alias("g"), (F.col("user_id") % 5).alias("tx")).agg(F.min("user_id").alias("low"), (F.max("event_id") - 50).alias("seqno"))
    return g.select("tx", key(F.col("low")).alias("lo"), key(F.col("low") + 9).alias("hi"), "seqno")


@query(f"WITH {LOG}, {RANGES} SELECT DISTINCT r.tx, l.k FROM ranges r JOIN log l ON l.k BETWEEN r.lo AND r.hi AND l.seqno > r.seqno")
def occ_range(spark, sf):
    return transactions.range_conflicts(events_log(spark, sf), _ranges(spark, sf))


@query("SELECT DISTINCT user_id AS tx FROM (SELECT user_id, max(event_id) AS seqno FROM events GROUP BY 1) WHERE seqno < (SELECT max(event_id) + 1 FROM events) - 20")
def occ_fullscan(spark, sf):
    scans = table(spark, sf, "events").groupBy(F.col("user_id").alias("tx")).agg((F.max("event_id") + 20).alias("seqno"))
    return transactions.scan_conflicts(events_log(spark, sf), scans)


@query(f"WITH {LOG}, {OVERLAY}, {RANGES} SELECT DISTINCT r.tx, l.k FROM ranges r JOIN log l ON l.k BETWEEN r.lo AND r.hi AND l.seqno > r.seqno ANTI JOIN overlay o ON o.tx = r.tx AND o.k = l.k")
def occ_compat(spark, sf):
    return transactions.exempt(transactions.range_conflicts(events_log(spark, sf), _ranges(spark, sf)), _overlay(spark, sf))


@query(
    """WITH r AS (SELECT user_id AS tx, event_id AS lo, event_id + 40 + CAST(floor(value) AS BIGINT) % 60 AS hi, event_id AS seqno FROM events),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY tx ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins FROM r),
i AS (SELECT *, sum(begins) OVER (PARTITION BY tx ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT tx, min(lo) AS lo, max(hi) AS hi, min(seqno) AS seqno FROM i GROUP BY tx, island"""
)
def range_merge_islands(spark, sf):
    reads = table(spark, sf, "events").select(F.col("user_id").alias("tx"), F.col("event_id").alias("lo"), (F.col("event_id") + 40 + F.floor("value").cast("long") % 60).alias("hi"), F.col("event_id").alias("seqno"))
    return transactions.merged_ranges(reads)


# Blobs

def _blobs(spark, sf):
    """Every page's html as a blob of one of eight files, each filled in the order of page ids."""
    values = table(spark, sf, "pages").select(F.col("page_id").alias("k"), F.lit(0).alias("seqno"), F.octet_length("html").cast("long").alias("size"), F.pmod("page_id", F.lit(8)).alias("file_id"))
    filled = running_sums(values, {"end": F.col("size")}, F.col("file_id"), F.col("k"))
    first = filled.groupBy("file_id").agg(F.min(F.col("end") - F.col("size")).alias("first"))  # where the file begins among all
    return filled.join(F.broadcast(first), "file_id").withColumn("off", F.col("end") - F.col("size") - F.col("first")).select("k", "seqno", "size", "file_id", "off")


BLOBS = "b AS (SELECT page_id AS k, strlen(html) AS size, page_id % 8 AS file_id, CAST(sum(strlen(html)) OVER (PARTITION BY page_id % 8 ORDER BY page_id ROWS UNBOUNDED PRECEDING) - strlen(html) AS BIGINT) AS off FROM pages), lab AS (SELECT DISTINCT doc_id FROM labels)"


@query("SELECT CASE WHEN strlen(text) >= 4096 THEN 3 ELSE 0 END AS vt, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def blob_split(spark, sf):
    rows = blobs.separate(table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("v")))
    return rows.groupBy("vt").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").cast("long").alias("bytes"))


@query(f"WITH {BLOBS} SELECT doc_id AS k, file_id, off, strlen(html) AS bytes FROM lab JOIN b ON b.k = doc_id JOIN pages ON page_id = doc_id")
def blob_deref(spark, sf):
    placed = _blobs(spark, sf)
    handles = table(spark, sf, "labels").select(F.col("doc_id").alias("k")).distinct().join(placed.select("k", "file_id", "off"), "k")
    stored = placed.select("k", "file_id", "off").join(table(spark, sf, "pages").select(F.col("page_id").alias("k"), F.col("html").alias("v")), "k").drop("k")
    return blobs.read(handles, stored).select("k", "file_id", "off", F.octet_length("v").cast("long").alias("bytes"))


def _blob_stats(spark, sf):
    placed = _blobs(spark, sf)
    live = placed.join(table(spark, sf, "labels").select(F.col("doc_id").alias("k")).distinct(), "k", "left_semi")
    return placed, live, blobs.statistics(placed, live)


STATS = f"{BLOBS}, st AS (SELECT file_id, count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (k NOT IN (SELECT doc_id FROM lab)), 0) AS BIGINT) AS stale FROM b GROUP BY file_id)"


@query(f"WITH {STATS} SELECT * FROM st")
def blob_gc_live(spark, sf):
    return _blob_stats(spark, sf)[2]


@query(f"WITH {STATS} SELECT file_id FROM st WHERE stale / bytes >= 0.6")
def blob_gc_candidates(spark, sf):
    return blobs.candidates(_blob_stats(spark, sf)[2], 0.6).select("file_id")


@query(f"WITH {STATS}, c AS (SELECT file_id FROM st WHERE stale / bytes >= 0.6) SELECT k, file_id, off, CAST(sum(size) OVER (PARTITION BY file_id ORDER BY off ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS new_off FROM b SEMI JOIN c USING (file_id) SEMI JOIN lab ON lab.doc_id = b.k")
def blob_rewrite(spark, sf):
    placed, live, stats = _blob_stats(spark, sf)
    return blobs.rewritten(placed, live, blobs.candidates(stats, 0.6)).select("k", "file_id", "off", "new_off")


@query(f"WITH {STATS} SELECT CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(stale) AS BIGINT) AS stale, count(*) AS files FROM st")
def blob_totals(spark, sf):
    return blobs.totals(_blob_stats(spark, sf)[2])


# Metrics, recovery, sizing


@query(
    """WITH m AS (SELECT o_orderpriority AS ks, CAST(o_orderkey % 3 AS INTEGER) AS level, o_orderkey // 100 AS run, count(*) AS entries, CAST(sum(o_custkey) AS BIGINT) AS bytes FROM orders GROUP BY ALL)
SELECT ks, level, count(*) AS tables, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(entries) AS BIGINT) AS entries FROM m GROUP BY ROLLUP (ks, level)"""
)
def metrics_rollup(spark, sf):
    meta = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("ks"), (F.col("o_orderkey") % 3).cast("int").alias("level"), F.floor(F.col("o_orderkey") / 100).alias("run"))
    return metrics.rollup(meta.agg(F.count(F.lit(1)).alias("entries"), F.sum("o_custkey").alias("bytes")))


@query(f"WITH {LOG} SELECT run, count(*) FILTER (vt = 0) AS n_values, count(*) FILTER (vt = 1) AS n_tombstones, count(*) FILTER (vt = 2) AS n_weak FROM log GROUP BY run")
def tombstone_counts(spark, sf):
    return metrics.tombstones(events_log(spark, sf), "run")


@query("SELECT user_id, CASE WHEN h + m = 0 THEN 0.0 ELSE CAST(100.0 AS DOUBLE) * h / (h + m) END AS hit_rate FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS h, count(*) FILTER (event_type = 'error') AS m FROM events GROUP BY 1)")
def cache_hit_rate(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("h"), F.count_if(F.col("event_type") == "error").alias("m"))
    return counts.select("user_id", sizing.hit_rate(F.col("h"), F.col("m")).alias("hit_rate"))


@query("WITH r AS (SELECT conv_id AS batch_id, count(*) AS n, max(turn) + 1 AS declared FROM conversations GROUP BY 1) SELECT conv_id AS batch_id, turn FROM conversations JOIN r ON conv_id = batch_id WHERE n = declared")
def journal_torn_tail(spark, sf):
    """A conversation declares its last turn + 1 items; one with other turns missing is torn."""
    c = table(spark, sf, "conversations")
    declared = c.groupBy(F.col("conv_id").alias("batch_id")).agg((F.max("turn") + 1).alias("declared"))
    records = c.select(F.col("conv_id").alias("batch_id"), "turn").join(declared, "batch_id")
    return replication.complete_batches(records).select("batch_id", "turn")


@query(
    "WITH j AS (SELECT o_orderkey // 500 AS journal, bool_and(o_orderstatus <> 'P' OR o_custkey % 5 <> 0) AS done FROM orders GROUP BY 1) SELECT journal FROM j WHERE journal < coalesce((SELECT min(journal) FROM j WHERE NOT done), 1000000000)"
)
def journal_evictable(spark, sf):
    o = table(spark, sf, "orders")
    behind = (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 5 == 0)
    journals = o.select(F.floor(F.col("o_orderkey") / 500).cast("long").alias("journal"), F.col("o_orderpriority").alias("ks"), F.when(behind, 0).otherwise(1).alias("persisted"), F.lit(1).alias("lsn"))
    return metrics.evictable(journals)


BLOOM = "s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT *, greatest(CAST(ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS BIGINT), 64) AS bits FROM s), u AS (SELECT *, CAST(least(greatest(round(bits / n * ln(2)), 1), 30) AS INTEGER) AS hashes FROM t)"


def _bloom(spark, sf):
    n = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    sized = n.withColumn("bits", sizing.filter_bits(F.col("n"), F.lit(0.01)))
    return sized.withColumn("hashes", sizing.filter_hashes(F.col("n"), F.col("bits")))


@query(f"WITH {BLOOM} SELECT c_mktsegment, n, bits, hashes FROM u")
def bloom_sizing(spark, sf):
    return _bloom(spark, sf)


@query(f"WITH {BLOOM} SELECT c_mktsegment, round(pow(1 - exp(-hashes * n / bits), hashes), 9) AS fpr FROM u")
def bloom_fpr(spark, sf):
    return _bloom(spark, sf).select("c_mktsegment", F.round(sizing.false_positive_rate(F.col("n"), F.col("bits"), F.col("hashes")), 9).alias("fpr"))


@query("SELECT o_orderkey, CAST(ceil(length(bin(o_orderkey * o_orderkey)) / 7.0) AS INTEGER) AS bytes FROM orders")
def varint_sizes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sizing.varint_bytes(F.col("o_orderkey") * F.col("o_orderkey")).alias("bytes"))


@query(
    """WITH a AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY 1), i AS (SELECT conv_id, t, unnest(range(1, len(t) + 1)) AS s FROM a),
j AS (SELECT conv_id, t, s, unnest(range(s, len(t) + 1)) AS e FROM i) SELECT conv_id, t[s] AS first_turn, t[e] AS last_turn, CAST(e - s + 1 AS INTEGER) AS size FROM j"""
)
def slice_windows(spark, sf):
    grouped = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    each = grouped.select("conv_id", F.explode(sizing.slices(F.col("t"), 1, F.size("t"))).alias("s"))
    return each.select("conv_id", F.element_at("s", 1).alias("first_turn"), F.element_at("s", -1).alias("last_turn"), F.size("s").alias("size"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS name, count(*) AS n, length(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) BETWEEN 1 AND 255 AS valid FROM pages GROUP BY 1")
def keyspace_names(spark, sf):
    name = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return table(spark, sf, "pages").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select("name", "n", F.length("name").between(1, 255).alias("valid"))


# Replicated logs


@query("SELECT conv_id AS term, max(turn) AS last_idx, count(*) AS entries FROM conversations GROUP BY 1")
def raft_replay(spark, sf):
    return replication.last_entry(table(spark, sf, "conversations").select(F.col("conv_id").alias("term"), F.col("turn").alias("idx")))


@query("SELECT term, idx, before FROM (SELECT l_orderkey AS term, CAST(l_linenumber AS BIGINT) AS idx, CAST(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS before FROM lineitem) WHERE idx - before <> 1")
def raft_gap_check(spark, sf):
    return replication.gaps(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("term"), F.col("l_linenumber").cast("long").alias("idx")))


@query(
    """WITH l AS (SELECT event_id // 100 AS grp, event_id % 100 AS idx, value >= 5 AS ok FROM events WHERE event_id % 100 <> 60),
m AS (SELECT *, CASE WHEN ok AND idx - coalesce(lag(idx) OVER (PARTITION BY grp ORDER BY idx), idx - 1) = 1 THEN 0 ELSE 1 END AS bad FROM l),
b AS (SELECT *, sum(bad) OVER (PARTITION BY grp ORDER BY idx ROWS UNBOUNDED PRECEDING) AS broken FROM m) SELECT grp, idx FROM b WHERE broken = 0"""
)
def raft_valid_prefix(spark, sf):
    """Logs of a hundred entries; entry 60 is missing from each, and small values are corrupt."""
    e = table(spark, sf, "events").where("event_id % 100 <> 60")
    log = e.select(F.floor(F.col("event_id") / 100).cast("long").alias("grp"), (F.col("event_id") % 100).alias("idx"), (F.col("value") >= 5).alias("ok"))
    return replication.valid_prefix(log).select("grp", "idx")


@query("WITH l AS (SELECT l_orderkey AS grp, CAST(l_linenumber AS BIGINT) AS idx, max(l_suppkey % 5) AS a, max(l_partkey % 5) AS b FROM lineitem GROUP BY ALL) SELECT grp, min(idx) AS conflict_idx FROM l WHERE a <> b GROUP BY 1")
def raft_conflict_index(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("long").alias("idx"), (F.col("l_suppkey") % 5).alias("a"), (F.col("l_partkey") % 5).alias("b"))
    lead, own = (lines.groupBy("grp", "idx").agg(F.max(c).alias("term")) for c in ("a", "b"))
    return replication.first_conflict(lead, own)


@query("WITH m AS (SELECT CAST(user_id % 9 AS INTEGER) AS grp, user_id AS node, max(event_id) AS idx FROM events GROUP BY ALL) SELECT grp, idx AS commit_idx FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY idx DESC, node) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM m) WHERE rn = n // 2 + 1")
def majority_commit(spark, sf):
    matches = table(spark, sf, "events").groupBy((F.col("user_id") % 9).cast("int").alias("grp"), F.col("user_id").alias("node")).agg(F.max("event_id").alias("idx"))
    return replication.commit_index(matches)


@query(
    """WITH m AS (SELECT user_id % 9 AS grp, user_id AS node, max(event_id) AS idx FROM events GROUP BY ALL),
c AS (SELECT grp, idx FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY idx DESC, node) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM m) WHERE rn = n // 2 + 1)
SELECT c.grp, max(e.event_id) AS commit_idx FROM c JOIN events e ON e.user_id % 9 = c.grp AND e.event_id <= c.idx WHERE e.event_type = 'view' GROUP BY 1"""
)
def majority_commit_term(spark, sf):
    """Only entries of the current term (here: views) move the commit index."""
    e = table(spark, sf, "events")
    matches = e.groupBy((F.col("user_id") % 9).alias("grp"), F.col("user_id").alias("node")).agg(F.max("event_id").alias("idx"))
    terms = e.select((F.col("user_id") % 9).alias("grp"), F.col("event_id").alias("idx"), F.when(F.col("event_type") == "view", 2).otherwise(1).alias("term"))
    return replication.commit_index(matches, terms, 2)


@query("SELECT o_orderkey, o_custkey % 3 > c_nationkey % 3 OR (o_custkey % 3 = c_nationkey % 3 AND o_orderkey >= c_custkey * 10) AS granted FROM orders JOIN customer ON o_custkey = c_custkey")
def vote_grant(spark, sf):
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", replication.up_to_date(F.col("o_custkey") % 3, F.col("o_orderkey"), F.col("c_nationkey") % 3, F.col("c_custkey") * 10).alias("granted"))


@query("SELECT o_custkey AS term, o_orderstatus AS candidate, count(DISTINCT o_orderpriority) AS votes FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) >= 3")
def elected(spark, sf):
    votes = table(spark, sf, "orders").select(F.col("o_custkey").alias("term"), F.col("o_orderstatus").alias("candidate"), F.col("o_orderpriority").alias("voter"), F.lit(5).alias("cluster"))
    return replication.elected(votes).select("term", "candidate", "votes")


@query(f"WITH {LOG} SELECT k, v, seqno AS idx FROM (SELECT * FROM log WHERE seqno <= {HALF} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1) WHERE vt = 0")
def raft_state(spark, sf):
    log = events_log(spark, sf)
    rows = log.select(F.col("seqno").alias("idx"), F.when(F.col("vt") == 0, "SET").otherwise("DELETE").alias("op"), "k", "v")
    return replication.state(rows, half(log))


@query(
    """WITH l AS (SELECT user_id % 10 AS grp, event_id AS idx, CASE event_type WHEN 'signup' THEN 'RECONFIGURE' WHEN 'error' THEN 'REMOVE' ELSE 'ADD' END AS op, user_id AS node FROM events),
s AS (SELECT grp, max(idx) AS since FROM l WHERE op = 'RECONFIGURE' GROUP BY 1)
SELECT grp, node FROM (SELECT l.* FROM l LEFT JOIN s USING (grp) WHERE since IS NULL OR idx >= since QUALIFY row_number() OVER (PARTITION BY grp, node ORDER BY idx DESC) = 1) WHERE op <> 'REMOVE'"""
)
def raft_membership(spark, sf):
    op = F.when(F.col("event_type") == "signup", "RECONFIGURE").when(F.col("event_type") == "error", "REMOVE").otherwise("ADD")
    return replication.membership(table(spark, sf, "events").select((F.col("user_id") % 10).alias("grp"), F.col("event_id").alias("idx"), op.alias("op"), F.col("user_id").alias("node")))


@query("SELECT min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS entries FROM (SELECT event_id AS idx FROM events) WHERE idx > (SELECT max(event_id) * 2 // 5 FROM events) AND idx < (SELECT max(event_id) * 9 // 10 FROM events)")
def raft_truncate(spark, sf):
    """A snapshot replaces the entries up to its index; a conflict drops those from an index on."""
    log = table(spark, sf, "events").select(F.col("event_id").alias("idx"))
    last = log.agg(F.max("idx")).first()[0] or 0
    return log.where((F.col("idx") > last * 2 // 5) & (F.col("idx") < last * 9 // 10)).agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("entries"))


# Clocks and ids

STAMPS = "t AS (SELECT event_id, user_id, event_id * 1000 AS t1, event_id * 1000 + CAST(floor(value * 10) AS BIGINT) AS t2, event_id * 1000 + CAST(floor(value * 10) AS BIGINT) + 50 AS t3, event_id * 1000 + 300 AS t4 FROM events)"


def _stamps(spark, sf):
    shift = F.floor(F.col("value") * 10).cast("long")
    t1 = F.col("event_id") * 1000
    return table(spark, sf, "events").select("event_id", "user_id", t1.alias("t1"), (t1 + shift).alias("t2"), (t1 + shift + 50).alias("t3"), (t1 + 300).alias("t4"))


@query(f'WITH {STAMPS} SELECT event_id, ((t2 - t1) + (t3 - t4)) / 2.0::DOUBLE AS "offset", (t4 - t1) - (t3 - t2) AS delay FROM t')
def ntp_offset_delay(spark, sf):
    c = [F.col(f"t{i}") for i in (1, 2, 3, 4)]
    return _stamps(spark, sf).select("event_id", clock.offset(*c).alias("offset"), clock.delay(*c).alias("delay"))


@query("WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d, count(*) AS n FROM events GROUP BY 1) SELECT event_id FROM events JOIN s USING (event_type) WHERE n < 3 OR abs(value - m) <= 2 * d")
def outlier_2sigma(spark, sf):
    return clock.without_outliers(table(spark, sf, "events"), "event_type", "value").select("event_id")


@query(
    """WITH s AS (SELECT user_id % 10 AS grp, CAST(floor(value) AS BIGINT) AS o, sum((1 + event_id % 3) * length(event_type)) AS w FROM events GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY grp ORDER BY o ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY grp) AS total FROM s) SELECT grp, min(o) AS consensus FROM r WHERE run * 2 >= total GROUP BY grp"""
)
def weighted_median(spark, sf):
    """Weight: confidence times the length of the peer's name."""
    samples = table(spark, sf, "events").select((F.col("user_id") % 10).alias("grp"), F.floor("value").cast("long").alias("o"), ((1 + F.col("event_id") % 3) * F.length("event_type")).alias("w"))
    return clock.weighted_median(samples, ["grp"], "o", "w")


@query(
    """WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS d, count(*) AS n FROM events GROUP BY 1), k AS (SELECT user_id, count(*) AS kept FROM events JOIN s USING (user_id) WHERE n < 3 OR abs(value - m) <= 2 * d GROUP BY 1)
SELECT s.user_id, CASE WHEN n >= 2 AND coalesce(kept, 0) >= 2 THEN 'synchronized' ELSE 'failed' END AS state FROM s LEFT JOIN k USING (user_id)"""
)
def sync_state(spark, sf):
    e = table(spark, sf, "events")
    before = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    after = clock.without_outliers(e, "user_id", "value").groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))
    return before.join(after, "user_id", "left").select("user_id", clock.sync_state(F.col("n"), F.coalesce("kept", F.lit(0))).alias("state"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def ring_last_n(spark, sf):
    return clock.last_n(table(spark, sf, "events"), "user_id", "event_id", 10).select("user_id", "event_id")


@query("SELECT event_id, (epoch_us(ts) // 1000) * 4194304 + (user_id % 1024) * 4096 + event_id % 4096 AS txid FROM events")
def txid_pack(spark, sf):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return table(spark, sf, "events").select("event_id", clock.transaction_id(ms, F.col("user_id"), F.col("event_id")).alias("txid"))


@query("SELECT event_id, 'FEFF01' || lpad(hex(event_id * 1000003), 16, '0') AS request, 'FEFF02' || lpad(hex(event_id * 7), 16, '0') || lpad(hex(user_id), 16, '0') AS response, user_id AS t3 FROM events")
def packet_hex(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", sizing.request_packet(F.col("event_id") * 1000003).alias("request"), sizing.response_packet(F.col("event_id") * 7, F.col("user_id")).alias("response"))
    return e.select("event_id", "request", "response", sizing.packet_time(F.col("response"), 11).alias("t3"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    return metrics.latencies(table(spark, sf, "events"), "event_type", "value")


# Reads at a snapshot, catalogue and sequence numbers


@query(f"WITH {LOG} SELECT DISTINCT k, k IN (SELECT k FROM (SELECT * FROM log WHERE seqno <= {HALF} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1) WHERE vt = 0) AS present FROM log")
def snapshot_contains(spark, sf):
    log = events_log(spark, sf)
    return mvcc.contains(log, log.select("k").distinct(), half(log))


@query(f"WITH {LOG} SELECT k, CAST(strlen(v) AS INTEGER) AS bytes FROM (SELECT * FROM log WHERE seqno <= {HALF} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1) WHERE vt = 0")
def snapshot_size(spark, sf):
    log = events_log(spark, sf)
    return mvcc.size_of(log, half(log))


@query(f"WITH {LOG} SELECT min(k) AS first_k, max(k) AS last_k, count(*) AS n, count(*) = 0 AS is_empty FROM (SELECT * FROM log WHERE seqno <= {HALF} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1) WHERE vt = 0")
def snapshot_len(spark, sf):
    log = events_log(spark, sf)
    return mvcc.summary(log, half(log))


@query("SELECT count(DISTINCT o_custkey) AS n_keys, true AS close FROM orders")
def approximate_length(spark, sf):
    """The sketch's count against the exact one: within a tenth."""
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    exact = log.agg(F.count_distinct("k").alias("n_keys"))
    return exact.join(F.broadcast(mvcc.approximate_length(log)), how="cross").select("n_keys", (F.abs(F.col("n") - F.col("n_keys")) <= 0.1 * F.col("n_keys")).alias("close"))


@query(f"WITH {LOG} SELECT k, CASE WHEN k LIKE '%7' THEN v END AS v FROM ({NEWEST}) WHERE vt = 0")
def value_if_key(spark, sf):
    return mvcc.value_if(events_log(spark, sf), F.col("k").endswith("7"))


@query(f"WITH {LOG} SELECT k, seqno FROM ({NEWEST}) WHERE vt = 0 AND k NOT IN (SELECT k FROM log WHERE vt = 2 AND level = 0)")
def delete_keys(spark, sf):
    log = events_log(spark, sf)
    return mvcc.without(mvcc.resolve(log), log.where("vt = 2 and run % 4 = 3")).select("k", "seqno")


@query(f"WITH {LOG} SELECT max(seqno) AS seqno, max(seqno) + 1 AS visible_seqno FROM log")
def seqno_published(spark, sf):
    return changelog.published(events_log(spark, sf))


@query("SELECT o_orderpriority AS name, count(*) AS entries, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS n_keyspaces FROM orders GROUP BY 1")
def keyspace_catalogue(spark, sf):
    names = changelog.keyspaces(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("ks")))
    return names.join(F.broadcast(names.agg(F.count(F.lit(1)).alias("n_keyspaces"))), how="cross")


@query("SELECT DISTINCT event_type AS name, event_type IN (SELECT event_type FROM events WHERE value > 500) AS present FROM events")
def keyspace_exists(spark, sf):
    events = table(spark, sf, "events")
    return changelog.exist(events.where("value > 500").select(F.col("event_type").alias("ks")), events.select(F.col("event_type").alias("name")).distinct())


@query(f"WITH {LOG} SELECT k, seqno, v FROM ({NEWEST}) WHERE vt = 0")
def append_read_back(spark, sf):
    """Every event is appended as a commit to a new log, whose files are then read."""
    path = shared_folder(spark, "log")
    changelog.append(events_log(spark, sf).withColumn("ks", F.lit("events")).select("ks", "k", "seqno", "vt", "v"), path)
    return mvcc.resolve(changelog.read(spark, path), keys=("ks", "k")).select("k", "seqno", "v")


# Ordered merges, files and compaction


@query(f"WITH {LOG} SELECT k, seqno, row_number() OVER (ORDER BY k, seqno DESC) AS pos FROM log")
def merge_ordered(spark, sf):
    """The runs of both levels as one sequence: keys ascending, of a key the newest first, with each row's place."""
    log = events_log(spark, sf).select("k", "seqno", "run")
    both = log.where("run % 4 = 3").unionByName(log.where("run % 4 <> 3"))
    return running_sums(both, {"pos": F.lit(1)}, F.col("k"), F.desc("seqno")).select("k", "seqno", "pos")


@query("SELECT count(*) AS entries, count(DISTINCT user_id) AS n_keys, true AS in_order FROM events")
def ingest_files(spark, sf):
    """Files of sorted rows whose key ranges follow each other, checked from what was read back."""
    path = shared_folder(spark, "ingested")
    ingest.write(events_log(spark, sf).drop("run"), path)
    rows = spark.read.parquet(path)
    files = rows.groupBy(F.input_file_name().alias("file")).agg(F.min(F.struct("k", -F.col("seqno"))).alias("low"), F.max(F.struct("k", -F.col("seqno"))).alias("high"))
    follow = files.withColumn("before", F.lag("high").over(Window.orderBy("low"))).agg(F.bool_and(F.col("before").isNull() | (F.col("before") < F.col("low"))).alias("in_order"))  # a row for each file
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("k").alias("n_keys")).join(F.broadcast(follow), how="cross")


@query("SELECT coalesce(CASE WHEN strlen(text) = 0 THEN 'empty key' WHEN strlen(text) > 65536 THEN 'long key' END, 'ok') AS fault, count(*) AS n FROM (SELECT coalesce(text, '') AS text FROM documents) GROUP BY 1")
def ingest_limits(spark, sf):
    items = table(spark, sf, "documents").select(F.col("text").alias("k"), F.lit("v").alias("v"))
    return items.groupBy(F.coalesce(batch.fault(most_key=ingest.MOST_KEY), F.lit("ok")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG}, {META} SELECT a.run, (SELECT count(*) FROM meta b WHERE a.min_k <= b.max_k AND a.max_k >= b.min_k) AS overlapping FROM meta a")
def overlap_counts(spark, sf):
    meta = written(_meta(spark, sf), "meta")
    return layout.overlap_counts(meta, meta).select("run", "overlapping")


@query(f"WITH {LOG}, {META} SELECT DISTINCT l.k, (SELECT count(*) FROM meta b WHERE l.k BETWEEN b.min_k AND b.max_k) AS runs FROM log l")
def runs_that_may_hold(spark, sf):
    return layout.may_contain(_meta(spark, sf), events_log(spark, sf))


@query(
    f"""WITH {LOG}, {META}, p AS (SELECT run FROM meta m WHERE level = 0 OR (level = 1 AND EXISTS (SELECT 1 FROM meta u WHERE u.level = 0 AND u.min_k <= m.max_k AND u.max_k >= m.min_k))),
r AS (SELECT log.* FROM log SEMI JOIN p USING (run)) SELECT k, seqno, vt FROM r WHERE seqno >= {HALF} UNION ALL SELECT k, seqno, vt FROM (SELECT * FROM r WHERE seqno < {HALF} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seqno DESC) = 1)"""
)
def compaction_major(spark, sf):
    """Pick the runs of a level with what they overlap below, and merge them."""
    log = events_log(spark, sf)
    return layout.major_compact(log, written(_meta(spark, sf), "meta"), half(log)).select("k", "seqno", "vt")


@query(f"WITH {LOG}, n AS (SELECT run, vt, lag(vt) OVER (PARTITION BY k ORDER BY seqno) AS below FROM log) SELECT run, count(*) AS reclaimable FROM n WHERE vt = 2 AND below = 0 GROUP BY run")
def weak_reclaimable(spark, sf):
    return layout.reclaimable(events_log(spark, sf), "run")


@query(f"WITH {LOG} SELECT run AS journal, CAST(sum(strlen(k) + coalesce(strlen(v), 0)) AS BIGINT) AS bytes FROM log GROUP BY 1")
def journal_disk_space(spark, sf):
    return metrics.disk_space(events_log(spark, sf).withColumnRenamed("run", "journal"), "journal")


# Tracked transactions: blocks of 50 events write their keys and read those of the next users

READS = """reads AS (SELECT event_id // 50 AS tx, 'u' || lpad(CAST(user_id + 1 AS VARCHAR), 6, '0') AS k, event_id AS ord, event_id // 50 * 50 AS at FROM events)"""
TRACKED = f"""{LOG}, {OVERLAY}, {READS}, mine AS (SELECT tx, k, vt, v FROM overlay QUALIFY row_number() OVER (PARTITION BY tx, k ORDER BY ord DESC) = 1),
tracked AS (SELECT r.tx, r.k, r.ord, CASE WHEN m.k IS NOT NULL THEN CASE WHEN m.vt = 0 THEN m.v END WHEN l.vt = 0 THEN l.v END AS v, m.k IS NOT NULL AS own,
  CASE WHEN m.k IS NULL THEN CASE WHEN l.vt = 0 THEN l.seqno ELSE 0 END END AS seqno
  FROM (SELECT r.*, l.seqno AS found FROM reads r ASOF LEFT JOIN log l ON r.k = l.k AND r.at >= l.seqno) r LEFT JOIN log l ON l.seqno = r.found LEFT JOIN mine m ON m.tx = r.tx AND m.k = r.k),
points AS (SELECT tx, k, arg_min(seqno, ord) AS seqno FROM tracked WHERE seqno IS NOT NULL GROUP BY tx, k)"""


def _tracked(spark, sf):
    e = table(spark, sf, "events")
    tx = F.floor(F.col("event_id") / 50).cast("long")
    key = F.concat(F.lit("u"), F.lpad((F.col("user_id") + 1).cast("string"), 6, "0"))
    reads = e.select(tx.alias("tx"), key.alias("k"), F.col("event_id").alias("ord"), (tx * 50).alias("at"))
    return transactions.tracked_reads(events_log(spark, sf), _overlay(spark, sf), reads)


@query(f"WITH {TRACKED} SELECT tx, k, ord, v, own, seqno FROM tracked")
def tx_tracked_reads(spark, sf):
    return _tracked(spark, sf)


@query(f"WITH {TRACKED} SELECT tx, k, ord, v AS old_v, upper(v) AS new_v, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS vt, seqno FROM tracked")
def tx_tracked_update(spark, sf):
    return transactions.tracked_update(_tracked(spark, sf), F.upper)


@query(f"WITH {TRACKED} SELECT tx, k, ord, v AS old_v, 1 AS vt, seqno FROM tracked")
def tx_tracked_take(spark, sf):
    return transactions.tracked_update(_tracked(spark, sf), lambda v: F.lit(None).cast("string")).drop("new_v")


@query(f"WITH {TRACKED} SELECT tx, k, seqno FROM points")
def tx_read_set(spark, sf):
    return transactions.read_set(_tracked(spark, sf))


@query(f"WITH {TRACKED}, {RANGES} SELECT tx, count(*) AS reads FROM (SELECT tx FROM points UNION ALL SELECT tx FROM ranges) GROUP BY tx")
def tx_read_counts(spark, sf):
    return transactions.read_set_size(transactions.read_set(_tracked(spark, sf)), _ranges(spark, sf))


@query(f"WITH {LOG}, {RANGES}, l AS (SELECT k, max(seqno) AS now FROM log GROUP BY k) SELECT r.tx, r.lo, r.hi, count(l.k) AS keys, coalesce(max(l.now), 0) AS seqno FROM (SELECT DISTINCT tx, lo, hi FROM ranges) r LEFT JOIN l ON l.k BETWEEN r.lo AND r.hi GROUP BY ALL")
def tx_tracked_scan(spark, sf):
    return transactions.tracked_ranges(events_log(spark, sf), _ranges(spark, sf))


@query(f"WITH {LOG}, r AS (SELECT user_id AS tx, substr('u' || lpad(CAST(user_id AS VARCHAR), 6, '0'), 1, 6) AS p FROM events GROUP BY ALL), l AS (SELECT k, max(seqno) AS now FROM log GROUP BY k) SELECT r.tx, r.p AS lo, count(l.k) AS keys, coalesce(max(l.now), 0) AS seqno FROM r LEFT JOIN l ON starts_with(l.k, r.p) GROUP BY ALL")
def tx_tracked_prefix(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("tx")).distinct()
    low, high = transactions.prefix_range(F.substring(F.concat(F.lit("u"), F.lpad(F.col("tx").cast("string"), 6, "0")), 1, 6))
    return transactions.tracked_ranges(events_log(spark, sf), users.select("tx", low.alias("lo"), high.alias("hi"))).drop("hi")


@query("SELECT event_id // 50 AS tx, least(max(event_id) + 60, (SELECT max(event_id) + 1 FROM events)) AS seqno FROM events GROUP BY 1")
def tx_full_scan(spark, sf):
    scans = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 50).cast("long").alias("tx")).agg((F.max("event_id") + 60).alias("at"))
    return transactions.tracked_full_scans(events_log(spark, sf), scans)


@query(
    f"""WITH {TRACKED}, bad AS (SELECT DISTINCT p.tx FROM points p JOIN log l ON l.k = p.k AND l.seqno > p.seqno AND l.seqno <= p.tx * 50 + 4 WHERE p.seqno > 0 OR l.seqno > 0)
SELECT tx, k, vt, v FROM mine ANTI JOIN bad USING (tx)"""
)
def tx_commit_validated(spark, sf):
    """Transactions commit four numbers after their snapshot; those whose reads are out of date by then append nothing."""
    points = transactions.read_set(_tracked(spark, sf))
    commits = points.select("tx").distinct().withColumn("at", F.col("tx") * 50 + 4)
    return transactions.validated(_overlay(spark, sf), transactions.outdated(events_log(spark, sf), points, commits))


# More of clocks and summaries


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY 1")
def mean_deviation(spark, sf):
    return clock.mean_deviation(table(spark, sf, "events"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(f"WITH {STAMPS}, s AS (SELECT event_id, (t4 - t1) - (t3 - t2) AS delay FROM t) SELECT event_id, round(1.0 / (1.0 + abs(delay) / 1e6), 9) AS confidence FROM s WHERE abs(delay) <= 200")
def sync_round(spark, sf):
    """Samples with a delay over the limit are dropped; the others have a confidence."""
    delayed = _stamps(spark, sf).select("event_id", clock.delay(*(F.col(f"t{i}") for i in (1, 2, 3, 4))).alias("delay"))
    return clock.usable(delayed, "delay", 200).select("event_id", F.round("confidence", 9).alias("confidence"))


@query(f"WITH {STAMPS}, o AS (SELECT user_id, CAST(floor(((t2 - t1) + (t3 - t4)) / 2) AS BIGINT) AS o, count(*) AS w FROM t GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY user_id) AS total FROM o), c AS (SELECT user_id, min(o) AS consensus FROM r WHERE run * 2 >= total GROUP BY 1) SELECT event_id, t4 + consensus AS synchronized FROM t JOIN c USING (user_id)")
def synchronized_time(spark, sf):
    stamps = _stamps(spark, sf)
    offsets = stamps.select("user_id", F.floor(clock.offset(*(F.col(f"t{i}") for i in (1, 2, 3, 4)))).cast("long").alias("o"), F.lit(1).alias("w"))
    return clock.synchronized(stamps, "user_id", "t4", clock.weighted_median(offsets, ["user_id"], "o", "w")).select("event_id", "synchronized")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10)")
def ring_items(spark, sf):
    return clock.ring(table(spark, sf, "events"), "user_id", "event_id", 10).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("SELECT event_type, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS per_second FROM events GROUP BY 1")
def throughput(spark, sf):
    timed = metrics.throughput(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts")
    return timed.select("event_type", "n", F.round("seconds", 6).alias("seconds"), F.round("per_second", 9).alias("per_second"))


@query("WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), s AS (SELECT unnest(range(1, 5)) AS size) SELECT conv_id, p AS first, size, row_number() OVER (PARTITION BY conv_id ORDER BY size DESC, p) AS nth FROM t, s WHERE p + size - 1 <= n")
def slice_windows_shrinking(spark, sf):
    """Slices of at most four turns, the largest first: in proportion to the turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations").select("conv_id", F.row_number().over(w).cast("long").alias("first"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"))
    each = turns.withColumn("size", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(4).cast("long"), F.col("n") - F.col("first") + 1))))
    return each.select("conv_id", "first", "size", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("size"), "first")).cast("long").alias("nth"))


# Streaming


@query(f"WITH {LOG} SELECT k, seqno, vt, v FROM ({NEWEST})")
def stream_lww(spark, sf):
    """The newest versions by a stream over the events file, drained into a table."""
    source = table(spark, sf, "events")
    folder = shared_folder(spark, "stream")
    files = spark.readStream.schema(source.schema).parquet(f"{sf}/events.parquet*")
    vt = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).otherwise(0)
    log = files.select(F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("k"), (F.col("event_id") + 1).alias("seqno"), vt.alias("vt"), F.col("props").alias("v"))
    latest.write_table(latest.newest_stream(log), f"{folder}/table", f"{folder}/state")
    return latest.read_table(spark, f"{folder}/table", "k string, seqno long, vt int, v string")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
