import duckdb

from tidemark.llm import exact_dedup as E


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    known = c.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({E.SQL})").fetchall()
    out = E.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(map(tuple, out)) == sorted(known)


def test_hot_group_ties_and_nulls(spark):
    rows = [(i, "same  text", "x") for i in range(500, 900)] + [(2, "sametext", "x"), (1, "same te\nxt ", "x"), (3, "same te\nxt ", "x"), (7, None, "x"), (8, "", "x"), (9, " \x0b", "x"), (None, "other", "x"), (11, "other", "x"), (12, "lone", "x"), (12, "lone", "x"), (13, "y" * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(6)
    for hot in (1 / 256, 1.0):  # with and without salts
        out = E.exact_dedup(docs, hot_share=hot).collect()
        assert len(out) == len(rows)
        by = {r.doc_id: r for r in out}
        assert by[2].keep_id == 1 and by[2].group_size == 403 and [i for i in by if i and by[i].keep_id == 1 and by[i].kept] == [1]
        assert (by[7].keep_id, by[8].keep_id, by[9].kept) == (9, 9, True)
        assert by[None].keep_id == 11 and not by[None].kept
        assert by[12].group_size == 2 and by[12].kept and by[13].kept
    assert E.exact_dedup(docs.limit(0)).count() == 0
