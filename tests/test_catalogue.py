"""Every registered query against its SQL on the same files."""

import math

import duckdb
import pytest

from tidemark.plans import catalogue
from tests.conftest import SF, SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == names
    cols = ", ".join(f'"{n}"' for n in names)
    assert plain(df.select(*names).collect()) == plain(duck.sql(f"SELECT {cols} FROM ({catalogue.oracle_sql()[name]})").fetchall())


def test_lww_ties_over_files(spark, tmp_path):
    """Items with an equal order in files of growing size: the first of the table counts, whatever Spark reads first."""
    c = duckdb.connect()
    c.sql("SET threads = 1")
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    bounds = [0, 500, 1500, 3500, 6000]
    for part, (low, high) in enumerate(zip(bounds, bounds[1:])):
        c.sql(f"COPY (SELECT * REPLACE (l_orderkey % 200 AS l_orderkey) FROM '{SF_SMALL}/lineitem.parquet' LIMIT {high - low} OFFSET {low}) TO '{folder}/part-{part}.parquet'")
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    out = catalogue.queries()["batch_lww"](spark, str(tmp_path)).select("k", "vt", "v")
    assert plain(out.collect()) == plain(c.sql(catalogue.oracle_sql()["batch_lww"]).fetchall())
