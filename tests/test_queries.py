import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = entry.oracle_sql()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def _rows(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return [columns[i] for i in at], sorted((tuple(clean(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLE:
        sql = duck.sql(ORACLE[name])
        assert got == _rows(sql.fetchall(), sql.columns)
    else:
        assert got[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["point_id", "polygon_id", "cls"]
    assert df.count() > 0
