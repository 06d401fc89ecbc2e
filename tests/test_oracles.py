"""Every query against DuckDB, or for those without SQL its stable schema, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if isinstance(x, (list, tuple)):
        return [plain(i) for i in x]
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows and df.columns
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    assert table(df.columns, rows) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["context_paragraphs", "corpus_exact_dedup", "digest_join"])
def test_paragraphs_of_odd_rows(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "a\nb", " s"), (2, "a\nb", "s"), (3, " a \n\u3000b\u00a0", "s "), (4, "a\nb", "s"), (5, "a\nb", None), (6, "a\nb", None), (None, "a\nb", "s"), (None, "z", "s"), (7, "x", ""), (8, "x", " "), (9, "x", None)]
    rows += [(10, "", "s"), (11, None, "s"), (12, " \n ", "s"), (13, "0 a\r\nb", "s"), (14, "00 a\nb", "s"), (15, "\ta\nb\u0085", "s"), (2, "other", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = c.sql(entry.oracle_sql()[name])
        assert table(df.columns, [tuple(r) for r in df.collect()]) == table(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["trajectory_uid", "step_index", "advantage"]
