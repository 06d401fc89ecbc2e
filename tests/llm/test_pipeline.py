import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.llm import linededup, quality, queries
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_linededup import brute as without_boilerplate
from tests.llm.test_ngramjoin import brute as components
from tests.llm.test_quality_pool import views_of

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        rows = docs.collect()
        before = [(r.doc_id, r.text) for r in rows]
        after = stage(spark, docs, small)
        assert after.columns == columns
        docs = spark.createDataFrame(after.collect(), after.schema).cache()
        got = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            # a model of the same table, and all rows scored without Spark
            model = quality.fit(docs_before := spark.createDataFrame(rows, after.schema), spark.read.parquet(f"{small}/labels.parquet"))
            score = model.scores(views_of([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows]))[:, 0]
            assert set(got) == {r.doc_id for r, x in zip(rows, score, strict=True) if x >= quality.ACCEPT} and 0 < len(got) < docs_before.count()
        if k == 1:
            assert got == without_boilerplate([(r.doc_id, r.text, r.source) for r in rows], linededup.MIN_SITES)
        if k == 2:
            assert set(got) == {i for i, _, c in components(before) if i == c}
        if k == 3:
            assert set(got) == {r[0] for r in contaminated(before, benchmark) if not r[5]}
        if k != 1:
            assert all(dict(before)[i] == t for i, t in got.items())
    pieces = pipeline.STAGES[-1][1](spark, docs, small)
    by = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r.doc_id for r in by} == {r.doc_id for r in docs.collect()} and all(r.n == r.d for r in by)


def test_run_gives_the_last_stage(spark, small):
    got = entry.queries()["pipeline"](spark, small)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_line_dedup_equals_its_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    want = c.sql(queries.ORACLES["op2_line_site_spread"])
    df = queries.op2_line_site_spread(spark, small)
    order = [want.columns.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
