import random
from collections import defaultdict

from pyspark.sql import functions as F

from strandline.llm import linededup
from tests.llm.conftest import ODD


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for p, line in enumerate((text or "").split("\n")):
            key = line.strip(" ")
            if text is not None and key:
                if site is not None:
                    sites[key].add(site)
                first[key] = min(first.get(key, (i, p)), (i, p))
    out = {}
    for i, text, _ in rows:
        kept = [x for p, x in enumerate((text or "").split("\n")) if not (len(sites[x.strip(" ")]) >= least and (i, p) != first[x.strip(" ")])] if text is not None else None
        out[i] = None if text is None else "\n".join(kept)
    return out


def test_equals_exact_counts(spark):
    rng = random.Random(2)
    pool = [f"line {k}" for k in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else rng.choice(["", "  ", f" own {i} "]) for _ in range(rng.randrange(8))) if i % 17 else None, f"s{rng.randrange(1, 14) * (rng.random() < 0.7) // 1}" if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    for least in (2, 4, 9):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(df, min_sites=least).collect()}
        assert got == brute(rows, least)


def test_many_sites_are_beyond_the_near_band(spark):
    rows = [(i, f"cookie notice\nbody {i}", f"s{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    got = {r.doc_id: (r.text, r.n_chars, r.n) for r in linededup.dedup_lines(df, min_sites=100, count_col="n").collect()}
    assert got[0] == ("cookie notice\nbody 0", 20, 0) and got[7] == ("body 7", 6, 1)


def test_odd_rows(documents):
    df = documents(ODD)
    got = linededup.dedup_lines(df, min_sites=2)
    assert got.columns == df.columns and got.count() == len(ODD)
    kept = {r.doc_id: r.text for r in got.collect()}
    assert kept[1] is None and kept[2] == "" and kept[5] == "same text here now" and kept[6] == ""
    assert linededup.dedup_lines(df.limit(0)).collect() == []


def test_plan_has_no_python(documents):
    plan = linededup.dedup_lines(documents(ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns_of_any_name_and_type(spark):
    rows = [(i, "notice\nown line", f"s{i}", {"a": i}, i, i, i, i) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, m map<string,int>, __gone int, __k int, __key int, line int")
    got = linededup.dedup_lines(df, chars_col=None, min_sites=5)
    assert got.columns == df.columns
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].text == "notice\nown line" and all(by[i].text == "" for i in range(1, 9))
    assert all((r["__gone"], r["__k"], r["__key"], r.line, r.m) == (i, i, i, i, {"a": i}) for i, r in by.items())


def test_a_line_of_every_document(spark):
    rows = [(i if i % 10 else None, f"all have this\nbody {i}\nsome have this {i % 2}", f"s{i % 40}") for i in range(1, 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [r.text for r in linededup.dedup_lines(df, chars_col=None, min_sites=15).collect()]
    assert len(got) == 399 and sum("all have this" in t for t in got) == 1 and sum("some have this" in t for t in got) == 2
    assert sum("body" in t for t in got) == 399
