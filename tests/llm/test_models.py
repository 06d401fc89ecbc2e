import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import language, quality
from tests.llm.conftest import ODD

LABELS = "doc_id bigint, quality int, toxic int"


def test_language_of_held_out_documents(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_does_not_read_the_label_of_what_it_predicts(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    model = language.learn(docs.filter(~language.held_out()))
    a = {r.doc_id: r.lang_pred for r in language.classify(docs, model).collect()}
    b = {r.doc_id: r.lang_pred for r in language.classify(docs.withColumn("lang", F.lit("zz")), model).collect()}
    assert a == b


def test_bundle_equals_the_sum_of_bound_letters():
    space = language.Space(64)
    (got,), (some,) = space.bundle(["Ab c"])
    s = [0, 1, 2, 0, 3, 0]
    L = space.letters
    want = sum(np.roll(L[s[i - 1]], 2) * np.roll(L[s[i]], 1) * L[s[i + 1]] for i in (1, 2, 4))
    assert some and np.allclose(got, want)


def test_language_odd_rows(documents, spark):
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(documents(ODD)).collect()}
    by = {i: (p, s) for i, p, s in got}
    assert all(by[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and by[5][0] == "en"
    none = language.identify(documents(ODD).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == len(ODD) and all(r.lang_pred == "und" for r in none)
    assert language.identify(documents(ODD).limit(0)).collect() == []


def test_quality_of_documents_that_were_not_fitted_on(spark, middle):
    large = middle.replace("sf0.01", "sf0.1")
    docs, labels = (spark.read.parquet(f"{large}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) > 0)
    rest = labels.join(seen, "doc_id", "left_anti").withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0))
    got = quality.score(docs, quality.fit(docs, seen)).join(rest, "doc_id").collect()
    assert len(got) > 200 and sum(r.keep == r.good for r in got) / len(got) > 0.95
    assert sum(r.keep for r in got if r.good) / sum(r.good for r in got) > 0.98


def test_fit_does_not_depend_on_how_rows_are_dealt(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality.fit(docs, labels), quality.fit(docs.repartition(7), labels.repartition(3))
    assert np.allclose(a.combine, b.combine) and np.allclose(a.content.weights, b.content.weights)


def test_each_view_teaches_the_other():
    rng = np.random.default_rng(0)
    n = 400
    y = rng.integers(0, 2, n)
    words = [np.unique(np.concatenate((np.array([11 + k], np.uint64), rng.integers(100, 200, 5).astype(np.uint64)))) for k in y]
    length = rng.normal(0, 0.2, (n, 2))
    length[:, 0] += y
    v = quality.Views(np.concatenate(words), np.concatenate(([0], np.cumsum([len(w) for w in words]))), rng.normal(0, 1, (n, quality._N_CONTENT)), length, np.zeros((n, 2), np.int64))
    label = np.where(np.arange(n) < 60, y, -1)
    model = quality.co_train(v, label, np.arange(n) % 4)
    s = model.scores(v)
    assert ((s[:, 0] >= 0.5) == y).mean() > 0.97 and ((s[:, 2] >= 0.5) == y).mean() > 0.95


def test_quality_odd_rows(documents, spark):
    df = documents(ODD)
    none = spark.createDataFrame([], LABELS)
    assert quality.fit(df, none) is None and quality.keep_good(df, none).count() == len(ODD)
    labels = spark.createDataFrame([(2, 0, None), (4, None, 1), (5, 1, 0), (7, 1, None), (8, None, None), (None, 1, 0), (99, 0, 0)], LABELS)
    model = quality.fit(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(df, labels, model)
    assert kept.columns == df.columns and kept.count() == sum(r.keep for r in got)
    assert quality.score(df.limit(0), model).collect() == []


@pytest.mark.parametrize("q, t, want", [(1, 0, 1), (1, None, 1), (None, 0, 1), (0, 0, 0), (1, 1, 0), (None, 1, 0), (None, None, None)])
def test_labels(spark, q, t, want):
    df = spark.createDataFrame([(q, t)], "q int, t int")
    assert df.select(quality.good_label(F.col("q"), F.col("t")).alias("g")).first().g == want


def test_language_equals_a_plain_recomputation(spark):
    """Prototypes, cosines and winners recomputed trigram by trigram, without the operator's matrices."""
    rows = [(1, "the river and the hill", "en"), (2, "der Fluss und der Berg", "de"), (3, "the hill is there", "en"), (4, "und der Fluss", None), (5, "Über den Fluß, 12!", "de"), (6, "9 9 9", "en"), (7, None, "de"), (8, "le fleuve et la colline", "fr"), (9, "river; Fluss\n\nhill", "en"), (10, "the the the", "en"), (12, "la colline", "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    L, table = language.space().letters.astype(float), language._letter_table()

    def vector(text):
        out, before = np.zeros(language.DIM), 0
        s = [int(table[ord(c)]) for c in (text or "").lower()] + [0]
        for k, x in enumerate(s[:-1]):
            if x:
                out += np.roll(L[before], 2) * np.roll(L[x], 1) * L[s[k + 1]]
            before = x
        return out

    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    proto = {}
    for i, t, g in rows:
        if not held[i] and g is not None and t is not None:
            proto[g] = proto.get(g, 0) + vector(t)
    proto = {g: p / np.linalg.norm(p) for g, p in proto.items() if np.linalg.norm(p)}
    got = {r.doc_id: r for r in language.identify(df).collect()}
    for i, t, _ in rows:
        x, r = vector(t), got[i]
        assert r.held_out == held[i]
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {g: float(x @ p / np.linalg.norm(x)) for g, p in sorted(proto.items())}
        best = max(cosines, key=cosines.get)
        assert r.lang_pred == best and abs(r.score - max(0, cosines[best])) < 1e-5


def test_language_of_many_short_varied_rows_takes_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x6000, 200))) for _ in range(3_000)]
    space = language.Space()
    want = space.bundle(texts[:3])[0]
    tracemalloc.start()
    got, some = space.bundle(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400_000_000 and some.all() and np.allclose(got[:3], want, atol=1e-2)
