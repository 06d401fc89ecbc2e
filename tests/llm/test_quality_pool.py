import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandline.llm import quality, tokens
from tests.llm.conftest import ODD

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(spark, copies=0):
    """80 labelled documents and 6,000 unlabelled ones, a few of which have a word that is nowhere else."""
    rows = [(i, f"{'fine prose about rivers' if i % 2 else 'cheap pills win money'} {i}", "en", "a" if i % 2 else "b") for i in range(6_080)]
    rows = [(i, f"{t} zebraword" if i >= 80 and i % 500 == 1 else t, g, s) for i, t, g, s in rows] + [(3, "copy", "en", "a")] * copies
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return docs, spark.createDataFrame([(i, i % 2, 0) for i in range(80)], LABELS)


def test_every_unlabelled_document_can_be_taught(spark, monkeypatch):
    docs, labels = corpus(spark)
    seen = []
    was = quality.Pool.teach

    def teach(self, *args):
        out = was(self, *args)
        seen.append((self.per_round, len(self._at)))
        return out

    monkeypatch.setattr(quality.Pool, "teach", teach)
    monkeypatch.setattr(quality, "PER_ROUND", 4_000)
    assert quality.fit(docs, labels) is not None
    # in each of three rounds; more than the 4,000 documents of the former sample, at least 80 of which have labels
    assert len(seen) == 3 and seen[-1][1] == 6_000


def test_lessons_grow_with_the_table(spark):
    docs, labels = corpus(spark)
    assert quality.Pool(docs, labels).per_round > quality.Pool(docs.limit(100), labels).per_round


def test_copies_of_an_id_do_not_crowd_out_the_rest(spark):
    docs, labels = corpus(spark, copies=500)
    rows = docs.join(labels, "doc_id").select(F.col("doc_id").alias("key"), *quality._columns(docs), F.lit(1).alias("label"), F.lit(1).alias("fold"))
    v, label, _ = quality._features(rows)
    assert len(label) == 80 and len(v.offs) == 81
    again, _, _ = quality._features(rows.repartition(9))
    assert (again.words == v.words).all()


def views_of(rows):
    """The views of (id, text, lang, source, length) rows, made without Spark."""
    return quality.views(pa.array([r[1] for r in rows], pa.string()), [r[2] for r in rows], [r[3] for r in rows], np.array([np.nan if r[4] is None else r[4] for r in rows], float))


def fitted(rows, label):
    v, y, one = views_of(rows), np.array(label, float), np.ones(len(label))
    return quality.ContentView().fit(v, y, one), quality.MetadataView().fit(v, y, one), v


def test_one_exchange_equals_a_search_of_all_documents(spark, monkeypatch):
    docs, labels = corpus(spark)
    docs = docs.filter("doc_id < 700").withColumn("text", F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.repeat(F.lit(" rivers pills"), 20))).otherwise(F.col("text")))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("source"))).unionByName(docs.filter("doc_id > 650"))
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    taught = [r for r in rows if r[0] < 80]
    content, metadata, v = fitted(taught, [r[0] % 2 for r in taught])
    pool, given = quality.Pool(docs, labels), {"content": {}, "metadata": {}}
    pool.per_round = 40
    after = pool.teach(content, metadata, v, given)
    # every unlabelled document, each distinct one once, by what the other view says
    left = list(dict.fromkeys(r[1:] for r in rows if r[0] >= 80))
    key = {tuple(r[:3]): r.key for r in docs.select("text", "lang", "source", F.xxhash64("text", "lang", "source", F.col("n_chars").cast("double")).alias("key")).collect()}
    x = views_of([(0, *r) for r in left])
    want = {}
    for pupil, teacher in (("metadata", content), ("content", metadata)):
        p = np.round(quality._sigmoid(teacher.score(x)), 9)
        for y, side in ((1.0, p), (0.0, 1 - p)):
            n = 0
            for i in sorted(range(len(left)), key=lambda i: (-side[i], key[left[i][:3]])):
                if side[i] >= quality.SURE and n < 40:
                    n += 1
                    want.setdefault(pupil, {})[key[left[i][:3]]] = y
    row_key = {r: k for k, r in pool._at.items()}
    assert {pupil: {row_key[r]: y for r, y in rows.items()} for pupil, rows in given.items()} == {"content": {}, "metadata": {}} | want
    assert want["metadata"] and all(r >= len(taught) for r in row_key) and len(after.offs) - 1 == len(taught) + len(row_key)
    # what was added are the documents' own views
    for r, k in row_key.items():
        (i,) = [i for i, t in enumerate(left) if key[t[:3]] == k]
        assert (after.words[after.offs[r] : after.offs[r + 1]] == x.words[x.offs[i] : x.offs[i + 1]]).all() and np.allclose(after.content[r], x.content[i])


def test_the_metadata_view_reads_no_text():
    a, b = (views_of([(1, t, "en", "s", 5), (2, t, None, None, None)]) for t in ("some words", "\n\nquite ! another"))
    assert (a.length == b.length).all() and (a.hashed == b.hashed).all() and not np.allclose(a.content, b.content)
    assert a.length[1].tolist() == [0, 1]


def test_scores_combine_what_unseen_rows_calibrate():
    """The model's figures recomputed fold by fold from the views alone."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["good", "river", "tree"] if (i % 2) ^ (rng.random() < 0.15) else ["win", "pill", "tree"], 6)), "en", "ab"[i % 2 if rng.random() < 0.8 else 0], 10 + i % 7) for i in range(240)]
    label, fold = np.array([i % 2 for i in range(240)]), np.arange(240) // 2 % quality.FOLDS
    v = views_of(rows)
    model = quality.co_train(v, label, fold, rounds=1)
    seen = np.zeros((240, 2))
    for f in range(quality.FOLDS):
        own = np.flatnonzero(fold != f)
        content, metadata, _ = fitted([rows[i] for i in own], label[own])
        part = views_of([rows[i] for i in np.flatnonzero(fold == f)])
        seen[fold == f] = np.column_stack([content.score(part), metadata.score(part)])
    gradient = lambda x, w, y: x.T @ (quality._sigmoid(x @ w) - y)
    x = np.column_stack([seen, np.ones(240)])
    # at the optimum the penalised gradient is zero
    assert np.allclose(gradient(x, model.combine, label) + np.array([0.1, 0.1, 1e-6]) * model.combine, 0, atol=1e-4)
    content, metadata, _ = fitted(rows, label)
    a, b = content.score(v), metadata.score(v)
    want = [1 / (1 + np.exp(-(model.combine @ (p, q, 1)))) for p, q in zip(a, b, strict=True)]
    assert np.allclose(model.scores(v)[:, 0], want)


def test_the_surest_are_found_by_counts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 20_000
    # a third of all are equally sure, some keys are near each other, and one lesson has few
    sure = np.where(rng.random(n) < 0.3, 1.0, np.round(1 - rng.random(n) ** 3 * 0.05, 9))
    lesson = rng.choice(4, n, p=[0.6, 0.2, 0.199, 0.001])
    key = np.where(rng.random(n) < 0.5, np.arange(n), rng.integers(-(2**62), 2**62, n))
    rows = spark.createDataFrame(pa.table({"lesson": pa.array(lesson, pa.int32()), "key": pa.array(key), "sure": pa.array(sure)})).repartition(200)
    for most in (40, 1_000, 9_000):
        sent = []
        monkeypatch.setattr(quality, "_to_driver", lambda df, sent=sent: (lambda t: (sent.append(t.num_rows), t)[1])(df.toArrow()))
        got = quality.surest(rows, most, 4)
        for i in range(4):
            own = np.flatnonzero(lesson == i)
            assert got[i] == key[own[np.lexsort((key[own], -sure[own]))]][:most].tolist()
        # counts, and twice what is taken; not what each of 200 tasks is surest of
        assert sent[-1] <= 4 * 2 * most and max(sent[:-1]) <= 4 * (quality._STEPS + 1)


def test_sources_are_known_by_name():
    rows = [(i, "text", "en", f"site{i % 300}", 5) for i in range(3_000)]
    label = [int(i % 300 < 150) for i in range(3_000)]
    _, metadata, v = fitted(rows, label)
    p = quality._sigmoid(metadata.score(views_of([(0, "text", "en", f"site{k}", 5) for k in range(quality.MOST_NAMES - 60)])))
    known = np.isin(views_of([(0, "t", "en", f"site{k}", 5) for k in range(len(p))]).hashed[:, 1], metadata.names[1])
    assert known.sum() > 100 and ((p > 0.5) == (np.arange(len(p)) < 150))[known].all()
    assert (views_of([(0, "t", "en", None, 5)]).hashed != views_of([(0, "t", "en", "None", 5)]).hashed).any()


def test_long_documents_teach_by_some_of_their_words(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST_DOC_WORDS", 7)
    docs = spark.createDataFrame([(1, " ".join(f"w{i}a" for i in "abcdefghijklmnop"), "en", "s", 4)], "doc_id bigint, text string, lang string, source string, n_chars int")
    for label, words in ((-1, 7), (1, 16)):
        rows = docs.select(F.lit(1).cast("bigint").alias("key"), F.lit(label).alias("label"), F.lit(1).alias("fold"), *quality._columns(docs))
        v, _, _ = quality._features(rows)
        assert len(v.words) == words


def test_rows_are_judged_as_they_are_scored(spark, documents):
    docs = documents(ODD * 2)
    train, labels = corpus(spark)
    model = quality.fit(train, labels)
    want = sorted((r.doc_id or -1) for r in quality.score(docs, model).filter("keep").collect())
    got = quality.keep_good(docs, labels, model)
    assert got.columns == docs.columns and sorted((r.doc_id or -1) for r in got.collect()) == want
    assert quality.keep_good(docs.limit(0), labels, model).count() == 0


def test_a_task_frees_what_others_left_in_its_worker():
    tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"))
    assert len(tokens._ENCODERS) == 1
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 400_000] * 7)], names=["text"])
    sizes = [s.num_rows for s in quality._small(iter([batch]))]
    assert not tokens._ENCODERS and sizes == [2, 2, 2, 1]


def test_workers_of_the_pipeline_need_no_pandas():
    code = "import sys, corpus_pipeline; assert 'pandas' not in sys.modules, 'pandas'"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(quality.__file__).parents[2])
