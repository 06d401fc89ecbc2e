import time

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from strandline import checks, schemas
from strandline.operators import alignment
from strandline.sources import readers, writers
from strandline.streaming import records

ROW = "sample_index int, sample_key string, question string, search_queries array<string>, answer string, ground_truth string, score double"


def rows(spark, *pairs):
    return spark.createDataFrame([(i, k, "q", [], None, "g", 1.0) for i, k in pairs], ROW)


def test_appending_twice_changes_nothing(spark, tmp_path):
    sink = records.RecordSink(spark, f"file://{tmp_path}/out", schemas.SEARCH_RECORD)
    assert sink.append(rows(spark, (0, "a"), (1, "b"))) == 2
    assert sink.append(rows(spark, (1, "b"), (2, "c"))) == 1
    assert sink.contiguous() == 3
    with pytest.raises(checks.CheckFailed):
        sink.append(rows(spark, (1, "other")))


def test_resume_must_be_asked_for(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    records.RecordSink(spark, path, schemas.SEARCH_RECORD).append(rows(spark, (0, "a"), (1, "b")))
    with pytest.raises(FileExistsError):
        records.RecordSink(spark, path, schemas.SEARCH_RECORD)
    sink = records.RecordSink(spark, path, schemas.SEARCH_RECORD, resume=True)
    assert sink.resume_point(2, 1) == 2
    with pytest.raises(checks.CheckFailed):
        sink.resume_point(2, 2)


def test_malformed_lines_raise(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "a int").collect()


def test_list_index_and_snapshot(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": "b"}, {"x": "a"}]')
    df = readers.indexed_list(spark, f"file://{tmp_path}/a.json", "x: string")
    assert [tuple(r) for r in df.orderBy("index").select("index", "x").collect()] == [(0, "b"), (1, "a")]
    assert readers.snapshot(df, "x", 2, "list") is df
    with pytest.raises(checks.CheckFailed):
        readers.snapshot(df, "x", 3, "list")


def test_dataset_files(spark, tmp_path):
    for n in ("test2.jsonl", "test1.jsonl", "train.jsonl"):
        (tmp_path / n).write_text("{}\n")
    assert [x.rsplit("/", 1)[1] for x in readers.dataset_files(spark, f"file://{tmp_path}")] == ["test1.jsonl", "test2.jsonl"]
    with pytest.raises(FileNotFoundError):
        readers.dataset_files(spark, f"file://{tmp_path}/none")


def test_evidence_store_refuses_two_contents(spark, tmp_path):
    p = spark.createDataFrame([(1, "t", ["a"]), (1, "t", ["b"])], "pid bigint, title string, sentences array<string>")
    with pytest.raises(checks.CheckFailed):
        writers.consistent_paragraphs(p)


def test_alignment_raises_on_leftovers(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "i int, q string")
    with pytest.raises(checks.CheckFailed):
        alignment.align_by_position(a, a.filter("i = 0"), "i", ["q"])


def test_manifest_gates(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    stats = readers.file_stats(spark, f"file://{tmp_path}/f")
    assert writers.run_manifest("r", stats, {"rows": (3, 3)})["rows"] == {"rows": 3}
    with pytest.raises(checks.CheckFailed):
        writers.run_manifest("r", stats, {"rows": (2, 3)})
    writers.write_json_file(str(tmp_path / "m.json"), {"a": 1})
    assert (tmp_path / "m.json").read_text().startswith("{")


def test_corpus_ids_must_be_contiguous(spark, tmp_path):
    writers.write_corpus(spark.createDataFrame([(0, "t", "a"), (2, "t", "b")], "pid bigint, title string, text string"), f"file://{tmp_path}/c.jsonl")
    with pytest.raises(checks.CheckFailed):
        readers.corpus(spark, f"file://{tmp_path}/c.jsonl")


def read_bytes(spark, action):
    """Bytes that the stages of an action read from files."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s.inputBytes() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    had = set(stages())
    action()
    time.sleep(1)
    return sum(n for i, n in stages().items() if i not in had)


def test_an_append_reads_what_it_touches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "BUCKET", 50)
    sink = records.RecordSink(spark, f"file://{tmp_path}/out", schemas.SEARCH_RECORD)
    some = lambda a, b: rows(spark, *((i, f"k{i}") for i in range(a, b)))
    sink.append(some(0, 100))
    small = read_bytes(spark, lambda: sink.append(some(95, 105)))
    sink.append(some(105, 6_000))
    big = read_bytes(spark, lambda: sink.append(some(5_995, 6_005)))
    assert sink.contiguous() == 6_005
    assert 0 < big < 1.5 * small


def test_a_failed_batch_adds_nothing_until_it_runs_again(spark, tmp_path):
    sink = records.RecordSink(spark, f"file://{tmp_path}/out", schemas.SEARCH_RECORD)
    assert sink.append(rows(spark, (0, "a"), (1, "b")), 0) == 2

    class Broken(records.RecordSink):
        def _mark(self, what, name):
            if what == "done":
                raise RuntimeError("lost")
            super()._mark(what, name)

    again = Broken(spark, f"file://{tmp_path}/out", schemas.SEARCH_RECORD, resume=True)
    with pytest.raises(RuntimeError):
        again.append(rows(spark, (1, "b"), (2, "c"), (3, "d")), 1)
    assert sink.contiguous() == 2
    assert sink.append(rows(spark, (1, "b"), (2, "c"), (3, "d")), 1) == 2
    assert sink.append(rows(spark, (1, "b"), (2, "c"), (3, "d")), 1) == 0
    assert sink.contiguous() == 4
    with pytest.raises(checks.CheckFailed, match="no_index"):
        sink.append(rows(spark, (None, "x")))
    with pytest.raises(checks.CheckFailed, match="two_keys"):
        sink.append(rows(spark, (9, "x"), (9, "y")))
