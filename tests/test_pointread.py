"""Point reads by an index of byte ranges."""

import json

import pytest

from strandline import checks, runtime
from strandline.sources import pointread

SCHEMA = "doc_id bigint, text string, tags array<string>"


@pytest.fixture
def files(spark, tmp_path, monkeypatch):
    runtime.prepare(spark)
    monkeypatch.setattr(pointread, "RANGE_BYTES", 700)
    rows = [{"doc_id": i, "text": "é \n" * (i % 9) + f"text {i}", "tags": [str(i)] if i % 2 else None, "score": 1} for i in range(300)]
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        ends = ["\n", "\r\n", "\n\n"][k]
        (folder / f"part{k}.jsonl").write_bytes("".join(json.dumps(r, ensure_ascii=k == 0) + ends for r in rows[k::3]).encode())
    (folder / "part2.jsonl").write_bytes((folder / "part2.jsonl").read_bytes().rstrip(b"\n"))
    (folder / "_SUCCESS").write_text("")
    return rows, folder, f"file://{tmp_path}/index"


def test_index_and_whole_reads(spark, files):
    rows, folder, index = files
    made = pointread.build_index(spark, f"file://{folder}", "doc_id", index)
    assert made.count() == 300
    got = pointread.read_ids(spark, spark.range(300).selectExpr("id AS doc_id").union(spark.range(5).toDF("doc_id")), f"file://{folder}", index, "doc_id", SCHEMA).collect()
    want = {(r["doc_id"], r["text"], tuple(r["tags"] or ())) for r in rows}
    assert len(got) == 300 and {(r.doc_id, r.text, tuple(r.tags or ())) for r in got} == want
    pointread.register(spark)
    df = spark.read.format("indexed_jsonl").schema(SCHEMA).options(path=f"file://{folder}", index=index, key="doc_id").load()
    assert {(r.doc_id, r.text, tuple(r.tags or ())) for r in df.collect()} == want and df.count() == 300
    with pytest.raises(checks.CheckFailed, match="missing"):
        pointread.read_ids(spark, spark.createDataFrame([(999,)], "doc_id bigint"), f"file://{folder}", index, "doc_id", SCHEMA)


def test_only_the_lines_asked_for_are_read(spark, files, monkeypatch):
    rows, folder, index = files
    made = {int(r.key): r for r in pointread.build_index(spark, str(folder), "doc_id", index).collect()}
    wanted = [5, 44, 250]
    # all other bytes are made unreadable: whoever parses them fails
    for file in {r.file for r in made.values()}:
        raw = bytearray(b"{" * len(open(file, "rb").read()))
        whole = open(file, "rb").read()
        for i in wanted:
            r = made[i]
            if r.file == file:
                raw[r.offset : r.offset + r.length] = whole[r.offset : r.offset + r.length]
        open(file, "wb").write(bytes(raw))
    pointread.register(spark)
    df = spark.read.format("indexed_jsonl").schema(SCHEMA).options(path=str(folder), index=index, key="doc_id").load()
    got = df.filter("doc_id IN (5, 44, 250, 7777) AND length(text) > 0").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(i, rows[i]["text"]) for i in wanted]
    assert df.filter("doc_id = 44").first().text == rows[44]["text"]
    assert df.filter("doc_id = 44 AND doc_id IN (5, 6)").collect() == [] and df.filter("doc_id = 7777").collect() == []
    # bytes that a reader takes from the files
    taken = []
    monkeypatch.setattr(pointread, "GAP_BYTES", 0)
    reader = pointread.Reader(df.schema, {"path": str(folder), "index": index, "key": "doc_id"})
    list(reader.pushFilters([pointread.In(("doc_id",), tuple(wanted))]))
    store = Counting(taken)
    monkeypatch.setattr(pointread, "store_of", lambda path, real=pointread.store_of: (store, path) if path == str(folder) else real(path))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3
    assert sum(taken) == sum(made[i].length for i in wanted)


class Counting:
    """A file system whose files tell how much is read of them."""

    def __init__(self, taken):
        self.taken = taken

    def open_input_file(self, path):
        outer = self

        class File:
            def __enter__(self):
                self.f = open(path, "rb")
                return self

            def __exit__(self, *_):
                self.f.close()

            def seek(self, at):
                self.f.seek(at)

            def read(self, n):
                data = self.f.read(n)
                outer.taken.append(len(data))
                return data

        return File()


def test_bad_files(spark, tmp_path, files):
    rows, folder, index = files
    twice = tmp_path / "twice.jsonl"
    twice.write_text('{"doc_id": 1}\n{"doc_id": 1}\n')
    with pytest.raises(checks.CheckFailed, match="repeated keys"):
        pointread.build_index(spark, str(twice), "doc_id", f"{tmp_path}/twice-index")
    with pytest.raises(FileNotFoundError):
        pointread.data_files(str(tmp_path / "none"))
    pointread.build_index(spark, str(folder), "doc_id", index)
    moved = folder / "part0.jsonl"
    moved.write_bytes(b'{"doc_id": 12345}\n' + moved.read_bytes())
    with pytest.raises(Exception, match="not of this file|Expecting|Extra data"):
        pointread.read_ids(spark, spark.createDataFrame([(3,)], "doc_id bigint"), str(folder), index, "doc_id", SCHEMA).collect()
