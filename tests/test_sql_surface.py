"""Table functions, functions of SQL, variants, images and the preflight of files."""

import hashlib
import os
import struct
import zlib

import pytest

from strandline import runtime
from strandline.functions import variants
from strandline.plans import sql_functions, table_functions
from strandline.plans.text_queries import _png
from strandline.sources import images, preflight, readers


def verified(spark, rows, verifier="given_scores", schema="trajectory_uid string, step_index int, score double, audit string, process_reward int"):
    runtime.prepare(spark)
    table_functions.register(spark)
    return spark.sql(f"SELECT * FROM verify_steps(TABLE({{t}}) PARTITION BY (trajectory_uid) ORDER BY (step_index), '{verifier}')", t=spark.createDataFrame(rows, schema)).collect()


def test_a_verifier_keeps_its_contract(spark):
    got = verified(spark, [("a", 1, 0.5, "x", 9), ("a", 0, 0.25, "x", 9), ("a", 2, None, "x", 9), ("b", 0, 1.0, "x", 9), ("c", 0, None, "x", 9)])
    assert sorted(map(tuple, got)) == [("a", 0, 0.25, 0.75, None), ("a", 1, 0.5, 0.75, None), ("b", 0, 1.0, 1.0, None)]
    for bad, why in (([("a", 0, 1.5, "", 0)], "outside"), ([("a", 0, -0.1, "", 0)], "outside"), ([("a", 0, float("nan"), "", 0)], "outside"), ([("a", 0, 0.6, "", 0), ("a", 1, 0.6, "", 0)], "more than 1"), ([("a", 0, 0.1, "", 0), ("a", 0, 0.1, "", 0)], "twice")):
        with pytest.raises(Exception, match=why):
            verified(spark, bad)
    with pytest.raises(Exception, match="needs columns"):
        verified(spark, [("a", 0, 0.1, "", 0)], "first_queries")
    with pytest.raises(Exception, match="no step verifier"):
        verified(spark, [("a", 0, 0.1, "", 0)], "none")
    with pytest.raises(ValueError, match="not there"):
        table_functions.checked(iter([(5, 0.1, {})]), {1}, "v")


def test_types_of_the_table_are_kept(spark):
    rows = [(7, 3_000_000_000, " A  b", True), (7, 3_000_000_001, "a B", True), (7, 3_000_000_002, None, True), (7, 3_000_000_003, "c", False)]
    got = verified(spark, rows, "first_queries", "trajectory_uid bigint, step_index bigint, query string, success boolean")
    assert [tuple(r) for r in got] == [(7, 3_000_000_000, 0.25, 0.25, '[{"query":"a b"}]')]


def test_named_functions_leave_no_function_in_the_plan(spark):
    sql_functions.register(spark)
    df = spark.sql("SELECT clipped_loss(id * 0.1D, 0.2D, -1.0D) AS a, policy_loss('clipped', id * 0.1D, 0.2D, -1.0D) AS b, clipped_loss(id * 0.1D, 0.2D, 1.0D, 0.1D, 0.3D) AS c, answer_reward('same_words', 'The  Cat!', 'the cat') AS d, answer_reward('contains', 'a black cat', 'lack') AS e FROM range(9)")
    plan = df._jdf.queryExecution().executedPlan().toString().lower()
    assert "udf" not in plan and "python" not in plan and "raise_error" not in plan and "clipped_loss" not in plan
    for r in df.collect():
        assert r.a == r.b and r.d == 1.0 and r.e == 0.0
    for call in ("policy_loss('none', 1.0D, 1.0D, 1.0D)", "group_advantage('none', 1.0D, 1.0D, 1.0D, 2L)", "answer_reward('none', 'a', 'b')"):
        with pytest.raises(Exception, match="none"):
            spark.sql(f"SELECT {call}").collect()


def test_cases_of_mixed_types_keep_them(spark):
    good = [
        (1, '{"inputs": ["1\\n2", ["a", "b"], []], "outputs": [["x"], "y", ""]}'),
        (2, '{"fn_name": "go", "inputs": [[1, "x", [true, null], {"b": 2.5, "a": {}}], []], "outputs": [{"z": 1, "y": [1]}, null]}'),
        (3, None),
        (4, '{"fn_name": "", "inputs": [], "outputs": []}'),
    ]
    from pyspark.sql import functions as F

    got = {r.id: r.m for r in spark.createDataFrame(good, "id int, raw string").select("id", variants.test_cases(F.col("raw")).alias("m")).collect()}
    assert [tuple(c) for c in got[1].cases] == [("1\n2", "x"), ("a\nb", "y"), ("", "")] and got[1].fn_name is None
    assert [tuple(c) for c in got[2].cases] == [('[1,"x",[true,null],{"a":{},"b":2.5}]', '{"y":[1],"z":1}'), ("[]", "null")] and got[2].fn_name == "go"
    assert got[3] is None and got[4].cases == []
    for bad in ('{"inputs": [1], "outputs": ["x"]}', '{"inputs": ["a"], "outputs": []}', '{"inputs": "a", "outputs": ["x"]}', "[]", '{"fn_name": "a b", "inputs": [], "outputs": []}', '{"fn_name": "f", "inputs": ["x"], "outputs": [1]}', '{"inputs": [["a", 1]], "outputs": ["x"]}', "not json"):
        with pytest.raises(Exception):  # noqa: B017 the message of each is another
            spark.createDataFrame([(bad,)], "raw string").select(variants.test_cases(F.col("raw"))).collect()


def test_one_value_has_one_digest(spark):
    from pyspark.sql import functions as F

    rows = [('{"b":[1,{"d":null,"c":"é"}],"a":1.5}', '{"a":1.5,"b":[1,{"c":"é","d":null}]}'), ('{ "a" : 1.50, "b":[1 ,{"c":"\\u00e9","d":null}]}', '{"a":1.5,"b":[1,{"c":"é","d":null}]}'), ("nope", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, w string").select(variants.canonical(F.col("t")).alias("c"), "w", variants.canonical_sha256(F.col("t")).alias("d")).collect()
    for r in got:
        assert r.c == r.w and r.d == (hashlib.sha256(r.w.encode()).hexdigest() if r.w else None)


def colour_png(width, height, channels, samples):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + samples[y * width * channels : (y + 1) * width * channels] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_pixels_of_images(spark, tmp_path):
    rgb = bytes(range(2 * 3 * 3))
    alpha = b"".join(rgb[i : i + 3] + b"\xff" for i in range(0, len(rgb), 3))
    (tmp_path / "c.png").write_bytes(colour_png(2, 3, 3, rgb))
    (tmp_path / "a.png").write_bytes(colour_png(2, 3, 4, alpha))
    (tmp_path / "g.png").write_bytes(_png(3, 2, bytes([0, 1, 2, 253, 254, 255])))
    (tmp_path / "broken.png").write_bytes(colour_png(2, 3, 3, rgb)[:40])
    (tmp_path / "text.png").write_text("no image")
    got = {os.path.basename(r.path): r for r in images.read_images(spark, f"file://{tmp_path}").collect()}
    assert len(got) == 5
    assert bytes(got["c.png"].pixels) == rgb and (got["c.png"].width, got["c.png"].height) == (2, 3)
    assert got["a.png"].sha256 == got["c.png"].sha256 == hashlib.sha256(b"RGB\x002\x003\x00" + rgb).hexdigest()
    assert bytes(got["g.png"].pixels) == bytes(x for x in (0, 1, 2, 253, 254, 255) for _ in range(3))
    for name in ("broken.png", "text.png"):
        assert got[name].width is None and got[name].pixels is None and got[name].sha256 is None


def test_long_files_are_digested_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(preflight, "WHOLE", 50_000)
    monkeypatch.setattr(preflight, "PIECE", 7_000)
    folder = tmp_path / "in"
    folder.mkdir()
    want = {}
    for name, n in (("a", 1), ("b", 50_000), ("c", 50_001), ("d+e", 140_000)):
        (folder / name).write_bytes(bytes(i % 251 for i in range(n)))
        want[name] = (n, hashlib.sha256((folder / name).read_bytes()).hexdigest())
    # the scan refuses to hold what is longer
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, 60_000)
    try:
        made = preflight.preflight(spark, f"file://{folder}", f"file://{tmp_path}/manifests").collect()
        stats = readers.file_stats(spark, f"file://{folder}").collect()
    finally:
        spark.conf.unset(limit)
    assert sorted((r.size, r.sha256) for r in made) == sorted(want.values())
    assert {r.name: (r.length, r.sha256) for r in stats} == want


def test_only_what_changed_is_digested(spark, tmp_path):
    from tests.test_io import read_bytes

    folder, manifests = tmp_path / "in", f"file://{tmp_path}/manifests"
    folder.mkdir()
    for i in range(4):
        (folder / f"f{i}").write_bytes(bytes([i]) * 100_000)
    run = lambda s="": {os.path.basename(r.path): (r.reused, r.sha256) for r in preflight.preflight(spark, f"file://{folder}", manifests, s).collect()}
    digest = lambda i, n=100_000: hashlib.sha256(bytes([i]) * n).hexdigest()
    assert run() == {f"f{i}": (False, digest(i)) for i in range(4)}
    seen = []
    second = read_bytes(spark, lambda: seen.append(run()))
    assert seen[0] == {f"f{i}": (True, digest(i)) for i in range(4)} and second < 100_000
    (folder / "f2").write_bytes(bytes([2]) * 50_000)
    (folder / "f0").unlink()
    assert run() == {"f1": (True, digest(1)), "f2": (False, digest(2, 50_000)), "f3": (True, digest(3))}
    assert all(not reused for reused, _ in run("other settings").values())
