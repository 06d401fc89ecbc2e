import pytest

from strandline import checks
from strandline.functions import arithmetic
from strandline.operators import prep, sampling
from strandline.sources import writers


def test_rows_without_an_order_are_numbered_whatever_the_size(spark, monkeypatch):
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 30, i) for i in range(100)], "o int, i int")
    want = {r.i: r.n for r in sampling.numbered(df, "o", "i").collect()}
    monkeypatch.setattr(sampling, "NUMBERED_ROWS", 10)
    got = {r.i: r.n for r in sampling.numbered(df, "o", "i").collect()}
    assert got == want and sorted(got.values()) == list(range(100))


def test_quality_reasons(spark):
    missing, figure, clash = "missing_or_invalid_problem_or_answer", "missing_referenced_diagram", "conflicting_reference_answers"
    rows = [
        ("find x", "1/2", None), (" find x ", "0.5", None), ("find y", "3", clash), ("find y", "4", clash), ("find y", None, missing), ("find z", "Inf", missing), ("find z", "...", missing), ("find z", "unknown", None),
        ("", "3", missing), (None, "3", missing), ("  ", "4", missing), ("The diagram shown has x", "3", figure), ("In the figure [asy] draw [/asy] x", "3", None), ("the polygon below", "1", clash), ("the polygon below", "2", clash), ("as shown by Gauss", "3", None),
    ]
    df = spark.createDataFrame([(i, q, t) for i, (q, t, _) in enumerate(rows)], "i int, question string, truth string")
    got = {r.i: r.reason for r in prep.quarantine(df, "question", "truth").collect()}
    assert got == {i: why for i, (_, _, why) in enumerate(rows)}


def test_paragraphs_that_differ_in_a_first_digit_both_stay(spark):
    rows = [(1, ["t"], [["0 a", "b"]]), (2, ["t"], [["00 a", "b"]]), (3, ["t"], [[" 0 a", "b "]]), (4, ["t"], [["a", "b"]])]
    p = prep.paragraphs(spark.createDataFrame(rows, "pid int, titles array<string>, sentences array<array<string>>"), "pid")
    kept = prep.first_of(p, ["title", "text"], ["pid"]).collect()
    assert {(r.pid, r.text) for r in kept} == {(1, "0 a b"), (2, "00 a b"), (4, "a b")}


def test_label_conflicts(spark):
    df = spark.createDataFrame([("a", "1/2"), ("a", "0.5"), ("b", "1"), ("b", "2"), ("b", None), (None, "x"), (None, "y"), ("c", None)], "q string, t string")
    got = {r.q: (r.rows, r.labels, r.least_label, r.conflicting) for r in prep.label_conflicts(df, "q", "t").collect()}
    assert got == {"a": (2, 2, "0.5", False), "b": (3, 2, "1", True), None: (2, 2, "x", True), "c": (1, 0, None, False)}


@pytest.mark.parametrize("label, status", [("12", "numeric"), (r"\frac{1}{2}", "numeric"), ("1/0", "invalid_numeric_domain"), ("1, 2, ...", "ambiguous_ellipsis"), ("x^2+1", "symbolic_or_structured"), ("(1, 2)", "symbolic_or_structured"), ("17 or 18", "symbolic_or_structured"), ("because it is so", "unsupported_answer_format"), (None, "unsupported_answer_format")])
def test_label_status(label, status):
    assert arithmetic.label_status(label) == status


def test_reports_are_whole_or_an_error(spark):
    assert writers.markdown_table(spark.range(30)).count("\n") == 31
    with pytest.raises(checks.CheckFailed):
        writers.markdown_table(spark.range(30), 20)
    with pytest.raises(checks.CheckFailed):
        writers.latex_table(spark.range(2_000))


@pytest.mark.parametrize("n, want", [(0, []), (1, [0, 0, 0, 0, 0]), (4, [0, 1]), (5, [0]), (6, [])])
def test_padding_repeats_the_first_rows_without_their_mask(spark, n, want):
    rows = sampling.padded(spark.createDataFrame([(i, 1) for i in range(n)], "i int, mask int"), [2, 3], "i", "mask").collect()
    assert sorted((r.i, r.mask) for r in rows if r.sample_mask) == [(i, 1) for i in range(n)]
    assert sorted((r.i, r.mask) for r in rows if not r.sample_mask) == [(i, 0) for i in want]


def test_mini_batches_take_turns(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate([3, 0, 3, 5, 0])], "i int, mini_batch int")
    assert sorted((r.mini_batch, r.turn) for r in sampling.by_mini_batch(df).collect()) == [(0, 0), (0, 0), (3, 1), (3, 1), (5, 2)]
    one, two = ({(r.i, r.turn) for r in sampling.by_mini_batch(df.repartition(p), True, 1).collect()} for p in (1, 3))
    assert one == two and {t for _, t in one} == {0, 1, 2}
