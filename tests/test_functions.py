import base64
import json
import pickle
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.functions import answers, arithmetic, certificates, equations, toolcalls
from strandline.functions import text as tx
from strandline.operators import prep
from strandline.sources import readers


@pytest.mark.parametrize(
    "text, value",
    [(r"60\times512", 30720), (r"1 \frac{4}{11}", 15 / 11), ("(-125)^{2/3}", 25), (r"1/10 \div 1/2", 0.2), (r"\sqrt[3]{27}", 3), ("11000_2", 24), (r"0.\overline{3}", 1 / 3), ("5!", 120), ("50% of 20", 10), (r"\binom{5}{2}", 10), ("-2^2", -4), (r"\sin(30^\circ)", 0.5), ("10 and 5/12", 125 / 12), (r"\frac12", 0.5), (r"\lceil2.1\rceil", 3)],
)
def test_arithmetic(text, value):
    got, status = arithmetic.evaluate(text)
    assert status == "ok" and float(got) == pytest.approx(value)


@pytest.mark.parametrize("text, status", [("sin(30)", "unsupported"), ("x+1", "unsupported"), ("2 3", "unsupported"), (r"20\% 2", "unsupported"), (r"1/2\pi", "unsupported"), ("1/0", "invalid_domain"), ("(-4)^(1/2)", "invalid_domain"), ("7^{100000}", "limit"), ("99999!", "limit"), ("", "unsupported"), ("__import__('os')", "unsupported")])
def test_what_arithmetic_refuses(text, status):
    assert arithmetic.evaluate(text) == (None, status)


@pytest.mark.parametrize("a, b, same", [("17, 18", "17 or 18", True), ("18, 17", "17 or 18", True), ("17", "17 or 18", False), ("DR' + R", "$R+R'D$", True), ("DR + R", "$R+R'D$", False), ("4:3", "3:4", False), ("1/4", "1:4", True), ("5", "y=5", True), ("(1,234)", "1234", False), ("1,234", "1234", True), ("50 cm", "50", True), (r"\frac{1}{2}", "0.5", True)])
def test_answers_equal(a, b, same):
    assert arithmetic.answers_equal(a, b) is same


@pytest.mark.parametrize("text, answer", [(r"\boxed{12} then \boxed{\frac{1}{2}}", r"\frac{1}{2}"), ("<answer>3</answer> the answer is 4.", "4"), ("x\n42", "42"), (r"\boxed{1} \boxed{2", None), (r"`\boxed{3}`", None), (r"<think>\boxed{1}", None), (r"\boxed{?}", None), ("", None), (None, None)])
def test_final_answer(text, answer):
    got = answers.final_answer(text)
    assert (got and got["answer"]) == answer


def test_texts_of_a_list_lose_their_spaces_and_nothing_else(spark):
    texts = ["0 a", " 1 b1 ", "\u00a02\u3000", "  ", "4"]
    rows = spark.createDataFrame([("k", ["t"], [texts], texts, "<search> 0x </search><search>1y1</search>")], "key string, titles array<string>, sentences array<array<string>>, flat array<string>, said string")
    assert [r.text for r in prep.paragraphs(rows, "key").collect()] == ["0 a 1 b1 2 4"]
    got = readers.joined_paragraphs(rows.withColumn("title", F.lit("t")).drop("sentences"), sentences="flat").first()
    lists = rows.select(prep.clean_answers(F.col("flat")).alias("a"), tx.candidate_references(F.lit("0"), F.col("flat")).alias("r"), tx.search_queries(F.col("said")).alias("q")).first()
    assert got.text == "0 a 1 b1 2 4" and lists.a == ["0 a", "1 b1", "2", "4"] and lists.r == ["0", "0 a", "1 b1", "2", "4"] and lists.q == ["0x", "1y1"]


def test_integer_answers():
    assert [answers.whole_below_thousand(x) for x in ("12.0", r"\text{7}", "1000", "-1", "1.5", None)] == [12, 7, None, None, None, None]
    with pytest.raises(ValueError):
        answers.score_integer("1", "1000")


@pytest.mark.parametrize("text, counted, valid", [("125/12=10 and 5/12", 1, True), ("125/12=10 and 4/12", 1, False), (r"$164 / 60 = 2$ R $44$.", 0, True), ("In binary, $11000 = 24$.", 0, True), (r"$60 = 1, 2, 3, 4, 5, 6$.", 0, True), ("2 + 3 = 5 = 6", 2, False), ("0.8 * 100 = 80", 1, True), ("d1 = 2", 0, True), ("x^2 = 2", 0, True), ("1 / 0 = 1", 1, False), ("200/600=33.3%", 0, True), ("20*.0145=2.9", 1, False), ("Step 1: (28 / 35) * 100 = 80", 1, True), (r"$143,818,402 \times 10 = 1,", 0, True), ("", 0, True), (None, 0, True)])
def test_equations(text, counted, valid):
    found = [e for _, e in equations.audit(text) if e.valid is not None]
    assert len(found) == counted and all(e.valid for e in found) is valid


def test_process_score():
    assert equations.process_score("Step 1: d1=2 and s(200)=2.\nStep 2: 45/216=5/24.") == (1.0, 1, 1)
    assert equations.process_score("Step 1: d1=2.\nStep 2: 2+3=6.\nStep 3: 2+3=5.") == (0.5, 1, 2)


def test_tool_calls_keep_scalars_as_text():
    got = toolcalls.tool_calls('<tool_call><function=f><parameter=answer>1838</parameter><parameter=x>{"a":[1]}</parameter></function></tool_call>')
    assert got == [{"name": "f", "arguments": {"answer": "1838", "x": {"a": [1]}}}]
    assert toolcalls.structured("4,000") is None and toolcalls.structured("__x__") is None and toolcalls.tool_calls(None) == []


def test_certificates():
    assert certificates.certificate('{"source_id": "p:1", "support_span"} some text "target} foo', "search") == ({"source_id": "p:1", "support_span": "some text", "target": "foo"}, ["certificate_repaired"])
    assert certificates.certificate({"claim": "x"}, "visual") == (None, ["certificate_fields_invalid"])
    assert certificates.certificate("nonsense", "finish") == (None, ["certificate_not_object"])
    step = {"ref": "r1", "op": "extract_bridge_entity", "premises": [], "inputs": ["a", "a"], "output": {}}
    assert certificates.certificate(step, "reason_step") == (None, ["inputs_invalid"])


def test_serialised_objects_are_never_loaded():
    evil = base64.b64encode(zlib.compress(pickle.dumps([1]))).decode()
    with pytest.raises(ValueError):
        readers.decode_tests(evil)
    assert readers.decode_tests(base64.b64encode(zlib.compress(json.dumps([1]).encode())).decode()) == [1]


def test_text_columns(spark):
    df = spark.createDataFrame([("The Eiffel  Tower!", "eiffel tower"), ("Eiffel", "Eiffel Tower"), ("yes", "yes please"), (None, "")], "p string, g string")
    got = df.select(tx.token_f1(F.col("p"), F.col("g")).alias("f"), tx.official_f1(F.col("p"), F.col("g")).alias("o"), tx.is_alias(F.col("p"), F.col("g")).alias("a")).collect()
    assert [r.f for r in got] == pytest.approx([1, 2 / 3, 2 / 3, 1]) and [r.o for r in got] == pytest.approx([1, 2 / 3, 0, 1]) and [r.a for r in got] == [True, False, False, True]


def test_evidence_ids_round_trip(spark):
    df = spark.createDataFrame([("hotpotqa-official-sentence-v1:12:3",), ("hotpotqa-official-sentence-v1:012:3",), ("x:1:2",)], "e string")
    got = [r.x for r in df.select(tx.parse_evidence_id(F.col("e")).alias("x")).collect()]
    assert (got[0].pid, got[0].sentence) == (12, 3) and got[1] is None and got[2] is None


@pytest.mark.parametrize(
    "text, reason",
    [
        ("The units digit is asked.\n7 * 8 = 6", "units_digit_display"),
        ("hours: 5 30\nminutes: 70 (10 + 60) = 70", "time_borrowing_annotation"),
        (r"$60 = 1, 2, 3$", "list_rhs_not_scalar_equality"),
        ("2 + 3 = 5\n+ 4 = 9", "running_total_requires_previous_value"),
        ("1, +2 = 3", "numeric_list_or_running_total"),
        ("Total ways for D = 5 = 5 + 0", "conditional_label_not_equation"),
        ("original equation: 1 + 1 = 3\nLHS $\\neq$ RHS\nso not a solution", "extraneous_root_explicitly_rejected"),
        ("200/600=33.3%", "rounded_decimal_display"),
    ],
)
def test_what_does_not_count_says_why(text, reason):
    assert reason in [e.reason for _, e in equations.audit(text)] and all(e.reason != reason or e.valid is None for _, e in equations.audit(text))


def test_borrowed_time_counts_if_the_figures_differ():
    found = [e for _, e in equations.audit("minutes: 71 (10 + 60) = 71")]
    assert all(e.reason != "time_borrowing_annotation" for e in found)


def test_a_digit_is_meant_only_where_lines_nearby_say_so():
    far = "The units digit is asked.\n" + "so on\n" * 4 + "7 * 8 = 6"
    assert [e.valid for _, e in equations.audit(far) if e.left == "7 * 8"] == [False]


def test_literals_without_json_values_are_none():
    assert [toolcalls.structured(x) for x in ("{'a': (1, -2.5)}", "[1, b'x']", "{**a}", "(1, 2)", "{'k': {3, 1}}", "1 + 2j", "f(1)")] == [{"a": [1, -2.5]}, None, None, None, {"k": [1, 3]}, None, None]
