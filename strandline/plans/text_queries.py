"""Queries of the functions that parse, and of readers, writers and the streaming sink, over texts made from the driver's tables."""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import runtime, schemas
from strandline.functions import answers, arithmetic, certificates, equations, hashing, toolcalls, variants
from strandline.functions import text as tx
from strandline.functions.once import once_per_value
from strandline.operators import credit, prep, reports, verification
from strandline.plans import registry, sql_functions, table_functions
from strandline.plans import views as v
from strandline.plans.queries import query, r
from strandline.sources import images, pointread, preflight, readers, writers
from strandline.streaming import records, trajectories


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), (F.col("l_partkey") % 9 + 1).cast("int").alias("d"), (F.col("l_suppkey") % 5).cast("int").alias("e"))


_LINES = "x AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, (l_partkey % 9 + 1)::INT AS d, (l_suppkey % 5)::INT AS e FROM lineitem)"


def _s(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber, {r('CASE e WHEN 4 THEN NULL WHEN 3 THEN q * d / 100.0::DOUBLE WHEN 2 THEN pow(d, 2) - q WHEN 1 THEN q::DOUBLE / d + 1.5 ELSE (q + d) * 2 END', 'value')}, CASE e WHEN 4 THEN 'invalid_domain' ELSE 'ok' END AS status FROM x")
def numeric_expression_eval(spark: SparkSession, sf: str) -> DataFrame:
    q, d = F.col("q"), F.col("d")
    text = F.when(F.col("e") == 4, _s(q, "/(", d, "-", d, ")")).when(F.col("e") == 3, _s(q, "\\% \\text{ of } ", d)).when(F.col("e") == 2, _s(d, "^2-", q)).when(F.col("e") == 1, _s("\\frac{", q, "}{", d, "}+1.5")).otherwise(_s("2(", q, "+", d, ")"))
    text = F.replace(text, F.lit("\\text{ of }"), F.lit("of"))
    x = arithmetic.evaluate_column(text)
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber, e < 3 AS same FROM x")
def answer_equality(spark: SparkSession, sf: str) -> DataFrame:
    q, d, e = F.col("q"), F.col("d"), F.col("e")
    p = F.when(e == 0, _s("\\frac{", q, "}{", d, "}")).when(e == 1, _s(q, " or ", d)).when(e == 2, _s(q, " cm")).otherwise(_s(q, "x+y"))
    t = F.when(e == 0, _s(q, "/", d)).when(e == 1, _s(d, " or ", q)).when(e == 2, _s(q, ".0")).otherwise(_s("y-", q, "x"))
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", arithmetic.answers_equal_column(p, t).alias("same"))


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber, CASE e WHEN 0 THEN q::VARCHAR WHEN 1 THEN d::VARCHAR WHEN 2 THEN 'x_' || q WHEN 3 THEN q || '.0' END AS answer, CASE e WHEN 0 THEN 'boxed' WHEN 1 THEN 'answer_tag' WHEN 2 THEN 'verbal' WHEN 3 THEN 'final_line' END AS method, CASE e WHEN 0 THEN q WHEN 1 THEN d WHEN 3 THEN q END::INT AS whole FROM x")
def final_answer_extract(spark: SparkSession, sf: str) -> DataFrame:
    q, d, e = F.col("q"), F.col("d"), F.col("e")
    text = F.when(e == 0, _s("first \\boxed{", d, "} so \\boxed{", q, "}.")).when(e == 1, _s("\\boxed{1} <answer> ", d, " </answer>")).when(e == 2, _s("<think>a</think> The final answer is: x_", q, ".")).when(e == 3, _s("so we get\n", q, ".0 ")).otherwise(_s("\\boxed{", q, "} no, \\boxed{", d))
    x = once_per_value(_lines(spark, sf), text, answers.final_answer_column, "x").select("l_orderkey", "l_linenumber", "x.answer", "x.method")
    return once_per_value(x, F.col("answer"), answers.integer_answer_column, "whole")


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber, CASE WHEN e < 4 THEN q || '{{' || d || '}}' END AS answer FROM x".replace("{{", "{").replace("}}", "}"))
def prefilled_answer(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("e") < 4, _s(F.col("q"), "{", F.col("d"), "} } done }")).otherwise(_s(F.col("q"), "{ open"))
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", answers.prefilled_answer_column(text).alias("answer"))


def _solutions(spark: SparkSession, sf: str) -> DataFrame:
    q, d, e = F.col("q"), F.col("d"), F.col("e")
    text = _s("Step 1: add ", q, " + ", d, " = ", q + d + F.when(e == 0, 1).otherwise(0), ".\nStep 2: nothing here.\nStep 3: ", q, " \\times ", d, " = ", q * d, " = ", q * d + F.when(e == 1, 2).otherwise(0), ".")
    return _lines(spark, sf).select(_s(F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("id"), text.alias("text"), "q", "d", "e")


_SOLVED = f"WITH {_LINES}, s AS (SELECT l_orderkey || '-' || l_linenumber AS id, * FROM x)"


_SOLVED += """, eq AS (SELECT id, 1 AS step_index, q || ' + ' || d AS lhs, (q + d + CASE WHEN e = 0 THEN 1 ELSE 0 END)::VARCHAR AS rhs, e > 0 AS valid FROM s
  UNION ALL SELECT id, 3, q || ' \\times ' || d, (q * d)::VARCHAR, true FROM s UNION ALL SELECT id, 3, (q * d)::VARCHAR, (q * d + 2)::VARCHAR, false FROM s WHERE e = 1)"""


@query(f"{_SOLVED} SELECT * FROM eq")
def equation_audit(spark: SparkSession, sf: str) -> DataFrame:
    return equations.extract_distinct(_solutions(spark, sf), "id", "text").select("id", "step_index", "lhs", "rhs", "valid")


@query(f"{_SOLVED}, st AS (SELECT id, step_index, avg(valid::INT) AS rate FROM eq GROUP BY 1, 2) SELECT id AS trajectory_uid, count(*) AS graded_steps, {r('avg(rate)', 'process_score')} FROM st GROUP BY 1")
def equation_process_reward(spark: SparkSession, sf: str) -> DataFrame:
    e = equations.extract_distinct(_solutions(spark, sf), "id", "text").filter("valid is not null")
    return reports.equation_totals(e.withColumnRenamed("id", "trajectory_uid"))


@query(f"WITH {_LINES} SELECT CASE e WHEN 4 THEN 'invalid_numeric_domain' WHEN 3 THEN 'ambiguous_ellipsis' WHEN 2 THEN 'symbolic_or_structured' ELSE 'numeric' END AS status, count(*) AS n FROM x GROUP BY 1")
def label_parse_status(spark: SparkSession, sf: str) -> DataFrame:
    q, e = F.col("q"), F.col("e")
    text = F.when(e == 4, _s(q, "/0")).when(e == 3, _s("about ", q, "...")).when(e == 2, _s(q, "^{99999999}")).otherwise(_s(q))
    labels = _lines(spark, sf).select(text.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # each distinct label is parsed once, however many rows have it
    return labels.select(arithmetic.label_status_column(F.col("label")).alias("status"), "n").groupBy("status").agg(F.sum("n").alias("n"))


def _completions(spark: SparkSession, sf: str) -> DataFrame:
    q, d, e = F.col("q"), F.col("d"), F.col("e")
    one = _s('<tool_call>{"name": "search", "arguments": {"query": "', q, '"}}</tool_call>')
    two = _s("<tool_call><function=finish><parameter=answer>", d, '</parameter><parameter=reason_step>{"ref": "r1"}</parameter><parameter=status>answer</parameter></function></tool_call>')
    three = _s("<tool_call>{'name': 'sum', 'arguments': {'of': [", q, ", ", d, "]}}</tool_call>")
    text = F.when(e == 0, one).when(e == 1, two).when(e == 2, F.concat(F.lit("hm</think>"), one, three)).otherwise(_s("no call ", q))
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", text.alias("text"), "q", "d", "e")


@query(f"""WITH {_LINES} SELECT l_orderkey, l_linenumber, CASE e WHEN 0 THEN 'search' WHEN 1 THEN 'finish' WHEN 2 THEN 'search,sum' ELSE '' END AS names, CASE e WHEN 0 THEN '{{"query": "' || q || '"}}' WHEN 1 THEN '{{"answer": "' || d || '", "reason_step": {{"ref": "r1"}}, "status": "answer"}}' WHEN 2 THEN '{{"of": [' || q || ', ' || d || ']}}' ELSE '' END AS last_arguments FROM x""")
def tool_call_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = once_per_value(_completions(spark, sf), F.col("text"), toolcalls.tool_calls_column, "c")
    return c.select("l_orderkey", "l_linenumber", F.array_join(F.transform("c", lambda x: x["name"]), ",").alias("names"), F.coalesce(F.try_element_at("c", F.lit(-1))["arguments"], F.lit("")).alias("last_arguments"))


@query(f"""WITH {_LINES} SELECT l_orderkey, l_linenumber, e = 1 AS valid, CASE WHEN e = 1 THEN d::VARCHAR END AS answer, CASE e WHEN 0 THEN 'finish_call_unparseable' WHEN 1 THEN '' ELSE 'not_exactly_one_tool_call' END AS errors FROM x""")
def finish_envelope(spark: SparkSession, sf: str) -> DataFrame:
    c = once_per_value(_completions(spark, sf), F.col("text"), toolcalls.finish_call_column, "c")
    return c.select("l_orderkey", "l_linenumber", "c.valid", "c.answer", F.array_join("c.errors", ",").alias("errors"))


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber, CASE WHEN e IN (0, 2) THEN 1 ELSE 0 END AS hermes, CASE WHEN e < 3 THEN 1 ELSE 0 END AS qwen35, 0 AS channel FROM x")
def tool_formats(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda name: lambda t: F.size(toolcalls.format_column(name)(t))
    every = lambda t: F.struct(count("hermes")(t).alias("hermes"), count("qwen35")(t).alias("qwen35"), count("gpt-oss")(t).alias("channel"))
    return once_per_value(_completions(spark, sf), F.col("text"), every, "n").select("l_orderkey", "l_linenumber", "n.*")


@query(f"""WITH {_LINES} SELECT l_orderkey, l_linenumber, e < 3 AS usable, CASE e WHEN 0 THEN '' WHEN 1 THEN 'target_invalid' WHEN 2 THEN 'certificate_repaired' ELSE 'certificate_not_object' END AS errors FROM x""")
def certificate_repair(spark: SparkSession, sf: str) -> DataFrame:
    q, e = F.col("q"), F.col("e")
    text = F.when(e == 0, _s('{"source_id": "p:', q, '", "support_span": "a b", "target": "t"}')).when(e == 1, _s('{"source_id": "p:', q, '", "support_span": "a", "target": " "}')).when(e == 2, _s('{"source_id": "p:', q, '", "support_span"} some words "target} the rest')).otherwise("not at all")
    c = once_per_value(_lines(spark, sf), text, certificates.certificate_column("search"), "c")
    return c.select("l_orderkey", "l_linenumber", "c.usable", F.array_join("c.errors", ",").alias("errors"))


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber, {r('(e < 2)::INT::DOUBLE', 'reward')} FROM x")
def reward_plugin(spark: SparkSession, sf: str) -> DataFrame:
    q, d, e = F.col("q"), F.col("d"), F.col("e")
    text = F.when(e < 2, _s("\\boxed{", q, "/", d, "}")).when(e == 2, _s("\\boxed{-", q + 1, "}")).otherwise(_s("I can't say ", q, " here"))
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", registry.reward_column("final_answer")(text, _s("\\frac{", q, "}{", d, "}")).alias("reward"))


@query()
def verifier_plugin(spark: SparkSession, sf: str) -> DataFrame:
    s = v.steps(spark, sf).select("trajectory_uid", "step_index", _s("Q ", F.col("k") % 9).alias("query"), (F.col("k") % 4 > 0).alias("success"))
    return registry.verify(s, "novel_queries")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN doc_id % 2 = 0 THEN '{\"input\": \"' || doc_id || '\"}' ELSE '\"' || lang || '\"' END AS first FROM documents")
def decoded_tests(spark: SparkSession, sf: str) -> DataFrame:
    d = v.table(spark, sf, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, _s('[{"input": "', F.col("doc_id"), '"}, 2]')).otherwise(_s('["', F.col("lang"), '"]'))
    c = readers.decode_tests_column(raw)
    return d.select("doc_id", c.alias("c")).select("doc_id", F.size("c").alias("n"), F.col("c")[0].alias("first"))


@query("SELECT doc_id, sha256('{\"a\":' || doc_id || ',\"b\":[\"' || lang || '\"]}') AS sha FROM documents")
def canonical_json_digest(spark: SparkSession, sf: str) -> DataFrame:
    d = v.table(spark, sf, "documents")
    return d.select("doc_id", hashing.canonical_json_sha256(_s('{ "b": ["', F.col("lang"), '"], "a": ', F.col("doc_id"), "}")).alias("sha"))


@query("SELECT doc_id, lower(lang) || ' x ' || doc_id AS title FROM documents")
def normalized_titles(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "documents").select("doc_id", tx.normalize_title(_s(F.upper("lang"), "_Ｘ  ", F.col("doc_id"))).alias("title"))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for files that a query writes, deleted when the driver ends."""
    path = f"{runtime.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return f"{path}/out"


@query("SELECT doc_id, lang, source FROM documents ORDER BY doc_id")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    d = v.table(spark, sf, "documents").select("doc_id", "lang", "source")
    first = (F.col("doc_id") % 2).eqNullSafe(1)
    writers.append_jsonl(d.filter(first), path)
    writers.append_jsonl(d.filter(~first), path)
    return readers.read_jsonl(spark, path, "doc_id BIGINT, lang STRING, source STRING")


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN doc_id < 100 THEN 'validation' ELSE 'train' END AS split FROM documents) GROUP BY 1")
def split_writer(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "splits")
    writers.write_splits(prep.split_by_index(v.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100), path)
    return readers.read_columns(spark, [path], ["split", "lang", "absent"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS pid, source AS title, len(string_split(text, chr(10))) AS sentences FROM documents")
def evidence_store(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "evidence")
    d = v.table(spark, sf, "documents")
    paragraphs = d.select(F.col("doc_id").alias("pid"), F.col("source").alias("title"), F.split("text", "\n").alias("sentences"))
    samples = d.select(F.lit("train").alias("split"), F.col("doc_id").alias("row_index"), _s("q", F.col("doc_id")).alias("official_qid"))
    writers.write_evidence(folder, paragraphs, samples, version="1")
    store = readers.EvidenceStore(spark, folder)
    return store.table("paragraphs").join(store.samples("train").select(F.col("row_index").alias("pid")), "pid").select("pid", "title", F.size("sentences").alias("sentences"))


@query("SELECT event_id::INT AS sample_index, 'k' || event_id AS sample_key, event_type AS question, 'g' AS ground_truth, round(value, 6) + 0.0 AS score FROM events")
def streaming_append(spark: SparkSession, sf: str) -> DataFrame:
    """Records that arrive in two folders of files, the second of which repeats half of the first, are each written once."""
    base = scratch(spark, "stream")
    e = v.table(spark, sf, "events").select(F.col("event_id").cast("int").alias("sample_index"), _s("k", F.col("event_id")).alias("sample_key"), F.col("event_type").alias("question"), F.array(F.col("event_type")).alias("search_queries"), F.lit(None).cast("string").alias("answer"), F.lit("g").alias("ground_truth"), F.col("value").alias("score"))
    total = e.count()
    writers.append_jsonl(e.filter(F.col("sample_index") < total * 3 // 4), f"{base}/in")
    sink = records.RecordSink(spark, f"{base}/out", schemas.SEARCH_RECORD)
    records.stream_records(spark, f"{base}/in", schemas.SEARCH_RECORD, sink, f"{base}/checkpoint").awaitTermination()
    writers.append_jsonl(e.filter(F.col("sample_index") >= total * 3 // 8), f"{base}/in")
    again = records.RecordSink(spark, f"{base}/out", schemas.SEARCH_RECORD, resume=True)
    records.stream_records(spark, f"{base}/in", schemas.SEARCH_RECORD, again, f"{base}/checkpoint").awaitTermination()
    return records.finished(again, total).select("sample_index", "sample_key", "question", "ground_truth", "score")


_FOLLOWED = f"""WITH {v.STEPS}, p AS (
  SELECT trajectory_uid, step_index, prompt_len, row_id, CASE WHEN k % 10 = 9 THEN 'finish' ELSE 'search' END AS kind, 'd' || (k % 20) AS artifact, k % 20 % 3 = 0 AS gold, 'd' || (row_id % 20) AS cites, least(response_len, 45 - prompt_len, 20) AS want FROM steps
), b AS (
  SELECT *, CASE WHEN coalesce(sum(greatest(want, 0)) OVER w, 0) >= 120 THEN 'token_budget' WHEN prompt_len > 48 THEN 'prompt_limit' WHEN prompt_len >= 45 THEN 'context_limit' END AS pre, coalesce(sum((kind = 'search')::INT) OVER w, 0) AS searches
  FROM p WINDOW w AS (PARTITION BY trajectory_uid ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s AS (
  SELECT *, coalesce(pre, CASE WHEN kind = 'finish' AND searches > 0 THEN 'finish' WHEN step_index + 1 >= 12 THEN 'max_steps' END) AS stop FROM b
), f AS (
  SELECT *, coalesce(min(step_index) FILTER (stop IS NOT NULL) OVER (PARTITION BY trajectory_uid), 1000000) AS last FROM s
), r AS (
  SELECT *, step_index < last OR (step_index = last AND pre IS NULL) AS ran FROM f
), n AS (
  SELECT *, ran AND kind = 'search' AND row_number() OVER (PARTITION BY trajectory_uid, artifact, ran AND kind = 'search' ORDER BY step_index) = 1 AS fresh,
    least(120, coalesce(sum(CASE WHEN ran THEN want ELSE 0 END) OVER (PARTITION BY trajectory_uid ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS used FROM r
), g AS (SELECT trajectory_uid, artifact, step_index FROM n WHERE fresh)
SELECT n.trajectory_uid, n.step_index, used::BIGINT AS used, CASE WHEN n.step_index > last OR used >= 120 OR prompt_len >= 45 THEN 0 ELSE least(120 - used, 45 - prompt_len, 20) END::BIGINT AS cap, CASE WHEN n.step_index > last THEN 'closed' ELSE stop END AS stop,
  coalesce(sum(fresh::INT) OVER (PARTITION BY n.trajectory_uid ORDER BY n.step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS available, n.step_index <= last AND g.step_index IS NOT NULL AS cite_known, fresh AND gold AS covers,
  coalesce(sum((fresh AND gold)::INT) OVER (PARTITION BY n.trajectory_uid ORDER BY n.step_index), 0)::INT AS covered
FROM n LEFT JOIN g ON n.trajectory_uid = g.trajectory_uid AND n.cites = g.artifact AND g.step_index < n.step_index"""


@query(_FOLLOWED)
def trajectory_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Steps that arrive in mixed order over at least four micro-batches, with a restart from the checkpoint in between, and half of the last ones twice."""
    base = scratch(spark, "follow")
    k = F.col("k")
    search = F.when(k % 10 == 9, "finish").otherwise("search")
    steps = v.steps(spark, sf).select("trajectory_uid", "step_index", "prompt_len", "response_len", search.alias("kind"), _s("d", k % 20).alias("artifact"), (k % 20 % 3 == 0).alias("is_gold"), _s("d", F.col("row_id") % 20).alias("cites"), F.pmod(F.xxhash64("row_id"), F.lit(8)).alias("part"))
    limits = trajectories.Limits(total=120, context=45, per_step=20, prompt=48, steps=12)
    for part, rows in (("part < 4", 2), ("part >= 2", 2)):
        # each round writes four parts, two of which the second round repeats
        steps.filter(part).repartition(4).select(*trajectories.STEP_COLUMNS).write.mode("append").parquet(f"{base}/in")
        trajectories.stream_followed(spark, f"{base}/in", limits, f"{base}/out", f"{base}/checkpoint", files=rows).awaitTermination()
    return spark.read.schema(trajectories.FOLLOWED).parquet(f"{base}/out")


@query("SELECT event_type AS request_key, count(*) > 0 AS asked FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def cached_requests(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").select(F.col("event_type").alias("request_key"))
    cache = e.distinct().filter("request_key in ('click', 'view', 'error')").withColumn("failed", F.col("request_key") == "error")
    return records.result_cache(e, cache)[1].withColumn("asked", F.lit(True))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS terminal_weight, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS process_weight FROM documents")
def fixed_schedule(spark: SparkSession, sf: str) -> DataFrame:
    d = v.table(spark, sf, "documents")
    s = credit.fixed_schedule(F.lit(50), F.col("doc_id") % 3 == 0, 20, 0.5)
    return d.select("doc_id", s.alias("s")).select("doc_id", "s.*")


# --- verifiers


def _audits(spark: SparkSession, sf: str) -> DataFrame:
    return v.steps(spark, sf)


_AUDITS = v.STEPS + ", a AS (SELECT * FROM steps)"


@query(f"""WITH {_AUDITS}, c AS (SELECT trajectory_uid, step_index, k % 4 > 0 AS tested, k % 3 = 0 AS verified FROM a), z AS (SELECT trajectory_uid, max(step_index) AS last, min(k) % 2 = 0 AS attempted, max(k) % 2 = 0 AS valid FROM a GROUP BY 1),
s AS (SELECT trajectory_uid, step_index, verified AS ok FROM c WHERE tested UNION ALL SELECT trajectory_uid, last, valid FROM z WHERE attempted)
SELECT trajectory_uid, step_index, {r('sum(share)', 'score')} FROM (SELECT *, ok::INT::DOUBLE / count(*) OVER (PARTITION BY trajectory_uid) AS share FROM s) GROUP BY 1, 2""")
def code_artifact_credit(spark: SparkSession, sf: str) -> DataFrame:
    a = _audits(spark, sf)
    code = a.select("trajectory_uid", F.col("row_id").cast("string").alias("artifact_id"), "step_index", (F.col("k") % 4 > 0).alias("tested"), (F.col("k") % 3 == 0).alias("verified"))
    certs = a.groupBy("trajectory_uid").agg(F.max("step_index").alias("step_index"), (F.min("k") % 2 == 0).alias("attempted"), (F.max("k") % 2 == 0).alias("valid"))
    return verification.code_credits(code, certs)


@query(f"""WITH {_AUDITS}, n AS (SELECT trajectory_uid, k % 3 = 0 AS valid, k % 5 = 0 AS cited FROM a), m AS (SELECT *, bool_or(cited) OVER (PARTITION BY trajectory_uid) AS has FROM n) SELECT trajectory_uid, {r('avg(valid::INT)', 'score')} FROM m WHERE cited OR NOT has GROUP BY 1""")
def visual_credit(spark: SparkSession, sf: str) -> DataFrame:
    a = _audits(spark, sf).select("trajectory_uid", F.col("row_id").cast("string").alias("artifact_id"), (F.col("k") % 3 == 0).alias("valid"), (F.col("k") % 5 == 0).alias("cited"))
    return verification.crop_credits(a.drop("cited"), a.filter("cited").select("trajectory_uid", "artifact_id"))


@query(f"WITH {_AUDITS}, n AS (SELECT trajectory_uid, step_index, k % 3 > 0 AS valid, row_number() OVER (PARTITION BY trajectory_uid ORDER BY step_index) AS i, least(count(*) OVER (PARTITION BY trajectory_uid), 5) AS n FROM a) SELECT trajectory_uid, step_index, valid, {r('CASE WHEN i <= 5 THEN valid::INT::DOUBLE / n ELSE 0 END', 'score')} FROM n")
def horizon_credit(spark: SparkSession, sf: str) -> DataFrame:
    return verification.horizon_credits(_audits(spark, sf).select("trajectory_uid", "step_index", (F.col("k") % 3 > 0).alias("valid")), 5)


@query(f"WITH {_AUDITS} SELECT trajectory_uid, {r('avg((k % 2 = 0)::INT)', 'grounded')}, {r('avg((k % 3 > 0)::INT)', 'coupled')}, {r('avg((k % 5 > 0)::INT)', 'valid')}, count(*) AS steps, count(*) FILTER (WHERE k % 5 > 0) AS valid_steps, bool_or(step_index > 5) AS any_past_horizon FROM a GROUP BY 1")
def certificate_summary(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return verification.certificate_summary(_audits(spark, sf).select("trajectory_uid", (k % 2 == 0).alias("grounded"), (k % 3 > 0).alias("coupled"), (k % 5 > 0).alias("valid"), (F.col("step_index") > 5).alias("past_horizon")))


@query()
def novelty_credit(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    s = _audits(spark, sf).select("trajectory_uid", "step_index", F.when(k % 7 == 0, "finish").otherwise("search").alias("action"), _s("query ", k % 11).alias("query"), _s("fact ", k % 13).alias("conclusion"), F.array(_s("p", k % 17)).alias("sources"), (k % 5 > 0).alias("valid"), F.lit(True).alias("coupled"), F.lit(1.0).alias("factor"))
    return verification.novelty_credits(s, 8)


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'span_selection_invalid' WHEN 2 THEN 'bridge_already_in_question' WHEN 3 THEN NULL WHEN 4 THEN 'comparison_invalid' ELSE 'op_unverifiable' END AS error FROM documents""")
def inference_check(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("doc_id") % 6
    op = F.when(m < 2, "select_exact_span").when(m == 2, "extract_bridge_entity").when(m == 3, "normalize_answer").when(m == 4, "compare_equal").otherwise("guess")
    head = F.col("text")
    conclusion = F.when(m == 1, _s("☃", head)).when(m == 2, F.col("lang")).when(m == 3, "eiffel tower").when(m == 4, "yes").otherwise(head)
    spans = F.when((m == 3) | (m == 4), F.array().cast("array<string>")).when(m == 2, F.array(_s("in ", F.col("lang"), " now"))).otherwise(F.array("text"))
    inputs = F.when(m == 3, F.array(F.lit("The Eiffel Tower!"))).when(m == 4, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return v.table(spark, sf, "documents").select("doc_id", verification.inference_error(op, conclusion, spans, inputs, _s("what is ", F.col("lang"), "?")).alias("error"))


@query("SELECT doc_id, doc_id % 3 < 2 AS same FROM documents")
def functional_outputs(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    want = F.when(i % 3 == 0, _s('{"a": [', i, ", 2]}")).when(i % 3 == 1, _s('[{"a":[', i, ",2]}]")).otherwise(_s('{"a": [', i, "]}"))
    return v.table(spark, sf, "documents").select("doc_id", tx.functional_equal(_s('{"a":[', i, ",2]}"), want).alias("same"))


# --- indexed reads, table functions, variants, images, preflight


_DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _indexed(spark: SparkSession, sf: str) -> tuple[str, str]:
    base = scratch(spark, "indexed")
    writers.append_jsonl(v.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), f"{base}/in")
    pointread.build_index(spark, f"{base}/in", "doc_id", f"{base}/index")
    return f"{base}/in", f"{base}/index"


@query("SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def indexed_point_read(spark: SparkSession, sf: str) -> DataFrame:
    """Every document by its byte range, from an index of JSON lines."""
    path, index = _indexed(spark, sf)
    ids = v.table(spark, sf, "documents").select("doc_id")
    return pointread.read_ids(spark, ids, path, index, "doc_id", _DOCUMENT).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, max(doc_id) AS last FROM documents GROUP BY 1")
def indexed_source_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same files read whole through the data source."""
    path, index = _indexed(spark, sf)
    pointread.register(spark)
    docs = spark.read.format("indexed_jsonl").schema(_DOCUMENT).options(path=path, index=index, key="doc_id").load()
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max("doc_id").alias("last"))


@query(f"""WITH {v.STEPS}, x AS (SELECT trajectory_uid, step_index, anchor_obs AS q, row_id % 3 > 0 AS ok, count(*) OVER (PARTITION BY trajectory_uid) AS n FROM steps),
f AS (SELECT *, ok AND row_number() OVER (PARTITION BY trajectory_uid, q, ok ORDER BY step_index) = 1 AS fresh FROM x)
SELECT trajectory_uid, step_index, {r('1.0::DOUBLE / n', 'score')}, {r('sum(1.0::DOUBLE / n) OVER (PARTITION BY trajectory_uid)', 'process_reward')}, '[{{"query":"' || q || '"}}]' AS audit FROM f WHERE fresh""")
def verify_table_function(spark: SparkSession, sf: str) -> DataFrame:
    table_functions.register(spark)
    # a column of the table has the name of one of the result's
    steps = v.steps(spark, sf).select("trajectory_uid", "step_index", F.upper("anchor_obs").alias("query"), (F.col("row_id") % 3 > 0).alias("success"), F.lit("clash").alias("audit"))
    return spark.sql("SELECT * FROM verify_steps(TABLE({steps}) PARTITION BY (trajectory_uid) ORDER BY (step_index), 'first_queries')", steps=steps)


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'solve' END AS fn_name, md5(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN lang || chr(10) || source ELSE '[' || n_chars || ',"' || lang || '",{"a":null,"b":[true,0.5]}]' END) AS stdin_md5,
CASE doc_id % 3 WHEN 2 THEN n_chars::VARCHAR ELSE lang END AS expected_stdout, sha256('{"a":' || n_chars || ',"b":"' || lang || '"}') AS digest FROM documents""")
def variant_test_cases(spark: SparkSession, sf: str) -> DataFrame:
    d, kind = v.table(spark, sf, "documents"), F.col("doc_id") % 3
    texts = F.to_json(F.struct(F.array("text").alias("inputs"), F.array("lang").alias("outputs")))
    lines = F.to_json(F.struct(F.array(F.array("lang", "source")).alias("inputs"), F.array(F.array("lang")).alias("outputs")))
    calls = _s('{"fn_name": "solve", "inputs": [[', F.col("n_chars"), ', "', F.col("lang"), '", {"b": [true, 0.50], "a": null}]], "outputs": [', F.col("n_chars"), "]}")
    made = variants.test_cases(F.when(kind == 0, texts).when(kind == 1, lines).otherwise(calls))
    digest = variants.canonical_sha256(_s('{"b" : "', F.col("lang"), '", "a":', F.col("n_chars"), "}"))
    return d.select("doc_id", made.alias("m"), digest.alias("digest")).select("doc_id", "m.fn_name", F.md5(F.col("m.cases")[0]["stdin"]).alias("stdin_md5"), F.col("m.cases")[0]["expected_stdout"].alias("expected_stdout"), "digest")


@query(f"""WITH {v.TOKENS}, x AS (SELECT uid, advantage AS a, log_prob, exp(greatest(least(log_prob - old_log_prob, 20), -20)) AS q, new_value, value, returns FROM tokens),
l AS (SELECT *, greatest(-a * q, -a * greatest(least(q, 1.2), 0.8)) AS c FROM x)
SELECT uid, {r('avg(CASE WHEN a < 0 THEN least(c, -a * 3) ELSE c END)', 'clipped')}, {r('avg(-a * log_prob)', 'reinforce')}, {r('avg(-a * q)', 'bypass')}, {r('avg(0.5 * greatest(pow(new_value - returns, 2), pow(greatest(least(new_value, value + 0.5), value - 0.5) - returns, 2)))', 'value')} FROM l GROUP BY 1""")
def named_losses_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    sql_functions.register(spark)
    return spark.sql(
        "SELECT uid, avg(policy_loss('clipped', log_prob, old_log_prob, advantage)) AS clipped, avg(policy_loss('reinforce', log_prob, old_log_prob, advantage)) AS reinforce, avg(policy_loss('bypass', log_prob, old_log_prob, advantage)) AS bypass, avg(value_loss(new_value, value, returns)) AS value FROM {tokens} GROUP BY uid",
        tokens=v.tokens(spark, sf),
    )


@query(f"""WITH {v.STEPS}, s AS (SELECT trajectory_uid, min(uid) AS uid, sum(reward) AS score FROM steps GROUP BY 1)
SELECT trajectory_uid, {r('(score - avg(score) OVER g) / (stddev_samp(score) OVER g + 1e-6)', 'grpo')}, {r('(score - avg(score) OVER g) * count(*) OVER g / (count(*) OVER g - 1)', 'rloo')} FROM s WINDOW g AS (PARTITION BY uid)""")
def named_estimators_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    sql_functions.register(spark)
    scores = v.steps(spark, sf).groupBy("trajectory_uid").agg(F.min("uid").alias("uid"), F.sum("reward").alias("score"))
    return spark.sql(
        "WITH m AS (SELECT uid, avg(score) AS mean, stddev_samp(score) AS sd, count(*) AS n FROM {scores} GROUP BY uid) SELECT trajectory_uid, group_advantage('grpo', score, mean, sd, n) AS grpo, group_advantage('rloo', score, mean, sd, n) AS rloo FROM {scores} JOIN m USING (uid)",
        scores=scores,
    )


#: Rows of one file of the preflight's documents.
FILE_ROWS = 20_000


def _png(width: int, height: int, grey: bytes) -> bytes:
    """A PNG file of grey samples."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + grey[y * width : (y + 1) * width] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@query("""SELECT vec_id, len(embedding)::INT AS width, 1::INT AS height, sha256(unhex(hex('RGB') || '00' || hex(len(embedding)::VARCHAR) || '00' || hex('1') || '00' || array_to_string(list_transform(embedding, lambda x: repeat(printf('%02X', floor(abs(x::DOUBLE) * 100)::INT % 256), 3)), ''))) AS sha256 FROM embeddings""")
def image_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector drawn as a grey image, one file each, and read again by the JVM's decoder."""
    folder = scratch(spark, "images")
    store, place = runtime.hadoop(spark, folder)
    store.mkdirs(place)

    def draw(rows) -> None:
        target, place = pointread.store_of(folder)
        for row in rows:
            grey = bytes(int(abs(x) * 100) % 256 for x in row.embedding)
            with target.open_output_stream(f"{place}/{row.vec_id}.png") as f:
                f.write(_png(len(grey), 1, grey))

    v.table(spark, sf, "embeddings").select("vec_id", "embedding").foreachPartition(draw)
    found = images.read_images(spark, folder)
    return found.select(F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("bigint").alias("vec_id"), "width", "height", "sha256")


@query("SELECT lang, false AS first, true AS second, lang = (SELECT min(lang) FROM documents) AS changed FROM documents GROUP BY 1")
def preflight_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Files of documents by language are digested in the first run, in the second not, and in the third only those of the language that was written anew."""
    base = scratch(spark, "preflight")
    docs = v.table(spark, sf, "documents").withColumn("language", F.col("lang"))
    # a language is one file as long as it is small; a file has FILE_ROWS rows at most, and no task has all of a language
    lots = max(1, -(-docs.count() // FILE_ROWS))
    docs.repartition("lang", F.pmod(F.xxhash64("doc_id"), F.lit(lots))).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("lang").json(f"{base}/in")
    runs = [preflight.preflight(spark, f"{base}/in", f"{base}/manifests") for _ in range(2)]
    least = docs.agg(F.min("lang")).first()[0]
    docs.filter(F.col("lang") == least).drop("lang", "n_chars").write.option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").json(f"{base}/in/lang={least}")
    runs.append(preflight.preflight(spark, f"{base}/in", f"{base}/manifests"))
    # null where a language's files disagree
    same = F.when(F.min("reused") == F.max("reused"), F.min("reused"))
    of = [x.groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(same.alias(k)) for x, k in zip(runs, ("first", "second", "third"), strict=True)]
    return of[0].join(of[1], "lang").join(of[2], "lang").select("lang", "first", "second", (~F.col("third")).alias("changed"))
