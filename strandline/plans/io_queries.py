"""Queries of the readers and writers of whole datasets and runs: each writes a given table and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schemas
from strandline.operators import records
from strandline.plans import views as v
from strandline.plans.queries import query, r
from strandline.plans.text_queries import scratch
from strandline.sources import readers, writers


@query("SELECT doc_id, md5(text) AS text, lang, source FROM documents")
def benchmark_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """A directory of JSON lines, validated as one snapshot, with what an actor may see and the references apart."""
    folder = scratch(spark, "snapshot")
    d = v.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    writers.append_jsonl(d, folder)
    files = readers.dataset_files(spark, folder, "part-*.json")
    rows = readers.read_rows(spark, files[0], "doc_id BIGINT, text STRING, lang STRING, source STRING", multi_line=False) if len(files) == 1 else spark.read.schema(d.schema).option("mode", "FAILFAST").json(files)
    whole = readers.snapshot(rows, "doc_id", d.count(), "documents")
    seen, references = readers.tasks(whole, "doc_id", "doc_id", ["text"], ["lang", "source"])
    return seen.join(references, "doc_id").select("doc_id", F.md5("text").alias("text"), "lang", "source")


@query("SELECT doc_id, lang, n_chars FROM documents")
def recursive_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parquet in nested folders, read without taking their names for columns."""
    folder = scratch(spark, "nested")
    d = v.table(spark, sf, "documents")
    d.select("doc_id", "lang", "n_chars", F.col("lang").alias("a"), (F.col("doc_id") % 3).alias("b")).repartition("a", "b").write.partitionBy("a", "b").parquet(folder)
    return readers.read_recursive(spark, folder, "doc_id BIGINT, lang STRING, n_chars BIGINT")


@query("SELECT vec_id AS pid, 'label ' || label || ' vector ' || vec_id AS text, len(embedding)::INT AS width FROM embeddings")
def corpus_with_index(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus and its vectors, of which each paragraph has one."""
    base = scratch(spark, "search")
    e = v.table(spark, sf, "embeddings")
    paragraphs = e.select(F.col("vec_id").alias("pid"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("title"), F.concat(F.lit(" vector "), F.col("vec_id").cast("string"), F.lit(" ")).alias("text"))
    blank = paragraphs.limit(1).select(F.lit(-1).cast("bigint").alias("pid"), F.lit("blank").alias("title"), F.lit("  ").alias("text"))
    writers.write_corpus(paragraphs.unionByName(blank), f"{base}/corpus.jsonl")
    writers.write_vectors(e.withColumnRenamed("vec_id", "pid"), f"{base}/vectors")
    corpus, vectors = readers.search_corpus(spark, f"{base}/corpus.jsonl", f"{base}/vectors")
    texts = readers.corpus_texts(corpus).select("pid", F.regexp_replace("text", " +", " ").alias("text"))
    return texts.join(vectors, "pid").select("pid", "text", F.size("embedding").alias("width"))


@query(f"SELECT event_id, event_type, {r('value', 'value')} FROM events")
def merged_results(spark: SparkSession, sf: str) -> DataFrame:
    """Records of three workers, one of which lacks a column, as one table in order."""
    folder = scratch(spark, "results")
    e = v.table(spark, sf, "events").select("event_id", "event_type", "value")
    parts = [e.filter(F.col("event_id") % 3 == k) for k in range(3)]
    parts[1] = parts[1].withColumn("note", F.lit("x"))
    writers.write_results(parts, folder, ["event_id"])
    return readers.read_jsonl(spark, folder, "event_id BIGINT, event_type STRING, value DOUBLE, note STRING").select("event_id", "event_type", "value")


@query("SELECT (event_id % 5)::INT AS global_step, count(*) AS n, sum(CASE WHEN event_id % 5 = 2 THEN -event_id ELSE event_id END)::BIGINT AS total FROM events GROUP BY event_id % 5")
def checkpoint_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectories by checkpoint, of which one is written again and replaces itself alone."""
    folder = scratch(spark, "checkpoints")
    e = v.table(spark, sf, "events").select(F.col("event_id").cast("bigint").alias("row"), (F.col("event_id") % 5).cast("int").alias("global_step"))
    writers.write_checkpoint(e, folder)
    writers.write_checkpoint(e.filter("global_step = 2").withColumn("row", -F.col("row")), folder)
    back = spark.read.schema("row BIGINT, global_step INT").parquet(folder)
    return back.groupBy("global_step").agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("total"))


@query(f"WITH {v.STEPS} SELECT trajectory_uid, step_index, {r('reward', 'reward')} FROM steps WHERE NOT is_padding")
def rollout_log(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded steps without padding rows, appended in two batches and read with the schema of steps."""
    folder = scratch(spark, "rollouts")
    s = v.steps(spark, sf)
    for part in (s.filter("row_id % 2 = 0"), s.filter("row_id % 2 = 1")):
        writers.write_rollouts(part.select([x.split()[0] for x in schemas.STEP.split(", ")]), folder)
    return readers.read_jsonl(spark, folder, schemas.STEP).select("trajectory_uid", "step_index", "reward")


@query("SELECT lang, count(*) AS n, (SELECT count(*) FROM documents) AS all_rows, 'v1' AS version FROM documents GROUP BY 1")
def dataset_with_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset and the manifest beside it, which has its rows and what it was made with."""
    folder = scratch(spark, "dataset")
    d = v.table(spark, sf, "documents").select("doc_id", "lang")
    writers.write_with_manifest(d, folder, version="v1")
    facts = writers.read_manifest(spark, f"{folder}.manifest")
    back = readers.read_columns(spark, [folder], ["lang"])
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumns({"all_rows": F.lit(facts["rows"]).cast("bigint"), "version": F.lit(facts["version"])})


@query("SELECT source, count(*) AS n, (SELECT count(*) FROM documents) AS gate, true AS same_digest FROM documents GROUP BY 1")
def run_with_gates(spark: SparkSession, sf: str) -> DataFrame:
    """A run's manifest: digests of all input files, a row count that has to be as required, and one digest of the tree."""
    folder = scratch(spark, "run")
    d = v.table(spark, sf, "documents").select("doc_id", "source")
    d.write.parquet(folder)
    stats = readers.file_stats(spark, folder)
    back = spark.read.parquet(folder)
    made = writers.run_manifest("documents", stats, {"documents": (back.count(), d.count())})
    again = writers.run_manifest("documents", readers.file_stats(spark, folder), {"documents": (back.count(), d.count())})
    tree = [readers.tree_digest(readers.file_stats(spark, folder)).first().sha256 for _ in range(2)]
    same = made["inputs"] == again["inputs"] and len(made["inputs"]) > 0 and tree[0] == tree[1]
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumns({"gate": F.lit(made["rows"]["documents"]).cast("bigint"), "same_digest": F.lit(same)})


@query("""WITH u AS (SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS asked FROM conversations GROUP BY 1)
SELECT conv_id AS sample_index, CASE WHEN conv_id % 3 = 0 THEN 'k' || conv_id ELSE 'validation:' || conv_id END AS sample_key, CASE WHEN conv_id % 2 = 0 THEN 'd' || conv_id ELSE 'q' || conv_id END AS dataset_question_id, CASE WHEN conv_id % 7 = 0 THEN 'o' || conv_id WHEN conv_id % 2 = 0 THEN 'd' || conv_id ELSE 'q' || conv_id END AS official_qid,
CASE WHEN conv_id % 5 = 0 THEN 'who is ' || conv_id ELSE trim(coalesce(asked, '')) END AS question, CASE conv_id % 4 WHEN 0 THEN ['ran'] WHEN 1 THEN ['step ' || conv_id] ELSE ['call ' || conv_id, 'again'] END AS search_queries, 'answer ' || conv_id AS answer, 'g' AS ground_truth, (conv_id % 2)::DOUBLE AS score FROM u""")
def compact_validation_records(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation as an evaluated trajectory, with each of the ways in which its columns may be given."""
    i = F.col("conv_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    c = v.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns"))
    prompt = F.transform(F.when(i % 5 == 0, F.array().cast("array<struct<turn:int,role:string,content:string>>")).otherwise(F.col("turns")), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    steps = F.array(F.struct(F.lit("policy").alias("source"), F.lit("not this").alias("query")), F.struct(F.lit("model").alias("source"), text("step ", i).alias("query")), F.struct(F.lit("model").alias("source"), F.lit("").alias("query")))
    rows = c.select(
        i.alias("sample_index"), F.when(i % 3 == 0, text("k", i)).otherwise("").alias("sample_key"), F.when(i % 2 == 0, text("d", i)).alias("dataset_question_id"), F.when(i % 7 == 0, text("o", i)).alias("official_qid"),
        F.struct(F.lit(None).cast("string").alias("split"), i.alias("index"), text("q", i).alias("question_id")).alias("extra_info"), prompt.alias("prompt"), text("### System\nbe brief\n\n### User Query\n who is ", i, " \n\n### Assistant\nyes").alias("decoded_input"),
        F.when(i % 4 == 0, F.array(F.lit("ran"))).alias("executed_queries"), F.when(i % 4 == 1, steps).alias("search_steps"),
        text("<think>no <answer>wrong</answer></think><function=search><parameter=query> call ", i, "\n</parameter></function><function=search></function><FUNCTION=search><parameter=query>again</parameter></function> <answer> answer ", i, " </answer>").alias("output_text"), F.lit("g").alias("ground_truth"), (i % 2).alias("score"),
    )
    return records.validation_records(rows)
