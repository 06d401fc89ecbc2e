"""Writers of datasets, corpora, runs and manifests. A path that exists is refused unless the writer says otherwise."""

from __future__ import annotations

import datetime
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import checks


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines; the committer makes each task's file appear whole."""
    df.write.mode("append").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Parquet with a folder per split."""
    df.write.partitionBy(split).option("compression", "zstd").parquet(path)


def write_with_manifest(df: DataFrame, path: str, **facts: str) -> None:
    """Parquet and a manifest beside it: rows, schema and the given facts, where a footer could hold keys and values."""
    df.write.option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.parquet(path).count()
    write_manifest(df.sparkSession, f"{path}.manifest", rows=rows, columns=df.schema.simpleString(), **facts)


def write_manifest(spark: SparkSession, path: str, **facts) -> None:
    """A one-row JSON folder of facts; the committer's rename makes it appear whole."""
    text = json.dumps(facts, ensure_ascii=False, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(path).first().value)


def write_json_file(path: str, value) -> None:
    """A small JSON document on the driver, in place of any before it, in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    part.replace(target)


def write_corpus(paragraphs: DataFrame, path: str) -> None:
    """A corpus without blank texts."""
    paragraphs.filter(F.trim("text") != "").write.json(path)


def write_checkpoint(df: DataFrame, path: str, step: str = "global_step") -> None:
    """Trajectories by checkpoint: those of a checkpoint that is written again replace its old ones and no others."""
    df.write.partitionBy(step).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_rollouts(df: DataFrame, path: str) -> None:
    """Recorded steps without padding rows, added to what is there."""
    append_jsonl(df.filter(~F.coalesce(F.col("is_padding"), F.lit(False))), path)


def write_results(parts: list[DataFrame], path: str, order: list[str]) -> None:
    """Records of several workers as one table in dataset order; a path that exists is refused."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").json(path)


def consistent_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """One row per pid; two contents for one pid raise."""
    by = paragraphs.groupBy("pid").agg(F.count_distinct(F.to_json(F.struct("title", "sentences"))).alias("n"), F.min(F.struct("title", "sentences")).alias("x"))
    checks.require(by, "paragraphs", contents_differ=F.col("n") > 1)
    return by.select("pid", "x.title", "x.sentences")


def write_evidence(folder: str, paragraphs: DataFrame, samples: DataFrame, **metadata: str) -> None:
    """An evidence store: paragraphs, samples and metadata with both counts, all checked before anything is written."""
    spark = paragraphs.sparkSession
    unique = consistent_paragraphs(paragraphs)
    checks.require_unique(samples, "samples", "split", "row_index")
    checks.require_unique(samples, "samples", "official_qid")
    unique.withColumn("joined_text", F.array_join("sentences", "")).write.parquet(f"{folder}/paragraphs")
    samples.write.parquet(f"{folder}/samples")
    facts = {**metadata, "paragraphs": str(spark.read.parquet(f"{folder}/paragraphs").count()), "samples": str(spark.read.parquet(f"{folder}/samples").count())}
    spark.createDataFrame(sorted(facts.items()), "key string, value string").coalesce(1).write.parquet(f"{folder}/metadata")


def write_vectors(df: DataFrame, path: str) -> None:
    df.select(F.col("pid").cast("bigint").alias("pid"), F.col("embedding").cast("array<float>").alias("embedding")).write.parquet(path)


#: Inputs of a manifest and rows of a printed report at most; more raise.
MOST_INPUTS, MOST_REPORT_ROWS = 10_000, 1_000


def run_manifest(name: str, inputs: DataFrame, gates: dict[str, tuple[int, int]], **facts) -> dict:
    """A run's manifest: digests of its inputs (name, sha256) and its row counts; a count that is not as required raises."""
    wrong = {k: got for k, (got, want) in gates.items() if got != want}
    if wrong:
        raise checks.CheckFailed(f"{name}: counts are not as required: {wrong}")
    return {"name": name, "created": datetime.datetime.now(datetime.UTC).isoformat(), "inputs": {r.name: r.sha256 for r in sorted(checks.bounded_rows(inputs.select("name", "sha256"), MOST_INPUTS, f"{name}: inputs"))}, "rows": {k: got for k, (got, _) in gates.items()}, **facts}


def markdown_table(df: DataFrame, most: int = MOST_REPORT_ROWS) -> str:
    """A report's rows, all of them, as a Markdown table."""
    rows = checks.bounded_rows(df, most, "a printed report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows])


def latex_table(df: DataFrame, most: int = MOST_REPORT_ROWS) -> str:
    """A report's rows, all of them, as the lines of a LaTeX table."""
    rows = checks.bounded_rows(df, most, "a printed report")
    esc = lambda x: "" if x is None else str(x).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    return "\n".join([" & ".join(map(esc, df.columns)) + r" \\", r"\midrule", *[" & ".join(map(esc, r)) + r" \\" for r in rows]])
