"""Compact records of evaluated trajectories: one projection, with what stands in where a column is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as tx

# Where a rendered prompt has the question, and an output its search calls.
_ASKED = r"(?s)(?:^|\n)### User Query\s*\n(.*?)(?=\n\n### |$(?![\s\S]))"
_CALLS = r"(?is)<function=search>(.*?)</function>"
_QUERY = r"(?is)<parameter=query>\s*(.*?)\s*</parameter>"


def _some(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def question(prompt: Column, rendered: Column) -> Column:
    """The last user message that has content; else what the rendered prompt has under its heading; else nothing."""
    users = F.filter(prompt, lambda m: (m["role"] == "user") & m["content"].isNotNull())
    told = F.when(F.size(users) > 0, F.element_at(users, -1)["content"])
    return F.trim(F.coalesce(told, F.regexp_extract(F.coalesce(rendered, F.lit("")), _ASKED, 1)))


def called_queries(output: Column) -> Column:
    """The query of each search call of an output that has one."""
    bodies = F.regexp_extract_all(F.coalesce(output, F.lit("")), F.lit(_CALLS), F.lit(1))
    return F.filter(F.transform(bodies, lambda b: F.when(b.rlike(_QUERY), F.regexp_extract(b, _QUERY, 1))), lambda q: q.isNotNull())


def queries(executed: Column, steps: Column, output: Column) -> Column:
    """The queries that were executed: as recorded, else those of the model's search steps, else those of the output's calls."""
    own = F.filter(steps, lambda s: (s["source"] == "model") & (F.coalesce(s["query"], F.lit("")) != ""))
    recorded = F.coalesce(executed, F.transform(own, lambda s: s["query"]), F.array().cast("array<string>"))
    return F.when(F.size(recorded) > 0, recorded).otherwise(called_queries(output))


def validation_records(rows: DataFrame, tagged: bool = True) -> DataFrame:
    """sample_index, sample_key, dataset_question_id, official_qid, question, search_queries, answer, ground_truth, score of each row.

    A key that is missing is ``split:index`` of ``extra_info`` (``validation``
    without a split), an id of the question that of ``extra_info``, an official
    id that of the question; without any they are empty. With ``tagged`` the
    answer is that of the last <answer> element, or the whole output; without it
    the whole output; an empty one is null. Other columns are not read.
    """
    info = F.col("extra_info")
    place = F.when(info["index"].isNotNull(), F.concat_ws(":", F.coalesce(_some(info["split"]), F.lit("validation")), info["index"].cast("bigint").cast("string")))
    own_id = F.coalesce(_some(F.col("dataset_question_id")), _some(info["question_id"]), F.lit(""))
    output = F.coalesce("output_text", F.lit(""))
    return rows.select(
        "sample_index",
        F.coalesce(_some(F.col("sample_key")), place, F.lit("")).alias("sample_key"),
        own_id.alias("dataset_question_id"),
        F.coalesce(_some(F.col("official_qid")), own_id).alias("official_qid"),
        question(F.col("prompt"), F.col("decoded_input")).alias("question"),
        queries(F.col("executed_queries"), F.col("search_steps"), F.col("output_text")).alias("search_queries"),
        F.nullif(tx.lenient_answer(output) if tagged else F.trim(output), F.lit("")).alias("answer"),
        "ground_truth",
        F.col("score").cast("double").alias("score"),
    )
