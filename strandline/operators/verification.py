"""Credits of whole verifiers: tested code, cited crops, reasoning steps, and reports on them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions.certificates import OUTPUT_FIELDS
from strandline.operators import ordered
from strandline.operators.credit import weighted_slots


def _slots(df: DataFrame, group: Column, step: Column, score: Column, applicable: Column) -> DataFrame:
    return df.select("trajectory_uid", group.alias("group_id"), F.lit("singleton_artifact").alias("group_kind"), F.lit(0).alias("slot"), step.cast("int").alias("step_index"), score.cast("double").alias("score"), applicable.alias("applicable"), F.lit(1.0).alias("base_weight"))


def code_credits(artifacts: DataFrame, certificates: DataFrame) -> DataFrame:
    """(trajectory_uid, step_index, score): an even share for each tested version of the code and for an attempted submission's certificate.

    ``artifacts``: trajectory_uid, artifact_id, step_index, tested, verified;
    ``certificates``: trajectory_uid, step_index, attempted, valid. What failed
    keeps its share and gives nothing; a version that was never run has none.
    """
    code = _slots(artifacts, F.concat(F.lit("code:"), "artifact_id"), F.col("step_index"), F.col("verified"), F.col("tested"))
    cert = _slots(certificates, F.lit("certificate"), F.col("step_index"), F.col("valid"), F.col("attempted"))
    return weighted_slots(code.unionByName(cert)).filter("applicable").groupBy("trajectory_uid", "step_index").agg(F.sum("credit").alias("score"))


def extended_checks(credits_checks: DataFrame, runs: DataFrame) -> DataFrame:
    """Each trajectory's checks with one more per run (all passed and the replay agrees), and its numbers of revisions and tests."""
    run = runs.select("trajectory_uid", (F.col("all_passed") & F.col("replay_valid")).cast("double").alias("check"), "artifact_id")
    by = run.groupBy("trajectory_uid").agg(F.collect_list("check").alias("more"), F.greatest(F.lit(0), F.count_distinct("artifact_id") - 1).alias("revisions"), F.count(F.lit(1)).alias("tests"))
    out = credits_checks.join(by, "trajectory_uid", "left")
    return out.select("trajectory_uid", F.concat("checks", F.coalesce("more", F.array().cast("array<double>"))).alias("checks"), F.coalesce("revisions", F.lit(0)).alias("revisions"), F.coalesce("tests", F.lit(0)).alias("tests"))


def crop_credits(crops: DataFrame, cited: DataFrame) -> DataFrame:
    """(trajectory_uid, score): the share of cited crops that are there and valid; with nothing cited, of all crops.

    ``crops``: trajectory_uid, artifact_id, valid; ``cited``: trajectory_uid,
    artifact_id. A cited crop that is missing keeps its share.
    """
    named = cited.distinct().join(crops, ["trajectory_uid", "artifact_id"], "left").select("trajectory_uid", F.coalesce(F.col("valid"), F.lit(False)).alias("valid"))
    other = crops.join(cited.select("trajectory_uid").distinct(), "trajectory_uid", "left_anti").select("trajectory_uid", "valid")
    return named.unionByName(other).groupBy("trajectory_uid").agg(F.avg(F.col("valid").cast("double")).alias("score"))


def horizon_credits(transitions: DataFrame, horizon: int) -> DataFrame:
    """Only a trajectory's first ``horizon`` transitions take part; each has an even share of what took part, if it is valid."""
    w = Window.partitionBy("trajectory_uid")
    rank = F.row_number().over(w.orderBy("step_index"))
    marked = transitions.withColumn("__in", rank <= horizon)
    n = F.sum(F.col("__in").cast("int")).over(w)
    return marked.withColumn("score", F.when(F.col("__in"), F.col("valid").cast("double") / n).otherwise(0.0)).drop("__in")


def inference_error(op: Column, conclusion: Column, spans: Column, inputs: Column, question: Column) -> Column:
    """Why a reasoning step's conclusion does not follow from its spans and the conclusions of its inputs; null if it does."""
    within = F.exists(spans, lambda s: F.contains(s, conclusion))
    norm = tx.normalize_answer
    known = (norm(conclusion) != "") & F.contains(F.concat(F.lit(" "), norm(question), F.lit(" ")), F.concat(F.lit(" "), norm(conclusion), F.lit(" ")))
    first, second = F.get(inputs, F.lit(0)), F.get(inputs, F.lit(1))
    lone, pair = F.size(inputs) == 1, F.size(inputs) == 2
    compared = F.when(norm(first) == norm(second), "yes").otherwise("no")
    no_spans = F.size(spans) == 0
    return (
        F.when(conclusion.isNull(), "conclusion_unavailable")
        .when(op == "select_exact_span", F.when(~within, "span_selection_invalid"))
        .when(op == "extract_bridge_entity", F.when(~within, "bridge_not_in_premise").when(known, "bridge_already_in_question"))
        .when(op == "extract_answer_candidate", F.when(~(within | F.coalesce(F.array_contains(inputs, conclusion), F.lit(False))), "answer_candidate_not_derived"))
        .when(op == "normalize_answer", F.when(~(lone & no_spans), "normalize_sources_invalid").when(first.isNull() | (conclusion != norm(first)), "normalization_invalid"))
        .when(op == "compare_equal", F.when(~(pair & no_spans), "compare_sources_invalid").when(first.isNull() | second.isNull(), "compare_inputs_unavailable").when(conclusion != compared, "comparison_invalid"))
        .otherwise("op_unverifiable")
    )


def output_value(op: Column, output: Column) -> Column:
    """The trimmed value of the one field that an operation's output may have; null if it is blank, or no yes or no for a comparison."""
    value = F.trim(F.coalesce(*[F.when(op == k, F.try_element_at(output, F.lit(f))) for k, f in OUTPUT_FIELDS.items()]))
    fine = (F.size(F.map_keys(output)) == 1) & (value != "") & ((op != "compare_equal") | value.isin("yes", "no"))
    return F.when(fine, value)


_NOVEL = "trajectory_uid string, step_index int, novel boolean, credit double, reasons array<string>"


def novelty_credits(steps: DataFrame, horizon: int) -> DataFrame:
    """Credits of reasoning steps in order: a repeated query, or a conclusion or source of a step that was credited before, gives none.

    ``steps``: trajectory_uid, step_index, action, query, conclusion, sources,
    valid, coupled, factor. What counts as repeated depends on which earlier
    steps were credited, so a trajectory's steps are read one after another.
    """

    def read(pdf: pd.DataFrame, starts: set[int]) -> Iterator[tuple]:
        for i, s in enumerate(pdf.itertuples()):
            if i in starts:
                k, asked, concluded, used = 0, set(), set(), set()
            k += 1
            query, conclusion, sources = s.query_key or "", s.conclusion_key or "", set(s.sources if s.sources is not None else ())
            search = s.action == "search"
            why = [w for bad, w in ((query and query in asked, "query_repeated"), (conclusion and conclusion in concluded, "conclusion_repeated"), (sources & used, "source_repeated")) if search and bad]
            credit = s.valid * s.factor * s.coupled * (not why) / horizon if k <= horizon else 0.0
            if search and query:
                asked.add(query)
            if search and credit > 0:
                concluded |= {conclusion} - {""}
                used |= sources
            yield s.trajectory_uid, s.step_index, not why, float(credit), why + (["reward_horizon_exceeded"] if k > horizon else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, at in ordered.whole_groups(batches, "trajectory_uid"):
            yield pd.DataFrame(read(pdf, set(at)), columns=["trajectory_uid", "step_index", "novel", "credit", "reasons"])

    keyed = steps.withColumns({"query_key": tx.normalize_answer(F.col("query")), "conclusion_key": tx.normalize_answer(F.col("conclusion"))}).drop("query", "conclusion")
    return ordered.in_order(keyed, "trajectory_uid", "step_index").mapInPandas(run, _NOVEL)


def certificate_summary(audits: DataFrame) -> DataFrame:
    """By trajectory: mean grounding, coupling and own validity, counts, and whether any step was past the horizon."""
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return audits.groupBy("trajectory_uid").agg(mean("grounded"), mean("coupled"), mean("valid"), F.count(F.lit(1)).alias("steps"), F.count_if("valid").alias("valid_steps"), F.bool_or("past_horizon").alias("any_past_horizon"))
