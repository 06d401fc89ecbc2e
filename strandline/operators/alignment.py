"""Joins that align corpora, official records, trajectories and execution lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import checks, runtime
from strandline.functions import hashing
from strandline.functions import text as tx


def corpus_map(corpus: DataFrame) -> DataFrame:
    """(digest, pid) of a corpus (pid, title, text); two paragraphs with one digest are an error."""
    out = corpus.select(hashing.paragraph_digest(F.col("title"), F.col("text")).alias("digest"), "pid")
    return checks.require_unique(out, "corpus", "digest")


def join_by_digest(rows: DataFrame, corpus: DataFrame, must_match: bool = True) -> DataFrame:
    """Rows (title, text, ...) with the pid of their paragraph; without one, an error or, if allowed, a null pid.

    Each side is digested once, and what the join gives is written down; one
    aggregate over it and over the corpus' digests makes both checks.
    """
    digests = corpus.select(hashing.paragraph_digest(F.col("title"), F.col("text")).alias("__digest"), "pid").groupBy("__digest").agg(F.min("pid").alias("pid"), F.count(F.lit(1)).alias("__n"))
    # a full join also has the digests that no row has, so that repeats among them are seen
    marked = rows.withColumns({"__digest": hashing.paragraph_digest(F.col("title"), F.col("text")), "__real": F.lit(True)}).join(digests, "__digest", "full")
    out = runtime.materialise(marked, "digested")
    bad = {"repeated_in_corpus": F.col("__n") > 1}
    if must_match:
        bad["not_in_corpus"] = F.col("__real") & F.col("__n").isNull()
    checks.require(out.select(F.coalesce("__real", F.lit(False)).alias("__real"), "__n"), "paragraphs", **{k: F.coalesce(c, F.lit(False)) for k, c in bad.items()})
    return out.filter("__real").select(*rows.columns, "pid")


def align_by_position(official: DataFrame, prepared: DataFrame, index: str, same: list[str]) -> DataFrame:
    """Pairs of rows with one index; a row without a partner, or columns in ``same`` that differ, raise."""
    l, r = official.alias("l"), prepared.alias("r")  # noqa: E741
    both = l.join(r, F.col(f"l.{index}") == F.col(f"r.{index}"), "full_outer")
    bad = {f"{c}_differs": ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in same}
    checks.require(both, "alignment", only_prepared=F.col(f"l.{index}").isNull(), only_official=F.col(f"r.{index}").isNull(), **bad)
    extra = [c for c in prepared.columns if c not in official.columns]
    return both.select("l.*", *[F.col(f"r.{c}") for c in extra])


def resolve_facts(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Supporting facts (row, title, sent_id) against contexts (row, title, pid, sentences): evidence_id, or why there is none."""
    j = facts.join(contexts.select("row", "title", "pid", F.size("sentences").alias("n")), ["row", "title"], "left")
    reason = F.when(F.col("pid").isNull(), "title_missing").when((F.col("sent_id") < 0) | (F.col("sent_id") >= F.col("n")), "sentence_out_of_range")
    return j.select("row", "title", "sent_id", F.when(reason.isNull(), tx.evidence_id(F.col("pid"), F.col("sent_id"))).alias("evidence_id"), reason.alias("reason"))


def sentence_records(paragraphs: DataFrame) -> DataFrame:
    """(evidence_id, pid, sentence, title, text) of paragraphs (pid, title, sentences)."""
    return paragraphs.select("pid", "title", F.posexplode("sentences").alias("sentence", "text")).select(tx.evidence_id(F.col("pid"), F.col("sentence")).alias("evidence_id"), "pid", "sentence", "title", "text")


def with_fallback_key(rows: DataFrame, source: DataFrame, index: str, question: str, label: str) -> DataFrame:
    """Rows with ``source_index``: by index where the source has it, else the least index with the question and label."""
    by_index = source.select(F.col(index).alias("__i"))
    by_text = source.groupBy(question, label).agg(F.min(index).alias("__t"))
    out = rows.join(by_index, F.col(index) == F.col("__i"), "left").join(by_text, [question, label], "left")
    return out.withColumn("source_index", F.coalesce("__i", "__t")).drop("__i", "__t")


def coverage(expected: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one side has, with the side: empty if the two cover one another."""
    both = expected.select(*keys).distinct().withColumn("e", F.lit(1)).join(observed.select(*keys).distinct().withColumn("o", F.lit(1)), list(keys), "full_outer")
    return both.select(*keys, F.when(F.col("o").isNull(), "missing").when(F.col("e").isNull(), "unexpected").alias("side")).filter("side is not null")


def remaining(tasks: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Tasks without a finished record."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def lineage(artifacts: DataFrame, runs: DataFrame, suite_id: str, suite_sha256: str) -> DataFrame:
    """By artifact: runs of the suite, those on its exact code, and whether one of them passed everything."""
    exact = (F.col("r.code_sha256") == F.col("a.sha256")) & (F.col("r.suite_id") == suite_id) & (F.col("r.suite_sha256") == suite_sha256)
    j = artifacts.alias("a").join(runs.alias("r"), F.col("a.artifact_id") == F.col("r.code_artifact_id"), "left")
    return j.groupBy("a.artifact_id").agg(F.count("r.run_id").alias("runs"), F.count_if(exact).alias("exact_runs"), F.coalesce(F.max(F.when(exact, F.col("r.all_passed").cast("int"))), F.lit(0)).cast("boolean").alias("verified"))


def certificates(submissions: DataFrame, artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """Each submission (submission_id, artifact_id, run_ids) with the first condition that fails, or ``ok``."""
    flat = submissions.select("submission_id", "artifact_id", F.explode_outer("run_ids").alias("run_id"))
    j = flat.join(artifacts.select("artifact_id", "sha256"), "artifact_id", "left").join(runs.select("run_id", "code_artifact_id", "code_sha256", "all_passed"), "run_id", "left")
    by = j.groupBy("submission_id", "artifact_id").agg(F.max("sha256").alias("sha"), F.count("run_id").alias("named"), F.count("code_artifact_id").alias("found"), F.bool_and(F.col("code_artifact_id") == F.col("artifact_id")).alias("own"), F.bool_and(F.col("code_sha256") == F.col("sha256")).alias("exact"), F.bool_and("all_passed").alias("passed"))
    why = F.when(F.col("sha").isNull(), "unknown_artifact").when(F.col("named") == 0, "no_evidence").when(F.col("found") < F.col("named"), "unknown_run").when(~F.col("own"), "run_of_another_artifact").when(~F.col("exact"), "code_changed").when(~F.col("passed"), "not_all_passed").otherwise("ok")
    return by.select("submission_id", "artifact_id", why.alias("result"))


def crop_parents(artifacts: DataFrame) -> DataFrame:
    """Each crop with a reason if its parent is missing or was changed since, else ``ok``."""
    p = artifacts.select(F.col("artifact_id").alias("__p"), F.col("sha256").alias("__sha"))
    j = artifacts.filter("parent_id is not null").join(p, F.col("parent_id") == F.col("__p"), "left")
    return j.select("artifact_id", F.when(F.col("__p").isNull(), "parent_missing").when(F.col("__sha") != F.col("parent_sha256"), "parent_changed").otherwise("ok").alias("result"))


def grounding(premises: DataFrame, sources: DataFrame) -> DataFrame:
    """Each premise (premise_id, artifact_id, digest, span) against sources (artifact_id, text): why it is not grounded, or ``ok``."""
    j = premises.join(sources.select("artifact_id", F.col("text").alias("__text")), "artifact_id", "left")
    why = F.when(F.col("__text").isNull(), "unknown_source").when(F.sha2("__text", 256) != F.col("digest"), "digest_differs").when((F.trim("span") == "") | ~F.contains("__text", F.col("span")), "span_not_in_source").otherwise("ok")
    return j.select("premise_id", "artifact_id", why.alias("result"))


def action_coupled(kind: Column, value: Column, target: Column) -> Column:
    """A finish must equal the certificate's target, a search must have it as whole tokens."""
    return F.when(kind == "finish", tx.normalize_answer(value) == tx.normalize_answer(target)).otherwise(tx.token_bounded(target, value))


def submission(steps: DataFrame) -> DataFrame:
    """The answer of each trajectory's first finish that follows a search (trajectory_uid, step_index, action, answer)."""
    searched = steps.filter("action = 'search'").groupBy("trajectory_uid").agg(F.min("step_index").alias("first_search"))
    ok = steps.filter("action = 'finish'").join(searched, "trajectory_uid").filter("step_index > first_search")
    return ok.groupBy("trajectory_uid").agg(F.min_by("answer", "step_index").alias("answer"), F.min("step_index").alias("step_index"))


def leaked(train: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    """Keys that are in both splits; there should be none."""
    return train.select(key).intersect(validation.select(key))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side, once per surplus."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
