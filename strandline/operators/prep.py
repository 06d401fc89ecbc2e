"""Dataset rows from source rows: projections, predicates, splits and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import checks
from strandline.functions import arithmetic
from strandline.functions import text as tx


def filled(*cols: Column) -> Column:
    """The first column that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols])


def needed(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"{what} is missing")).cast("string"))


def clean_answers(answers: Column) -> Column:
    """Trimmed answers without blanks; null gives an empty array."""
    some = F.coalesce(answers, F.array().cast("array<string>"))
    return F.filter(tx.all_trimmed(some), lambda x: x.isNotNull() & (x != ""))


def user_prompt(content: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def dataset_row(source: Column, question: Column, truth: Column, split: Column, index: Column, question_id: Column | None = None, answers: Column | None = None, suffix: str = "", style: str = "rule") -> list[Column]:
    """The columns of a dataset row; the id falls back to ``{split}_{index}``."""
    qid = F.coalesce(question_id.cast("string") if question_id is not None else F.lit(None).cast("string"), F.concat_ws("_", split, index.cast("string")))
    return [
        source.alias("data_source"),
        user_prompt(F.concat(question, F.lit(suffix))).alias("prompt"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(index.cast("bigint").alias("index"), split.alias("split"), qid.alias("question_id"), source.alias("source"), (answers if answers is not None else F.array(truth)).alias("answers")).alias("extra_info"),
    ]


def paragraphs(df: DataFrame, key: str, titles: str = "titles", sentences: str = "sentences", trim_titles: bool = True) -> DataFrame:
    """(key, pos, title, text) from parallel arrays of titles and sentence lists; blank texts go, and titles lose their outer spaces unless they are to stay as given."""
    flat = df.select(key, F.posexplode(F.arrays_zip(F.col(titles).alias("t"), F.col(sentences).alias("s"))).alias("pos", "x"))
    text = F.array_join(F.filter(tx.all_trimmed(F.col("x.s")), lambda s: s != ""), " ")
    return flat.select(key, "pos", (F.trim("x.t") if trim_titles else F.col("x.t")).alias("title"), text.alias("text")).filter("text <> ''")


def canonical_sentences(sentences: Column) -> Column:
    """A paragraph's sentences with its outer white space gone and its inner sentence borders kept."""
    last = F.size(sentences) - 1
    return F.transform(sentences, lambda s, i: F.when((i == 0) & (i == last), F.trim(s)).when(i == 0, F.ltrim(s)).when(i == last, F.rtrim(s)).otherwise(s))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order, nulls last: which row stays does not depend on how the table is dealt."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def split_by_index(df: DataFrame, index: str, first: int) -> DataFrame:
    """Adds split: validation for the first ``first`` indices, train for the rest."""
    return df.withColumn("split", F.when(F.col(index) < first, "validation").otherwise("train"))


def prefix(df: DataFrame, index: str, n: int, what: str = "source") -> DataFrame:
    """The first ``n`` rows by a contiguous index; a shorter or gapped source raises."""
    if checks.require_contiguous(df.filter(F.col(index) < n).select(index), what, index) < n:
        raise checks.CheckFailed(f"{what} has fewer than {n} rows")
    return df.filter(F.col(index) < n)


def within_length(df: DataFrame, length: Column, most: int, what: str = "prompt") -> DataFrame:
    """All rows, if none is longer than ``most``; nothing is skipped."""
    return checks.require(df, what, too_long=length > most)


#: Labels that stand for none, questions about a picture, and what shows that the picture is there: fixed values.
_NO_LABEL = ("", "none", "null", "nan", "inf", "...")
_FIGURE = r"(?i)\b(?:diagram|figure|polygon)\s+(?:shown|below)|\b(?:shown|pictured)\s+(?:below|in the figure)|\bin the (?:diagram|figure)\b"
_FIGURE_GIVEN = r"(?i)\[asy\]|<svg|data:image"


def _usable(question: Column, truth: Column) -> Column:
    """Whether there is a question and a label."""
    return (F.trim(F.coalesce(question, F.lit(""))) != "") & ~F.lower(F.trim(F.coalesce(truth.cast("string"), F.lit("")))).isin(*_NO_LABEL)


def quality_reason(question: Column, truth: Column) -> Column:
    """Why a row by itself is quarantined, or null: no question or label, or a figure that the question names and has not."""
    figure = F.regexp_like(question, F.lit(_FIGURE)) & ~F.regexp_like(question, F.lit(_FIGURE_GIVEN))
    return F.when(~_usable(question, truth), "missing_or_invalid_problem_or_answer").when(figure, "missing_referenced_diagram")


def label_conflicts(df: DataFrame, question: str, truth: str) -> DataFrame:
    """By question: rows, labels (distinct in canonical form), least_label, and whether one is not equal to the least as an answer.

    Each distinct label of a question is parsed once. A null label is none.
    """
    pairs = df.groupBy(F.col(question).alias("__q"), F.col(truth).cast("string").alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    named = pairs.withColumn("__c", arithmetic.canonical_column(F.col("__t")))
    first = F.min("__c").alias("__first")
    by = named.groupBy("__q").agg(F.sum("__n").alias("rows"), F.countDistinct("__c").alias("labels"), F.min("__t").alias("least_label"), first)
    several = by.filter("labels > 1").select(F.col("__q").alias("__k"), "__first")
    # null questions have no key to join by; they are compared as one group like any other
    met = named.join(several, F.col("__q").eqNullSafe(F.col("__k"))).filter("__c is not null").select("__k", "__c", "__first").distinct()
    bad = met.filter(~arithmetic.answers_equal_column(F.col("__c"), F.col("__first"))).select("__k").distinct().withColumn("__bad", F.lit(True))
    return by.join(bad, F.col("__q").eqNullSafe(F.col("__k")), "left").select(F.col("__q").alias(question), "rows", "labels", "least_label", F.coalesce("__bad", F.lit(False)).alias("conflicting"))


def quarantine(df: DataFrame, question: str, truth: str) -> DataFrame:
    """Adds reason to every row; usable rows of a question whose labels are not equal as answers have ``conflicting_reference_answers``."""
    q, t = F.col(question), F.col(truth)
    usable = df.filter(_usable(q, t)).select(F.trim(q).alias("__question"), t.alias("__label"))
    clash = label_conflicts(usable, "__question", "__label").filter("conflicting").select("__question", F.lit(True).alias("__clash"))
    own = quality_reason(q, t)
    joined = df.join(clash, F.trim(q) == F.col("__question"), "left")
    return joined.withColumn("reason", F.when(F.col("__clash") & _usable(q, t), "conflicting_reference_answers").otherwise(own)).drop("__question", "__clash")


def corrected(df: DataFrame, corrections: DataFrame, exclusions: DataFrame, index: str, truth: str) -> DataFrame:
    """Rows without the excluded indices, with corrected labels where there are some (index, correction)."""
    kept = df.join(exclusions.select(index).distinct(), index, "left_anti")
    return kept.join(corrections.select(index, "correction"), index, "left").withColumn(truth, F.coalesce("correction", truth)).drop("correction")


def align(parts: list[DataFrame]) -> DataFrame:
    """The union of tables with different columns; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def flatten_steps(trajectories: DataFrame) -> DataFrame:
    """Step rows from (uid, trajectory_uid, steps, reward): the trajectory's reward stands at its last step."""
    rows = trajectories.select("uid", "trajectory_uid", F.col("reward").alias("__reward"), F.size("steps").alias("__n"), F.posexplode("steps").alias("step_index", "step"))
    return rows.select("uid", "trajectory_uid", "step_index", "step.*", F.when(F.col("step_index") == F.col("__n") - 1, F.coalesce("__reward", F.lit(0.0))).otherwise(0.0).alias("reward"))


def repeated(df: DataFrame, n: Column, out: str) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``out``; ``n`` below 1 gives none."""
    return df.filter(n >= 1).withColumn(out, F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))


def drop_or_raise(df: DataFrame, failed: str, key: str, strict: bool) -> DataFrame:
    """Rows that did not fail; with ``strict`` any failure raises and names a few ids."""
    if strict:
        ids = [r[0] for r in df.filter(failed).select(key).distinct().orderBy(key).limit(5).collect()]
        if ids:
            raise checks.CheckFailed(f"{failed}: {', '.join(map(str, ids))}")
    return df.filter(~F.coalesce(F.col(failed), F.lit(True)))


def crop_ok(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, least_edge: int = 28, least: float = 0.01, most: float = 0.90) -> Column:
    """Whether a box is ordered, inside the image, wide and high enough, and of a fitting share of its area."""
    w, h = x1 - x0, y1 - y0
    share = (w * h) / (width * height)
    return (x0 >= 0) & (y0 >= 0) & (x1 <= width) & (y1 <= height) & (w >= least_edge) & (h >= least_edge) & share.between(least, most)


def placeholders_match(text: Column, images: Column, mark: str = "<image>") -> Column:
    return F.regexp_count(text, F.lit(mark)) == F.size(images)


def parse_cases(raw: Column) -> Column:
    """struct(inputs, outputs, fn_name) of a JSON test description; lists of different lengths raise."""
    x = F.from_json(raw, "struct<inputs:array<string>,outputs:array<string>,fn_name:string>")
    return F.when(F.size(x["inputs"]) == F.size(x["outputs"]), x).otherwise(F.raise_error(F.lit("inputs and outputs differ in number")).cast("struct<inputs:array<string>,outputs:array<string>,fn_name:string>"))


def homogeneous(kinds: Column) -> Column:
    """The one kind of a list of test kinds; ``empty`` or ``mixed`` otherwise."""
    k = F.array_distinct(kinds)
    return F.when(F.size(k) == 0, "empty").when(F.size(k) > 1, "mixed").otherwise(F.element_at(k, 1))


def vision_row(df: DataFrame, index: str, split: str) -> DataFrame:
    """Vision rows with their placeholders checked and their options spelled."""
    checks.require(df, "vision rows", placeholders=~placeholders_match(F.col("problem"), F.col("images")))
    return df.select(F.lit(split).alias("split"), F.col(index).cast("bigint").alias("index"), user_prompt(F.col("problem")).alias("prompt"), "images", F.struct(F.lit("rule").alias("style"), F.col("answer").alias("ground_truth")).alias("reward_model"))


def with_options(question: Column, options: Column) -> Column:
    """A question with its lettered options on lines of their own."""
    return F.when(F.size(options) > 0, F.concat(question, F.lit("\n"), F.array_join(tx.spell_options(options), "\n"))).otherwise(question)
