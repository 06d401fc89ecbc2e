"""Answer normalisation and matching, chat texts, evidence ids: column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # fixed value: ASCII punctuation
EVIDENCE_PREFIX = "hotpotqa-official-sentence-v1"  # fixed value: the id format of stored evidence
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # fixed value: Unicode's space separators


def trimmed(x: Column) -> Column:
    """A text without the spaces of any kind at its ends, as SQL's trim."""
    return F.trim(x, F.lit(SPACES))


def all_trimmed(xs: Column) -> Column:
    """Each text of a list trimmed. ``F.transform(xs, F.trim)`` would give each text's index as the characters to take off."""
    return F.transform(xs, lambda s: trimmed(s))


def answer_tokens(x: Column) -> Column:
    """Words of an answer in lower case, without ASCII punctuation and the articles a, an, the."""
    low = F.translate(F.lower(F.coalesce(x, F.lit(""))), PUNCTUATION, "")
    bare = F.regexp_replace(low, r"(?U)\b(a|an|the)\b", " ")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")


def normalize_answer(x: Column) -> Column:
    return F.array_join(answer_tokens(x), " ")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(xs: Column) -> Column:
    """The tokens, each with the number of its occurrence: equal multisets become equal sets. Work grows as sorting does."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        of_run = lambda at, i, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(at, k + 1), F.size(s)) - i), lambda n: F.concat(F.get(s, i), F.lit("\0"), n.cast("string")))
        return F.when(F.size(s) == 0, s).otherwise(_let(starts, lambda at: F.flatten(F.transform(at, lambda i, k: of_run(at, i, k)))))

    return _let(F.array_sort(xs), runs)


def _multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 over answer tokens as multisets; 1 if both are empty, 0 if one is or they share none."""
    p, g = answer_tokens(pred), answer_tokens(gold)
    n, m, same = F.size(p), F.size(g), _multiset_overlap(p, g)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (same == 0), 0.0).otherwise(2.0 * same / (n + m))


def official_f1(pred: Column, gold: Column) -> Column:
    """Token F1, but 0 where either side is yes, no or noanswer and the other differs."""
    p, g = normalize_answer(pred), normalize_answer(gold)
    closed = ("yes", "no", "noanswer")
    return F.when((p.isin(*closed) | g.isin(*closed)) & (p != g), 0.0).otherwise(token_f1(pred, gold))


def is_alias(pred: Column, gold: Column) -> Column:
    """Equal, or one contains the other, they share a token, and the shorter has two tokens at least."""
    p, g = normalize_answer(pred), normalize_answer(gold)
    pt, gt = answer_tokens(pred), answer_tokens(gold)
    within = F.contains(p, g) | F.contains(g, p)
    return (p == g) | ((p != "") & (g != "") & within & F.arrays_overlap(pt, gt) & (F.least(F.size(pt), F.size(gt)) >= 2))


def token_overlap(pred: Column, gold: Column) -> Column:
    """Share of the gold answer's distinct tokens that the prediction has; 0 without gold tokens."""
    p, g = answer_tokens(pred), F.array_distinct(answer_tokens(gold))
    return F.when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_intersect(p, g)) / F.size(g))


def exact_match(pred: Column, references: Column) -> Column:
    """Whether the normalised prediction equals any normalised reference; a blank prediction never does."""
    p = normalize_answer(pred)
    return (p != "") & F.exists(references, lambda r: normalize_answer(r) == p)


def best_over_references(pred: Column, references: Column, score) -> Column:
    return F.coalesce(F.array_max(F.transform(references, lambda r: score(pred, r))), F.lit(0.0))


def candidate_references(truth: Column, aliases: Column) -> Column:
    """The truth and its aliases without blanks or repeats, in order of first mention."""
    every = F.concat(F.array(truth), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(all_trimmed(every), lambda x: x.isNotNull() & (x != "")))


def tagged_answer(text: Column) -> Column:
    """The last complete <answer> element after the last </think>, trimmed; without one, the whole text."""
    after = F.regexp_replace(text, r"(?is)^.*</think>", "")
    found = F.regexp_extract_all(after, F.lit(r"(?is)<answer>((?:(?!<answer>).)*?)</answer>"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1))).otherwise(F.trim(text))


def lenient_answer(text: Column) -> Column:
    """What follows the last code fence, if anything does, read as :func:`tagged_answer`."""
    after = F.substring_index(text, "```", -1)
    return tagged_answer(F.when(F.trim(after) != "", after).otherwise(text))


def split_thinking(text: Column) -> Column:
    """struct(thinking, visible, complete): the text before and after the first </think>; without it all is thinking if one was opened."""
    at = F.instr(text, "</think>")
    start = F.regexp_replace(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), r"^\s*<think>\s*", "")
    opened = F.contains(text, F.lit("<think>"))
    return F.struct(
        F.when((at > 0) | opened, F.trim(start)).otherwise("").alias("thinking"),
        F.when(at > 0, F.trim(F.substring(text, at + 8, F.length(text)))).when(opened, "").otherwise(F.trim(text)).alias("visible"),
        ((at > 0) | ~opened).alias("complete"),
    )


def visible_completion(text: Column) -> Column:
    """The text after the last </think>, in any case."""
    return F.trim(F.regexp_replace(text, r"(?is)^.*</think>", ""))


def last_user_message(prompt: Column) -> Column:
    """Content of the last user message of an array of (role, content)."""
    mine = F.filter(prompt, lambda m: m["role"] == "user")
    return F.when(F.size(mine) > 0, F.element_at(mine, -1)["content"])


def user_text(prompt: Column) -> Column:
    """All user messages, joined by line ends."""
    return F.array_join(F.transform(F.filter(prompt, lambda m: m["role"] == "user"), lambda m: m["content"]), "\n")


def search_queries(text: Column) -> Column:
    """Queries of <search> elements, trimmed, without blanks."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)<search>(.*?)</search>"), F.lit(1))
    return F.filter(all_trimmed(found), lambda q: q != "")


def prompt_group_key(source: Column, split: Column, **identity: Column) -> Column:
    """``source:split:field:value`` with the first identity field that is there; without any, an error."""
    parts = [F.when(v.isNotNull(), F.concat_ws(":", source, split, F.lit(k), v.cast("string"))) for k, v in identity.items()]
    return F.coalesce(*parts, F.raise_error(F.lit("a row has no identity field")).cast("string"))


def evidence_id(pid: Column, sentence: Column) -> Column:
    return F.concat_ws(":", F.lit(EVIDENCE_PREFIX), pid.cast("string"), sentence.cast("string"))


def parse_evidence_id(x: Column) -> Column:
    """struct(pid, sentence) of a canonical id; null for any text that does not come back the same."""
    digits = rf"^{EVIDENCE_PREFIX}:([0-9]+):([0-9]+)$"
    pid = F.try_to_number(F.nullif(F.regexp_extract(x, digits, 1), F.lit("")), F.lit("999999999999999999")).cast("bigint")
    sentence = F.try_to_number(F.nullif(F.regexp_extract(x, digits, 2), F.lit("")), F.lit("999999999")).cast("int")
    return F.when(evidence_id(pid, sentence) == x, F.struct(pid.alias("pid"), sentence.alias("sentence")))


@F.pandas_udf(T.StringType())
def normalize_title(titles: pd.Series) -> pd.Series:
    """Compatibility form, underscores as spaces, single spaces, case folded."""
    return titles.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).replace("_", " ").split()).casefold())


def normalize_stdout(x: Column) -> Column:
    """Line ends unified, each line stripped on the right, the whole stripped."""
    lines = F.split(F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    return F.regexp_replace(F.array_join(F.transform(lines, lambda s: F.regexp_replace(s, r"\s+$", "")), "\n"), r"^\s+|\s+$", "")


def last_code_block(text: Column) -> Column:
    """Content of the last complete fenced block, without its language; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```[^\n`]*\n(.*?)```"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def coupled(answer: Column, claim: Column) -> Column:
    """Whether the claim has the answer, letter case and white space aside; never for a blank answer."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)\s+", "")
    return F.coalesce((bare(answer) != "") & F.contains(bare(claim), bare(answer)), F.lit(False))


def token_bounded(target: Column, query: Column) -> Column:
    """Whether the normalised query has the normalised target as whole tokens."""
    t, q = normalize_answer(target), normalize_answer(query)
    return (t != "") & F.contains(F.concat(F.lit(" "), q, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" ")))


def truncated(x: Column, limit: int) -> Column:
    """A text, or any value as JSON, cut to ``limit`` characters."""
    return F.substring(x, 1, limit)


def spell_options(options: Column) -> Column:
    """``A. first``, ``B. second``, ..."""
    return F.transform(options, lambda v, i: F.concat(F.char(i + 65), F.lit(". "), v))


#: Scores that a judge may give, by what it writes: fixed values.
JUDGE_SCORES = {"0": 0.0, "0.0": 0.0, "0.25": 0.25, "0.5": 0.5, "0.75": 0.75, "1": 1.0, "1.0": 1.0}


def judge_score(text: Column) -> Column:
    """The score that a judge's whole answer spells; null for any other answer."""
    table = F.create_map(*[F.lit(x) for kv in JUDGE_SCORES.items() for x in kv])
    return F.try_element_at(table, F.trim(text))


def judge_ids(text: Column, allowed: Column) -> Column:
    """Allowed ids in the JSON array that a text holds, each once in the array's order; null if there is no array."""
    inner = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    ids = F.from_json(F.nullif(inner, F.lit("")), "array<string>")
    return F.array_intersect(ids, allowed)


def functional_equal(actual: Column, expected: Column) -> Column:
    """Whether two results are the same JSON value, or the expected one is a list whose first member is the actual one; false for what is no JSON."""
    a, e = F.try_parse_json(actual), F.try_parse_json(expected)
    wrapped = F.try_variant_get(e, "$[0]", "variant")
    same = lambda x, y: F.to_json(x) == F.to_json(y)
    return F.coalesce(same(a, e) | F.coalesce(same(a, wrapped), F.lit(False)), F.lit(False))


def json_safe(df, *columns: str):
    """Nested columns as JSON text, so that any sink can hold them."""
    return df.withColumns({c: F.to_json(c) for c in columns})
