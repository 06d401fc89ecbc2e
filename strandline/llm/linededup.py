"""Removal of boilerplate lines that many sites share.

For each line's hash a HyperLogLog sketch of the sites that show it is built in
every task and merged by aggregation. Most lines are far from the threshold and
their estimate decides. A line whose estimate is near the threshold gets its
sites counted exactly. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import shared

#: Sites that must show a line before it is boilerplate.
MIN_SITES = 8
#: log2 of the sketch's registers: a relative standard error of about 1.6 %.
LG_K = 12
#: Estimates within this fraction of the threshold (one site at least) are counted exactly: over six standard errors.
NEAR = 0.1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _exploded(df: DataFrame, text_col: str, site_col: str, order_col: str) -> DataFrame:
    """(line, site, o, k, p) of each line that is not blank: its hash, its site, and its row and place.

    ``line`` is two 64-bit hashes under different seeds. A row is known by its
    order and a hash of its order, site and text, so that rows which are alike
    in these are treated alike, whatever else they hold.
    """
    hashed = F.transform(_lines(F.col(text_col)), lambda x: F.when(F.trim(x) != "", F.struct(F.xxhash64(F.trim(x)).alias("a"), F.xxhash64(F.lit(1), F.trim(x)).alias("b"))))
    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(site_col).cast("string").alias("site"), F.col(order_col).alias("o"), _row_key(text_col, site_col, order_col).alias("k"), F.posexplode(hashed).alias("p", "line"))
    return rows.filter(F.col("line").isNotNull())


def _row_key(text_col: str, site_col: str, order_col: str) -> Column:
    return F.xxhash64(order_col, site_col, text_col)


def _spread(df: DataFrame, text_col: str, site_col: str, order_col: str, min_sites: int) -> DataFrame:
    """Lines that at least ``min_sites`` sites show: line, first (the first occurrence in id order), copies (occurrences)."""
    lines = _exploded(df, text_col, site_col, order_col)
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"), F.min(F.struct("o", "k", "p")).alias("first"), F.count(F.lit(1)).alias("copies"))
    slack = max(1.0, NEAR * min_sites)
    spread = sketched.select("line", "first", "copies", F.hll_sketch_estimate("s").alias("e")).filter(F.col("e") >= min_sites - slack)
    sure = spread.filter(F.col("e") > min_sites + slack).drop("e")
    near = spread.filter(F.col("e") <= min_sites + slack).drop("e")
    # the distinct (line, site) pairs come first: a line that is everywhere is then a row per site, and no task holds its occurrences
    pairs = lines.select("line", "site").filter(F.col("site").isNotNull()).distinct().join(near.select("line"), "line", "left_semi")
    exact = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("line")
    return sure.unionByName(near.join(exact, "line", "left_semi"))


def dedup_lines(df: DataFrame, text_col: str = "text", site_col: str = "source", order_col: str = "doc_id", chars_col: str | None = "n_chars", min_sites: int = MIN_SITES, count_col: str | None = None) -> DataFrame:
    """The rows with boilerplate lines removed, all but each line's first occurrence in id order.

    A line is compared without leading and trailing spaces; blank lines are
    never removed. A null site is no site. A null text stays null, an empty one
    empty; a text may become empty, its row stays. Repeated rows are treated
    alike. An empty table gives an empty result. All columns are kept, whatever
    their names and types; ``chars_col`` is set to the new length where lines
    went, and ``count_col``, if named, is added with the number of lines
    removed. Of the lines that go, those that are very common meet their rows by
    a broadcast of bounded size, so that no task gets all rows of one line.
    """
    spread = shared.materialise(_spread(df, text_col, site_col, order_col, min_sites), "spread")
    lines = _exploded(df, text_col, site_col, order_col)
    hit = shared.join_counted(lines.drop("site"), spread, "line", "copies").filter(~F.struct("o", "k", "p").eqNullSafe(F.col("first")))
    k, o, of, ps = shared.free_names(df, "key", "order", "of", "gone")
    gone = hit.groupBy(F.col("o").alias(o), F.col("k").alias(of)).agg(F.collect_set("p").alias(ps))
    own = df.withColumn(k, _row_key(text_col, site_col, order_col))
    # the order is compared too, null for null
    joined = own.join(gone, (F.col(k) == F.col(of)) & own[order_col].eqNullSafe(F.col(o)), "left")
    kept = F.filter(_lines(F.col(text_col)), lambda x, i: ~F.array_contains(F.col(ps), i))
    text = F.when(F.col(ps).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = []
    for c in df.columns:
        if c == text_col:
            out.append(text.alias(c))
        elif c == chars_col:
            out.append(F.when(F.col(ps).isNull(), F.col(c)).otherwise(F.char_length(text)).cast(df.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    if count_col:
        out.append(F.coalesce(F.size(ps), F.lit(0)).cast("bigint").alias(count_col))
    return joined.select(*out)


ORACLE = f"""
WITH lines AS (
  SELECT d.doc_id, d.source, u.i AS p, trim(u.line) AS line
  FROM documents d, (SELECT doc_id AS k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) u
  WHERE u.k = d.doc_id AND trim(u.line) <> ''
), spread AS (
  SELECT line, min((doc_id, p)) AS first FROM lines GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), gone AS (
  SELECT l.doc_id, list(l.p) AS ps FROM lines l JOIN spread s ON l.line = s.line WHERE (l.doc_id, l.p) <> s.first GROUP BY l.doc_id
), made AS (
  SELECT d.*, g.ps, CASE WHEN g.ps IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.ps, i)), chr(10)) END AS new_text
  FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id
)
SELECT doc_id, new_text AS text, lang, source, CASE WHEN ps IS NULL THEN n_chars ELSE length(new_text) END AS n_chars, coalesce(len(ps), 0) AS n_removed
FROM made
"""
