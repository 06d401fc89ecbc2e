"""Readers of datasets, corpora and recorded runs: schema first, and malformed input raises."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline import checks, schemas
from strandline.functions import text as tx
from strandline.sources import preflight


def read_rows(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """Rows of a parquet, JSON-lines or JSON-list path, by its ending; any other ending raises."""
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if path.endswith((".jsonl", ".ndjson", ".json")):
        many = path.endswith(".json") if multi_line is None else multi_line
        reader = spark.read.option("multiLine", many).option("mode", "FAILFAST")
        return (reader.schema(schema) if schema else reader).json(path)
    raise ValueError(f"rows of {path} can't be read: it is neither parquet nor JSON")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; a line that is no object of the schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def dataset_files(spark: SparkSession, path: str, pattern: str = "test*.jsonl") -> list[str]:
    """The files that a path stands for: itself, or a directory's files that fit the pattern, sorted; none is an error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        raise FileNotFoundError(path)
    if store.getFileStatus(where).isFile():
        return [path]
    found = store.globStatus(jvm.org.apache.hadoop.fs.Path(where, pattern))
    files = sorted(str(f.getPath()) for f in found or [])
    if not files:
        raise FileNotFoundError(f"{path} has no {pattern}")
    return files


def read_columns(spark: SparkSession, paths: list[str], wanted: Iterable[str]) -> DataFrame:
    """Parquet shards with those of the wanted columns that are there; the scan reads no others."""
    df = spark.read.parquet(*paths)
    return df.select([c for c in wanted if c in df.columns])


def read_recursive(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet files of a directory tree."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).parquet(path)


def indexed_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file that is one list, with ``index`` by place. Lines of a text have no stable number; places in a list have."""
    whole = spark.read.option("wholetext", True).text(path)
    rows = whole.select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>", {"mode": "FAILFAST"})).alias("index", "row"))
    return rows.select(F.col("index").cast("bigint").alias("index"), "row.*")


def snapshot(df: DataFrame, id_col: str, rows: int, what: str) -> DataFrame:
    """The table, if it has exactly so many rows with distinct ids: a partial download is refused before anything is selected."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("d")).first()
    if r.n != rows or r.d != rows:
        raise checks.CheckFailed(f"{what} has {r.n} rows with {r.d} ids, not {rows}")
    return df


def tasks(df: DataFrame, id_col: str, order: str, visible: list[str], reference: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(what an actor may see, references) of the first ``most`` rows in order: the two never travel in one table."""
    picked = df.filter(F.col(order) < most) if most is not None else df
    return picked.select(id_col, *visible), picked.select(id_col, *reference)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus with its paragraph ids as a column (pid, title, text); ids must run from 0."""
    df = read_rows(spark, path, schemas.PARAGRAPH)
    checks.require_contiguous(df, "corpus", "pid")
    return df


def corpus_texts(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select("pid", F.trim(F.concat_ws(" ", "title", "text")).alias("text"))


def joined_paragraphs(rows: DataFrame, title: str = "title", sentences: str = "sentences") -> DataFrame:
    """(title, text) of paragraphs given as sentence lists; blank ones go."""
    kept = F.filter(tx.all_trimmed(F.col(sentences)), lambda s: s != "")
    return rows.select(F.trim(title).alias("title"), F.array_join(kept, " ").alias("text")).filter("text <> ''")


def nested_paragraphs(rows: DataFrame, column: str = "paragraphs") -> DataFrame:
    """(title, paragraph_text) structs of an array column, one row each; nulls go."""
    return rows.select(F.explode(column).alias("p")).filter("p is not null").select(F.trim("p.title").alias("title"), F.trim("p.paragraph_text").alias("text")).filter("text <> ''")


def embeddings(spark: SparkSession, path: str, paragraphs: DataFrame | None = None) -> DataFrame:
    """(pid, embedding), if there is one vector per paragraph."""
    df = spark.read.schema(schemas.EMBEDDING).parquet(path)
    if paragraphs is not None:
        checks.require_same_keys(df, paragraphs, "embeddings", "pid")
    return df


def search_corpus(spark: SparkSession, corpus_path: str, vectors_path: str) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, vectors) of a search; a corpus and an index that do not agree row by row are refused."""
    paragraphs = corpus(spark, corpus_path)
    return paragraphs, embeddings(spark, vectors_path, paragraphs)


def checkpoint_rows(spark: SparkSession, path: str, schema: str, global_step: int) -> DataFrame:
    """Recorded rows of one checkpoint; partition pruning reads only its files where they are partitioned by it."""
    return read_jsonl(spark, path, schema).filter(F.col("global_step") == global_step)


def one_task(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """The row of an id; none or several is an error."""
    got = df.filter(F.col(id_col) == value)
    if got.limit(2).count() != 1:
        raise checks.CheckFailed(f"{value} is not one row")
    return got


def decode_tests(value: str | None) -> list:
    """Test cases as JSON, or as base64 of deflated JSON. Serialised objects are never loaded: they raise."""
    if value is None:
        return []
    try:
        return json.loads(value)
    except ValueError:
        pass
    try:
        return json.loads(zlib.decompress(base64.b64decode(value, validate=True)))
    except (ValueError, zlib.error):
        raise ValueError("test cases are neither JSON nor deflated JSON") from None


@F.pandas_udf(T.ArrayType(T.StringType()))
def decode_tests_column(values: pd.Series) -> pd.Series:
    """Test cases, each as JSON."""
    return values.map(lambda v: [json.dumps(c, ensure_ascii=False, sort_keys=True) for c in decode_tests(v)])


def image_files(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(path, content, width, height) of PNG files, the size read from the header."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content", png_side("content", 17).alias("width"), png_side("content", 21).alias("height"))


def png_side(content: str, at: int) -> Column:
    """A big-endian number in a PNG's header; null for what is no PNG."""
    ok = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.when(ok, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int"))


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files: what a manifest pins."""
    files = preflight.digests(spark.read.format("binaryFile").load(path))
    return files.select(F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("name"), "length", "sha256")


def tree_digest(stats: DataFrame) -> DataFrame:
    """One digest of a set of files, by name and content, in name order."""
    pair = F.concat_ws("\0", "name", "sha256")
    return stats.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "\n"), 256).alias("sha256"), F.count(F.lit(1)).alias("files"))


class EvidenceStore:
    """A sidecar of three tables: metadata (key, value), paragraphs and samples."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}")

    def metadata(self) -> dict[str, str]:
        """The few key/value pairs that describe the store."""
        return {r.key: r.value for r in checks.bounded_rows(self.table("metadata"), 10_000, "metadata")}

    def paragraph(self, pid: int) -> DataFrame:
        return self.table("paragraphs").filter(F.col("pid") == pid)

    def sample(self, split: str, row_index: int) -> DataFrame:
        return self.table("samples").filter((F.col("split") == split) & (F.col("row_index") == row_index))

    def samples(self, split: str, limit: int | None = None) -> DataFrame:
        rows = self.table("samples").filter(F.col("split") == split).orderBy("row_index")
        return rows.limit(limit) if limit is not None else rows

    def count(self, name: str) -> int:
        return self.table(name).count()
