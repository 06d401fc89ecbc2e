"""The corpus operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, decontamination, language, linededup, ngramjoin, packing, pii, quality, repeats, resampling, sharding, tiff, tokenoutput, tokens

SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op2_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"), count_col="n_removed")


def op3_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(SHARDS)
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), tree, sharding.grow(tree))


def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op6_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_round_trip(_table(spark, sf_dir, "documents"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), end_id=0, with_ids=False)


def op9_seekable_zstd_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenoutput.tokens_round_trip(_table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"), end_id=2)


def op10_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text of documents, where every tenth by the id's checksum repeats a few words from some word on."""
    ruled = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = (F.col("h") % 10 == 0) & (F.octet_length("text") > 0)
    worded = ruled.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("words"))
    cut = worded.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    planted = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), tail)
    return period.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_tandem_repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.run_digests(periodic_tails(_table(spark, sf_dir, "documents")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_deobfuscation": op1_pii_deobfuscation,
    "op2_line_site_spread": op2_line_site_spread,
    "op3_wu_manber_decontamination": op3_wu_manber_decontamination,
    "op4_hash_tree_sharding": op4_hash_tree_sharding,
    "op5_co_training": op5_co_training,
    "op6_prefix_tree_join": op6_prefix_tree_join,
    "op7_tiff_pages": op7_tiff_pages,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_seekable_zstd_tokens": op9_seekable_zstd_tokens,
    "op10_hyperdimensional_language": op10_hyperdimensional_language,
    "op11_tandem_repeat_runs": op11_tandem_repeat_runs,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_bpe_codec": op13_bpe_codec,
}

ORACLES: dict[str, str] = {"op2_line_site_spread": linededup.ORACLE}
