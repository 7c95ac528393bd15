"""Queries of the problems for training-data pipelines, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import canonical, glyphs, matching, mixing, products, quality, tokenizer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.found(_table(spark, sf_dir, "line_items"), _table(spark, sf_dir, "ref_values"))


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values without an entry, with the number of rows that hold them."""
    cells = canonical.canonical_values(_table(spark, sf_dir, "line_items"), _table(spark, sf_dir, "ref_values"))
    return cells.where("ref_id = 0").groupBy("field", "value").agg(F.count("*").alias("n_rows"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.product_pairs(_table(spark, sf_dir, "line_items"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.product_groups(_table(spark, sf_dir, "line_items"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).select("line_id_a", "line_id_b")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with their marginal probabilities."""
    return matching.match_lines(_table(spark, sf_dir, "line_items"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.disguised(_table(spark, sf_dir, "line_items"), "line_id", "quote")


def p5_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.normalise_texts(_table(spark, sf_dir, "line_items"), "line_id", "quote")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_documents(_table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.round_trip(_table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_forms(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "form_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir).where("form IN ('list', 'table', 'junk')").select("doc_id", "form")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir)


QUERIES = {
    "p1_found": p1_found, "p1_unmatched": p1_unmatched, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_matches": p4_matches,
    "p5_found": p5_found, "p5_normalised": p5_normalised, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip,
    "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_statistics": p8_statistics,
}
SQL = {"p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
