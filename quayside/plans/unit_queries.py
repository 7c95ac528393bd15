"""Queries of problem 2: quantities recorded in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.operators import units


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/line_items.parquet")
    listed = spark.read.parquet(f"{sf_dir}/ref_values.parquet").where("field = 'unit'")
    return units.convert_measures(lines, listed)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.found(_converted(spark, sf_dir))


def p2_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir)


QUERIES = {"p2_found": p2_found, "p2_converted": p2_converted}
SQL: dict[str, str] = {}
