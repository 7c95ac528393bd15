"""Checking quoted rows against the text of the pages they cite, and dropping rows that were read twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.functions.text import normalise_quote

#: Least length of a quote that is checked, and how far from the cited page it may be found.
LEAST_QUOTE, PAGE_WINDOW = 8, 2


def plain_text(text: Column) -> Column:
    """Lower case, single spaced: the simpler form of comparison."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")))


def folded_text(text: Column) -> Column:
    """Also look-alikes, odd spaces, quotation marks and dashes as one."""
    return normalise_quote(F.coalesce(text, F.lit("")))


def verify_citations(lines: DataFrame, pages: DataFrame, keys: list[str], normalise=folded_text) -> DataFrame:
    """``lines`` with verified, page and verify_note.

    A quote must occur on the cited page or within two pages of it, the nearest first and the earlier of two. Pages
    join by document (``keys``), so only a document's own pages are searched; a document's pages are a bounded group.
    Lines are told apart by line_id.
    """
    text = pages.select(*keys, F.col("page").alias("at"), normalise(F.col("text")).alias("body"))
    with_text = text.groupBy(*keys).agg(F.max(F.length("body") > 0).alias("has_text"))
    asked = lines.select("line_id", *keys, F.greatest(F.coalesce("page", F.lit(1)), F.lit(1)).alias("cited"), normalise(F.col("quote")).alias("q"))
    long = asked.where(F.length("q") >= LEAST_QUOTE)
    hits = long.join(text, keys).where(F.col("body").contains(F.col("q"))).withColumn("off", F.abs(F.col("at") - F.col("cited")))
    near = hits.groupBy("line_id").agg(
        F.min(F.when(F.col("off") <= PAGE_WINDOW, F.struct("off", "at")))["at"].alias("found"), F.min("at").alias("elsewhere")
    )
    checked = asked.join(with_text, keys, "left").join(near, "line_id", "left")
    far = F.concat(F.lit("only on page "), F.col("elsewhere").cast("string"), F.lit(", too far from page "), F.col("cited").cast("string"))
    note = (
        F.when(F.length("q") < LEAST_QUOTE, "too short to be checked")
        .when(~F.coalesce("has_text", F.lit(False)), "document without text, quote not checked")
        .when(F.col("found") == F.col("cited"), "on the cited page")
        .when(F.col("found").isNotNull(), F.concat(F.lit("page corrected from "), F.col("cited").cast("string"), F.lit(" to "), F.col("found").cast("string")))
        .when(F.col("elsewhere").isNotNull(), far)
        .otherwise(F.concat(F.lit("nowhere near page "), F.col("cited").cast("string")))
    )
    result = checked.select("line_id", F.col("found").isNotNull().alias("verified"), F.coalesce("found", "cited").cast("int").alias("page"), note.alias("verify_note"))
    return lines.drop("verified", "page", "verify_note").join(result, "line_id")


def keep_first_quotes(lines: DataFrame, keys: list[str], order: list[str], normalise=folded_text) -> DataFrame:
    """The first line of each quote in a document, and all lines without a quote, renumbered in order as ``n``."""
    keyed = lines.withColumn("quote_key", normalise(F.col("quote")))
    first = F.row_number().over(W.partitionBy(*keys, "quote_key").orderBy(*order))
    kept = keyed.withColumn("k", F.when(F.col("quote_key") == "", 1).otherwise(first)).where("k = 1").drop("k", "quote_key")
    return kept.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
