"""Similarity of descriptions: token weights, weighted Jaccard, and the sequence ratio that has no built-in."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.scalars import description_tokens


def token_weights(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, df, weight) of the descriptions in each pool: weight = ln(1 + lines / lines with the token)."""
    tokens = lines.select(*keys, "line_id", F.explode(description_tokens(F.col("description"))).alias("token"))
    sizes = lines.groupBy(*keys).agg(F.count("*").alias("n"))
    df = tokens.groupBy(*keys, "token").agg(F.count("*").alias("df"))
    return df.join(sizes, keys).select(*keys, "token", "df", F.log(1 + F.col("n") / F.col("df")).alias("weight"))


def weighted_jaccard(pairs: DataFrame, left: DataFrame, right: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` (keys, a, b) with the weighted Jaccard similarity of their descriptions, 0 where either has no token.

    Token rows join on the pair, each with its weight once, so a pair costs its tokens, not the square of the pool.
    """
    tokens = lambda df, side: df.select(F.col("line_id").alias("line"), F.lit(side).alias("side"), F.explode(description_tokens(F.col("description"))).alias("token"))
    sides = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("line")) for s in "ab"]))
    each = pairs.select(*keys, "a", "b", sides).join(tokens(left, "a").unionByName(tokens(right, "b")), ["line", "side"]).join(weights.select(*keys, "token", "weight"), [*keys, "token"])
    one = each.groupBy(*keys, "a", "b", "token").agg(F.max("weight").alias("weight"), F.max(F.col("side") == "a").alias("in_a"), F.max(F.col("side") == "b").alias("in_b"))
    mass = lambda name, holds: F.coalesce(F.sum(F.when(holds, F.col("weight"))), F.lit(0.0)).alias(name)
    sums = one.groupBy(*keys, "a", "b").agg(mass("mass_a", F.col("in_a")), mass("mass_b", F.col("in_b")), mass("shared", F.col("in_a") & F.col("in_b")))
    joined = pairs.join(sums, [*keys, "a", "b"], "left").fillna(0.0, ["mass_a", "mass_b", "shared"])
    union = F.col("mass_a") + F.col("mass_b") - F.col("shared")
    return joined.select(*keys, "a", "b", F.round(F.when((F.col("mass_a") > 0) & (F.col("mass_b") > 0), F.col("shared") / union).otherwise(0.0), 6).alias("similarity"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of characters in matching blocks of two texts (Ratcliff and Obershelp)."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], index=a.index, dtype="float64")


def description_similarity(tokens_a: Column, tokens_b: Column, jaccard: Column) -> Column:
    """Four fifths weighted Jaccard, one fifth sequence ratio of the sorted tokens; 0 where either is empty."""
    ratio = sequence_ratio(F.array_join(tokens_a, " "), F.array_join(tokens_b, " "))
    return F.when((F.size(tokens_a) > 0) & (F.size(tokens_b) > 0), 0.8 * jaccard + 0.2 * ratio).otherwise(0.0)
