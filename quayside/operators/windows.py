"""Ordered operators: relative position, pro-rata shares, numbering, totals at several levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def with_position(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with position: 0 for the first row of its group, 1 for the last, 0 for an only one."""
    return df.withColumn("position", F.percent_rank().over(W.partitionBy(*keys).orderBy(*order)))


def renumber(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``df`` with the running number of each row in its group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def apportion(df: DataFrame, keys: list[str], weight: Column, charges: dict[str, Column]) -> DataFrame:
    """``df`` with each group's charge spread over its rows in proportion to ``weight``; 0 unless the weights sum to more.

    The group's sum is taken before the join, combined before the shuffle, so a hot group does not pass through one
    sort; each row is rounded by itself, halves up. Counted in whole hundredths of the charge and ten-thousandths of
    the weight, as decimal division would round twice.
    """
    w = F.round(weight.cast("decimal(18,4)") * 10_000, 0).cast("decimal(20,0)")
    sums = df.groupBy(*keys).agg(F.sum(weight.cast("decimal(18,4)")).alias("whole_"))
    joined = df.join(sums, keys).withColumn("whole_", F.round(F.col("whole_") * 10_000, 0).cast("decimal(32,0)"))

    def share(charge: Column) -> Column:
        c = F.round(charge.cast("decimal(18,2)") * 100, 0).cast("decimal(18,0)")
        twice = (c * w * 2).cast("decimal(38,0)") + F.col("whole_")
        # floor for either sign: the remainder is taken off before the exact division
        exact = (twice - F.pmod(twice, F.col("whole_") * 2)) / (F.col("whole_") * 2)
        return F.when(F.col("whole_") > 0, (exact / 100).cast("decimal(18,2)")).otherwise(0).cast("decimal(18,2)")

    return joined.withColumns({name: share(c) for name, c in charges.items()}).drop("whole_")


def totals(df: DataFrame, levels: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums and row counts at every level of ``levels`` (rollup); an upper level has null in the lower columns."""
    return df.rollup(*levels).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(n) for n, c in sums.items()])


def forward_fill(df: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """Each null of ``columns`` as the last value before it in its group."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
