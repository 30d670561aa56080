"""Percentiles of very large numeric columns, by cumulative frequencies.

The rows are reduced to counts of every value within its group; these counts are sorted by range, running sums are
formed in windows within each range and raised by the offsets of the ranges before, and each percentile is the first
value whose cumulative count reaches the target rank. The result is exact (rank error 0). Counts of separate
days or partitions are combined by adding them, so ``combine`` over any run of days gives what one pass over
their rows would have given.

Scale: the reduction is a partial aggregation, so a group with a third of all rows shuffles its distinct values
only; and as ranges cut through groups, no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.prefix_sum import running_totals

PERCENTILES = {"p50": 5000, "p90": 9000, "p95": 9500, "p99": 9900}


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, n): how often each value that is neither null nor NaN comes. A null group is a group."""
    rows = df.select(*groups, F.col(f"`{value}`").alias("value")).filter("value IS NOT NULL")
    if dict(rows.dtypes)["value"] in ("double", "float"):
        rows = rows.filter(~F.isnan("value")).withColumn("value", F.col("value") + F.lit(0.0))  # -0.0 becomes 0.0
    return rows.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))


def combine(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts of separate days, partitions or runs as one: ``groups`` are what is kept apart."""
    return counts.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: Sequence[str], wanted: Mapping[str, int] = PERCENTILES) -> DataFrame:
    """(groups, n, and a column for each percentile): the value at position ceil(p * n) in ascending order.

    ``wanted`` maps a column's name to the percentile in 1/10000, from 1 to 10000; positions are computed in whole
    numbers. Ties and repeated values need no rule, as equal values share one count. Groups without rows don't appear.
    """
    summed = running_totals(counts.select(*groups, "value", "n"), groups, ["value"], "n")
    rank = lambda p: F.expr(f"(whole * {int(p)}L + 9999L) div 10000L")
    before = F.col("running") - F.col("n")
    hits = {c: (before < rank(p)) & (rank(p) <= F.col("running")) for c, p in wanted.items()}
    any_hit = F.lit(False)
    for hit in hits.values():
        any_hit = any_hit | hit
    return summed.filter(any_hit).groupBy(*groups).agg(
        F.max("whole").alias("n"), *[F.max(F.when(hit, F.col("value"))).alias(c) for c, hit in hits.items()]
    )
