"""Running totals over data of any size.

A window without enough partition keys sends a whole group to one task. Here the rows are sorted
by range instead, so that one group may spread over many partitions; each partition sums up its own
rows, and the totals of the partitions before it are added as offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.staging import stage


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], amount: str, total: str = "running", whole: str = "whole") -> DataFrame:
    """Add ``total``, the sum of ``amount`` over the group up to and with the row, and ``whole``, the sum over the group.

    ``group`` plus ``order`` must be unique per row for a defined result. Null amounts count as 0. Null group
    keys form a group of their own. An empty table gives an empty table.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys])
    # Written out, because the split into ranges must be the same for the sums and for the offsets.
    ranged = stage(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    local = W.partitionBy("_part", *group)
    amount_0 = F.coalesce(F.col(amount), F.lit(0))
    summed = ranged.withColumn("_run", F.sum(amount_0).over(local.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    parts = ranged.groupBy("_part", *group).agg(F.sum(amount_0).alias("_sum"))
    over = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    parts = parts.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_sum").over(over.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_sum").over(over).alias(whole),
    )
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        summed.join(parts, same)
        .withColumn(total, F.col("_before") + F.col("_run"))
        .drop("_part", "_run", "_p", "_before", *[f"_g{i}" for i in range(len(group))])
    )
