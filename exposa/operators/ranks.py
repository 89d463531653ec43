"""Ranks within groups that may be larger than a task: counts by range, then offsets.

A window over a group sends all of it to one task. Here the rows are dealt out in ranges of (group, order), so a
large group is many ranges; rows are numbered within their range, and a small table with a row for each group and
range gives what comes before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposa.session import materialize


def ranked(df: DataFrame, group: str, order: list[str], out: str = "rank") -> DataFrame:
    """``out``: the row's rank in its group by ``order``, from 1. Rows alike in all of ``order`` are ranked in any order."""
    dealt = df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt)  # so a row's range is the same to both sides of the join
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    return (dealt.withColumn("_within", within).join(offsets, [group, "_range"])
            .withColumn(out, (F.col("_before") + F.col("_within")).cast("bigint")).drop("_range", "_within", "_before"))
