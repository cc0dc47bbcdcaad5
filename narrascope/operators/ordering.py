"""Row numbers and running sums over a total order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.session import Scratch


def running_sum(df: DataFrame, order: list, weight: Column, out: str) -> DataFrame:
    """With ``out``: the sum of ``weight`` over all rows up to this one in the order, which must have no ties.

    Rows are range-partitioned by the order and written once, so their parts stay as they are; sums run inside each
    part, and a table of one row for each part gives what stands before it.
    """
    work = Scratch(df.sparkSession, "ordering")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = work.save(df.withColumn("__w", weight).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "parts")
    inside = F.sum("__w").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = placed.groupBy("__part").agg(F.sum("__w").alias("__sum"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each part
    before = sums.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    joined = placed.withColumn("__own", inside).join(F.broadcast(before), "__part")
    return joined.withColumn(out, F.col("__own") + F.col("__before")).drop("__w", "__part", "__own", "__before")


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """With ``out``: the row's place from 1 in the order."""
    return running_sum(df, order, F.lit(1).cast("long"), out)


def numbered_within(df: DataFrame, by: list[str], order: list, out: str) -> DataFrame:
    """With ``out``: the row's place from 1 in its group; groups of any size are spread over tasks."""
    rows = numbered(df, [*by, *order], "__n")
    first = rows.groupBy(*by).agg(F.min("__n").alias("__first"))
    return rows.join(first, by).withColumn(out, F.col("__n") - F.col("__first") + 1).drop("__n", "__first")
