"""Running sums in a total order over any number of rows: no task sorts more than a range of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweave.shared import cut


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with a column per sum: that of all rows before this one in the order (0 for the first).

    Rows are split into ranges of the order, written once (so that a range stays what it is when an executor is lost), summed per range,
    and summed within each range; the sums of whole ranges are one small row per task. Rows equal in the order lie in one range: aggregate
    them first where there may be many.
    """
    named = {f"_{k}": v for k, v in sums.items()}
    placed = cut(df.withColumns(named).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    whole = placed.groupBy("_range").agg(*[F.sum(c).alias(c) for c in named])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = whole.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o{c}") for c in named])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(offsets, "_range")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_o_{k}") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0))).alias(k) for k in sums])
