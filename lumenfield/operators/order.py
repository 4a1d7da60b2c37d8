"""Places in a total order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def numbered(df: DataFrame, *order: Column | str, place: str = "ord", weight: str | None = None, before: str = "before") -> DataFrame:
    """``df`` with its place from 0 in the order, and with ``weight`` the sum of the weights before each row.

    Rows are range-partitioned and sorted in their partition; what comes before a partition is summed over one
    small row per partition. Ties have any order unless ``order`` breaks them.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rid", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_part", F.shiftright("_rid", 33)).withColumn("_in", F.col("_rid").bitwiseAND((1 << 33) - 1)).drop("_rid")
    dealt = written(dealt, "numbered", plain=True)
    w = F.lit(0) if weight is None else F.col(weight)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_s"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_b"))
    out = dealt.join(starts, "_part").withColumn(place, F.col("_s") + F.col("_in"))
    if weight is not None:
        inside = Window.partitionBy("_part").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(before, F.col("_b") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return out.drop("_part", "_in", "_s", "_b")
