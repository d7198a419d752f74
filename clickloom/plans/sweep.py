"""Points and intervals met by one sweep over sorted ranges of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.plans.workspace import staged


def covered_points(points: DataFrame, intervals: DataFrame, family: str, point: str, low: str, high: str) -> DataFrame:
    """The points that lie in an interval of their family, borders included. All three are texts of equal length per
    family, so that text order is their order; points should be distinct.

    A point is covered if the greatest end among the intervals that start before it reaches it. Points and starts are
    dealt by ranges of one order. The greatest end so far is a running maximum inside a range, and one summary row per
    range carries it on, so one interval around everything costs no more than any other, and intervals need not be
    disjoint. Nothing is expanded: rows in are rows sorted.
    """
    columns = [family, "_at", "_kind", "_end"]
    starts = intervals.select(family, F.col(low).alias("_at"), F.lit(0).alias("_kind"), F.col(high).alias("_end")).distinct()
    marks = points.select(family, F.col(point).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_end"))
    dealt = starts.unionByName(marks).repartitionByRange(*columns)
    swept = staged(dealt.withColumn("_part", F.spark_partition_id()), "swept")
    reach = swept.groupBy(family, "_part").agg(F.max("_end").alias("_reach"))
    earlier = Window.partitionBy(family).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = reach.select(family, "_part", F.max("_reach").over(earlier).alias("_carried"))
    so_far = Window.partitionBy(family, "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = swept.withColumn("_inside", F.max("_end").over(so_far)).join(carried, [family, "_part"])
    found = met.where((F.col("_kind") == 1) & (F.greatest("_inside", "_carried") >= F.col("_at")))
    return found.select(family, F.col("_at").alias(point))
