"""Places in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warder.functions.state import written


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Add the gapless place, from 1, of each row in the order.

    Rows are dealt out by ranges, numbered within each, and moved up by the counts of the
    ranges before; the only table that one task orders has a row for each range. The order
    should tell rows apart, as equal ones share a range.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("range_no").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range_no", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    return ranged.withColumn("inner", inner).join(F.broadcast(starts), "range_no").withColumn(name, F.col("start") + F.col("inner")).drop("range_no", "inner", "start")
