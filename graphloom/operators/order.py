"""Global order without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import rows_in, written


def numbered(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """``df`` with rows numbered from 0 in the given order.

    Rows are range-partitioned and sorted within partitions; only the
    partitions' sizes are summed in one place. The order should be total,
    or numbers of tied rows may differ between runs.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = rows.join(F.broadcast(shift), "_part").withColumn(name, F.col("_shift") + F.col("_row")).drop("_part", "_row", "_shift")
    out._graphloom_rows = rows_in(rows)
    return out
