"""Running sums that do not pass a group through one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_before(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of the group that come before.

    bucket must not fall while `order` rises; rows are summed within buckets, and the few bucket totals over buckets."""
    rows = df.withColumn("_b", bucket)
    totals = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_t"))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(over), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_here", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(totals, [*keys, "_b"]).withColumn(name, F.col("_before") + F.col("_here")).drop("_b", "_before", "_here")
