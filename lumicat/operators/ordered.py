"""Running totals and next values that spread over one busy key.

A plain window puts all rows of a key into one task. Here rows are cut into
time buckets first: the window runs inside a bucket, and a second window over
one row per bucket carries the values across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col
BUCKET_SECONDS = 3600


def running_total(df: DataFrame, keys: list[str], at: str, value: str, tie: str,
                  name: str = "total", bucket: int = BUCKET_SECONDS) -> DataFrame:
    """Running sum of ``value`` per key in the order of (``at``, ``tie``);
    ``at`` is in epoch seconds. Sums are exact (decimal) to avoid overflow."""
    amount = c(value).cast("decimal(38,0)")
    rows = df.withColumn("__b", F.floor(c(at) / bucket))
    sums = rows.groupBy(*keys, "__b").agg(F.sum(amount).alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__c"))
    inside = Window.partitionBy(*keys, "__b").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__l", F.sum(amount).over(inside))
    total = (c("__l") + c("__c")).cast("decimal(38,0)").alias(name)
    return local.join(carried, [*keys, "__b"]).select(*df.columns, total)


def next_value(df: DataFrame, keys: list[str], at: str, tie: str, value: str,
               name: str = "next", bucket: int = BUCKET_SECONDS) -> DataFrame:
    """The ``value`` of the following row per key in the order of (``at``, ``tie``),
    NULL for the last row."""
    rows = df.withColumn("__b", F.floor(c(at) / bucket))
    firsts = rows.groupBy(*keys, "__b").agg(
        F.min_by(F.struct(c(value).alias("v")), F.struct(at, tie)).alias("__f")
    )
    order = Window.partitionBy(*keys).orderBy("__b")
    following = firsts.select(*keys, "__b", F.lead("__f").over(order).alias("__n"))
    inside = Window.partitionBy(*keys, "__b").orderBy(at, tie)
    local = rows.withColumn("__l", F.lead(F.struct(c(value).alias("v"))).over(inside))
    pick = F.when(c("__l").isNotNull(), c("__l.v")).otherwise(c("__n.v")).alias(name)
    return local.join(following, [*keys, "__b"]).select(*df.columns, pick)
