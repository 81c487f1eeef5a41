"""Histograms, occupancy and dwell times of a pipeline's event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.operators.ordered import next_value, running_total

c = F.col
# fixed values: phases in order and histogram bounds
PHASES = ("claim", "download", "decode_queue", "decode", "infer_queue", "infer", "record_queue", "write")
PHASE_BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0, 300.0)
WRITE_BOUNDS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0)


def bucket_of(value: Column, bounds: tuple[float, ...]) -> Column:
    """Index of the histogram bucket: how many bounds lie below the value."""
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    return F.size(F.filter(edges, lambda b: b < value.cast("double")))


def histogram(df: DataFrame, col: str, bounds: tuple[float, ...], keys: list[str] | None = None) -> DataFrame:
    """Rows per bucket; the upper bound of the last bucket is NULL."""
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    counted = df.where(c(col).isNotNull()).groupBy(
        *(keys or []), bucket_of(c(col), bounds).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(c(col).cast("double")).alias("total"))
    return counted.withColumn("upper", F.get(edges, c("bucket")))


def phase_durations(events: DataFrame) -> DataFrame:
    """Seconds each item stays in a phase, from (item, phase, at, seq); the last
    phase of an item is still open and has no duration."""
    moved = next_value(events, ["item"], "at", "seq", "at", "left_at")
    return moved.withColumn("seconds", c("left_at") - c("at"))


def phase_occupancy(events: DataFrame) -> DataFrame:
    """Items in each phase after every second in which that changed. Changes are
    added up per second and the running sum is carried over time buckets, so eight
    phases do not mean eight tasks."""
    stays = phase_durations(events)
    enters = stays.select("phase", "at", F.lit(1).alias("d"))
    leaves = stays.where(c("left_at").isNotNull()).select("phase", c("left_at").alias("at"), F.lit(-1).alias("d"))
    changes = enters.unionByName(leaves).groupBy("phase", "at").agg(F.sum("d").alias("change"))
    totals = running_total(changes, ["phase"], "at", "change", tie="at", name="items")
    return totals.withColumn("items", c("items").cast("bigint"))


def resource_rollup(samples: DataFrame, period: str = "10 seconds") -> DataFrame:
    """Average and peak of host samples (host, device, metric, ts, value) per
    period; a NULL device stands for the host itself."""
    return (
        samples.groupBy(F.window("ts", period).alias("w"), "host", "device", "metric")
        .agg(F.avg("value").alias("mean"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))
        .select(c("w.start").alias("start"), "host", "device", "metric", "mean", "peak", "n")
    )
