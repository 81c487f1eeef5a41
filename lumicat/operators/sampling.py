"""Seeded samples that any page reaches directly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumicat.functions.hashing import mix64_numpy
from lumicat.operators.paging import check_page, lookup_in_order

c = F.col


@F.pandas_udf(T.LongType())
def _draw(i: pd.Series, seed: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    bits = [s.to_numpy("int64").view("uint64") for s in (i, seed, low, high)]
    span = bits[3] - bits[2] + np.uint64(1)
    return pd.Series((bits[2] + mix64_numpy(bits[1] ^ mix64_numpy(bits[0])) % span).view("int64"))


def id_bounds(df: DataFrame) -> DataFrame:
    """Smallest and largest id in one row, no row for an empty table."""
    return df.agg(F.min("id").alias("min_id"), F.max("id").alias("max_id")).where(
        c("min_id").isNotNull()
    )


def draw_ids(bounds: DataFrame, seed: int, limit: int, offset: int = 0) -> DataFrame:
    """R1 over a one-row bounds table: (pos, id) without repeats inside the page."""
    check_page(limit, offset)
    places = bounds.sparkSession.range(offset, offset + limit).withColumnRenamed("id", "i")
    drawn = places.join(F.broadcast(bounds)).select(
        "i", _draw("i", F.lit(seed).cast("bigint"), "min_id", "max_id").alias("id")
    )
    return drawn.groupBy("id").agg(F.min("i").alias("pos"))


def random_ids(spark: SparkSession, seed: int, low: int, high: int, limit: int,
               offset: int = 0) -> DataFrame:
    """Ids for draws ``offset .. offset+limit``; needs ``low <= high``."""
    bounds = spark.range(1).select(
        F.lit(low).cast("bigint").alias("min_id"), F.lit(high).cast("bigint").alias("max_id")
    )
    return draw_ids(bounds, seed, limit, offset)


def random_rows(df: DataFrame, seed: int, limit: int, offset: int = 0) -> DataFrame:
    """The rows behind a page of draws, in draw order; unused ids drop out."""
    return lookup_in_order(df, draw_ids(id_bounds(df), seed, limit, offset), limit)
