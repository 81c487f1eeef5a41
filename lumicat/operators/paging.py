"""Pages of ordered rows.

A page is the only place where rows are gathered: it holds ``limit`` rows. Joins
against a page broadcast the page when its limit proves it small and leave the
choice to the planner beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def check_page(limit: int, offset: int) -> None:
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """K2: rows ``offset .. offset+limit`` of the ordered input (offset first)."""
    check_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def first_rows(df: DataFrame, major: str, minor: str, n: int, ranges: int = 1_024, small: int = BROADCAST_ROWS) -> DataFrame:
    """The first ``n`` rows by (major, minor), both whole numbers, without a sort of them: counts per range of ``minor`` find the row that
    is cut at, narrower ranges following until one holds few rows; then a filter takes the rest. For large ``n``; rows that
    tie at the cut are taken in any order."""
    check_page(n, 0)
    left, done = n, None
    groups = df.groupBy(major).agg(F.count(F.lit(1)).alias("n"), F.min(minor).alias("low"), F.max(minor).alias("high")).orderBy(major)
    for g in groups.toLocalIterator():  # one row per value of ``major``
        if g["n"] <= left:
            left -= g["n"]
            done = g[major]
            continue
        taken = df.where(F.col(major) <= done) if done is not None else df.limit(0)
        here, low, high, count = df.where(F.col(major) == g[major]), g["low"], g["high"], g["n"]
        first = low
        while count > small and low < high and left:
            width = (high - low) // ranges + 1
            place = F.floor((F.col(minor) - F.lit(low)) / F.lit(width))
            counts = sorted(here.where(F.col(minor).between(low, high)).groupBy(place.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect())
            for at, count in counts:  # at most ``ranges`` rows
                if count > left:
                    low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                    break
                left -= count
        edge = here.where(F.col(minor).between(low, high)).orderBy(minor).limit(left)
        return taken.unionByName(here.where((F.col(minor) >= first) & (F.col(minor) < low))).unionByName(edge)
    return df


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of an already limited page from 1."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """A page as the small side of a join: broadcast only below a proven size."""
    return F.broadcast(rows) if limit <= BROADCAST_ROWS else rows


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                name: str = "rank") -> DataFrame:
    """The first ``n`` rows per key. ``row_number() <= n`` lets Spark cut each key
    to ``n`` rows before the shuffle (WindowGroupLimit), so a hot key costs
    ``n`` rows per input partition."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def first_per_group(df: DataFrame, keys: list[str], order: Column, values: list[str],
                    latest: bool = False) -> DataFrame:
    """A3: one row per key, the one with the smallest (largest) order value."""
    pick = F.max_by if latest else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*values), order).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{v}").alias(v) for v in values])


def lookup_in_order(df: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """Rows of ``df`` for a list of (pos, id); the list keeps its order,
    missing ids drop out."""
    return df.join(bounded(ids, limit), "id").orderBy("pos")


def has_more(rows: DataFrame, limit: int, random: bool = False) -> DataFrame:
    """K7: whether another page may follow, from the rows of this one."""
    count = F.count(F.lit(1))
    more = (count > 0) if random else (count >= limit)
    return rows.agg(count.alias("n_rows"), more.alias("has_more"))
