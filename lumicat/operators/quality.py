"""Q1-Q3: constraint checks that split or list, never drop silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def not_blank(name: str) -> Column:
    return F.trim(c(name)) != ""


def max_length(name: str, n: int) -> Column:
    return F.char_length(c(name)) <= n


def positive(name: str) -> Column:
    return c(name) > 0


def one_of(name: str, values: tuple[str, ...]) -> Column:
    return c(name).isin(*values)


def check_rows(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Q1: (good rows, rejects with the names of the rules they break). A rule
    that is NULL is broken: the checked columns are NOT NULL in the reference."""
    broken = F.array(*[
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ])
    marked = df.withColumn("failures", F.array_compact(broken))
    good = marked.where(F.size("failures") == 0).drop("failures")
    return good, marked.where(F.size("failures") > 0)


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q2: keys that occur more than once, with their count; NULL keys are exempt."""
    present = df
    for key in keys:
        present = present.where(c(key).isNotNull())
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(c("n") > 1)


def check_refs(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Q3: child rows whose key (child column to parent column) has no parent."""
    keys = parent.select(*[c(p).alias(k) for k, p in on.items()])
    return child.join(keys, list(on), "left_anti")


# rule sets of the catalog tables
def post_rules() -> dict[str, Column]:
    return {"title_blank": not_blank("title"), "title_long": max_length("title", 255)}


def image_rules() -> dict[str, Column]:
    return {
        "name_blank": not_blank("name"),
        "name_long": max_length("name", 255),
        "width": positive("width"),
        "height": positive("height"),
        "status": one_of("status", ("pending", "processing", "completed")),
    }


def video_rules() -> dict[str, Column]:
    return {
        "name_blank": not_blank("name"),
        "name_long": max_length("name", 255),
        "width": positive("width"),
        "height": positive("height"),
        "duration": positive("duration"),
    }


def name_rules() -> dict[str, Column]:
    return {"name_blank": not_blank("name"), "name_long": max_length("name", 100)}


def like_rules() -> dict[str, Column]:
    return {"kind": one_of("kind", ("post", "image", "video"))}
