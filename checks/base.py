"""Registry of queries with their oracle SQL, and the catalog as CTEs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.session import tune
from lumicat.sources.fixture import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CTES = {
    "posts": "SELECT p_partkey AS id, p_name AS title FROM part",
    "images": """SELECT o_orderkey AS id, 'order-' || o_orderkey AS name,
        (100 + o_orderkey % 50)::INT AS width, (80 + o_orderkey % 40)::INT AS height,
        CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'processing' ELSE 'completed' END AS status,
        (o_orderkey % 8)::INT AS attempt, o_orderdate AS claimed_at FROM orders""",
    "videos": """SELECT c_custkey AS id, c_name AS name, 16 AS width, 9 AS height,
        (1 + c_custkey % 7200)::INT AS duration FROM customer""",
    "authors": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "tags": "SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS id, p_brand AS name FROM part",
    "wd_tags": "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation",
    "wd_tag_translations": """SELECT n_nationkey::BIGINT AS tag_id, r_name AS translation FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT n_nationkey::BIGINT, 'land ' || n_nationkey FROM nation""",
    "post_images": "SELECT DISTINCT l_partkey AS post_id, l_orderkey AS image_id FROM lineitem",
    "post_videos": """SELECT DISTINCT l_partkey AS post_id, o_custkey AS video_id FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "author_posts": "SELECT DISTINCT l_suppkey AS author_id, l_partkey AS post_id FROM lineitem",
    "tag_posts": "SELECT regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS tag_id, p_partkey AS post_id FROM part",
    "wd_tag_images": """SELECT s_nationkey::BIGINT AS wd_tag_id, l_orderkey AS image_id, max(l_discount)::FLOAT AS score
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
}


def with_cte(names: str, body: str, **extra: str) -> str:
    """``WITH`` the named catalog tables (and extra ones) in front of a query."""
    parts = [(n, CTES[n]) for n in names.split()] + list(extra.items())
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in parts) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its oracle SQL."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Lists as text, so that every check compares plain values."""
    for column in columns:
        df = df.withColumn(column, F.array_join(column, "|"))
    return df
