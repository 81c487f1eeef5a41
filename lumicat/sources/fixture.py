"""The catalog read out of the star-schema parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumicat.catalog import Catalog


_SCHEMAS: dict[str, T.StructType] = {}  # read once per file, not once per query


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.dir}/{name}.parquet"
        if path in _SCHEMAS:
            return self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        df = self.spark.read.parquet(path)
        _SCHEMAS[path] = df.schema
        return df

    @cached_property
    def catalog(self) -> Catalog:
        return catalog_from_fixture(self.spark, self.dir)


def catalog_from_fixture(spark: SparkSession, sf_dir: str) -> Catalog:
    t = Tables(spark, sf_dir)
    c = F.col
    brand_id = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("bigint")
    nation_aliases = lambda: t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select(
        c("n_nationkey").cast("bigint").alias("tag_id"),
        F.explode(
            F.array(c("r_name"), F.concat(F.lit("land "), c("n_nationkey").cast("string")))
        ).alias("translation"),
    )
    images = lambda: t.orders.select(
        c("o_orderkey").alias("id"),
        F.concat(F.lit("order-"), c("o_orderkey").cast("string")).alias("name"),
        (100 + c("o_orderkey") % 50).cast("int").alias("width"),
        (80 + c("o_orderkey") % 40).cast("int").alias("height"),
        F.when(c("o_orderstatus") == "P", "pending")
        .when(c("o_orderstatus") == "O", "processing")
        .otherwise("completed")
        .alias("status"),
        (c("o_orderkey") % 8).cast("int").alias("attempt"),
        c("o_orderdate").cast("timestamp").alias("claimed_at"),
    )
    return Catalog(
        posts=lambda: t.part.select(c("p_partkey").alias("id"), c("p_name").alias("title")),
        images=images,
        videos=lambda: t.customer.select(
            c("c_custkey").alias("id"),
            c("c_name").alias("name"),
            F.lit(16).alias("width"),
            F.lit(9).alias("height"),
            (1 + c("c_custkey") % 7200).cast("int").alias("duration"),
        ),
        authors=lambda: t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name")),
        tags=lambda: t.part.select(brand_id.alias("id"), c("p_brand").alias("name")).distinct(),
        wd_tags=lambda: t.nation.select(
            c("n_nationkey").cast("bigint").alias("id"), c("n_name").alias("name")
        ),
        wd_tag_translations=nation_aliases,
        post_images=lambda: t.lineitem.select(
            c("l_partkey").alias("post_id"), c("l_orderkey").alias("image_id")
        ).distinct(),
        post_videos=lambda: t.lineitem.where(c("l_returnflag") == "R")
        .join(t.orders, c("l_orderkey") == c("o_orderkey"))
        .select(c("l_partkey").alias("post_id"), c("o_custkey").alias("video_id"))
        .distinct(),
        author_posts=lambda: t.lineitem.select(
            c("l_suppkey").alias("author_id"), c("l_partkey").alias("post_id")
        ).distinct(),
        tag_posts=lambda: t.part.select(brand_id.alias("tag_id"), c("p_partkey").alias("post_id")),
        wd_tag_images=lambda: t.lineitem.join(t.supplier, c("l_suppkey") == c("s_suppkey"))
        .groupBy(
            c("s_nationkey").cast("bigint").alias("wd_tag_id"), c("l_orderkey").alias("image_id")
        )
        .agg(F.max("l_discount").cast("float").alias("score")),
    )
