"""The metadata job: listing or metadata records to a new catalog snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.operators.merge import merge_images, merge_links, merge_names
from lumicat.sources.snapshots import read_catalog, stage, write_catalog

c = F.col


def ingest_metas(spark: SparkSession, root: str, metas: DataFrame) -> None:
    """M1-M3 against stored snapshots. Names get their ids in a first write; the
    links join the stored tables, so nothing is merged twice."""
    metas = stage(metas)
    cat = read_catalog(spark, root)
    exploded = lambda field: metas.select(F.explode(field).alias("name"))
    names = cat.with_(
        posts=merge_names(cat.posts, metas.select("title"), "title"),
        images=merge_images(cat.images, metas),
        authors=merge_names(cat.authors, exploded("authors")),
        tags=merge_names(cat.tags, exploded("tags")),
    )
    write_catalog(names, root, spark, ["posts", "images", "authors", "tags"])
    cat = read_catalog(spark, root)
    titles = cat.posts.select("id", c("title").alias("name"))
    links = cat.with_(
        post_images=merge_links(cat.post_images, metas, titles, cat.images, "images"),
        author_posts=merge_links(cat.author_posts, metas, cat.authors, titles, "authors"),
        tag_posts=merge_links(cat.tag_posts, metas, cat.tags, titles, "tags"),
    )
    write_catalog(links, root, spark, ["post_images", "author_posts", "tag_posts"])
