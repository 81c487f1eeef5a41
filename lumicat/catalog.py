"""The catalog: fixed schemas and a bundle of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


DDL = {
    "posts": "id bigint, title string",
    "images": (
        "id bigint, name string, width int, height int, status string, attempt int, "
        "claimed_at timestamp, dinov3 array<float>, clip array<float>"
    ),
    "videos": "id bigint, name string, width int, height int, duration int",
    "authors": "id bigint, name string",
    "tags": "id bigint, name string",
    "wd_tags": "id bigint, name string",
    "wd_tag_translations": "tag_id bigint, translation string",
    "post_images": "post_id bigint, image_id bigint",
    "post_videos": "post_id bigint, video_id bigint",
    "author_posts": "author_id bigint, post_id bigint",
    "tag_posts": "tag_id bigint, post_id bigint",
    "wd_tag_images": "wd_tag_id bigint, image_id bigint, score float",
}

META_DDL = (
    "ord bigint, title string, authors array<string>, tags array<string>, "
    "images array<struct<name:string,width:int,height:int>>"
)

STATUSES = ("pending", "processing", "completed")
MEDIA_KINDS = ("post", "image", "video")


class Catalog:
    """The tables by name. A table may be given as a function, which is called
    on first use, so that a query only plans what it reads."""

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(DDL)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._tables = dict(tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        if not isinstance(self._tables[name], DataFrame):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    def with_(self, **tables: DataFrame) -> "Catalog":
        return Catalog(**{**self._tables, **tables})

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self._tables}


def empty_catalog(spark: SparkSession) -> Catalog:
    return Catalog(**{name: spark.createDataFrame([], ddl) for name, ddl in DDL.items()})
