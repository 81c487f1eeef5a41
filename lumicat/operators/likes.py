"""Favourites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.catalog import Catalog
from lumicat.functions.text import parse_items
from lumicat.operators.paging import top_per_key
from lumicat.operators.search import images_by_ids, post_previews

c = F.col
KEY = ["address", "kind", "target_id"]


def apply_like_log(likes: DataFrame, log: DataFrame) -> DataFrame:
    """Favourites after an ordered log (address, kind, target_id, action,
    created_at, seq). Adding twice keeps the first time, removing forgets it.

    Per key only the last removal and the adds after it matter. Both sides are
    aggregates with a partial step, so a hot key does not gather its log.
    """
    order = F.struct("created_at", "seq")
    removed = log.where(c("action") == "remove").groupBy(*KEY).agg(F.max(order).alias("gone"))
    adds = log.where(c("action") == "add").join(removed, KEY, "left")
    alive = adds.where(c("gone").isNull() | (order > c("gone")))
    added = alive.groupBy(*KEY).agg(F.min_by("created_at", order).alias("created_at"))
    kept = likes.join(removed, KEY, "left_anti")
    fresh = added.join(kept, KEY, "left_anti")
    return kept.select(*KEY, "created_at").unionByName(fresh.select(*KEY, "created_at"))


def liked(likes: DataFrame, probe: DataFrame) -> DataFrame:
    """Whether each probed (address, kind, target_id) is a favourite."""
    known = likes.select(*KEY, F.lit(True).alias("hit"))
    return probe.join(known, KEY, "left").withColumn("liked", c("hit").isNotNull()).drop("hit")


def liked_batch(likes: DataFrame, requests: DataFrame) -> DataFrame:
    """The favourites among the ``kind:id`` lists of (address, items).
    A list beyond the caps is refused and answers with one ``error`` row."""
    parsed = requests.select("address", parse_items(c("items"), ("post", "image", "video")).alias("p"))
    refused = parsed.where(c("p").isNull()).select(
        "address", F.lit(None).cast("string").alias("item"), F.lit("too many items (max 100)").alias("error")
    )
    wanted = parsed.select("address", F.inline("p")).select("address", "kind", c("id").alias("target_id"))
    found = wanted.join(likes, KEY, "left_semi").select(
        "address",
        F.concat_ws(":", "kind", c("target_id").cast("string")).alias("item"),
        F.lit(None).cast("string").alias("error"),
    )
    return found.distinct().unionByName(refused)


def likes_page(likes: DataFrame, limit: int | None = None, kind: str | None = None,
               cursor: tuple[int, str, int] | int | None = None, address: str | None = None) -> DataFrame:
    """K8: the newest favourites of each address behind a cursor, in the order (created_at descending, kind, target_id).

    A full page carries its last row as the next cursor (``next_cursor``, ``next_kind``, ``next_target_id``); a cursor of all three
    goes on exactly behind it. A cursor that is a time alone goes on with older rows.
    """
    size = max(1, min(50 if limit is None else limit, 100))
    rows = likes
    if address is not None:
        rows = rows.where(c("address") == address)
    if kind is not None:
        rows = rows.where(c("kind") == kind)
    if isinstance(cursor, tuple):
        at, last_kind, last_id = cursor
        behind = (c("kind") > last_kind) | ((c("kind") == last_kind) & (c("target_id") > last_id))
        rows = rows.where((c("created_at") < at) | ((c("created_at") == at) & behind))
    elif cursor is not None:
        rows = rows.where(c("created_at") < cursor)
    pages = top_per_key(rows, ["address"], [c("created_at").desc(), c("kind"), c("target_id")], size)
    last = F.max_by(F.struct("created_at", "kind", "target_id"), "rank")
    ends = pages.groupBy("address").agg(F.when(F.count(F.lit(1)) == size, last).alias("last"))
    ends = ends.select(
        "address", c("last.created_at").alias("next_cursor"), c("last.kind").alias("next_kind"), c("last.target_id").alias("next_target_id"))
    return pages.join(ends, "address").withColumn("rank", c("rank").cast("bigint"))


def like_previews(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Previews for the ``kind:id`` lists of (request_id, items), in list
    order and of any length; unknown targets drop out, blank titles and zero counts are NULL."""
    items = parse_items(c("items"), ("post", "image"), "all")
    wanted = requests.select("request_id", F.posexplode(items).alias("pos", "item")).select(
        "request_id", "pos", "item.kind", "item.id"
    )
    null_text, null_count = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    image_ids = wanted.where(c("kind") == "image").select("id").distinct()
    images = images_by_ids(cat, image_ids).select(
        F.lit("image").alias("kind"), "id", c("id").alias("image_id"), "name", "width", "height",
        null_text.alias("title"), null_count.alias("image_count"), null_count.alias("video_count"),
    )
    post_ids = wanted.where(c("kind") == "post").select("id").distinct()
    zero = F.lit(0)
    posts = post_previews(cat, post_ids).select(
        F.lit("post").alias("kind"), c("post_id").alias("id"), "image_id", "name",
        F.coalesce("width", zero).alias("width"), F.coalesce("height", zero).alias("height"),
        F.when(F.trim("title") != "", c("title")).alias("title"),
        F.nullif(c("image_count"), zero).alias("image_count"),
        F.nullif(c("video_count"), zero).alias("video_count"),
    )
    return wanted.join(images.unionByName(posts), ["kind", "id"]).orderBy("request_id", "pos")
