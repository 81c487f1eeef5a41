"""Incremental merges, snapshot in, snapshot out.

Every merge is a pure DataFrame function: joins on unique keys, no updates in
place. Writers store the result as a new snapshot (see ``sources.snapshots``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicat.catalog import Catalog

c = F.col
ID_BUCKETS = 1024


def assign_ids(rows: DataFrame, key: str, start: DataFrame, buckets: int = ID_BUCKETS) -> DataFrame:
    """M9: consecutive ids after ``start`` (one row, column ``last_id``).

    Rows are spread over buckets by a hash of their unique key, numbered inside
    the bucket and shifted by the sizes of the buckets before. The id depends on
    the data alone, so a lost executor recomputes the same ids, and no single
    task sorts all names.
    """
    bucket = (F.conv(F.substring(F.md5(c(key)), 1, 8), 16, 10).cast("bigint") % buckets).alias("__b")
    spread = rows.select("*", bucket)
    sizes = spread.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")
    ).join(F.broadcast(start.select(F.coalesce("last_id", F.lit(0)).alias("__start"))))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    numbered = spread.withColumn("__place", place).join(F.broadcast(shifts), "__b")
    ident = (c("__start") + c("__shift") + c("__place")).cast("bigint").alias("id")
    return numbered.select(ident, *rows.columns)


def last_id(df: DataFrame) -> DataFrame:
    return df.agg(F.max("id").alias("last_id"))


def present(name: str) -> Column:
    """Blank names are skipped; names are stored untrimmed."""
    return F.trim(c(name)) != ""


def merge_names(target: DataFrame, incoming: DataFrame, key: str = "name") -> DataFrame:
    """M1, M5: insert new different names, ignore known ones."""
    names = incoming.select(key).where(present(key)).distinct()
    fresh = names.join(target.select(key), key, "left_anti")
    return target.unionByName(assign_ids(fresh, key, last_id(target)), allowMissingColumns=True)


def image_rows(metas: DataFrame) -> DataFrame:
    """The images of metadata records as rows with their place in the input."""
    return metas.select("ord", F.posexplode("images").alias("img_ord", "img")).select(
        F.struct("ord", "img_ord").alias("ord"), "img.name", "img.width", "img.height"
    )


def merge_image_rows(images: DataFrame, rows: DataFrame) -> DataFrame:
    """M2 on rows (ord, name, width, height): the last row per name wins."""
    latest = (
        rows.where(present("name"))
        .groupBy("name")
        .agg(F.max_by(F.struct("width", "height"), c("ord")).alias("__new"))
    )
    kept = images.join(latest, "name", "left").select(
        *[
            F.coalesce(c(f"__new.{n}"), c(n)).alias(n) if n in ("width", "height") else c(n)
            for n in images.columns
        ]
    )
    fresh = latest.join(images.select("name"), "name", "left_anti").select("name", "__new.*")
    added = assign_ids(fresh, "name", last_id(images))
    defaults = {"status": F.lit("pending"), "attempt": F.lit(0)}
    for name, value in defaults.items():
        if name in images.columns:
            added = added.withColumn(name, value)
    return kept.unionByName(added, allowMissingColumns=True).select(images.columns)


def merge_images(images: DataFrame, metas: DataFrame) -> DataFrame:
    """M2: image upsert from metadata records."""
    return merge_image_rows(images, image_rows(metas))


def merge_link_pairs(target: DataFrame, pairs: DataFrame, left: DataFrame, right: DataFrame,
                     names: tuple[str, str] = ("left_name", "right_name")) -> DataFrame:
    """M3 on pairs of names. ``left`` and ``right`` are (id, name) of the target's
    first and second column; unknown names drop out, known links stay."""
    first, second = target.columns
    wanted = pairs.where(present(names[0]) & present(names[1])).select(*names).distinct()
    links = (
        wanted.join(left.select(c("id").alias(first), c("name").alias(names[0])), names[0])
        .join(right.select(c("id").alias(second), c("name").alias(names[1])), names[1])
        .select(first, second)
        .distinct()
    )
    return target.unionByName(links.join(target, [first, second], "left_anti"))


def merge_links(target: DataFrame, metas: DataFrame, left: DataFrame, right: DataFrame,
                field: str) -> DataFrame:
    """M3: links between a record's title and its ``images``, ``authors`` or ``tags``."""
    name = c("v.name") if field == "images" else c("v")
    pairs = metas.select("title", F.explode(field).alias("v")).select("title", name.alias("name"))
    post_first = target.columns[0] == "post_id"
    order = ("title", "name") if post_first else ("name", "title")
    return merge_link_pairs(target, pairs, left, right, order)


def merge_metas(cat: Catalog, metas: DataFrame) -> Catalog:
    """M1-M3 for one batch of metadata records, in the reference's order."""
    def exploded(field: str) -> DataFrame:
        return metas.select(F.explode(field).alias("name"))

    posts = merge_names(cat.posts, metas.select("title"), "title")
    images = merge_images(cat.images, metas)
    authors = merge_names(cat.authors, exploded("authors"))
    tags = merge_names(cat.tags, exploded("tags"))
    titles = posts.select("id", c("title").alias("name"))
    return cat.with_(
        posts=posts, images=images, authors=authors, tags=tags,
        post_images=merge_links(cat.post_images, metas, titles, images, "images"),
        author_posts=merge_links(cat.author_posts, metas, authors, titles, "authors"),
        tag_posts=merge_links(cat.tag_posts, metas, tags, titles, "tags"),
    )


def merge_translations(target: DataFrame, wd_tags: DataFrame, incoming: DataFrame) -> DataFrame:
    """M4: trimmed, non-blank aliases of known tags, insert-ignore."""
    aliases = incoming.select("name", F.explode("translations").alias("t")).select(
        "name", F.btrim("t").alias("translation")
    )
    rows = (
        aliases.where(c("translation") != "")
        .join(wd_tags.select(c("id").alias("tag_id"), "name"), "name")
        .select("tag_id", "translation")
        .distinct()
    )
    return target.unionByName(rows.join(target, ["tag_id", "translation"], "left_anti"))


def merge_scores(target: DataFrame, wd_tags: DataFrame, preds: DataFrame) -> DataFrame:
    """M6: overwrite the score of (tag, image); tags that are no longer predicted
    stay. ``preds`` is (image_id, name, score); a pair given twice is an error."""
    named = preds.join(wd_tags.select(c("id").alias("wd_tag_id"), "name"), "name")
    fresh = named.groupBy("wd_tag_id", "image_id").agg(
        F.max("score").alias("s"), F.count(F.lit(1)).alias("n")
    )
    checked = F.when(
        c("n") > 1, F.raise_error(F.lit("the same tag and image occur twice in one batch"))
    ).otherwise(c("s"))
    fresh = fresh.select("wd_tag_id", "image_id", checked.cast("float").alias("new_score"))
    merged = target.join(fresh, ["wd_tag_id", "image_id"], "full")
    return merged.select("wd_tag_id", "image_id", F.coalesce("new_score", "score").alias("score"))


def complete_images(images: DataFrame, results: DataFrame) -> DataFrame:
    """M7: store both vectors and mark as completed. ``results`` is (id, clip, dinov3)."""
    new = results.select("id", F.struct("clip", "dinov3").alias("__new"))
    hit = c("__new").isNotNull()
    value = {
        "status": F.when(hit, "completed").otherwise(c("status")),
        "clip": F.when(hit, c("__new.clip")).otherwise(c("clip")),
        "dinov3": F.when(hit, c("__new.dinov3")).otherwise(c("dinov3")),
    }
    return images.join(new, "id", "left").select(
        *[value.get(n, c(n)).alias(n) for n in images.columns]
    )


def reset_failed(images: DataFrame, ids: DataFrame) -> DataFrame:
    """M8: failed images wait again; their attempt is already counted."""
    failed = ids.select("id", F.lit(True).alias("__failed")).distinct()
    status = F.when(c("__failed"), "pending").otherwise(c("status")).alias("status")
    return images.join(failed, "id", "left").select(
        *[status if n == "status" else c(n) for n in images.columns]
    )


def backfill_claimed_at(images: DataFrame, now: Column) -> DataFrame:
    """Stamp rows in work that carry no claim time."""
    missing = (c("status") == "processing") & c("claimed_at").isNull()
    return images.withColumn("claimed_at", F.when(missing, now).otherwise(c("claimed_at")))


# links of each kind that go with a deleted row
CASCADES = {
    "posts": {"post_images": "post_id", "post_videos": "post_id", "author_posts": "post_id",
              "tag_posts": "post_id"},
    "images": {"post_images": "image_id", "wd_tag_images": "image_id"},
    "videos": {"post_videos": "video_id"},
    "authors": {"author_posts": "author_id"},
    "tags": {"tag_posts": "tag_id"},
    "wd_tags": {"wd_tag_images": "wd_tag_id"},
}


def delete_cascade(cat: Catalog, kind: str, ids: DataFrame) -> tuple[Catalog, DataFrame]:
    """Delete rows and their links. Model tags with translations must stay
    (their table has no cascade) and come back as rejects."""
    rejects = ids.select("id").limit(0)
    if kind == "wd_tags":
        held = cat.wd_tag_translations.select(c("tag_id").alias("id"))
        rejects = ids.select("id").join(held, "id", "left_semi")
        ids = ids.select("id").join(held, "id", "left_anti")
    tables = {kind: getattr(cat, kind).join(ids.select("id"), "id", "left_anti")}
    for table, column in CASCADES[kind].items():
        gone = ids.select(c("id").alias(column))
        tables[table] = getattr(cat, table).join(gone, column, "left_anti").select(
            getattr(cat, table).columns
        )
    return cat.with_(**tables), rejects
