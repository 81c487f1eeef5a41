"""Text search, suggestions and catalog lookups.

Links reference existing rows (foreign keys, see Q3). Searches therefore cut the
page on the link table and read the wide table for the page only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.catalog import Catalog
from lumicat.functions import text as tx
from lumicat.operators.paging import bounded, page, ranked, top_per_key
from lumicat.sources.snapshots import stage

c = F.col


def _need_text(text: str, what: str) -> str:
    if not text:
        raise ValueError(f"{what} should not be empty")
    return text


# ---------------------------------------------------------------- post search
def newest_posts(cat: Catalog, limit: int, offset: int = 0) -> DataFrame:
    """K1: posts, newest id first."""
    order = [c("id").desc()]
    return ranked(page(cat.posts.select("id", "title"), order, limit, offset), order)


def posts_by_title(cat: Catalog, text: str, limit: int, offset: int = 0) -> DataFrame:
    """Posts whose title contains the text, newest first."""
    order = [c("id").desc()]
    hits = cat.posts.where(tx.ilike_contains(c("title"), _need_text(text, "title")))
    return ranked(page(hits.select("id", "title"), order, limit, offset), order)


def _posts_by_link(cat: Catalog, dim: DataFrame, links: DataFrame, link_key: str,
                   text: str, limit: int, offset: int, distinct_posts: bool) -> DataFrame:
    names = dim.where(tx.ilike_contains(c("name"), text)).select(c("id").alias(link_key))
    hits = links.join(names, link_key).select(c("post_id").alias("id"))
    if distinct_posts:
        hits = hits.distinct()
    found = page(hits, [c("id").desc()], limit, offset)
    rows = cat.posts.select("id", "title").join(bounded(found, limit), "id")
    return ranked(rows, [c("id").desc()])


def posts_by_author(cat: Catalog, text: str, limit: int, offset: int = 0,
                    distinct_posts: bool = False) -> DataFrame:
    """Posts with a matching author. A post counts once per matching author."""
    return _posts_by_link(cat, cat.authors, cat.author_posts, "author_id",
                          _need_text(text, "author name"), limit, offset, distinct_posts)


def posts_by_tag(cat: Catalog, text: str, limit: int, offset: int = 0,
                 distinct_posts: bool = False) -> DataFrame:
    """Posts with a matching tag, once per matching tag."""
    return _posts_by_link(cat, cat.tags, cat.tag_posts, "tag_id",
                          _need_text(text, "tag"), limit, offset, distinct_posts)


# --------------------------------------------------------------- image search
def matching_tags(cat: Catalog, text: str) -> DataFrame:
    """Ids of model tags whose name or any translation matches."""
    by_name = cat.wd_tags.where(tx.name_match(c("name"), text)).select(c("id").alias("wd_tag_id"))
    by_alias = cat.wd_tag_translations.where(tx.ilike_literal(c("translation"), text)).select(
        c("tag_id").alias("wd_tag_id")
    )
    return by_name.union(by_alias).distinct()


def image_scores(cat: Catalog, text: str) -> DataFrame:
    """A1: best score per image over all matching tags."""
    return (
        cat.wd_tag_images.join(matching_tags(cat, text), "wd_tag_id")
        .groupBy(c("image_id").alias("id"))
        .agg(F.max("score").alias("max_score"))
    )


def images_by_tag(cat: Catalog, text: str, limit: int, offset: int = 0) -> DataFrame:
    """Images by model tag, best score first, then newest."""
    raw = _need_text(tx.trim_unicode(text), "tag")
    order = [c("max_score").desc(), c("id").desc()]
    found = page(image_scores(cat, raw), order, limit, offset)
    rows = cat.images.select("id", "name", "width", "height").join(bounded(found, limit), "id")
    return ranked(rows, order).drop("max_score")


# -------------------------------------------------------------------- lookups
def unnest(df: DataFrame, columns: list[str], ordinal: str | None = None) -> DataFrame:
    """Parallel arrays to rows; shorter arrays are padded with NULL. The
    ordinal counts from 1."""
    rest = [n for n in df.columns if n not in columns]
    zipped = F.arrays_zip(*columns)
    rows = df.select(*rest, F.posexplode(zipped).alias("__pos", "__item"))
    place = [(c("__pos") + 1).alias(ordinal)] if ordinal else []
    return rows.select(*rest, *place, *[c(f"__item.{n}").alias(n) for n in columns])


def post_images(cat: Catalog, post_ids: DataFrame | None = None) -> DataFrame:
    """The images of each post, by id."""
    links = _restrict(cat.post_images, post_ids)
    rows = links.join(cat.images.select("id", "name", "width", "height"), c("image_id") == c("id"))
    return rows.select("post_id", "id", "name", "width", "height")


def post_videos(cat: Catalog, post_ids: DataFrame | None = None) -> DataFrame:
    """The videos of each post, by id."""
    links = _restrict(cat.post_videos, post_ids)
    return links.join(cat.videos, c("video_id") == c("id")).select(
        "post_id", "id", "name", "width", "height", "duration"
    )


def _restrict(links: DataFrame, ids: DataFrame | None, key: str = "post_id") -> DataFrame:
    return links if ids is None else links.join(ids.select(c("id").alias(key)), key, "left_semi")


def post_meta(cat: Catalog, post_ids: DataFrame | None = None) -> DataFrame:
    """(post_id, id, name) of each post's authors; order by post and name to show."""
    links = _restrict(cat.author_posts, post_ids)
    return links.join(cat.authors, c("author_id") == c("id")).select("post_id", "id", "name")


def _one_post(links: DataFrame, key: str) -> DataFrame:
    """One post per medium. The reference takes any; the smallest id is fixed here."""
    return links.groupBy(c(key).alias("id")).agg(F.min("post_id").alias("post_id"))


def image_details(cat: Catalog, image_ids: DataFrame | None = None) -> DataFrame:
    """Each image with its post; authors and tags follow as rows of
    :func:`image_authors` and :func:`image_tags`, so no list grows without bound."""
    images = cat.images.select("id", "name", "width", "height")
    if image_ids is not None:
        images = images.join(image_ids, "id", "left_semi")
    return _with_post(cat, images, cat.post_images, "image_id")


def _with_post(cat: Catalog, media: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return media.join(_one_post(links, key), "id", "left").join(
        cat.posts.select(c("id").alias("post_id"), c("title").alias("post_title")),
        "post_id",
        "left",
    )


def video_details(cat: Catalog, video_ids: DataFrame | None = None) -> DataFrame:
    """Each video with its post; videos carry no model tags."""
    videos = cat.videos.select("id", "name", "width", "height", "duration")
    if video_ids is not None:
        videos = videos.join(video_ids, "id", "left_semi")
    return _with_post(cat, videos, cat.post_videos, "video_id")


def image_authors(cat: Catalog, image_ids: DataFrame | None = None) -> DataFrame:
    """(image_id, author_id, name) of the post of each image."""
    links = cat.post_images
    if image_ids is not None:
        links = links.join(image_ids.select(c("id").alias("image_id")), "image_id", "left_semi")
    return (
        _one_post(links, "image_id")
        .withColumnRenamed("id", "image_id")
        .join(cat.author_posts, "post_id")
        .join(cat.authors.select(c("id").alias("author_id"), "name"), "author_id")
        .select("image_id", "author_id", "name")
    )


def alias_list(translations: DataFrame) -> DataFrame:
    """A4: sorted different aliases per tag; a tag without any keeps an empty list
    through the outer join of the caller."""
    return translations.groupBy("tag_id").agg(
        F.sort_array(F.collect_set("translation")).alias("aliases")
    )


def with_aliases(cat: Catalog, tags: DataFrame, key: str = "id") -> DataFrame:
    lists = alias_list(cat.wd_tag_translations).withColumnRenamed("tag_id", key)
    empty = F.array().cast("array<string>")
    return tags.join(lists, key, "left").withColumn("aliases", F.coalesce("aliases", empty))


def image_tags(cat: Catalog, image_ids: DataFrame | None = None) -> DataFrame:
    """(image_id, tag_id, name, score, aliases) of every scored tag."""
    scores = cat.wd_tag_images
    if image_ids is not None:
        scores = scores.join(image_ids.select(c("id").alias("image_id")), "image_id", "left_semi")
    tags = with_aliases(cat, cat.wd_tags).withColumnRenamed("id", "wd_tag_id")
    return scores.join(tags, "wd_tag_id").select(
        "image_id", c("wd_tag_id").alias("tag_id"), "name", "score", "aliases"
    )


def nested_image_details(cat: Catalog, image_ids: DataFrame) -> DataFrame:
    """J7 as one nested record per image, for a page of ids."""
    authors = (
        image_authors(cat, image_ids)
        .groupBy("image_id")
        .agg(F.array_sort(F.collect_list(F.struct("name", c("author_id").alias("id")))).alias("authors"))
    )
    by_score = lambda a, b: (
        F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
        .when(a["id"] < b["id"], -1).otherwise(1)
    )
    tags = (
        image_tags(cat, image_ids)
        .groupBy("image_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("score", c("tag_id").alias("id"), "name", "aliases")),
                by_score,
            ).alias("tags")
        )
    )
    rows = image_details(cat, image_ids)
    for part in (authors, tags):
        rows = rows.join(part.withColumnRenamed("image_id", "id"), "id", "left")
    return rows.withColumn(
        "authors", F.coalesce("authors", F.array().cast(rows.schema["authors"].dataType))
    ).withColumn("tags", F.coalesce("tags", F.array().cast(rows.schema["tags"].dataType)))


def images_by_ids(cat: Catalog, ids: DataFrame) -> DataFrame:
    """The images of an id set; missing ids drop out."""
    return cat.images.select("id", "name", "width", "height").join(
        ids.select("id"), "id", "left_semi"
    )


def post_previews(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """Title, cover (image with the smallest id) and media counts per post."""
    posts = cat.posts.select("id", "title")
    image_links, video_links = cat.post_images, cat.post_videos
    if ids is not None:
        posts = posts.join(ids.select("id"), "id", "left_semi")
        image_links, video_links = _restrict(image_links, ids), _restrict(video_links, ids)
    images = image_links.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("image_count"), F.min("image_id").alias("cover_id")
    )
    videos = video_links.groupBy("post_id").agg(F.count(F.lit(1)).alias("video_count"))
    zero = F.lit(0).cast("bigint")
    rows = (
        posts.withColumnRenamed("id", "post_id")
        .join(images, "post_id", "left")
        .join(videos, "post_id", "left")
        .join(
            cat.images.select(c("id").alias("cover_id"), "name", "width", "height"),
            "cover_id",
            "left",
        )
    )
    return rows.select(
        "post_id", "title", c("cover_id").alias("image_id"), "name", "width", "height",
        F.coalesce("image_count", zero).alias("image_count"),
        F.coalesce("video_count", zero).alias("video_count"),
    )


def post_media(cat: Catalog, posts: DataFrame | None = None) -> DataFrame:
    """J13, flat: (post_id, kind, id, name, width, height, duration) of all media."""
    images = post_images(cat, posts).withColumn("duration", F.lit(None).cast("int"))
    videos = post_videos(cat, posts)
    return images.withColumn("kind", F.lit("image")).unionByName(
        videos.withColumn("kind", F.lit("video"))
    )


def posts_with_media(cat: Catalog, posts: DataFrame, list_size: int = 1000) -> DataFrame:
    """A page of posts with nested, id-ordered media lists. A post with more
    than ``list_size`` media comes as several rows (``part``), so that no list grows
    with the post; ordinary posts are one row."""
    media = post_media(cat, posts)
    sizes = media.groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(c("n") / list_size).cast("bigint")
    spread = media.join(sizes, "post_id").withColumn("part", F.pmod(F.xxhash64("kind", c("id")), parts))
    item = F.struct("id", "name", "width", "height", "duration")

    def media_list(kind: str):
        picked = F.collect_list(F.when(c("kind") == kind, item))
        return F.array_sort(picked).alias(f"{kind}s")

    lists = spread.groupBy("post_id", "part").agg(media_list("image"), media_list("video"))
    rows = posts.join(lists.withColumnRenamed("post_id", "id"), "id", "left")
    for name in ("images", "videos"):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return rows.withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))


# ---------------------------------------------------------------- suggestions
def _clamp(limit: int, top: int) -> int:
    return max(1, min(limit, top))


def ranked_tag_matches(cat: Catalog, raw: str) -> DataFrame:
    """Every match by name or translation with its rank."""
    by_name = cat.wd_tags.where(tx.name_match(c("name"), raw, tx.autocomplete_pattern)).select(
        "id", "name", tx.match_rank(c("name"), raw, with_underscores=True).alias("match")
    )
    hits = cat.wd_tag_translations.where(c("translation").ilike(tx.autocomplete_pattern(raw)))
    by_alias = hits.join(cat.wd_tags, c("tag_id") == c("id")).select(
        "id", "name", tx.match_rank(c("translation"), raw).alias("match")
    )
    return by_name.unionByName(by_alias)


def suggest_tags(cat: Catalog, text: str, limit: int = 10) -> DataFrame:
    """K3: tag suggestions with aliases, best rank first, then short, then by name."""
    raw, limit = tx.trim_unicode(text), _clamp(limit, 20)
    best = ranked_tag_matches(cat, raw).groupBy("id", "name").agg(F.min("match").alias("match"))
    if not raw:
        best = best.limit(0)
    order = [c("match"), F.char_length("name"), c("name"), c("id")]
    top = ranked(page(best, order, limit), order)
    # aliases of the page only: the alias table is reduced before it is grouped
    lists = alias_list(
        cat.wd_tag_translations.join(
            bounded(top.select(c("id").alias("tag_id")), limit), "tag_id", "left_semi"
        )
    )
    rows = top.join(lists.withColumnRenamed("tag_id", "id"), "id", "left")
    return rows.select(
        "rank", "id", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")
    )


def _suggest_names(df: DataFrame, name: str, text: str, limit: int, tie: list) -> DataFrame:
    raw = tx.trim_unicode(text)
    hits = df.where(c(name).ilike(tx.autocomplete_pattern(raw))) if raw else df.limit(0)
    hits = hits.select("id", name, tx.match_rank(c(name), raw).alias("match"))
    order = [c("match"), *tie]
    return ranked(page(hits, order, limit), order).select("rank", "id", name)


def suggest_authors(cat: Catalog, text: str, limit: int = 10) -> DataFrame:
    """K4: author suggestions by rank, length and name."""
    tie = [F.char_length("name"), c("name"), c("id")]
    return _suggest_names(cat.authors, "name", text, _clamp(limit, 20), tie)


def suggest_titles(cat: Catalog, text: str, limit: int = 8) -> DataFrame:
    """K5: title suggestions by rank, newest first."""
    return _suggest_names(cat.posts, "title", text, _clamp(limit, 15), [c("id").desc()])


# fixed values: rows per suggestion list
SUGGEST_LIMITS = {"tag": 10, "author": 10, "title": 8}


HOT_GRAM = 100_000  # names of one gram that one task compares
COUNTED = 16  # one name in so many is counted to find rare grams


def _grams(low: Column) -> Column:
    """What a lower-case name is found by: all runs of three characters, and the
    first one and two."""
    inner = F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(low) - 2, F.lit(1))),
        lambda i: F.concat(F.lit("in:"), F.substring(low, i, 3)),
    )
    return F.array_distinct(F.concat(inner, F.transform(
        F.array(F.lit(1), F.lit(2)), lambda n: F.concat(F.lit("at:"), F.substring(low, F.lit(1), n)))))


def _gram_match(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of (query, name) of one ``src`` where the name matches the query's pattern.

    A name that contains a query contains all of its grams, so an equi join on any
    one of them loses nothing. Each query takes the one that is rarest in a part of the
    names (counts choose the way, not the result), and only names with a taken gram
    are joined. Names of a gram that stays frequent are dealt over tasks, to which
    its queries are copied.
    """
    offered = names.withColumn("low", F.lower("name"))
    grams = F.explode(_grams(c("low"))).alias("gram")
    asked = queries.withColumn("q_low", F.lower("raw")).withColumn("short", F.char_length("raw") < 3)
    start = F.array(F.concat(F.lit("at:"), F.substring("q_low", 1, 2)))
    inside = F.filter(_grams(c("q_low")), lambda g: F.startswith(g, F.lit("in:")))
    wanted = asked.withColumn("gram", F.explode(F.when(c("short"), start).otherwise(inside)))
    counts = (
        offered.where(F.pmod(F.xxhash64("id", "name"), F.lit(COUNTED)) == 0).select("src", grams)
        .join(wanted.select("src", "gram").distinct(), ["src", "gram"], "left_semi")
        .groupBy("src", "gram").agg(F.count(F.lit(1)).alias("n"))
    )
    keys = [*queries.columns, "q_low", "short"]
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")
    taken = stage(
        wanted.join(counts, ["src", "gram"], "left").groupBy(*keys).agg(rarest).select(
            *keys, "rarest.gram", (F.floor(c("rarest.n") * COUNTED / HOT_GRAM) + 1).cast("int").alias("parts"))
    )
    # the parts of a gram are the same for all of its queries
    left = offered.select("*", grams).join(taken.select("src", "gram", "parts").distinct(), ["src", "gram"]).withColumn(
        "part", F.pmod(F.xxhash64("id", "name"), c("parts")).cast("int")
    ).drop("parts")
    right = taken.withColumn("part", F.explode(F.sequence(F.lit(0), c("parts") - 1))).drop("parts")
    here = F.when(c("short"), F.startswith("low", "q_low")).otherwise(F.contains("low", "q_low"))
    return left.join(right, ["src", "gram", "part"]).where(here)


def suggest(cat: Catalog, queries: DataFrame) -> DataFrame:
    """K6: suggestions for a table of (query_id, mode, q), dispatched by mode.

    Popular texts repeat, so each different (mode, text) is answered once and
    the answers, at most ten rows each, are joined back to the queries.
    """
    asked_rows = queries.where(tx.should_suggest(c("mode"), c("q"))).select(
        "query_id", "mode", tx.trim_unicode(c("q")).alias("text")
    )
    live = stage(asked_rows.select("mode", "text", c("text").alias("raw")).distinct())
    tags = live.where(c("mode") == "tag")
    spaced = tags.withColumn("form", F.explode(F.array_distinct(F.array(
        c("raw"), F.translate("raw", " ", "_")))))
    names = cat.wd_tags.select("id", "name", c("name").alias("label"))
    aliases = cat.wd_tag_translations.join(cat.wd_tags, c("tag_id") == c("id")).select(
        "id", c("translation").alias("name"), c("name").alias("label")
    )
    authors = cat.authors.select("id", "name", c("name").alias("label"))
    posts = cat.posts.select("id", c("title").alias("name"), c("title").alias("label"))
    asked = lambda rows, src: rows.select(F.lit(src).alias("src"), "mode", "text", "raw")
    of = lambda rows, src: rows.withColumn("src", F.lit(src))
    rank = F.when(c("low") == c("q_low"), 0).when(F.startswith("low", "q_low"), 1).otherwise(2)

    hits = _gram_match(
        asked(spaced.drop("raw").withColumnRenamed("form", "raw"), "tag").unionByName(asked(tags, "alias"))
        .unionByName(asked(live.where(c("mode") == "author"), "author"))
        .unionByName(asked(live.where(c("mode") == "title"), "title")),
        of(names, "tag").unionByName(of(aliases, "alias")).unionByName(of(authors, "author")).unionByName(of(posts, "title")),
    ).select("src", "mode", "text", "id", "label", rank.alias("match"))
    by_tag = hits.where(c("src").isin("tag", "alias")).drop("src")
    by_name = hits.where(c("src").isin("author", "title")).drop("src")
    # a tag may match in several ways; authors and titles match once, so their hits
    # go straight into the top-n, which is cut before its shuffle
    best = by_tag.groupBy("mode", "text", "id", "label").agg(F.min("match").alias("match")).unionByName(by_name)
    titles = c("mode") == "title"
    order = [
        c("match"),
        F.when(~titles, F.char_length("label")),
        F.when(~titles, c("label")),
        F.when(titles, -c("id")).otherwise(c("id")),
    ]
    most = max(SUGGEST_LIMITS.values())
    cap = F.coalesce(*[F.when(c("mode") == m, n) for m, n in SUGGEST_LIMITS.items()])
    answers = top_per_key(best, ["mode", "text"], order, most).where(c("rank") <= cap)
    return asked_rows.join(answers, ["mode", "text"]).select(
        "query_id", "mode", c("rank").cast("bigint").alias("rank"), "id", c("label").alias("name")
    )
