"""Text search, suggestions and lookups: J1-J13, K1-K7, A1-A5, U1-U2."""

from pyspark.sql import functions as F

from checks.base import joined, query, with_cte
from lumicat.operators import paging, search

c = F.col

PAGE = "SELECT row_number() OVER (ORDER BY {o}) AS rank, {cols} FROM ({body}) q"


def paged(cols, body, order, limit, offset=0):
    return PAGE.format(o=order, cols=cols, body=f"{body} ORDER BY {order} LIMIT {limit} OFFSET {offset}")


J4_SCORES = """SELECT image_id AS id, max(score) AS s FROM wd_tag_images
    WHERE wd_tag_id IN (SELECT wd_tag_id FROM pos) GROUP BY 1"""


@query("j4_images_by_tag", with_cte(
    "images wd_tags wd_tag_translations wd_tag_images",
    """SELECT row_number() OVER (ORDER BY s DESC, id DESC) AS rank, id, name, width, height
    FROM (SELECT * FROM m JOIN images USING (id) ORDER BY s DESC, id DESC LIMIT 20 OFFSET 5)""",
    pos="""SELECT id AS wd_tag_id FROM wd_tags WHERE name ILIKE '%nation 1%' OR name ILIKE '%nation\\_1%' ESCAPE '\\'
        UNION SELECT tag_id FROM wd_tag_translations WHERE translation ILIKE '%nation 1%'""", m=J4_SCORES))
def j4(t):
    return search.images_by_tag(t.catalog, " nation 1 ", 20, 5)


@query("j4_images_by_alias", with_cte(
    "images wd_tags wd_tag_translations wd_tag_images",
    """SELECT row_number() OVER (ORDER BY s DESC, id DESC) AS rank, id, name, width, height
    FROM (SELECT * FROM m JOIN images USING (id) ORDER BY s DESC, id DESC LIMIT 50)""",
    pos="""SELECT id AS wd_tag_id FROM wd_tags WHERE name ILIKE '%asia%'
        UNION SELECT tag_id FROM wd_tag_translations WHERE translation ILIKE '%asia%'""", m=J4_SCORES))
def j4_alias(t):
    return search.images_by_tag(t.catalog, "asia", 50)


@query("a1_image_scores", with_cte(
    "wd_tags wd_tag_translations wd_tag_images",
    "SELECT image_id AS id, max(score) AS max_score FROM wd_tag_images JOIN pos USING (wd_tag_id) GROUP BY 1",
    pos="SELECT id AS wd_tag_id FROM wd_tags WHERE name ILIKE '%NATION%' UNION SELECT tag_id FROM wd_tag_translations WHERE translation ILIKE '%NATION%'"))
def a1(t):
    return search.image_scores(t.catalog, "NATION")


@query("u1_matching_tags", with_cte(
    "wd_tags wd_tag_translations",
    """SELECT id AS wd_tag_id FROM wd_tags WHERE name ILIKE '%land 1%' OR name ILIKE '%land\\_1%' ESCAPE '\\'
    UNION SELECT tag_id FROM wd_tag_translations WHERE translation ILIKE '%land 1%'"""))
def u1(t):
    return search.matching_tags(t.catalog, "land 1")


@query("u2_ranked_matches", with_cte(
    "wd_tags wd_tag_translations",
    """SELECT id, name, (CASE WHEN lower(name) IN ('nation 1','nation_1') THEN 0
        WHEN name ILIKE 'nation 1%' OR name ILIKE 'nation\\_1%' ESCAPE '\\' THEN 1 ELSE 2 END)::INT AS match
        FROM wd_tags WHERE name ILIKE '%nation 1%' OR name ILIKE '%nation\\_1%' ESCAPE '\\'
    UNION ALL SELECT id, name, (CASE WHEN lower(translation) = 'nation 1' THEN 0 WHEN translation ILIKE 'nation 1%' THEN 1 ELSE 2 END)::INT
        FROM wd_tag_translations JOIN wd_tags ON id = tag_id WHERE translation ILIKE '%nation 1%'"""))
def u2(t):
    return search.ranked_tag_matches(t.catalog, "nation 1")


@query("k1_newest_posts", with_cte("posts", paged("id, title", "SELECT id, title FROM posts", "id DESC", 50, 100)))
def k1(t):
    return search.newest_posts(t.catalog, 50, 100)


@query("j3_posts_by_title", with_cte("posts", paged(
    "id, title", "SELECT id, title FROM posts WHERE title ILIKE '%r_d%w%'", "id DESC", 40, 3)))
def j3(t):
    return search.posts_by_title(t.catalog, "R_d%w", 40, 3)


@query("j1_posts_by_author", with_cte("posts authors author_posts", paged(
    "id, title", """SELECT p.id, p.title FROM authors a JOIN author_posts ap ON ap.author_id = a.id
    JOIN posts p ON p.id = ap.post_id WHERE a.name ILIKE '%00000_%'""", "id DESC", 500, 10)))
def j1(t):
    return search.posts_by_author(t.catalog, "00000_", 500, 10)


@query("j1_posts_by_author_distinct", with_cte("posts authors author_posts", paged(
    "id, title", """SELECT DISTINCT p.id, p.title FROM authors a JOIN author_posts ap ON ap.author_id = a.id
    JOIN posts p ON p.id = ap.post_id WHERE a.name ILIKE '%00000_%'""", "id DESC", 500)))
def j1d(t):
    return search.posts_by_author(t.catalog, "00000_", 500, distinct_posts=True)


@query("j2_posts_by_tag", with_cte("posts tags tag_posts", paged(
    "id, title", """SELECT p.id, p.title FROM tags a JOIN tag_posts tp ON tp.tag_id = a.id
    JOIN posts p ON p.id = tp.post_id WHERE a.name ILIKE '%brand#1%'""", "id DESC", 300, 20)))
def j2(t):
    return search.posts_by_tag(t.catalog, "brand#1", 300, 20)


@query("j5_post_images", with_cte(
    "images post_images",
    "SELECT post_id, id, name, width, height FROM post_images JOIN images ON id = image_id"))
def j5(t):
    return search.post_images(t.catalog)


@query("j6_post_videos", with_cte(
    "videos post_videos",
    "SELECT post_id, id, name, width, height, duration FROM post_videos JOIN videos ON id = video_id"))
def j6(t):
    return search.post_videos(t.catalog)


@query("j7_image_details", with_cte(
    "posts images post_images",
    """SELECT i.id, i.name, i.width, i.height, o.post_id, p.title AS post_title FROM images i
    LEFT JOIN one o ON o.image_id = i.id LEFT JOIN posts p ON p.id = o.post_id""",
    one="SELECT image_id, min(post_id) AS post_id FROM post_images GROUP BY 1"))
def j7(t):
    return search.image_details(t.catalog)


@query("j7_image_authors", with_cte(
    "authors author_posts post_images",
    """SELECT o.image_id, a.id AS author_id, a.name FROM one o JOIN author_posts ap ON ap.post_id = o.post_id
    JOIN authors a ON a.id = ap.author_id""",
    one="SELECT image_id, min(post_id) AS post_id FROM post_images GROUP BY 1"))
def j7a(t):
    return search.image_authors(t.catalog)


@query("j7_image_tags", with_cte(
    "wd_tags wd_tag_images wd_tag_translations",
    """SELECT wi.image_id, t.id AS tag_id, t.name, wi.score,
        coalesce(string_agg(DISTINCT tt.translation, '|' ORDER BY tt.translation), '') AS aliases
    FROM wd_tags t JOIN wd_tag_images wi ON wi.wd_tag_id = t.id
    LEFT JOIN wd_tag_translations tt ON tt.tag_id = t.id GROUP BY ALL"""))
def j7t(t):
    return joined(search.image_tags(t.catalog), "aliases")


@query("j8_video_details", with_cte(
    "posts videos post_videos",
    """SELECT i.id, i.name, i.width, i.height, i.duration, o.post_id, p.title AS post_title FROM videos i
    LEFT JOIN one o ON o.video_id = i.id LEFT JOIN posts p ON p.id = o.post_id""",
    one="SELECT video_id, min(post_id) AS post_id FROM post_videos GROUP BY 1"))
def j8(t):
    return search.video_details(t.catalog)


EVENT_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def event_ids(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select((k * 50).alias("id")).distinct()


@query("j9_images_by_ids", with_cte(
    "images", f"SELECT id, name, width, height FROM images WHERE id IN (SELECT {EVENT_K} * 50 FROM events)"))
def j9(t):
    return search.images_by_ids(t.catalog, event_ids(t))


PREVIEW = """SELECT p.id AS post_id, p.title, c.image_id, i.name, i.width, i.height,
    coalesce(c.n, 0) AS image_count, coalesce(v.n, 0) AS video_count FROM posts p
    LEFT JOIN (SELECT post_id, min(image_id) AS image_id, count(*) AS n FROM post_images GROUP BY 1) c ON c.post_id = p.id
    LEFT JOIN images i ON i.id = c.image_id
    LEFT JOIN (SELECT post_id, count(*) AS n FROM post_videos GROUP BY 1) v ON v.post_id = p.id"""


@query("j10_post_previews", with_cte("posts images post_images post_videos", PREVIEW))
def j10(t):
    return search.post_previews(t.catalog)


@query("j11_post_meta", with_cte(
    "authors author_posts", "SELECT post_id, id, name FROM author_posts JOIN authors ON id = author_id"))
def j11(t):
    return search.post_meta(t.catalog)


@query("j13_post_media", with_cte(
    "images videos post_images post_videos",
    """SELECT post_id, 'image' AS kind, id, name, width, height, NULL::INT AS duration FROM post_images JOIN images ON id = image_id
    UNION ALL SELECT post_id, 'video', id, name, width, height, duration FROM post_videos JOIN videos ON id = video_id"""))
def j13(t):
    return search.post_media(t.catalog)


@query("j13_posts_with_media", with_cte(
    "posts images videos post_images post_videos",
    """SELECT rank, pg.id, title,
      coalesce((SELECT string_agg(image_id, '|' ORDER BY image_id) FROM post_images WHERE post_id = pg.id), '') AS images,
      coalesce((SELECT string_agg(video_id, '|' ORDER BY video_id) FROM post_videos WHERE post_id = pg.id), '') AS videos
    FROM pg""",
    pg=paged("id, title", "SELECT id, title FROM posts", "id DESC", 50)))
def j13_nested(t):
    rows = search.posts_with_media(t.catalog, search.newest_posts(t.catalog, 50))
    return rows.select("rank", "id", "title", *[
        F.array_join(F.transform(m, lambda x: x["id"].cast("string")), "|").alias(m)
        for m in ("images", "videos")])


@query("a2_post_counts", with_cte(
    "post_images", "SELECT post_id, count(*) AS image_count, min(image_id) AS cover_id FROM post_images GROUP BY 1"))
def a2(t):
    return t.catalog.post_images.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("image_count"), F.min("image_id").alias("cover_id"))


@query("a3_first_per_group",
       """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def a3(t):
    return paging.first_per_group(t.orders, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"),
                                  ["o_orderkey", "o_totalprice"], latest=True)


@query("a4_alias_list", with_cte(
    "wd_tags wd_tag_translations",
    """SELECT id, name, coalesce(string_agg(DISTINCT translation, '|' ORDER BY translation), '') AS aliases
    FROM wd_tags LEFT JOIN wd_tag_translations ON tag_id = id GROUP BY ALL"""))
def a4(t):
    return joined(search.with_aliases(t.catalog, t.catalog.wd_tags), "aliases")


K3_SQL = """SELECT row_number() OVER (ORDER BY r, length(name), name) AS rank, id, name,
      coalesce((SELECT string_agg(DISTINCT translation, '|' ORDER BY translation) FROM wd_tag_translations WHERE tag_id = b.id), '') AS aliases
    FROM (SELECT id, name, min(r) AS r FROM m GROUP BY id, name ORDER BY r, length(name), name LIMIT {n}) b"""


@query("k3_suggest_tags", with_cte(
    "wd_tags wd_tag_translations", K3_SQL.format(n=20),
    m="""SELECT id, name, CASE WHEN lower(name) IN ('nation 1','nation_1') THEN 0
        WHEN name ILIKE 'nation 1%' OR name ILIKE 'nation\\_1%' ESCAPE '\\' THEN 1 ELSE 2 END AS r
        FROM wd_tags WHERE name ILIKE '%nation 1%' OR name ILIKE '%nation\\_1%' ESCAPE '\\'
        UNION ALL SELECT id, name, CASE WHEN lower(translation) = 'nation 1' THEN 0 WHEN translation ILIKE 'nation 1%' THEN 1 ELSE 2 END
        FROM wd_tag_translations JOIN wd_tags ON id = tag_id WHERE translation ILIKE '%nation 1%'"""))
def k3(t):
    return joined(search.suggest_tags(t.catalog, "nation 1", 99), "aliases")


@query("k3_suggest_tags_short", with_cte(
    "wd_tags wd_tag_translations", K3_SQL.format(n=5),
    m="""SELECT id, name, 1 AS r FROM wd_tags WHERE name ILIKE 'a%'
        UNION ALL SELECT id, name, CASE WHEN lower(translation) = 'a' THEN 0 ELSE 1 END
        FROM wd_tag_translations JOIN wd_tags ON id = tag_id WHERE translation ILIKE 'a%'"""))
def k3_short(t):
    return joined(search.suggest_tags(t.catalog, "A", 5), "aliases")


@query("k4_suggest_authors", with_cte("authors", """
    SELECT row_number() OVER (ORDER BY r, length(name), name) AS rank, id, name FROM (
    SELECT id, name, CASE WHEN lower(name) = 'supplier#00000001' THEN 0 WHEN name ILIKE 'supplier#00000001%' THEN 1 ELSE 2 END AS r
    FROM authors WHERE name ILIKE '%supplier#00000001%' ORDER BY r, length(name), name LIMIT 10)"""))
def k4(t):
    return search.suggest_authors(t.catalog, "supplier#00000001", 10)


@query("k5_suggest_titles", with_cte("posts", """
    SELECT row_number() OVER (ORDER BY r, id DESC) AS rank, id, title FROM (
    SELECT id, title, CASE WHEN lower(title) = 'ring' THEN 0 WHEN title ILIKE 'ring%' THEN 1 ELSE 2 END AS r
    FROM posts WHERE title ILIKE '%ring%' ORDER BY r, id DESC LIMIT 15)"""))
def k5(t):
    return search.suggest_titles(t.catalog, "ring", 15)


def suggest_queries(t):
    """Search boxes typed by the event log: part names, supplier names, brands."""
    e = t.events.select(c("event_id").alias("query_id"),
                        F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    mode = F.element_at(F.array(*map(F.lit, ("tag", "author", "title", "clip"))), (c("k") % 4 + 1).cast("int"))
    text = (F.when(c("k") % 4 == 0, F.concat(F.lit(" nation "), (c("k") % 25).cast("string")))
            .when(c("k") % 4 == 1, F.concat(F.lit("#0000000"), (c("k") % 40).cast("string")))
            .when(c("k") % 8 == 2, F.lit("re")).when(c("k") % 8 == 6, F.lit("Bolt")).otherwise("x"))
    return e.select("query_id", mode.alias("mode"), text.alias("q"))


@query("k6_suggest", with_cte(
    "posts authors wd_tags wd_tag_translations",
    """SELECT query_id, mode, rank, id, name FROM (
      SELECT query_id, mode, row_number() OVER (PARTITION BY query_id ORDER BY r,
        CASE WHEN mode <> 'title' THEN length(name) END, CASE WHEN mode <> 'title' THEN name END,
        CASE WHEN mode = 'title' THEN -id ELSE id END) AS rank, id, name
      FROM (SELECT query_id, mode, id, name, min(r) AS r FROM hits GROUP BY ALL)
    ) WHERE rank <= CASE mode WHEN 'title' THEN 8 ELSE 10 END""",
    qs=f"""SELECT event_id AS query_id, ['tag','author','title','clip'][k % 4 + 1] AS mode,
        trim(CASE WHEN k % 4 = 0 THEN ' nation ' || (k % 25) WHEN k % 4 = 1 THEN '#0000000' || (k % 40)
        WHEN k % 8 = 2 THEN 're' WHEN k % 8 = 6 THEN 'Bolt' ELSE 'x' END) AS q
        FROM (SELECT event_id, {EVENT_K} AS k FROM events)""",
    pats="""SELECT DISTINCT mode, q, CASE WHEN length(q) >= 3 THEN '%' ELSE '' END AS lead FROM qs WHERE mode <> 'clip'""",
    dims="""SELECT 'tag' AS mode, id, name AS label, name, false AS alias FROM wd_tags
        UNION ALL SELECT 'tag', id, w.name, translation, true FROM wd_tag_translations JOIN wd_tags w ON id = tag_id
        UNION ALL SELECT 'author', id, name, name, true FROM authors UNION ALL SELECT 'title', id, title, title, true FROM posts""",
    found="""SELECT mode, q, id, label AS name, CASE WHEN lower(name) = lower(q) OR (NOT alias AND lower(name) = lower(replace(q, ' ', '_'))) THEN 0
        WHEN starts_with(lower(name), lower(q)) OR (NOT alias AND starts_with(lower(name), lower(replace(q, ' ', '_')))) THEN 1 ELSE 2 END AS r
        FROM pats JOIN dims USING (mode) WHERE CASE WHEN lead = '%' THEN contains(lower(name), lower(q)) OR (NOT alias AND contains(lower(name), lower(replace(q, ' ', '_'))))
          ELSE starts_with(lower(name), lower(q)) END""",
    hits="SELECT query_id, mode, id, name, r FROM qs JOIN found USING (mode, q)"))
def k6(t):
    return search.suggest(t.catalog, suggest_queries(t))


@query("k7_has_more", with_cte("posts", """SELECT count(*) AS n_rows, count(*) >= 60 AS has_more FROM
    (SELECT id FROM posts WHERE title ILIKE '%bolt%' ORDER BY id DESC LIMIT 60)"""))
def k7(t):
    return paging.has_more(search.posts_by_title(t.catalog, "bolt", 60), 60)


@query("j26_lookup_in_order", with_cte("images", f"""SELECT pos, id, name, width, height FROM
    (SELECT row_number() OVER (ORDER BY n DESC, id) AS pos, id FROM (SELECT {EVENT_K} * 50 AS id, count(*) AS n FROM events GROUP BY 1))
    JOIN images USING (id)"""))
def j26(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    popular = t.events.groupBy((k * 50).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    order = [c("n").desc(), c("id")]
    ids = paging.ranked(paging.page(popular, order, 100), order, "pos").drop("n")
    images = t.catalog.images.select("id", "name", "width", "height")
    return paging.lookup_in_order(images, ids, 100)
