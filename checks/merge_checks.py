"""Merges, constraints and favourites: M1-M9, M13-M15, M18, M19, Q1-Q3, J12-J15, J21-J23, K8."""

from pyspark.sql import functions as F

from checks.base import query, with_cte
from lumicat.operators import ledger, likes, merge, quality

c = F.col
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def ids_sql(fresh, key, target):
    """M9 in SQL: new rows numbered by (hash bucket, key) after the last id."""
    return f"""SELECT (SELECT coalesce(max(id), 0) FROM {target}) + row_number() OVER
        (ORDER BY ('0x' || substr(md5({key}), 1, 8))::BIGINT % 1024, {key}) AS id, * FROM {fresh}"""


@query("m1_merge_names", with_cte(
    "authors", f"SELECT id, name FROM authors UNION ALL ({ids_sql('fresh', 'name', 'authors')})",
    fresh="""SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT '  ' FROM nation)
        WHERE trim(name) <> '' AND name NOT IN (SELECT name FROM authors)"""))
def m1(t):
    names = t.customer.select(c("c_name").alias("name")).union(t.supplier.select("s_name")).union(
        t.nation.select(F.lit("  ")))
    return merge.merge_names(t.catalog.authors, names)


@query("m9_assign_ids", ids_sql("(SELECT DISTINCT o_orderkey::VARCHAR AS name FROM orders)", "name", "(SELECT 100 AS id)"))
def m9(t):
    start = t.spark.range(1).select(F.lit(100).cast("bigint").alias("last_id"))
    return merge.assign_ids(t.orders.select(c("o_orderkey").cast("string").alias("name")), "name", start)


LINE_IMAGES = """SELECT 'order-' || l_partkey * 10 AS name, arg_max(l_quantity::INT, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS width,
    arg_max(l_linenumber, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS height FROM lineitem GROUP BY 1"""


@query("m2_merge_images", with_cte(
    "images", f"""SELECT i.id, i.name, coalesce(l.width, i.width) AS width, coalesce(l.height, i.height) AS height, i.status, i.attempt
      FROM images i LEFT JOIN latest l ON l.name = i.name
    UNION ALL SELECT id, name, width, height, 'pending', 0 FROM ({ids_sql('fresh', 'name', 'images')})""",
    latest=LINE_IMAGES, fresh="SELECT * FROM latest WHERE name NOT IN (SELECT name FROM images)"))
def m2(t):
    rows = t.lineitem.select(
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("ord"),
        F.concat(F.lit("order-"), (c("l_partkey") * 10).cast("string")).alias("name"),
        c("l_quantity").cast("int").alias("width"), c("l_linenumber").alias("height"))
    return merge.merge_image_rows(t.catalog.images, rows).drop("claimed_at")


@query("m3_merge_links", with_cte(
    "author_posts", """SELECT author_id, post_id FROM author_posts UNION
    SELECT DISTINCT s_suppkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey"""))
def m3(t):
    lines = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    pairs = lines.join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(
        t.customer, c("o_custkey") == c("c_custkey")).select(
        c("s_name").alias("left_name"), c("c_name").alias("right_name"))
    return merge.merge_link_pairs(t.catalog.author_posts, pairs, t.catalog.authors,
                                  t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("name")))


@query("m4_merge_translations", with_cte(
    "wd_tags wd_tag_translations", """SELECT tag_id, translation FROM wd_tag_translations UNION
    SELECT id, translation FROM (SELECT 'NATION_' || (p_size % 40) AS name, unnest([p_brand, trim(p_type), 'land ' || (p_size % 40)]) AS translation FROM part) JOIN wd_tags USING (name)"""))
def m4(t):
    rows = t.part.select(
        F.concat(F.lit("NATION_"), (c("p_size") % 40).cast("string")).alias("name"),
        F.array(c("p_brand"), F.concat(F.lit("  "), c("p_type"), F.lit(" ")), F.lit("   "),
                F.concat(F.lit("land "), (c("p_size") % 40).cast("string"))).alias("translations"))
    return merge.merge_translations(t.catalog.wd_tag_translations, t.catalog.wd_tags, rows)


PREDS = """SELECT o_orderkey AS image_id, 'NATION_' || (o_custkey % 30) AS name, (0.5 + (o_orderkey % 50) / 100.0)::FLOAT AS score FROM orders"""


def preds(t):
    return t.orders.select(
        c("o_orderkey").alias("image_id"),
        F.concat(F.lit("NATION_"), (c("o_custkey") % 30).cast("string")).alias("name"),
        (0.5 + (c("o_orderkey") % 50) / 100.0).cast("float").alias("score"))


@query("m5_merge_wd_tags", with_cte(
    "wd_tags", f"SELECT id, name FROM wd_tags UNION ALL ({ids_sql('fresh', 'name', 'wd_tags')})",
    fresh=f"SELECT DISTINCT name FROM ({PREDS}) WHERE name NOT IN (SELECT name FROM wd_tags)"))
def m5(t):
    return merge.merge_names(t.catalog.wd_tags, preds(t))


@query("m6_merge_scores", with_cte(
    "wd_tags wd_tag_images", f"""SELECT wd_tag_id, image_id, coalesce(n.score, o.score) AS score FROM wd_tag_images o FULL JOIN
    (SELECT w.id AS wd_tag_id, image_id, score FROM ({PREDS}) JOIN wd_tags w USING (name)) n USING (wd_tag_id, image_id)"""))
def m6(t):
    return merge.merge_scores(t.catalog.wd_tag_images, t.catalog.wd_tags, preds(t))


def with_vectors(t):
    none = F.lit(None).cast("array<float>")
    return t.catalog.images.withColumn("clip", none).withColumn("dinov3", none)


@query("m7_complete_images", with_cte(
    "images", """SELECT i.id, CASE WHEN e.vec_id IS NOT NULL THEN 'completed' ELSE status END AS status, e.embedding[1] AS first, e.embedding[64] AS last
    FROM images i LEFT JOIN embeddings e ON e.vec_id = i.id"""))
def m7(t):
    results = t.embeddings.select(c("vec_id").alias("id"), c("embedding").alias("clip"),
                                  F.reverse("embedding").alias("dinov3"))
    return merge.complete_images(with_vectors(t), results).select(
        "id", "status", F.get("clip", F.lit(0)).alias("first"), F.get("dinov3", F.lit(0)).alias("last"))


@query("m8_reset_failed", with_cte(
    "images", """SELECT id, CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') THEN 'pending' ELSE status END AS status, attempt FROM images"""))
def m8(t):
    failed = t.lineitem.where("l_returnflag = 'A'").select(c("l_orderkey").alias("id"))
    return merge.reset_failed(t.catalog.images, failed).select("id", "status", "attempt")


@query("m18_backfill_claimed_at", with_cte(
    "images", """SELECT id, CASE WHEN attempt = 0 AND status = 'processing' THEN 1700000000 WHEN attempt = 0 THEN NULL ELSE epoch(claimed_at)::BIGINT END AS claimed FROM images"""))
def m18(t):
    unknown = t.catalog.images.withColumn("claimed_at", F.when(c("attempt") != 0, c("claimed_at")))
    stamped = merge.backfill_claimed_at(unknown, F.timestamp_seconds(F.lit(1700000000)))
    return stamped.select("id", F.unix_seconds("claimed_at").alias("claimed"))


@query("m19_delete_cascade", with_cte(
    "posts post_images author_posts", """SELECT 'posts' AS t, id AS a, 0 AS b FROM posts WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)
    UNION ALL SELECT 'post_images', post_id, image_id FROM post_images WHERE post_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)
    UNION ALL SELECT 'author_posts', post_id, author_id FROM author_posts WHERE post_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)"""))
def m19(t):
    gone = t.part.where("p_size > 40").select(c("p_partkey").alias("id"))
    cat, _ = merge.delete_cascade(t.catalog, "posts", gone)
    row = lambda name, df, a, b: df.select(F.lit(name).alias("t"), c(a).alias("a"), b.cast("bigint").alias("b"))
    return row("posts", cat.posts, "id", F.lit(0)).union(
        row("post_images", cat.post_images, "post_id", c("image_id"))).union(
        row("author_posts", cat.author_posts, "post_id", c("author_id")))


@query("m19_cascade_rejects", with_cte("wd_tags wd_tag_translations", "SELECT id FROM wd_tags WHERE id IN (SELECT tag_id FROM wd_tag_translations)"))
def m19_rejects(t):
    _, rejects = merge.delete_cascade(t.catalog, "wd_tags", t.catalog.wd_tags.select("id"))
    return rejects


@query("q1_check_rows", """SELECT doc_id, length(text) <= 255 AND trim(text) <> '' AS good, CASE WHEN trim(text) = '' THEN 'title_blank' ELSE '' END ||
    CASE WHEN length(text) > 255 THEN 'title_long' ELSE '' END AS failures FROM documents""")
def q1(t):
    good, rejects = quality.check_rows(t.documents.select("doc_id", c("text").alias("title")), quality.post_rules())
    return good.select("doc_id", F.lit(True).alias("good"), F.lit("").alias("failures")).union(
        rejects.select("doc_id", F.lit(False), F.array_join("failures", "")))


@query("q2_check_unique", with_cte("posts", "SELECT title, count(*) AS n FROM posts GROUP BY 1 HAVING count(*) > 1"))
def q2(t):
    return quality.check_unique(t.catalog.posts, ["title"])


@query("q3_check_refs", "SELECT event_id FROM events WHERE user_id * 11 NOT IN (SELECT c_custkey FROM customer)")
def q3(t):
    child = t.events.select("event_id", (c("user_id") * 11).alias("custkey"))
    return quality.check_refs(child, t.customer, {"custkey": "c_custkey"}).select("event_id")


# favourites: view/click/purchase add a post/image/video, error removes one
LOG_SQL = f"""SELECT (user_id % 5)::VARCHAR AS address, CASE event_type WHEN 'view' THEN 'post' WHEN 'click' THEN 'image' WHEN 'purchase' THEN 'video'
      ELSE ['post', 'image', 'video'][(event_id % 3 + 1)::INT] END AS kind, {K} AS target_id, CASE event_type WHEN 'error' THEN 'remove' ELSE 'add' END AS action,
      floor(epoch(ts))::BIGINT AS created_at, event_id AS seq FROM events WHERE event_type <> 'signup'"""


def like_log(t):
    kind = (F.when(c("event_type") == "view", "post").when(c("event_type") == "click", "image")
            .when(c("event_type") == "purchase", "video")
            .otherwise(F.element_at(F.array(*map(F.lit, ("post", "image", "video"))), (c("event_id") % 3 + 1).cast("int"))))
    return t.events.where("event_type <> 'signup'").select(
        (c("user_id") % 5).cast("string").alias("address"), kind.alias("kind"),
        F.get_json_object("props", "$.k").cast("bigint").alias("target_id"),
        F.when(c("event_type") == "error", "remove").otherwise("add").alias("action"),
        F.unix_seconds(c("ts").cast("timestamp")).alias("created_at"), c("event_id").alias("seq"))


def like_table(t):
    none = t.spark.createDataFrame([], "address string, kind string, target_id bigint, created_at bigint")
    return likes.apply_like_log(none, like_log(t))


LIKES = """SELECT address, kind, target_id, arg_min(created_at, (created_at, seq)) AS created_at FROM log a WHERE action = 'add' AND (created_at, seq) >
    coalesce((SELECT max((r.created_at, r.seq)) FROM log r WHERE r.action = 'remove' AND r.address = a.address AND r.kind = a.kind AND r.target_id = a.target_id), (-1, -1)) GROUP BY ALL"""


@query("m15_apply_like_log", with_cte("", "SELECT * FROM likes", log=LOG_SQL, likes=LIKES))
def m15(t):
    return like_table(t)


@query("j14_liked", with_cte("", """SELECT event_id, kind, target_id, EXISTS (SELECT 1 FROM likes l WHERE l.address = p.address AND l.kind = p.kind AND l.target_id = p.target_id) AS liked
    FROM (SELECT event_id, (user_id % 7)::VARCHAR AS address, 'image' AS kind, event_id % 100 AS target_id FROM events) p""", log=LOG_SQL, likes=LIKES))
def j14(t):
    probe = t.events.select("event_id", (c("user_id") % 7).cast("string").alias("address"),
                            F.lit("image").alias("kind"), (c("event_id") % 100).alias("target_id"))
    return likes.liked(like_table(t), probe).drop("address")


@query("j15_liked_batch", with_cte("", f"""SELECT DISTINCT address, kind || ':' || target_id AS item, NULL::VARCHAR AS error FROM likes JOIN
    (SELECT (user_id % 5)::VARCHAR AS address, unnest(['post', 'image']) AS kind, unnest([{K}, event_id % 100]) AS target_id FROM events) USING (address, kind, target_id)""",
    log=LOG_SQL, likes=LIKES))
def j15(t):
    k = F.get_json_object("props", "$.k")
    asked = t.events.select((c("user_id") % 5).cast("string").alias("address"), F.concat(
        F.lit("post:"), k, F.lit(", image:"), (c("event_id") % 100).cast("string"), F.lit(",bad:1")).alias("items"))
    return likes.liked_batch(like_table(t), asked)


@query("k8_likes_page", with_cte("", """SELECT address, kind, target_id, created_at, rank, CASE WHEN n = 40 THEN oldest END AS next_cursor FROM
    (SELECT *, count(*) OVER (PARTITION BY address) AS n, min(created_at) OVER (PARTITION BY address) AS oldest FROM
     (SELECT *, row_number() OVER (PARTITION BY address ORDER BY created_at DESC, kind, target_id) AS rank FROM likes WHERE kind = 'image' AND created_at < 1706400000) WHERE rank <= 40)""",
    log=LOG_SQL, likes=LIKES))
def k8(t):
    return likes.likes_page(like_table(t), 40, kind="image", cursor=1706400000).drop("next_kind", "next_target_id")


@query("j12_like_previews", with_cte("posts images post_images post_videos", f"""SELECT request_id, pos, kind, id, image_id, name, width, height, title, image_count, video_count FROM
    (SELECT request_id, kind, id, (row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1)::INT AS pos FROM (SELECT request_id, kind, id, min(pos) AS pos FROM (SELECT event_id AS request_id, unnest(['post','image','post','image']) AS kind,
        unnest([k, event_id, event_id % 3000, k * 50]) AS id, unnest(range(4)) AS pos FROM (SELECT event_id, {K} AS k FROM events)) GROUP BY ALL)) w
    JOIN (SELECT 'image' AS kind, id, id AS image_id, name, width, height, NULL AS title, NULL::BIGINT AS image_count, NULL::BIGINT AS video_count FROM images
      UNION ALL SELECT 'post', post_id, image_id, name, coalesce(width, 0), coalesce(height, 0), CASE WHEN trim(title) <> '' THEN title END, nullif(image_count, 0), nullif(video_count, 0) FROM pv) USING (kind, id)""",
    pv="""SELECT p.id AS post_id, p.title, c.image_id, i.name, i.width, i.height, coalesce(c.n, 0) AS image_count, coalesce(v.n, 0) AS video_count FROM posts p
    LEFT JOIN (SELECT post_id, min(image_id) AS image_id, count(*) AS n FROM post_images GROUP BY 1) c ON c.post_id = p.id
    LEFT JOIN images i ON i.id = c.image_id LEFT JOIN (SELECT post_id, count(*) AS n FROM post_videos GROUP BY 1) v ON v.post_id = p.id"""))
def j12(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    word = lambda x: x.cast("string")
    items = F.concat(F.lit("post:"), word(k), F.lit(",image: "), word(c("event_id")), F.lit(",video:3,post:"),
                     word(c("event_id") % 3000), F.lit(",image:"), word(k * 50))
    asked = t.events.select(c("event_id").alias("request_id"), items.alias("items"))
    return likes.like_previews(t.catalog, asked)


# users: one account per customer, logins from the events
USERS_SQL = "SELECT c_custkey::VARCHAR AS address, 1600000000 + c_custkey AS created_at, 1600000000 + c_custkey AS last_login, NULL::VARCHAR AS plan, false AS banned, NULL::VARCHAR AS linked FROM customer"


def users(t):
    at = 1600000000 + c("c_custkey")
    return t.customer.select(c("c_custkey").cast("string").alias("address"), at.alias("created_at"), at.alias("last_login"),
                             F.lit(None).cast("string").alias("plan"), F.lit(False).alias("banned"), F.lit(None).cast("string").alias("linked"))


def at(col="ts"):
    return F.unix_seconds(c(col).cast("timestamp"))


@query("m13_merge_users", f"""SELECT coalesce(u.address, l.address) AS address, coalesce(u.created_at, l.lo) AS created_at, coalesce(l.hi, u.last_login) AS last_login,
    plan, coalesce(banned, false) AS banned, linked FROM ({USERS_SQL}) u FULL JOIN (SELECT (user_id * 11)::VARCHAR AS address, min(floor(epoch(ts))::BIGINT) AS lo, max(floor(epoch(ts))::BIGINT) AS hi FROM events GROUP BY 1) l ON l.address = u.address""")
def m13(t):
    logins = t.events.select((c("user_id") * 11).cast("string").alias("address"), at().alias("at"))
    return ledger.merge_users(users(t), logins)


CHANGES_SQL = f"""SELECT user_id::VARCHAR AS address, CASE event_type WHEN 'view' THEN 'plan' WHEN 'click' THEN 'banned' ELSE 'linked' END AS field,
    CASE event_type WHEN 'view' THEN ['basic', 'pro', NULL][({K} % 3 + 1)::INT] WHEN 'click' THEN ['true', 'false'][({K} % 2 + 1)::INT] ELSE 'sol-' || {K} * 20 + user_id % 20 END AS value, event_id AS seq
    FROM events WHERE event_type IN ('view', 'click', 'purchase')"""


def changes(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = c("event_type")
    value = (F.when(kind == "view", F.element_at(F.array(F.lit("basic"), F.lit("pro"), F.lit(None)), (k % 3 + 1).cast("int")))
             .when(kind == "click", F.when(k % 2 == 0, "true").otherwise("false"))
             .otherwise(F.concat(F.lit("sol-"), (k * 20 + c("user_id") % 20).cast("string"))))
    return t.events.where(kind.isin("view", "click", "purchase")).select(
        c("user_id").cast("string").alias("address"),
        F.when(kind == "view", "plan").when(kind == "click", "banned").otherwise("linked").alias("field"),
        value.alias("value"), c("event_id").alias("seq"))


@query("m14_update_users", with_cte("", """SELECT u.address, u.created_at, u.last_login, CASE WHEN p.address IS NOT NULL THEN p.value ELSE u.plan END AS plan,
    coalesce(b.value = 'true', u.banned) AS banned, CASE WHEN k.address IS NOT NULL THEN k.value ELSE u.linked END AS linked FROM users u
    LEFT JOIN (SELECT * FROM last WHERE field = 'plan') p USING (address) LEFT JOIN (SELECT * FROM last WHERE field = 'banned') b USING (address)
    LEFT JOIN (SELECT * FROM last WHERE field = 'linked' AND value NOT IN (SELECT value FROM last WHERE field = 'linked' GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT * FROM (SELECT arg_min(address, seq) AS address, 'linked', value, min(seq) FROM last WHERE field = 'linked' GROUP BY value HAVING count(*) > 1)) k USING (address)""",
    users=USERS_SQL, last=f"SELECT address, field, arg_max_null(value, seq) AS value, max(seq) AS seq FROM ({CHANGES_SQL}) JOIN (SELECT address FROM users) USING (address) GROUP BY ALL"))
def m14(t):
    updated, _ = ledger.update_users(users(t), changes(t))
    return updated


@query("j21_list_users", f"""SELECT row_number() OVER (ORDER BY last_login DESC, address) AS rank, * FROM (SELECT * FROM ({USERS_SQL}) WHERE address LIKE '1_%' ORDER BY last_login DESC, address LIMIT 200)""")
def j21(t):
    return ledger.list_users(users(t), "1_")


@query("j23_linked_owner", with_cte("", """SELECT DISTINCT u.address, u.linked FROM u JOIN (SELECT 'sol-' || event_id AS linked FROM events) USING (linked)""",
    u="SELECT c_custkey::VARCHAR AS address, 'sol-' || c_custkey * 3 AS linked FROM customer"))
def j23(t):
    owners = users(t).withColumn("linked", F.concat(F.lit("sol-"), (c("address").cast("bigint") * 3).cast("string")))
    probes = t.events.select(F.concat(F.lit("sol-"), c("event_id").cast("string")).alias("linked"))
    return ledger.linked_owner(owners, probes)
