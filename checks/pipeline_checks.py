"""Ingest, scoring, events, telemetry, dispatch: A10-A17, P1-P8, H1-H3, J20, K9."""

import numpy as np
from pyspark.sql import functions as F

from checks.base import joined, query, with_cte
from lumicat.operators import events, ingest, merge, scoring, telemetry
from lumicat.plans.dispatch import search

c = F.col
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#]*$', '') || CASE WHEN page_id % 2 = 0 THEN '.jpg' ELSE '.png' END"


def listing(t):
    """Pages as stored objects: the URL is the path; a page id orders the listing."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[/?#]*$", "")
    ext = F.when(c("page_id") % 2 == 0, ".jpg").otherwise(".png")
    return t.pages.select("page_id", F.concat(path, ext).alias("path"))


def with_dims(t):
    return listing(t).select("path", c("page_id").alias("seq"), (c("page_id") % 900 + 1).cast("int").alias("width"),
                             (c("page_id") % 700 + 1).cast("int").alias("height"))


LISTED = f"""SELECT title, coalesce(nullif(split_part(title, ' ', 1), '/'), 'Unknown') AS author, name, arg_max(page_id % 900 + 1, page_id)::INT AS width, arg_max(page_id % 700 + 1, page_id)::INT AS height
    FROM (SELECT page_id, coalesce(nullif(trim(regexp_extract(p, '^(.*)/[^/]*$', 1), '/'), ''), '/') AS title, substr(p, 1, length(p) - 4) AS name FROM (SELECT page_id, {PATH} AS p FROM pages)) GROUP BY ALL"""


@query("a10_listing_images", LISTED)
def a10(t):
    return ingest.listing_images(with_dims(t)).drop("seq")


@query("a10_metas_from_listing", f"SELECT title, author, count(*) AS images, sum(width)::BIGINT AS widths FROM ({LISTED}) GROUP BY ALL")
def a10_metas(t):
    metas = ingest.metas_from_listing(with_dims(t), 3)
    rows = metas.select("title", c("authors")[0].alias("author"), F.explode("images").alias("i"))
    return rows.groupBy("title", "author").agg(F.count(F.lit(1)).alias("images"), F.sum("i.width").alias("widths"))


@query("m3_merge_metas", with_cte("authors", f"""SELECT 'posts' AS t, count(DISTINCT title) AS n FROM listed UNION ALL SELECT 'images', count(DISTINCT name) FROM listed
    UNION ALL SELECT 'authors', count(DISTINCT author) FROM listed UNION ALL SELECT 'post_images', count(*) FROM (SELECT DISTINCT title, name FROM listed)
    UNION ALL SELECT 'author_posts', count(*) FROM (SELECT DISTINCT title, author FROM listed)""", listed=LISTED))
def m3_metas(t):
    from lumicat.catalog import empty_catalog

    cat = merge.merge_metas(empty_catalog(t.spark), ingest.metas_from_listing(with_dims(t)))
    parts = [getattr(cat, n).agg(F.lit(n).alias("t"), F.count(F.lit(1)).alias("n")).select("t", "n")
             for n in ("posts", "images", "authors", "post_images", "author_posts")]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("p5_plan_conversions", f"""SELECT path, target, CASE WHEN owner IS NOT NULL AND owner <> path THEN 'collision' WHEN NOT here AND stored THEN 'recovered' WHEN NOT here THEN 'missing'
      WHEN k IS NOT NULL AND e = etag THEN 'unchanged' ELSE 'convert' END AS outcome FROM
    (SELECT r.path, r.target, s.path IS NOT NULL AS here, d.target IS NOT NULL AS stored, d.k, d.e, s.etag, coalesce(d.k, CASE WHEN s.path IS NOT NULL THEN f.first END) AS owner
     FROM (SELECT DISTINCT path, target FROM o) r LEFT JOIN (SELECT path, min(etag) AS etag FROM o WHERE page_id % 5 <> 0 GROUP BY 1) s ON s.path = r.path
     LEFT JOIN (SELECT target, arg_min(CASE WHEN page_id % 4 = 0 THEN NULL ELSE path END, page_id) AS ignored, arg_min(path, page_id) AS k, arg_min(CASE WHEN page_id % 2 = 0 THEN etag ELSE 'old' END, page_id) AS e FROM o WHERE page_id % 3 = 0 GROUP BY 1) d ON d.target = r.target
     LEFT JOIN (SELECT target, min(path) AS first FROM o WHERE path IN (SELECT path FROM o WHERE page_id % 5 <> 0) GROUP BY 1) f ON f.target = r.target)""".replace("SELECT path, target, CASE WHEN owner", f"WITH o AS (SELECT page_id, p AS path, substr(p, 1, length(p) - 4) || '.webp' AS target, md5(p) AS etag FROM (SELECT page_id, {PATH} AS p FROM pages)) SELECT path, target, CASE WHEN owner", 1))
def p5(t):
    from lumicat.functions.paths import target_path

    rows = listing(t).withColumn("etag", F.md5("path")).withColumn("target", target_path(c("path"))["target"])
    sources = rows.where("page_id % 5 <> 0").groupBy("path").agg(F.min("etag").alias("etag"))
    stored = rows.where("page_id % 3 = 0").groupBy("target").agg(
        F.min_by("path", "page_id").alias("source_key"),
        F.min_by(F.when(c("page_id") % 2 == 0, c("etag")).otherwise("old"), "page_id").alias("source_etag"))
    return ingest.plan_conversions(rows, sources, stored).drop("key")


@query("p6_same_identity", """SELECT o_orderkey, (o_orderkey % 5 <> 0) AND CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN o_orderkey % 3 = 0 ELSE false END AS same FROM orders""")
def p6(t):
    k = c("o_orderkey")
    etag = F.when(k % 4 < 2, "e")
    other = F.when(k % 4 == 0, "e").when(k % 4 == 1, "f").when(k % 4 == 3, "g")
    rows = t.orders.select("o_orderkey", F.struct(etag.alias("etag"), k.alias("modified"), F.lit(1).alias("length")).alias("a"),
                           F.struct(other.alias("etag"), F.when(k % 3 == 0, k).alias("modified"), F.when(k % 5 == 0, 2).otherwise(1).alias("length")).alias("b"))
    return rows.select("o_orderkey", ingest.same_identity("a", "b").alias("same"))


def upper_codec(content: bytes):
    """A stand-in codec: the width is the length; text that starts with a vowel breaks."""
    if content[:1].lower() in b"aeiou":
        raise ValueError("not a picture")
    return content.upper(), len(content), 1


def converted(t):
    rows = t.documents.select(F.concat(F.lit("docs/"), c("doc_id").cast("string"), F.lit(".png")).alias("path"), c("text").cast("binary").alias("content"))
    return ingest.convert_objects(rows, upper_codec)


@query("p7_convert_objects", """SELECT 'docs/' || doc_id || '.webp' AS target, CASE WHEN b THEN 'failed' ELSE 'converted' END AS outcome, CASE WHEN NOT b THEN strlen(text)::INT END AS width, CASE WHEN b THEN 'not a picture' END AS error
    FROM (SELECT doc_id, text, lower(substr(text, 1, 1)) IN ('a', 'e', 'i', 'o', 'u') AS b FROM documents)""")
def p7(t):
    return converted(t).select("target", "outcome", "width", "error")


@query("a13_scan_summary", """SELECT count(*) FILTER (NOT b) AS converted, count(*) FILTER (b) AS failed, array_to_string((list(path || ': not a picture' ORDER BY path) FILTER (b))[1:3], '|') AS examples
    FROM (SELECT 'docs/' || doc_id || '.png' AS path, lower(substr(text, 1, 1)) IN ('a', 'e', 'i', 'o', 'u') AS b FROM documents)""")
def a13(t):
    return joined(ingest.scan_summary(converted(t)), "examples")


@query("a12_write_stats", """SELECT (doc_id // 50) AS batch, count(*) FILTER (NOT b) AS completed, count(*) FILTER (b) AS failed
    FROM (SELECT doc_id, lower(substr(text, 1, 1)) IN ('a', 'e', 'i', 'o', 'u') AS b FROM documents) GROUP BY 1""")
def a12(t):
    doc = F.regexp_extract("path", r"(\d+)", 1).cast("bigint")
    return ingest.write_stats(converted(t).withColumn("batch", F.floor(doc / 50)))


@query("p8_extract_aliases", """SELECT page_id, array_to_string(regexp_extract_all(html, '<ul><li><a href="[^"]*">([^<]*)</a>|<li><a href="[^"]*">([^<]*)</a>', 2), '|') AS aliases FROM (SELECT page_id, replace(html, '<ul><li>', '<ul> <li>') AS html FROM pages)""")
def p8(t):
    rule = ingest.AnchorRule(parents=(("ul", None), ("li", None)), class_prefix="")
    rows = ingest.extract_aliases(t.pages, rule, "page_id")
    return joined(rows, "translations").withColumnRenamed("translations", "aliases")


@query("j20_untranslated", with_cte("wd_tags wd_tag_translations", "SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || tag_id FROM wd_tag_translations)"))
def j20(t):
    vocabulary = t.part.select(c("p_brand").alias("name")).distinct()
    known = t.catalog.wd_tag_translations.select(F.concat(F.lit("Brand#"), c("tag_id").cast("string")).alias("name"))
    return ingest.untranslated(vocabulary, known)


@query("p1_claim_work", with_cte("images", """SELECT id, status, attempt, claimed FROM (SELECT i.id, CASE WHEN p.id IS NOT NULL THEN 'processing' ELSE status END AS status,
      (attempt + CASE WHEN p.id IS NOT NULL THEN 1 ELSE 0 END)::INT AS attempt, CASE WHEN p.id IS NOT NULL THEN 800000000 ELSE epoch(claimed_at)::BIGINT END AS claimed FROM images i LEFT JOIN picked p ON p.id = i.id)""",
    picked="""SELECT id FROM (SELECT id, CASE status WHEN 'pending' THEN 0 ELSE 1 END AS pr FROM images WHERE attempt <= 5 AND (status = 'pending' OR (status = 'processing' AND epoch(claimed_at) < 800000000 - 1800)))
      ORDER BY pr, id LIMIT (SELECT count(*) // 2 FROM orders)"""))
def p1(t):
    images = t.catalog.images.select("id", "name", "status", "attempt", "claimed_at")
    _, after = scoring.claim_work(images, images.count() // 2, 1800, F.timestamp_seconds(F.lit(800000000)))
    return after.select("id", "status", "attempt", F.unix_seconds("claimed_at").alias("claimed"))


@query("u3_claim_order", with_cte("images", """SELECT id, name, pr AS priority FROM (SELECT id, name, (CASE status WHEN 'pending' THEN 0 ELSE 1 END)::INT AS pr FROM images
    WHERE attempt <= 5 AND (status = 'pending' OR (status = 'processing' AND epoch(claimed_at) < 800000000 - 1800))) ORDER BY pr, id LIMIT 500"""))
def u3(t):
    images = t.catalog.images.select("id", "name", "status", "attempt", "claimed_at")
    claimed, _ = scoring.claim_work(images, 500, 1800, F.timestamp_seconds(F.lit(800000000)))
    return claimed


def load_scorer():
    """A deterministic stand-in model: numbers derived from the content length."""
    def score(rows):
        out = []
        for row in rows:
            n = len(row["content"])
            out.append(scoring.Scores([(f"NATION_{n % 40}", n % 100 / 100)], [float(n), 1.0], [1.0, float(n)]))
        return out

    return score


def scored(t):
    rows = t.documents.select(c("doc_id").alias("id"), c("text").cast("binary").alias("content"),
                              F.when(c("doc_id") % 10 == 0, "object not found").alias("error"))
    return scoring.score_batches(rows, load_scorer, 4, "stand-in")


@query("p2_score_batches", """SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 0 THEN 'NATION_' || strlen(text) % 40 END AS tag, CASE WHEN doc_id % 10 <> 0 THEN strlen(text)::FLOAT END AS clip,
    CASE WHEN doc_id % 10 = 0 THEN 'object not found' END AS error FROM documents""")
def p2(t):
    return scored(t).select("id", F.get("tags", F.lit(0))["name"].alias("tag"), F.get("clip", F.lit(0)).alias("clip"), "error")


@query("p4_record_results", with_cte("images wd_tag_images", """SELECT 'completed' AS what, count(*) AS n FROM images LEFT JOIN documents ON doc_id = id WHERE (doc_id IS NOT NULL AND doc_id % 10 <> 0) OR ((doc_id IS NULL) AND status = 'completed')
    UNION ALL SELECT 'pending', count(*) FROM images LEFT JOIN documents ON doc_id = id WHERE (doc_id % 10 = 0) OR (doc_id IS NULL AND status = 'pending')
    UNION ALL SELECT 'scores', count(*) FROM (SELECT wd_tag_id, image_id FROM wd_tag_images UNION SELECT CASE WHEN n < 25 THEN n ELSE n + 100 END, doc_id FROM (SELECT doc_id, strlen(text) % 40 AS n FROM documents WHERE doc_id % 10 <> 0))
    UNION ALL SELECT 'tags', count(*) FROM (SELECT n_name FROM nation UNION SELECT 'NATION_' || strlen(text) % 40 FROM documents WHERE doc_id % 10 <> 0)"""))
def p4(t):
    none = F.lit(None).cast("array<float>")
    images = t.catalog.images.withColumn("clip", none).withColumn("dinov3", none)
    cat = scoring.record_results(t.catalog.with_(images=images), scored(t))
    by_status = cat.images.where("status <> 'processing'").groupBy(c("status").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    count = lambda n, df: df.agg(F.lit(n).alias("what"), F.count(F.lit(1)).alias("n")).select("what", "n")
    return by_status.union(count("scores", cat.wd_tag_images)).union(count("tags", cat.wd_tags))


def byte_picture(content: bytes) -> np.ndarray:
    """A stand-in decoder: the bytes as a grey picture of eight columns."""
    grey = np.frombuffer(content[: len(content) // 8 * 8], "uint8").reshape(-1, 8)
    if grey.size == 0:
        raise ValueError("empty picture")
    return np.repeat(grey[:, :, None], 3, axis=2)


@query("p3_prepare_inputs", """SELECT vec_id AS id, (384)::INT AS n_letterbox, 192 AS n_chw, NULL::VARCHAR AS error, round((vec_id % 200) / 255.0 * 2 - 1, 4)::DOUBLE AS first FROM embeddings""")
def p3(t):
    content = F.unhex(F.repeat(F.lpad(F.hex((c("vec_id") % 200).cast("bigint")), 2, "0"), 64))
    rows = t.embeddings.select(c("vec_id").alias("id"), content.alias("content"))
    specs = {"box": scoring.InputSpec(8, True), "chw": scoring.InputSpec(8, mean=(0.5,) * 3, std=(0.5,) * 3)}
    made = scoring.prepare_inputs(rows, specs, byte_picture)
    return made.select("id", (F.size("box") * 2).alias("n_letterbox"), F.size("chw").alias("n_chw"), "error",
                       F.round(c("chw")[0].cast("double"), 4).alias("first"))


# access log: one request per event
def requests(t):
    k = F.get_json_object("props", "$.k")
    kind = c("event_type")
    path = (F.when(kind == "view", F.concat(F.lit("/images/"), k)).when(kind == "click", "/api/search_similar")
            .when(kind == "purchase", "/api/search_by_image").when(kind == "signup", "/api/search_by_desc").otherwise("/imagesx/1"))
    body = (F.when(kind == "click", F.concat(F.lit("x=1&q="), k)).when(kind == "purchase", F.concat(F.lit("image=a+b%2F"), k))
            .when(c("event_id") % 3 == 0, F.concat(F.lit("q=%zz"), k)).when(c("event_id") % 3 == 1, "q=1&q=2").otherwise(F.concat(F.lit("q=caf%C3%A9+"), k)))
    return t.events.select("event_id", F.when(kind.isin("view", "error"), "GET").otherwise("POST").alias("method"), path.alias("path"),
                           F.when(c("event_id") % 5 == 0, "application/json").otherwise(" Application/X-WWW-form-urlencoded ; charset=utf-8").alias("content_type"), body.alias("body"))


@query("h1_classify_requests", f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'unmetered' WHEN bad THEN 'bad request' ELSE 'metered' END AS outcome,
    CASE WHEN event_type <> 'error' AND NOT bad THEN CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'similar' WHEN 'purchase' THEN 'upload' ELSE 'description' END END AS kind,
    CASE WHEN event_type <> 'error' AND NOT bad THEN CASE event_type WHEN 'view' THEN '/images/' || k WHEN 'click' THEN 'search:sim:' || k WHEN 'purchase' THEN 'search:img:' || substr(sha256('a b/' || k), 1, 32) ELSE 'search:desc:café ' || k END END AS key
    FROM (SELECT *, {K} AS k, event_type NOT IN ('view', 'error') AND (event_id % 5 = 0 OR (event_type = 'signup' AND event_id % 3 <> 2)) AS bad FROM events)""")
def h1(t):
    return events.classify_requests(requests(t)).select("event_id", "outcome", "kind", "key")


def messages(t):
    """Queue messages made of the page listing: all content types and failure modes."""
    p = c("path")
    event = F.to_json(F.struct(F.when(c("page_id") % 4 == 0, "other").otherwise("main").alias("bucket"),
                               F.element_at(F.array(*map(F.lit, ("PutObject", "DeleteObject", "Rename"))), (c("page_id") % 3 + 1).cast("int")).alias("action"),
                               F.struct(p.alias("key")).alias("object")))
    bare = F.to_json(F.struct(p.alias("key")))
    quote = lambda x: F.to_json(F.struct(x.alias("v")))
    text = lambda x: F.regexp_extract(quote(x), r'^\{"v":(.*)\}$', 1)
    r = c("page_id") % 8
    b64 = lambda x: F.rtrim(F.regexp_replace(F.base64(x.cast("binary")), "[\r\n=]", ""))
    body = (F.when(r == 0, event).when(r == 1, text(bare)).when(r == 2, text(b64(bare))).when(r == 3, text(b64(p)))
            .when(r == 4, text(p)).when(r == 5, F.lit("123")).when(r == 6, text(F.concat(F.lit("a//"), p))).otherwise(event))
    kind = F.when(r.isin(1, 2), "JSON").when(r == 3, "bytes").when(r == 7, "v8")
    meta = F.when(kind.isNotNull(), F.create_map(F.lit("CF-Content-Type"), kind)).otherwise(F.create_map().cast("map<string,string>"))
    return listing(t).select("page_id", p, (c("page_id") % 4).cast("int").alias("attempts"), meta.alias("metadata"), body.alias("body"))


H2 = f"""SELECT page_id, CASE WHEN r IN (5, 6, 7) THEN 'malformed' WHEN r = 0 AND page_id % 4 = 0 THEN 'ignore' WHEN r = 0 AND page_id % 3 = 1 THEN 'ignore' WHEN r = 0 AND page_id % 3 = 2 THEN 'malformed' ELSE 'convert' END AS action, path, page_id % 4 AS attempts
    FROM (SELECT page_id, page_id % 8 AS r, {PATH} AS path FROM pages)"""


@query("h2_classify_object_events", f"SELECT page_id, action, CASE WHEN action = 'convert' THEN path END AS key FROM ({H2})")
def h2(t):
    return events.classify_object_events(messages(t), "main").select("page_id", "action", "key")


@query("h3_route_events", f"""SELECT page_id, CASE WHEN action = 'malformed' THEN CASE WHEN attempts >= 3 THEN 'dead letter' ELSE 'retry' END WHEN action = 'convert' THEN 'work' ELSE 'done' END AS route,
    CASE WHEN action = 'malformed' AND attempts < 3 THEN 15 END AS delay_seconds FROM ({H2})""")
def h3(t):
    return events.route_events(events.classify_object_events(messages(t), "main"), 3).select("page_id", "route", "delay_seconds")


# pipeline phases: each user is an item that moves on with every event
PHASED = f"""SELECT user_id AS item, ['claim','download','decode_queue','decode','infer_queue','infer','record_queue','write'][({K} % 8 + 1)::INT] AS phase, floor(epoch(ts))::BIGINT AS sec, event_id AS seq FROM events"""


def phased(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(c("user_id").alias("item"), F.element_at(F.array(*map(F.lit, telemetry.PHASES)), k % 8 + 1).alias("phase"),
                           F.unix_seconds(c("ts").cast("timestamp")).alias("at"), c("event_id").alias("seq"))


@query("a14_histogram", """SELECT event_type, bucket, count(*) AS n, round(sum(value), 2) AS total, [0.01,0.025,0.05,0.1,0.25,0.5,1.0,2.5,5.0,10.0,20.0,30.0,60.0,120.0,300.0][bucket + 1]::DOUBLE AS upper FROM
    (SELECT event_type, value, (len(list_filter([0.01,0.025,0.05,0.1,0.25,0.5,1.0,2.5,5.0,10.0,20.0,30.0,60.0,120.0,300.0], lambda b: b::DOUBLE < value)))::INT AS bucket FROM events) GROUP BY ALL""")
def a14(t):
    return telemetry.histogram(t.events, "value", telemetry.PHASE_BOUNDS, ["event_type"]).withColumn("total", F.round("total", 2))


@query("a16_phase_durations", f"SELECT item, phase, sec AS at_sec, seq, lead(sec) OVER (PARTITION BY item ORDER BY sec, seq) - sec AS seconds FROM ({PHASED})")
def a16(t):
    return telemetry.phase_durations(phased(t)).select("item", "phase", c("at").alias("at_sec"), "seq", "seconds")


@query("a15_phase_occupancy", with_cte("", """SELECT phase, sec AS at_sec, change, sum(change) OVER (PARTITION BY phase ORDER BY sec)::BIGINT AS items FROM
    (SELECT phase, sec, sum(d)::BIGINT AS change FROM (SELECT phase, sec, 1 AS d FROM stays UNION ALL SELECT phase, left_at, -1 FROM stays WHERE left_at IS NOT NULL) GROUP BY ALL)""",
    stays=f"SELECT *, lead(sec) OVER (PARTITION BY item ORDER BY sec, seq) AS left_at FROM ({PHASED})"))
def a15(t):
    return telemetry.phase_occupancy(phased(t)).select("phase", c("at").alias("at_sec"), "change", "items")


@query("a17_resource_rollup", """SELECT floor(epoch(ts) / 10)::BIGINT * 10 AS start, 'host-' || user_id % 3 AS host, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS device, 'load' AS metric,
    round(avg(value), 6) AS mean, max(value) AS peak, count(*) AS n FROM events GROUP BY ALL""")
def a17(t):
    samples = t.events.select(F.concat(F.lit("host-"), (c("user_id") % 3).cast("string")).alias("host"),
                              F.when(c("event_type") != "view", c("event_type")).alias("device"), F.lit("load").alias("metric"),
                              c("ts").cast("timestamp").alias("ts"), "value")
    rows = telemetry.resource_rollup(samples)
    return rows.withColumn("start", F.unix_seconds("start")).withColumn("mean", F.round("mean", 6))


@query("k9_search", with_cte("posts", """SELECT 'title' AS mode, rank, id, title FROM (SELECT row_number() OVER (ORDER BY id DESC) AS rank, id, title FROM posts WHERE title ILIKE '%bolt%' ORDER BY id DESC LIMIT 50)
    UNION ALL SELECT 'newest', rank, id, title FROM (SELECT row_number() OVER (ORDER BY id DESC) AS rank, id, title FROM posts ORDER BY id DESC LIMIT 1)"""))
def k9(t):
    titles = search(t.catalog, "title", "bolt").withColumn("mode", F.lit("title"))
    return titles.unionByName(search(t.catalog, "nonsense", "", limit=0).withColumn("mode", F.lit("newest")))
