"""Streaming jobs over files that Spark writes from the tables: S1, S6, S7, M20, M21, H3, H6, H15, H16."""

import uuid

from pyspark.sql import functions as F

from checks import pipeline_checks as pc
from checks.base import query, with_cte
from checks.merge_checks import LIKES, LOG_SQL, like_log
from checks.metering_checks import H11, full_log, revisions
from lumicat.operators import events, ingest
from lumicat.session import checkpoint_dir
from lumicat.sources import files, snapshots
from lumicat.streaming import metering as metering_stream
from lumicat.streaming import sinks

c = F.col


def folder(t) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


FEED_ROWS = 1_600_000  # rows of a file, about: a micro-batch of the metering stream reads one


def feed(t, rows, path: str, by: str, parts: int = 3, most: int | None = None) -> None:
    """Write rows as JSON files in order of ``by``, one folder-append per part; parts of equal size, about ``most`` rows, where there are more rows."""
    bounds = rows.agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count(by).alias("n")).first()
    if most and bounds["n"] > most:
        parts = max(parts, -(-bounds["n"] // most))
        cuts = sorted(set(map(int, rows.approxQuantile(by, [i / parts for i in range(1, parts)], 0.2 / parts))))
        place = F.size(F.filter(F.lit(cuts), lambda x: x <= c(by)))
        rows.where(c(by).isNotNull()).withColumn("__part", place).repartition("__part").write.partitionBy("__part").parquet(f"{path}-parts")
        made = {r[0] for r in t.spark.read.parquet(f"{path}-parts").select("__part").distinct().collect()}  # one number per part
        for i in sorted(made):
            t.spark.read.schema(rows.schema).parquet(f"{path}-parts/__part={i}").coalesce(1).write.mode("append").json(path)
        return
    step = (bounds["hi"] - bounds["lo"]) // parts + 1
    for i in range(parts):
        low = bounds["lo"] + i * step
        part = rows.where((c(by) >= low) & (c(by) < low + step))
        part.coalesce(1).write.mode("append").json(path)


def drained(stream_query, t, path: str):
    stream_query.awaitTermination()
    return t.spark.read.parquet(path)


@query("h6_meter_stream", H11 + """SELECT account, event_id, ts, status::INT AS status, source, charged, cost, deducted,
    shown AS balance, vr AS views_remaining, sr AS searches_remaining, reset AS window_reset FROM run WHERE rn > 0""")
def h6_stream(t):
    root, rows = folder(t), snapshots.stage(full_log(t))
    feed(t, rows, f"{root}/in", "ts", most=FEED_ROWS)
    log = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(f"{root}/in")
    out = metering_stream.meter_stream(log, snapshots.stage(revisions(t)))  # not worked out again for each micro-batch
    return drained(sinks.write_stream(out, f"{root}/out", f"{root}/ckpt"), t, f"{root}/out")


@query("h15_likes_stream", with_cte("", "SELECT * FROM likes", log=LOG_SQL, likes=LIKES))
def h15(t):
    root, rows = folder(t), like_log(t)
    feed(t, rows, f"{root}/in", "created_at")
    log = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(f"{root}/in")
    sinks.likes_stream(log, f"{root}/likes", f"{root}/ckpt").awaitTermination()
    return sinks.read_likes(t.spark, f"{root}/likes")


@query("h16_scoring_rounds", with_cte("images wd_tag_images", """SELECT id, CASE WHEN NOT mine THEN status WHEN id % 8 = 5 THEN 'pending' ELSE 'completed' END AS status,
    (attempt + CASE WHEN mine THEN 1 ELSE 0 END)::INT AS attempt, CASE WHEN mine AND id % 8 <> 5 THEN (id % 97)::DOUBLE END AS clip,
    coalesce(n, 0) + CASE WHEN mine AND id % 8 <> 5 THEN 1 ELSE 0 END AS scores
    FROM (SELECT *, status IN ('pending', 'processing') AND attempt <= 5 AS mine FROM images)
    LEFT JOIN (SELECT image_id AS id, count(*) AS n FROM wd_tag_images GROUP BY ALL) USING (id)"""))
def h16(t):
    """Rounds over all images that wait or have got stuck; those on their last attempt fail."""
    tables = sinks.ScoringTables(t.spark, folder(t), 16)
    tables.begin(t.catalog)
    vector = F.array((c("id") % 97).cast("float"))
    bad = c("id") % 8 == 5

    def score(rows):
        tags = F.array(F.struct(F.concat(F.lit("model "), (c("id") % 40).cast("string")).alias("name"), F.lit(0.5).cast("float").alias("score")))
        return rows.select("id", tags.alias("tags"), vector.alias("clip"), vector.alias("dinov3"), F.when(bad, "device lost").alias("error"))

    waiting = t.catalog.images.where(c("status").isin("pending", "processing")).count()
    tables.run(score, waiting // 2 + 1)
    counts = tables.scores.read().groupBy(c("image_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return tables.images().join(counts, "id", "left").select(
        "id", "status", "attempt", F.get("clip", F.lit(0)).cast("double").alias("clip"), F.coalesce("n", F.lit(0)).cast("bigint").alias("scores"))


@query("s6_object_event_stream", f"""SELECT page_id, CASE WHEN action = 'malformed' THEN CASE WHEN attempts >= 3 THEN 'dead letter' ELSE 'retry' END WHEN action = 'convert' THEN 'work' ELSE 'done' END AS route FROM ({pc.H2})""")
def s6(t):
    root = folder(t)
    fields = [F.to_json(F.struct(c("page_id").cast("string").alias("id"), "attempts", "metadata")), F.lit('"body":'), c("body")]
    line = F.concat(F.regexp_replace(fields[0], r"\}$", ""), F.lit(","), fields[1], fields[2], F.lit("}"))
    pc.messages(t).select(line.alias("value")).write.text(f"{root}/in")
    stream = files.read_object_events(t.spark, f"{root}/in", 4)
    sinks.route_stream(stream, f"{root}/out", f"{root}/ckpt", "main", 3).awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select(c("id").cast("bigint").alias("page_id"), "route")


@query("s7_access_log", """SELECT event_id, CASE event_type WHEN 'view' THEN 'metered' WHEN 'error' THEN 'unmetered' ELSE CASE WHEN event_id % 5 = 0 OR (event_type = 'signup' AND event_id % 3 <> 2) THEN 'bad request' ELSE 'metered' END END AS outcome FROM events""")
def s7(t):
    root = folder(t)
    pc.requests(t).write.json(f"{root}/in")
    out = events.classify_requests(files.read_access_log(t.spark, f"{root}/in", stream=True)).select("event_id", "outcome")
    return drained(sinks.write_stream(out, f"{root}/out", f"{root}/ckpt"), t, f"{root}/out")


@query("s1_read_metas", f"SELECT title, author, name, width, height FROM ({pc.LISTED})")
def s1(t):
    root = folder(t)
    snapshots.write_metas(ingest.metas_from_listing(pc.with_dims(t), 5), f"{root}/metas")
    rows = files.read_metas(t.spark, f"{root}/metas")
    return rows.select("title", F.get("authors", F.lit(0)).alias("author"), F.inline("images"))


@query("s2_read_translations", "SELECT p_brand AS name, p_type AS translation, count(*) AS n FROM part GROUP BY ALL")
def s2(t):
    root = folder(t)
    t.part.select(c("p_brand").alias("name"), F.array("p_type").alias("translations")).write.json(f"{root}/in")
    rows = files.read_translations(t.spark, f"{root}/in").select("name", F.explode("translations").alias("translation"))
    return rows.groupBy("name", "translation").agg(F.count(F.lit(1)).alias("n"))


@query("s4_list_objects", "SELECT 'brand=' || p_brand AS folder, count(DISTINCT p_brand) AS n FROM part GROUP BY ALL")
def s4(t):
    rows = files.list_objects(t.spark, stored_objects(t)).where(c("path").contains("part-"))
    decoded = F.try_url_decode(F.split_part("path", F.lit("/"), F.lit(1)))
    return rows.groupBy(decoded.alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def stored_objects(t) -> str:
    """One text object per brand, below a folder of its own."""
    root = folder(t)
    t.part.select("p_name", c("p_brand").alias("brand")).repartition("brand").write.partitionBy("brand").text(f"{root}/objects")
    return f"{root}/objects"


@query("s5_read_objects", """SELECT 'brand=' || p_brand AS folder, NULL::VARCHAR AS error, sum(strlen(p_name) + 1)::BIGINT AS bytes FROM part GROUP BY 1
    UNION ALL SELECT n_name, 'object not found', NULL FROM nation""")
def s5(t):
    root = stored_objects(t)
    listed = files.list_objects(t.spark, root).where(c("path").endswith(".txt"))
    names = listed.select(F.regexp_replace("path", r"\.txt$", "").alias("name")).union(t.nation.select("n_name"))
    rows = files.read_objects(t.spark, names.withColumn("id", F.xxhash64("name")), root, ".txt")
    place = F.try_url_decode(F.split_part("name", F.lit("/"), F.lit(1)))
    return rows.groupBy(place.alias("folder"), "error").agg(F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


@query("s3_read_vocabulary", """SELECT (row_number() OVER (ORDER BY p_brand) - 1)::INT AS tag_index, p_brand AS name, n % 2 = 0 AS is_character FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)""")
def s3(t):
    root = folder(t)
    brands = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    rows = brands.select(c("n").alias("tag_id"), c("p_brand").alias("name"), F.when(c("n") % 2 == 0, 4).otherwise(0).alias("category"))
    rows.orderBy("name").coalesce(1).write.csv(f"{root}/tags", header=True)
    vocabulary = files.read_vocabulary(t.spark, f"{root}/tags", brands.count())
    return files.vocabulary_table(t.spark, vocabulary)


@query("m20_catalog_snapshot", with_cte("authors tag_posts posts", """SELECT 'authors' AS t, count(*) AS n, sum(id)::BIGINT AS ids FROM authors
    UNION ALL SELECT 'posts', count(*), sum(id)::BIGINT FROM posts UNION ALL SELECT 'tag_posts', count(*), sum(post_id)::BIGINT FROM tag_posts"""))
def m20(t):
    root = folder(t)
    tables = ["authors", "posts", "tag_posts"]
    snapshots.write_catalog(t.catalog, root, t.spark, tables[:1])
    snapshots.write_catalog(t.catalog, root, t.spark, tables)
    stored = snapshots.read_catalog(t.spark, root)
    rows = [getattr(stored, n).agg(F.lit(n).alias("t"), F.count(F.lit(1)).alias("n"), F.sum(k).alias("ids")).select("t", "n", "ids")
            for n, k in zip(tables, ("id", "id", "post_id"))]
    return rows[0].union(rows[1]).union(rows[2])
