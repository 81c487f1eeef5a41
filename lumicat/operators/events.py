"""H1-H3: access-log requests and object events, classified with built-in
expressions only, so they work on tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.functions.hashing import resource_key
from lumicat.functions.money import let
from lumicat.functions.paths import convertible, decode_form, segment_prefix, valid_key
from lumicat.functions.text import trim_unicode

c = F.col
# fixed values: search endpoints (path, charge kind, form field, key prefix)
SEARCHES = (
    ("/api/search_similar", "similar", "q", "search:sim:"),
    ("/api/search_by_image", "upload", "image", "search:img:"),
    ("/api/search_by_desc", "description", "q", "search:desc:"),
)
FORM_TYPE = "application/x-www-form-urlencoded"
CREATE_ACTIONS = ("PutObject", "CopyObject", "CompleteMultipartUpload")
DROP_ACTIONS = ("LifecycleDeletion", "AbortMultipartUpload")
RETRY_SECONDS = 15


def form_field(body: Column, name: Column) -> Column:
    """The value of a form field that occurs exactly once in a well-formed body."""
    pairs = F.filter(F.split(body, "&", -1), lambda p: p != "")
    parts = F.transform(pairs, lambda p: F.struct(
        decode_form(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("k"),
        p.contains("=").alias("ok"),
        F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1).alias("v"),
    ))

    def pick(fields: Column) -> Column:
        sound = F.forall(fields, lambda f: f["ok"] & f["k"].isNotNull())
        hits = F.filter(fields, lambda f: f["k"] == name)
        return F.when(sound & (F.size(hits) == 1), decode_form(F.get(hits, F.lit(0))["v"]))

    return let(parts, pick)


def classify_requests(log: DataFrame) -> DataFrame:
    """H1: adds ``outcome`` (metered, unmetered, bad request), ``kind`` and ``key``."""
    media = F.when(segment_prefix(c("path"), "/images"), "image").when(
        segment_prefix(c("path"), "/videos"), "video"
    )
    is_read = c("method").isin("GET", "HEAD")
    is_post = c("method") == "POST"

    def endpoint(i: int) -> Column:
        return F.coalesce(*[F.when(c("path") == s[0], F.lit(s[i])) for s in SEARCHES])

    kind = F.when(is_read, media).when(is_post, endpoint(1))
    form = F.lower(trim_unicode(F.split_part("content_type", F.lit(";"), F.lit(1)))) == FORM_TYPE
    search = is_post & kind.isNotNull()
    value = F.when(search & form, form_field(c("body"), endpoint(2)))
    rows = log.withColumn("kind", kind).withColumn("__value", value)
    found = c("kind").isNotNull()
    bad = found & ~is_read & c("__value").isNull()
    plain = F.when(c("kind") == "upload", resource_key(c("__value"))).otherwise(c("__value"))
    key = F.when(is_read, c("path")).otherwise(F.concat(endpoint(3), plain))
    outcome = F.when(~found, "unmetered").when(bad, "bad request").otherwise("metered")
    rows = rows.withColumn("outcome", outcome)
    metered = c("outcome") == "metered"
    return rows.withColumn("key", F.when(metered, key)).withColumn(
        "kind", F.when(metered, c("kind"))
    ).drop("__value")


# --------------------------------------------------------------- object events
def _decode64(text: Column) -> Column:
    """Padded or unpadded base64 of UTF-8 text."""
    bare = F.regexp_replace(trim_unicode(text), "=+$", "")
    sound = bare.rlike("^[A-Za-z0-9+/]*$") & (F.length(bare) % 4 != 1)
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
    raw = F.try_to_binary(F.when(sound, padded), F.lit("base64"))
    return F.try_validate_utf8(raw.cast("string"))


def _unquote(text: Column) -> Column:
    """The text of a JSON string literal."""
    return F.try_variant_get(F.try_parse_json(text), "$", "string")


def classify_object_events(df: DataFrame, bucket: str | None = None) -> DataFrame:
    """H2: adds ``action`` (convert, ignore, malformed), ``key`` and ``reason``.

    ``body`` is JSON text, ``metadata`` names the content type: json, text, bytes
    (base64) or nothing. A body is reduced to an object or to a bare key first.
    """
    names = ("cf-content-type", "contenttype", "content_type")
    declared = F.map_values(F.map_filter("metadata", lambda k, v: F.lower(k).isin(*names)))
    kind = F.lower(F.get(F.coalesce(declared, F.array().cast("array<string>")), F.lit(0)))
    rows = df.withColumn("__type", kind).withColumn("__text", F.when(
        c("body").startswith('"'), _unquote(c("body")))).withColumn("__b64", _decode64(c("__text")))
    is_text, is_object = c("__text").isNotNull(), c("body").startswith("{")
    lead = lambda x: F.substring(F.ltrim(F.regexp_replace(x, r"^\s+", "")), 1, 1)
    unknown = c("__type").isNotNull() & ~c("__type").isin("json", "text", "bytes")
    json_text = F.when(lead(c("__text")).isin("{", '"'), c("__text")).otherwise(c("__b64"))
    wrapped = F.try_parse_json(F.when(lead(c("__b64")) == "{", c("__b64")))
    wraps_event = (lead(c("__text")) != "{") & F.coalesce(*[
        F.when(F.try_variant_get(wrapped, f"$.{f}", "variant").isNotNull(), True)
        for f in ("key", "object", "action")
    ])
    # JSON value to look at, and bare text to look at
    value = (
        F.when(unknown, None)
        .when((c("__type") == "bytes"), None)
        .when(is_object, c("body"))
        .when(is_text & (c("__type") == "json"), json_text)
        .when(is_text & wraps_event, c("__b64"))
    )
    text = (
        F.when(unknown, None)
        .when(c("__type") == "bytes", c("__b64"))
        .when(is_text & F.coalesce(c("__type") != "json", F.lit(True)) & ~F.coalesce(wraps_event, F.lit(False)), c("__text"))
    )
    rows = rows.withColumn("__json", value).withColumn("__plain", text)
    plain = F.coalesce("__plain", F.when(lead(c("__json")) == '"', _unquote(c("__json"))))
    rows = rows.withColumn("__plain", plain).withColumn("__object", F.try_parse_json(
        F.when(lead(c("__plain")) == "{", c("__plain")).when(lead(c("__json")) == "{", c("__json"))))

    def at(path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(c("__object"), path, kind)

    def text_at(path: str) -> Column:  # only a JSON string counts
        return F.when(F.schema_of_variant(at(path)) == "STRING", at(path, "string"))

    event = at("$.object").isNotNull() | at("$.action").isNotNull()
    done = text_at("$.action")
    mismatch = F.lit(False) if bucket is None else text_at("$.bucket") != bucket
    ignored = (
        F.when(event & F.coalesce(mismatch, F.lit(False)), "bucket mismatch")
        .when(event & (done.startswith("Delete") | done.isin(*DROP_ACTIONS)), "no create action")
    )
    broken = event & (
        (at("$.bucket").isNotNull() & text_at("$.bucket").isNull())
        | (at("$.action").isNotNull() & ~F.coalesce(done.isin(*CREATE_ACTIONS), F.lit(False)))
    )
    named = F.when(event, text_at("$.object.key")).otherwise(text_at("$.key"))
    bare = F.when((lead(c("__plain")) != "{"), c("__plain"))
    key = F.when(c("__object").isNotNull(), F.when(~broken, named)).otherwise(bare)
    bad_bucket = event & at("$.bucket").isNotNull() & text_at("$.bucket").isNull()
    rows = rows.withColumn("reason", F.when(~F.coalesce(bad_bucket, F.lit(False)), ignored)).withColumn(
        "__key", F.when(valid_key(key), key))
    action = F.when(c("reason").isNotNull(), "ignore").when(c("__key").isNotNull(), "convert").otherwise("malformed")
    return rows.withColumn("action", action).withColumn(
        "key", F.when(c("action") == "convert", c("__key"))
    ).drop("__type", "__text", "__b64", "__json", "__plain", "__object", "__key")


def route_events(classified: DataFrame, max_attempts: int) -> DataFrame:
    """H3: adds ``route`` (work, done, retry, dead letter) and ``delay_seconds``.
    Malformed events and failed conversions (``failed``) are retried."""
    failed = F.coalesce(c("failed"), F.lit(False)) if "failed" in classified.columns else F.lit(False)
    work = (c("action") == "convert") & convertible(c("key"))
    again = (c("action") == "malformed") | (work & failed)
    route = (
        F.when(again & (c("attempts") >= max_attempts), "dead letter")
        .when(again, "retry")
        .when(work, "work")
        .otherwise("done")
    )
    return classified.withColumn("route", route).withColumn(
        "delay_seconds", F.when(c("route") == "retry", F.lit(RETRY_SECONDS))
    )
