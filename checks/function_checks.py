"""Scalar functions: C1-C27, Q4-Q9, J25."""

from pyspark.sql import functions as F

from checks.base import query
from lumicat.functions import hashing, money, paths, text, validity

c = F.col
KEY_SQL = "regexp_replace(url, '^https?://', '')"


def keys(t):
    return t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("key"))


def k_of(t):
    return F.get_json_object("props", "$.k").cast("bigint")


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("c1_escape_like", r"""SELECT doc_id, md5(regexp_replace(text, '([\\%_])', '\\\1', 'g')) AS escaped FROM documents""")
def c1(t):
    return t.documents.select("doc_id", F.md5(text.escape_like(c("text"))).alias("escaped"))


@query("c2_autocomplete_pattern", r"""SELECT doc_id, md5(CASE WHEN length(q) >= 3 THEN '%' ELSE '' END || regexp_replace(q, '([\\%_])', '\\\1', 'g') || '%') AS pattern
    FROM (SELECT doc_id, text AS q FROM documents)""")
def c2(t):
    return t.documents.select("doc_id", F.md5(text.autocomplete_pattern(c("text"))).alias("pattern"))


@query("c3_ilike_live", r"""SELECT doc_id FROM documents WHERE text ILIKE '%th_%n.%'""")
def c3(t):
    return t.documents.where(text.ilike_contains(c("text"), "Th_%n\\.")).select("doc_id")


@query("c4_ilike_literal", """SELECT doc_id FROM documents WHERE contains(lower(text), lower('Que%'))""")
def c4(t):
    return t.documents.where(text.ilike_literal(c("text"), "Que%")).select("doc_id")


@query("c5_name_match", """SELECT p_partkey FROM part WHERE p_name ILIKE '%d w%' OR contains(p_name, 'd_w')""")
def c5(t):
    return t.part.where(text.name_match(c("p_name"), "D w")).select("p_partkey")


@query("c6_match_rank", """SELECT p_partkey, (CASE WHEN lower(p_type) = 'economy' OR lower(p_name) = 'economy' THEN 0 WHEN p_type ILIKE 'eco%' AND lower(p_type) LIKE 'economy%' THEN 1 ELSE 2 END)::INT AS r,
    (CASE WHEN lower(p_name) IN ('red widget', 'red_widget') THEN 0 WHEN starts_with(lower(p_name), 'red widget') OR starts_with(lower(p_name), 'red_widget') THEN 1 ELSE 2 END)::INT AS r2 FROM part""")
def c6(t):
    return t.part.select("p_partkey", text.match_rank(c("p_type"), "Economy").alias("r"),
                         text.match_rank(c("p_name"), "Red Widget", True).alias("r2"))


@query("c7_should_suggest", """SELECT doc_id, count(*) FILTER (mode IN ('tag','author','title') AND q <> '' AND (length(q) >= 2 OR strlen(q) > length(q))) AS n FROM
    (SELECT doc_id, ['tag','clip','author','random'][(doc_id % 4 + 1)::INT] AS mode, unnest(string_split(text, ' ')) AS q FROM documents) GROUP BY 1""")
def c7(t):
    """How many words of each text would be suggested for."""
    mode = F.element_at(F.array(*map(F.lit, ("tag", "clip", "author", "random"))), (c("doc_id") % 4 + 1).cast("int"))
    words = t.documents.select("doc_id", mode.alias("mode"), F.explode(F.split("text", " ")).alias("q"))
    return words.groupBy("doc_id").agg(F.count_if(text.should_suggest(c("mode"), c("q"))).alias("n"))


@query("c8_parse_mode", """SELECT event_id, CASE WHEN m IN ('tag','author','title','random','similar','clip') THEN m ELSE 'tag' END AS mode FROM
    (SELECT event_id, CASE event_type WHEN 'view' THEN 'title' WHEN 'click' THEN 'similar' WHEN 'error' THEN NULL ELSE event_type END AS m FROM events)""")
def c8(t):
    raw = F.when(c("event_type") == "view", "title").when(c("event_type") == "click", "similar").when(
        c("event_type") != "error", c("event_type"))
    return t.events.select("event_id", text.parse_mode(raw).alias("mode"))


@query("c9_parse_items", f"""SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1)::INT AS pos, kind, id FROM (SELECT event_id, kind, id, min(pos) AS pos FROM (SELECT event_id, unnest(range(4)) AS pos,
      unnest(['post', 'image', 'post', 'bad']) AS kind, unnest([k, event_id % 7, k, 5]) AS id FROM (SELECT event_id, {K} AS k FROM events))
    WHERE kind <> 'bad' GROUP BY ALL)""")
def c9(t):
    k = k_of(t).cast("string")
    raw = F.concat(F.lit("post:"), k, F.lit(", image: "), (c("event_id") % 7).cast("string"),
                   F.lit(",post:"), k, F.lit(",bad:5,image:x"))
    items = text.parse_items(raw, ("post", "image", "video"))
    return t.events.select("event_id", F.posexplode(items).alias("pos", "item")).select(
        "event_id", "pos", "item.kind", "item.id")


@query("c10_format_duration", """SELECT c_custkey, CASE WHEN h > 0 THEN h || ':' || lpad(m::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0') ELSE m || ':' || lpad(s::VARCHAR, 2, '0') END AS d
    FROM (SELECT c_custkey, v // 3600 AS h, (v // 60) % 60 AS m, v % 60 AS s FROM (SELECT c_custkey, greatest(c_custkey * 17 - 100, 0) AS v FROM customer))""")
def c10(t):
    return t.customer.select("c_custkey", paths.format_duration(c("c_custkey") * 17 - 100).alias("d"))


@query("c11_encode_path", """SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda x: url_encode(x)), '/') AS coded FROM pages""")
def c11(t):
    return t.pages.select("page_id", paths.encode_path(c("url")).alias("coded"))


@query("c11_decode_path", """SELECT doc_id, md5(text) AS decoded FROM documents""")
def c11d(t):
    return t.documents.select("doc_id", F.md5(paths.decode_path(paths.encode_path(c("text")))).alias("decoded"))


@query("c13_resource_key", "SELECT page_id, substr(sha256(url), 1, 32) AS key, upper(sha256(url)) AS digest FROM pages")
def c13(t):
    return t.pages.select("page_id", hashing.resource_key(c("url")).alias("key"),
                          F.hex(hashing.resource_digest(c("url"))).alias("digest"))


SECRET = b"a fixed test secret"
PAD = SECRET.ljust(64, b"\0")
IPAD, OPAD = ("".join(f"{b ^ x:02x}" for b in PAD) for x in (0x36, 0x5C))
PREFIX = b"guest/v1\0".hex()


@query("c14_pseudonym", f"""SELECT event_id, 'guest:' || rtrim(replace(replace(to_base64(from_hex(sha256(from_hex('{OPAD}' || sha256(from_hex('{IPAD}{PREFIX}' || hex(ip))))))), '+', '-'), '/', '_'), '=') AS guest
    FROM (SELECT event_id, '10.0.' || (user_id % 256) || '.' || (event_id % 256) AS ip FROM events)""")
def c14(t):
    ip = F.concat_ws(".", F.lit("10.0"), (c("user_id") % 256).cast("string"), (c("event_id") % 256).cast("string"))
    return t.events.select("event_id", hashing.pseudonym(ip, SECRET).alias("guest"))


AMOUNT = "(o_orderkey::HUGEINT * 1000000007 * 12345678901)"


@query("c15_points_at_rate", f"""SELECT o_orderkey, least(floor_div, 9223372036854775807)::BIGINT AS points FROM
    (SELECT o_orderkey, {AMOUNT} * (150 + o_custkey % 7) * 10000 // 1000000000000000000::HUGEINT AS floor_div FROM orders)""")
def c15(t):
    amount = (c("o_orderkey").cast("decimal(20,0)") * F.lit(str(1000000007 * 12345678901)).cast("decimal(20,0)")).cast("string")
    return t.orders.select("o_orderkey", money.points_at_rate(
        amount, F.lit(18), (150 + c("o_custkey") % 7) * 100000000, F.lit(10000)).alias("points"))


@query("c15_points_fast", """SELECT o_orderkey, (o_orderkey::HUGEINT * 1000003 * 10000 // 1000000)::BIGINT AS points FROM orders""")
def c15_fast(t):
    return t.orders.select("o_orderkey", money.points_at_rate_fast(
        c("o_orderkey") * 1000003, F.lit(6), F.lit(None), F.lit(10000)).alias("points"))


# 0 to 33 hex digits: 32 reach the top of 128 bits, 33 are too many unless they begin with 0
HEX = "substr(md5(o_orderkey::VARCHAR) || '7', 1, (o_orderkey % 34)::INT)"
WORDS = " + ".join(f"('0x' || substr(p, {i * 8 + 1}, 8))::BIGINT::UHUGEINT * '{2 ** (96 - 32 * i)}'::UHUGEINT" for i in range(4))


@query("c16_hex_to_decimal", f"""SELECT o_orderkey, CASE WHEN h <> '' AND length(s) <= 32 THEN {WORDS} END::VARCHAR AS v
    FROM (SELECT *, right(lpad(s, 33, '0'), 32) AS p FROM (SELECT o_orderkey, h, ltrim(h, '0') AS s FROM (SELECT o_orderkey, {HEX} AS h FROM orders)))""")
def c16(t):
    digits = F.concat(F.md5(c("o_orderkey").cast("string")), F.lit("7"))
    h = F.concat(F.lit("0x"), F.substring(digits, F.lit(1), (c("o_orderkey") % 34).cast("int")))
    return t.orders.select("o_orderkey", money.hex_to_digits(h).alias("v"))


@query("c17_base_units", """SELECT o_orderkey, CASE WHEN round(o_totalprice * 100)::HUGEINT > 0 THEN (round(o_totalprice * 100)::HUGEINT * 10000)::VARCHAR END AS units FROM orders""")
def c17(t):
    cents = F.round(c("o_totalprice") * 100).cast("decimal(30,0)")
    amount = F.concat(F.lit(" "), (cents / 100).cast("decimal(32,2)").cast("string"), F.lit(" "))
    return t.orders.select("o_orderkey", money.base_units(amount, 6).alias("units"))


@query("c18_prorated_refund", """SELECT o_orderkey, (20000::HUGEINT * least(o_orderkey * 97, 2592000) // 2592000)::BIGINT AS refund FROM orders""")
def c18(t):
    return t.orders.select("o_orderkey", money.prorated_refund(
        F.lit(20000), F.lit(2592000), c("o_orderkey") * 97).alias("refund"))


@query("c19_settlement_min", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN greatest((o_custkey * 95) // 100, 1) ELSE o_custkey END AS least_points FROM orders""")
def c19(t):
    feed = F.when(c("o_orderstatus") == "F", "feed")
    return t.orders.select("o_orderkey", money.settlement_min(c("o_custkey"), feed).alias("least_points"))


@query("c20_segment_prefix", f"SELECT page_id FROM pages WHERE starts_with({KEY_SQL}, 'spam-farm.example.org/') OR {KEY_SQL} = 'spam-farm.example.org'")
def c20(t):
    return keys(t).where(paths.segment_prefix(c("key"), "spam-farm.example.org")).select("page_id")


@query("c21_in_free_scope", f"""SELECT page_id, kind NOT IN ('image', 'video') OR regexp_matches(split_part(key, '?', 1), '^[^/]*/(en|fr)(/|$)') AS free FROM
    (SELECT page_id, {KEY_SQL} AS key, CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' ELSE 'upload' END AS kind FROM pages)""")
def c21(t):
    kind = F.element_at(F.array(*map(F.lit, ("image", "video", "upload"))), (c("page_id") % 3 + 1).cast("int"))
    path = F.regexp_replace("key", "^[^/]*", "")
    rules = F.array(F.lit("/en"), F.lit("/fr"))
    return keys(t).select("page_id", paths.in_free_scope(paths.encode_path(path), kind, rules).alias("free"))


@query("c22_day_bucket", "SELECT event_id, floor(epoch(ts) / 86400)::BIGINT AS day FROM events")
def c22(t):
    return t.events.select("event_id", money.day_bucket(F.unix_seconds(c("ts").cast("timestamp"))).alias("day"))


EXT = "lower(regexp_extract(key, '\\.([^.]*)$', 1))"
KNOWN = ", ".join(f"'{e}'" for e in paths.IMAGE_EXTENSIONS)
SUFFIXED = f"(SELECT page_id, {KEY_SQL} || ['.JPG', '.bin', '', '.webp', '.mp4', '.txt'][(page_id % 6 + 1)::INT] AS key FROM pages)"


def suffixed(t):
    suffix = F.element_at(F.array(*map(F.lit, (".JPG", ".bin", "", ".webp", ".mp4", ".txt"))), (c("page_id") % 6 + 1).cast("int"))
    return keys(t).withColumn("key", F.concat("key", suffix))


@query("c23_target_path", f"""SELECT page_id, meta || '.webp' AS target, meta AS key FROM
    (SELECT page_id, CASE WHEN contains(key, '.') AND {EXT} IN ({KNOWN}) THEN regexp_extract(key, '^(.*)\\.[^.]*$', 1) ELSE key END AS meta FROM {SUFFIXED})""")
def c23(t):
    return suffixed(t).select("page_id", paths.target_path(c("key")).alias("p")).select("page_id", "p.*")


@query("c24_cover_dims", """SELECT p_partkey, CASE WHEN w > 0 AND h > 0 THEN w ELSE 16 END AS width, CASE WHEN w > 0 AND h > 0 THEN h ELSE 9 END AS height FROM
    (SELECT p_partkey, p_size - 10 AS w, (p_partkey % 7)::INT AS h FROM part)""")
def c24(t):
    return t.part.select("p_partkey", paths.cover_dims(c("p_size") - 10, (c("p_partkey") % 7).cast("int")).alias("d")).select("p_partkey", "d.*")


@query("c25_decode_price", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 90000 > 86400 THEN NULL WHEN o_orderkey % 7 = 0 THEN ('170141183460469231713240559642174554112'::UHUGEINT + (o_custkey + 1)::UHUGEINT)::VARCHAR ELSE (o_custkey + 1)::VARCHAR END AS price,
    CASE WHEN o_orderkey % 5 = 0 THEN 'price_zero' WHEN o_orderkey % 90000 > 86400 THEN 'price_stale' END AS error FROM orders""")
def c25(t):
    def word(v):
        return F.lpad(F.hex(v), 64, "0")

    zero = F.lit(0).cast("bigint")
    answer = F.when(c("o_orderkey") % 5 == 0, zero).otherwise(c("o_custkey") + 1)
    now = F.lit(1_700_000_000).cast("bigint")
    large = (c("o_orderkey") % 7 == 0) & (c("o_orderkey") % 5 != 0)  # 2^127 - 2^64 more
    price = F.when(large, F.concat(F.lit("0" * 32 + "7" + "f" * 15), F.lpad(F.hex(answer), 16, "0"))).otherwise(word(answer))
    data = F.concat(F.lit("0x"), word(zero), price, word(zero), word(now - c("o_orderkey") % 90000), word(zero))
    return t.orders.select("o_orderkey", money.decode_price(data, now).alias("p")).select(
        "o_orderkey", "p.price", "p.error")


@query("c26_usd_price", "SELECT o_orderkey, round(o_custkey / 10000.0, 6)::DOUBLE AS usd FROM orders")
def c26(t):
    return t.orders.select("o_orderkey", F.round(money.usd_price(c("o_custkey"), F.lit(10000)), 6).alias("usd"))


@query("c27_topic_address", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE substr(sha256(o_orderkey::VARCHAR), 1, 40) END AS a FROM orders""")
def c27(t):
    h = F.substring(F.sha2(c("o_orderkey").cast("string"), 256), 1, 40)
    lead = F.when(c("o_orderkey") % 3 == 0, "0" * 24).when(c("o_orderkey") % 3 == 1, "").otherwise("1" * 24)
    return t.orders.select("o_orderkey", money.topic_address(F.concat(F.lit("0x"), lead, h)).alias("a"))


@query("q4_valid_key", f"""SELECT page_id, trim(key) <> '' AND NOT contains('/' || key || '/', '//') AND NOT contains('/' || key || '/', '/./') AND NOT contains('/' || key || '/', '/../') AS ok FROM
    (SELECT page_id, CASE page_id % 9 WHEN 0 THEN './' WHEN 1 THEN '../' ELSE '' END || {KEY_SQL} AS key FROM pages)""")
def q4(t):
    lead = F.when(c("page_id") % 9 == 0, "./").when(c("page_id") % 9 == 1, "../").otherwise("")
    return keys(t).select("page_id", paths.valid_key(F.concat(lead, c("key"))).alias("ok"))


NON_IMAGE = ", ".join(f"'{e}'" for e in paths.non_image_extensions())


@query("q5_convertible", f"""SELECT page_id, CASE WHEN key = '' OR ends_with(key, '/') OR ends_with(lower(key), '.webp') THEN false WHEN ends_with(lower(key), '.bin') THEN true
    ELSE lower(regexp_extract(key, '[^/]\\.([^./]*)$', 1)) NOT IN ({NON_IMAGE}) END AS ok FROM {SUFFIXED}""")
def q5(t):
    return suffixed(t).select("page_id", paths.convertible(c("key")).alias("ok"))


@query("q6_within_limits", """SELECT p_partkey, p_partkey * 100000 <= 134217728 AND p_size::BIGINT * 1000 * (p_partkey * 10) <= 100000000 AND p_partkey > 0 AS ok FROM part""")
def q6(t):
    return t.part.select("p_partkey", paths.within_limits(
        c("p_partkey") * 100000, c("p_size") * 1000, (c("p_partkey") * 10).cast("int")).alias("ok"))


@query("q7_valid_principal", """SELECT o_orderkey, o_orderkey % 4 IN (0, 3) AS ok FROM orders""")
def q7(t):
    h = F.sha2(c("o_orderkey").cast("string"), 256)
    a40 = F.concat(F.lit("0x"), F.substring(h, 1, 40))
    sol = F.lit("7Np41oeYqPefeNQEHSv1UDhYrehxin3NStELsSKCT4K2")
    name = F.when(c("o_orderkey") % 4 == 0, a40).when(c("o_orderkey") % 4 == 1, F.upper(a40)).when(
        c("o_orderkey") % 4 == 2, F.concat(a40, F.lit("0"))).otherwise(sol)
    return t.orders.select("o_orderkey", validity.valid_principal(name).alias("ok"))


@query("q8_valid_tx_hash", "SELECT o_orderkey, o_orderkey % 3 = 0 AS ok FROM orders")
def q8(t):
    h = F.concat(F.lit("0x"), F.sha2(c("o_orderkey").cast("string"), 256))
    name = F.when(c("o_orderkey") % 3 == 0, h).when(c("o_orderkey") % 3 == 1, F.substring(h, 1, 65)).otherwise(
        F.concat(h, F.lit("\n")))
    return t.orders.select("o_orderkey", validity.valid_tx_hash(name).alias("ok"))


@query("q9_valid_deposit", """SELECT o_orderkey, o_orderkey % 8 IN (0, 4, 6) AS ok FROM orders""")
def q9(t):
    h = F.concat(F.lit("0x"), F.substring(F.sha2(c("o_orderkey").cast("string"), 256), 1, 40))
    r = c("o_orderkey") % 8
    # second chain: the wrapped coin, a wallet, a derived account beside the curve, another wallet, a point of order two
    address = F.when(r == 0, h).when(r == 1, "0x" + "0" * 40).when(
        r == 2, "0xdac17f958d2ee523a2206206994597c13d831ec7").when(
        r == 3, "So11111111111111111111111111111111111111112").when(r == 4, "7Np41oeYqPefeNQEHSv1UDhYrehxin3NStELsSKCT4K2").when(
        r == 5, "7A8QpSaBFfp5oymDuiAYtVRwZacTU63fy1ap9w9bkBc4").when(r == 6, "D5x5wVFxDXgkHGRbJzY3u6PRU8JhBTsMe1cwMr1Q3uES").otherwise(
        "Gx9dDNxzpALCowVuZb7pBceBLJugLA8sPa6TJDXrpfeW")
    return t.orders.select("o_orderkey", validity.valid_deposit(
        address, F.when(r >= 3, "solana").otherwise("ethereum")).alias("ok"))


@query("b7_token_registry", """SELECT event_id, a.token, decimals FROM events JOIN
    (VALUES ('view', 'ethereum', 'eth', 18), ('click', 'solana', 'usdc', 6), ('purchase', 'ethereum', 'usdt', 6)) a(t, chain, token, decimals) ON t = event_type""")
def b7(t):
    named = {"view": ("ethereum", "eth"), "click": ("solana", "usdc"), "purchase": ("ethereum", "usdt")}
    kind = c("event_type")
    chain, token = (F.coalesce(*[F.when(kind == k, v[i]) for k, v in named.items()]) for i in (0, 1))
    return t.events.select("event_id", chain.alias("chain"), token.alias("token")).join(
        F.broadcast(validity.token_registry(t.spark)), ["chain", "token"]).select("event_id", "token", "decimals")


@query("j25_unnest", "SELECT doc_id, unnest(range(1, 1 + len(string_split(text, ' '))))::INT AS pos, unnest(string_split(text, ' ')) AS word FROM documents")
def j25(t):
    from lumicat.operators.search import unnest

    words = t.documents.select("doc_id", F.split("text", " ", -1).alias("word"))
    return unnest(words, ["word"], ordinal="pos")
