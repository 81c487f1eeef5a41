"""Metering and policies: H1, H4-H10, H14, A11, J16-J19, M16, Q10, Q11."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import query, with_cte
from lumicat.operators import ledger, metering, policy

c = F.col
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

# one request per event: five accounts, kinds from the event type
LOG = f"""SELECT (user_id % 5)::VARCHAR AS account, event_id, floor(epoch(ts))::BIGINT AS ts,
    CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'similar' WHEN 'purchase' THEN 'description' ELSE 'upload' END AS kind,
    CASE event_type WHEN 'view' THEN '/images/' || {K} % 4 || '/' || {K} ELSE event_type || ':' || {K} END AS key
    FROM events WHERE event_type <> 'error'"""


def log(t, account=None):
    kind = (F.when(c("event_type") == "view", "image").when(c("event_type") == "click", "similar")
            .when(c("event_type") == "purchase", "description").otherwise("upload"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    path = F.concat(F.lit("/images/"), (k % 4).cast("string"), F.lit("/"), k.cast("string"))
    return t.events.where("event_type <> 'error'").select(
        (c("user_id") % 5 if account is None else account).cast("string").alias("account"), "event_id",
        F.unix_seconds(c("ts").cast("timestamp")).alias("ts"), kind.alias("kind"),
        F.when(c("event_type") == "view", path).otherwise(
            F.concat(c("event_type"), F.lit(":"), k.cast("string"))).alias("key"))


# one policy revision per event day at noon, prices vary by day
REVISIONS = """SELECT (row_number() OVER (ORDER BY day) - 1)::INT AS revision, day, day * 86400 + 43200 - CASE WHEN day = min(day) OVER () THEN 86400 ELSE 0 END AS updated_at
    FROM (SELECT DISTINCT floor(epoch(ts) / 86400)::BIGINT AS day FROM events)"""


def revisions(t, **fixed):
    day = F.floor(F.unix_seconds(c("ts").cast("timestamp")) / 86400).cast("bigint")
    days = t.events.select(day.alias("day")).distinct()
    # one row per day: numbering them in one task is the size of a calendar
    number = F.row_number().over(Window.orderBy("day")) - 1
    rows = days.withColumn("revision", number.cast("int"))
    start = c("day") * 86400 + 43200 - F.when(c("revision") == 0, 86400).otherwise(0)
    price = 1 + c("revision") % 3
    item = lambda p: F.struct(p.cast("bigint").alias("price"), F.lit(fixed.get("daily_free", 2)).cast("bigint").alias("daily_free"))
    signup = F.lit(fixed.get("signup", 200)).cast("bigint")
    plans = F.array(*[F.struct(F.lit(p).cast("bigint").alias("price"), F.lit(v).cast("bigint").alias("views"), F.lit(s).cast("bigint").alias("searches"))
                      for p, v, s in ((50, 3, 1), (120, None, 2))])
    document = F.to_json(F.struct(
        F.lit(fixed.get("login_required", True)).alias("login_required"),
        F.array(F.lit("/images/1"), F.lit("/images/2")).alias("free_media_folders"),
        F.array(item(price), item(price * 5), item(price * 9), item(price * 2), item(price * 10)).alias("items"),
        plans.alias("plans"), signup.alias("signup_points")))
    return rows.select("revision", document.alias("document"), start.alias("updated_at"), F.lit("editor").alias("updated_by"))


@query("j16_policy_asof", with_cte("", """SELECT event_id, ts, (SELECT max(revision) FROM revs WHERE updated_at <= ts) AS revision FROM log""", log=LOG, revs=REVISIONS))
def j16(t):
    return policy.policy_asof(log(t), revisions(t)).select("event_id", "ts", "revision")


SITE = """SELECT event_id::INT AS revision, floor(epoch(ts))::BIGINT AS updated_at FROM events WHERE event_type = 'error'"""


@query("j17_policy_candidates", with_cte("", """
    SELECT event_id, revision, (CASE WHEN class = 0 THEN 0 ELSE class * 5 - 5 + rn END)::INT AS priority FROM (
      SELECT event_id, revision, class, row_number() OVER (PARTITION BY event_id, class ORDER BY CASE WHEN class = 2 THEN -revision ELSE revision END) AS rn FROM (
        SELECT event_id, active AS revision, 0 AS class FROM act
        UNION ALL SELECT event_id, r.revision, 1 FROM act JOIN revs r ON r.updated_at > ts AND r.updated_at <= ts + 120
        UNION ALL SELECT event_id, r.revision, 2 FROM act JOIN revs a ON a.revision = active JOIN revs r ON r.revision < active
          AND (r.updated_at >= ts - 900 OR r.revision = (SELECT max(revision) FROM revs WHERE updated_at < ts - 900))
          WHERE a.updated_at >= ts - 900 AND active > 0)) WHERE rn <= 5""",
    revs=SITE, purchases="SELECT event_id, floor(epoch(ts))::BIGINT AS ts FROM events WHERE event_type = 'purchase'",
    act="SELECT event_id, ts, active FROM (SELECT event_id, ts, (SELECT max(revision) FROM revs WHERE updated_at <= ts) AS active FROM purchases) WHERE active IS NOT NULL"))
def j17(t):
    second = F.unix_seconds(c("ts").cast("timestamp"))
    revs = t.events.where("event_type = 'error'").select(
        c("event_id").cast("int").alias("revision"), second.alias("updated_at"), F.lit("{}").alias("document"))
    asked = t.events.where("event_type = 'purchase'").select("event_id", second.alias("ts"))
    return policy.policy_candidates(asked, revs).drop("ts")


@query("j19_latest_policy", with_cte("", "SELECT revision, updated_at FROM revs ORDER BY revision DESC LIMIT 1", revs=REVISIONS))
def j19(t):
    revs = revisions(t)
    return policy.latest_policy(revs).join(revs.select("revision", "updated_at"), "revision").select("revision", "updated_at")


@query("m16_publish_revision", with_cte("", """SELECT revision, updated_at, 'editor' AS updated_by FROM revs UNION ALL
    SELECT (SELECT max(revision) FROM revs) + 1, min(sec), 'user-' || arg_min(user_id, (sec, user_id::VARCHAR)) FROM (SELECT floor(epoch(ts))::BIGINT AS sec, user_id FROM events WHERE event_id % 30 = (SELECT max(revision) FROM revs))""", revs=REVISIONS))
def m16(t):
    drafts = t.events.select(
        (c("event_id") % 30).cast("int").alias("base_revision"), c("props").alias("document"),
        F.unix_seconds(c("ts").cast("timestamp")).alias("updated_at"),
        F.concat(F.lit("user-"), c("user_id").cast("string")).alias("updated_by"))
    return policy.publish_revision(revisions(t), drafts).drop("document")


@query("m17_initial_document", """WITH d AS (SELECT floor(epoch(ts))::BIGINT AS sec, 'user-' || user_id AS who, props FROM events WHERE event_id % 30 = 0)
    SELECT 0 AS revision, 'initial' AS document, (SELECT min(floor(epoch(ts)))::BIGINT FROM events) AS updated_at, 'system' AS updated_by
    UNION ALL SELECT 1, arg_min(props, (sec, who, props)), min(sec), arg_min(who, (sec, who, props)) FROM d""")
def m17(t):
    """The first publication, by the earliest of many drafts, also fills the still empty revision 0."""
    second = F.unix_seconds(c("ts").cast("timestamp"))
    start = t.events.agg(F.min(second).alias("updated_at")).select(
        F.lit(0).alias("revision"), F.lit("{}").alias("document"), "updated_at", F.lit("system").alias("updated_by"))
    drafts = t.events.select(
        (c("event_id") % 30).cast("int").alias("base_revision"), c("props").alias("document"), second.alias("updated_at"),
        F.concat(F.lit("user-"), c("user_id").cast("string")).alias("updated_by"))
    return policy.publish_revision(start, drafts, "initial")


@query("q10_clean_folder_rules", """SELECT page_id, CASE WHEN ends_with(p, '/..') THEN NULL ELSE '/images/a|/videos' || CASE WHEN p IN ('/images/a', '/videos') THEN '' ELSE '|' || p END END AS rules, ends_with(p, '/..') AS refused FROM
    (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '/images/..' ELSE '/images/' || split_part(regexp_replace(url, '^https?://', ''), '/', 1) END AS p FROM pages)""")
def q10(t):
    host = F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1))
    path = F.concat(F.lit("/images/"), F.when(c("page_id") % 7 == 0, "..").otherwise(host))
    text = F.concat(F.lit("/images/a/\n\n  \n/videos\r\n"), path, F.lit("//\n/images/a\n"))
    rules = policy.clean_folder_rules(text)
    return t.pages.select("page_id", rules.alias("r")).select(
        "page_id", F.array_join("r.rules", "|").alias("rules"), c("r.error").isNotNull().alias("refused"))


@query("q11_parse_policy_rows", """SELECT event_id, CASE WHEN bad THEN NULL ELSE k END::INT AS revision, CASE WHEN bad THEN NULL WHEN k % 2 = 0 THEN NULL ELSE k END AS views,
    CASE WHEN bad THEN 'image_price_out_of_range' END AS error FROM (SELECT event_id, k, k % 10 = 3 AS bad FROM (SELECT event_id, """ + K + " AS k FROM events))")
def q11(t):
    k = F.get_json_object("props", "$.k")
    n = k.cast("int")
    fields = {
        "revision": k, "login_required": F.lit("no"), "points_per_usd": F.lit(" 10000 "), "minimum_topup": F.lit("1"),
        "signup_points": F.lit("0"), "eth_deposit": F.lit(""), "sol_deposit": F.lit(""), "free_media_folders": F.lit("/images"),
        "basic_views": F.when(n % 2 == 0, "-1").otherwise(k), "basic_price": F.lit("20"), "basic_searches": F.lit("1"),
        "pro_views": F.lit("-1"), "pro_price": F.lit("2"), "pro_searches": F.lit("1"),
    }
    for kind in policy.KINDS:
        fields[f"{kind}_price"], fields[f"{kind}_free"] = F.lit("3"), F.lit("-1")
    fields["image_price"] = F.when(n % 10 == 3, "-5").otherwise("4")
    form = F.create_map(*[x for name, v in fields.items() for x in (F.lit(name), v)])
    rows = policy.parse_policy_rows(t.events.select("event_id", form.alias("form")))
    return rows.select("event_id", "revision", policy.parse_document(c("document"))["plans"][0]["views"].alias("views"), "error").withColumn(
        "views", F.when(c("error").isNull(), c("views")))


@query("a11_daily_usage", with_cte("", "SELECT account, ts // 86400 AS day, kind, count(DISTINCT key) AS resources FROM log GROUP BY ALL", log=LOG))
def a11(t):
    return metering.daily_usage(log(t))


@query("h4_dedupe_repeats", "WITH RECURSIVE log AS (" + LOG + """), s AS (SELECT DISTINCT account, key, ts FROM log),
    chain AS (SELECT account, key, min(ts) AS ts FROM s GROUP BY ALL UNION ALL
      SELECT c.account, c.key, (SELECT min(s.ts) FROM s WHERE s.account = c.account AND s.key = c.key AND s.ts >= c.ts + 86400) FROM chain c WHERE c.ts IS NOT NULL)
    SELECT s.account, s.key, s.ts, c.ts IS NOT NULL AS recorded FROM s LEFT JOIN chain c ON c.account = s.account AND c.key = s.key AND c.ts = s.ts""")
def h4(t):
    return metering.dedupe_repeats(log(t))


@query("h5_usage_windows", "WITH RECURSIVE log AS (" + LOG + """), s AS (SELECT account, ts, kind FROM log),
    chain AS (SELECT account, min(ts) AS ts FROM s GROUP BY ALL UNION ALL
      SELECT c.account, (SELECT min(s.ts) FROM s WHERE s.account = c.account AND s.ts >= c.ts + 18000) FROM chain c WHERE c.ts IS NOT NULL)
    SELECT s.account, c.ts AS win_start, sum(CASE WHEN kind IN ('image', 'similar') THEN 2 ELSE 0 END)::BIGINT AS views, count(*) FILTER (kind NOT IN ('image', 'similar')) AS searches
    FROM s JOIN chain c ON c.account = s.account AND s.ts >= c.ts AND s.ts < c.ts + 18000 GROUP BY ALL""")
def h5(t):
    return metering.usage_windows(log(t).withColumn("price", F.lit(2)))


@query("h7_free_allowance", with_cte("", """SELECT event_id, CASE WHEN writes THEN coalesce((since_ts, since_id) <= (l.ts, l.event_id), false)
      ELSE coalesce((since_ts, since_id) <= (l.ts, l.event_id), false) OR full_ts IS NULL OR (l.ts, l.event_id) <= (full_ts, full_id) END AS free
    FROM (SELECT *, ts // 86400 AS day, event_id % 6 <> 0 AS writes FROM log) l
    LEFT JOIN slots s ON s.account = l.account AND s.day = l.day AND s.kind = l.kind AND s.key = l.key
    LEFT JOIN (SELECT account, day, kind, since_ts AS full_ts, since_id AS full_id FROM slots WHERE slot = 3) f ON f.account = l.account AND f.day = l.day AND f.kind = l.kind""",
    log=LOG, slots="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, day, kind ORDER BY since_ts, since_id) AS slot FROM
      (SELECT account, ts // 86400 AS day, kind, key, min(ts) AS since_ts, arg_min(event_id, (ts, event_id)) AS since_id FROM log WHERE event_id % 6 <> 0 GROUP BY ALL)) WHERE slot <= 3"""))
def h7(t):
    items = log(t).withColumn("daily_free", F.lit(3)).withColumn("writes", c("event_id") % 6 != 0)
    return metering.free_allowance(items, 3).select("event_id", "free")


GUEST = """SELECT event_id, (CASE WHEN NOT in_scope THEN 402 WHEN has_slot THEN 200 ELSE 402 END)::INT AS status FROM
   (SELECT l.event_id, l.kind <> 'image' OR starts_with(l.key, '/images/1/') OR starts_with(l.key, '/images/2/') AS in_scope,
     s.slot IS NOT NULL AS has_slot FROM log l LEFT JOIN slots s ON s.account = l.account AND s.day = l.ts // 86400 AND s.kind = l.kind AND s.key = l.key)"""


@query("h8_meter_guests", with_cte("", GUEST, log=LOG, slots="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, day, kind ORDER BY first) AS slot FROM
      (SELECT account, ts // 86400 AS day, kind, key, min((ts, event_id)) AS first FROM log
       WHERE kind <> 'image' OR starts_with(key, '/images/1/') OR starts_with(key, '/images/2/') GROUP BY ALL)) WHERE slot <= 2"""))
def h8(t):
    return metering.meter_guests(log(t), revisions(t, login_required=False)).select("event_id", "status")


# solvent accounts: nobody runs out, so decisions follow from ranks alone
PRICED = """SELECT l.*, p * CASE kind WHEN 'image' THEN 1 WHEN 'similar' THEN 2 WHEN 'description' THEN 10 ELSE 9 END AS price,
    kind <> 'image' OR starts_with(key, '/images/1/') OR starts_with(key, '/images/2/') AS in_scope
    FROM (SELECT *, 1 + (SELECT max(revision) FROM revs WHERE updated_at <= ts) % 3 AS p FROM log) l"""
HEADS = """SELECT min(event_id) AS event_id FROM log JOIN chain USING (account, key, ts) GROUP BY account, key, ts"""


@query("h6_meter_solvent", "WITH RECURSIVE log AS (" + LOG + "), revs AS (" + REVISIONS + "), priced AS (" + PRICED + """),
    chain AS (SELECT account, key, min(ts) AS ts FROM log GROUP BY ALL UNION ALL
      SELECT c.account, c.key, (SELECT min(s.ts) FROM log s WHERE s.account = c.account AND s.key = c.key AND s.ts >= c.ts + 86400) FROM chain c WHERE c.ts IS NOT NULL),
    heads AS (""" + HEADS + """),
    used AS (SELECT *, CASE WHEN in_scope THEN row_number() OVER (PARTITION BY account, ts // 86400, kind, in_scope ORDER BY ts, event_id) <= 2 ELSE false END AS free FROM priced WHERE event_id IN (FROM heads))
    SELECT p.event_id, p.account, 200 AS status, CASE WHEN u.event_id IS NULL THEN 'repeat' WHEN u.free THEN 'free' ELSE 'balance' END AS source,
      u.event_id IS NOT NULL AND NOT u.free AS charged, CASE WHEN u.free THEN 0 ELSE p.price END::BIGINT AS cost,
      CASE WHEN u.event_id IS NULL OR u.free THEN 0 ELSE p.price END::BIGINT AS deducted
    FROM priced p LEFT JOIN used u USING (event_id)""")
def h6_solvent(t):
    return metering.meter(log(t), revisions(t, signup=10**9)).drop("ts")


# the account machine for charges, one row per step: balance, seen keys, free slots
H6_FOLD = """,
    steps AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, event_id) AS rn FROM priced),
    run AS (
      SELECT DISTINCT account, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BIGINT AS price, '' AS source, 200::BIGINT AS balance,
        MAP {'': 0::BIGINT} AS seen, MAP {'': 0::BIGINT} AS used FROM steps
      UNION ALL
      SELECT account, rn, event_id, price, source, CASE WHEN source = 'balance' THEN balance - price ELSE balance END,
        CASE WHEN source IN ('balance', 'free') THEN map_concat(seen, MAP {key: ts}) ELSE seen END,
        CASE WHEN source = 'free' THEN map_concat(used, MAP {slot: coalesce(used[slot], 0) + 1}) ELSE used END
      FROM (SELECT s.account, s.rn, s.event_id, s.price, s.key, s.ts, r.balance, r.seen, r.used, s.kind || (s.ts // 86400) AS slot,
          CASE WHEN r.seen[s.key] > s.ts - 86400 THEN 'repeat' WHEN s.in_scope AND coalesce(r.used[s.kind || (s.ts // 86400)], 0) < 2 THEN 'free'
            WHEN r.balance >= s.price THEN 'balance' ELSE 'refused' END AS source
        FROM run r JOIN steps s ON s.account = r.account AND s.rn = r.rn + 1))
    SELECT account, event_id, CASE WHEN source = 'refused' THEN 402 ELSE 200 END::INT AS status, source, source = 'balance' AS charged,
      CASE WHEN source = 'free' THEN 0 ELSE price END::BIGINT AS cost, CASE WHEN source = 'balance' THEN price ELSE 0 END::BIGINT AS deducted FROM run WHERE rn > 0"""


@query("h6_meter", "WITH RECURSIVE log AS (" + LOG + "), revs AS (" + REVISIONS + "), priced AS (" + PRICED + ")" + H6_FOLD)
def h6(t):
    return metering.meter(log(t), revisions(t)).drop("ts")



def full_log(t):
    """Every operation: charges and checks, credits, plans, grants and bans."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    op = (F.when(c("kind") != "upload", F.when(c("event_id") % 11 == 0, "check").otherwise("charge"))
          .when(c("event_id") % 4 == 0, "credit").when(c("event_id") % 4 == 1, "subscribe")
          .when(c("event_id") % 12 == 2, "unsubscribe").when(c("event_id") % 12 == 6, "grant")
          .when(c("event_id") % 12 == 10, "ban").otherwise("charge"))
    rows = log(t).join(t.events.select("event_id", k.alias("k")), "event_id").withColumn("op", op)
    return rows.withColumn("plan", F.when(c("k") % 2 == 0, "basic").otherwise("pro")).withColumn(
        "points", c("k") * 3 - 60).withColumn("token", c("k").cast("string")).withColumn(
        "days", (c("k") % 5 + 1).cast("int")).withColumn("flag", c("k") % 4 == 0).drop("k")


FULL = f""" full_log AS (SELECT p.*, k, CASE WHEN kind <> 'upload' THEN CASE WHEN event_id % 11 = 0 THEN 'check' ELSE 'charge' END
      WHEN event_id % 4 = 0 THEN 'credit' WHEN event_id % 4 = 1 THEN 'subscribe' WHEN event_id % 12 = 2 THEN 'unsubscribe'
      WHEN event_id % 12 = 6 THEN 'grant' WHEN event_id % 12 = 10 THEN 'ban' ELSE 'charge' END AS op,
      CASE WHEN k % 2 = 0 THEN 'basic' ELSE 'pro' END AS asked, row_number() OVER (PARTITION BY account ORDER BY ts, event_id) AS rn
    FROM priced p JOIN (SELECT event_id, {K} AS k FROM events) USING (event_id))"""

# every operation, one row per step; aliases build on each other from top to bottom
H11_FOLD = """,
    run AS (
      SELECT DISTINCT account, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BIGINT AS ts, 0 AS status, '' AS source, false AS charged, 0::BIGINT AS cost, 0::BIGINT AS deducted,
        0::BIGINT AS shown, NULL::BIGINT AS vr, NULL::BIGINT AS sr, 0::BIGINT AS reset,
        false AS init, 0::BIGINT AS balance, NULL::VARCHAR AS plan, 0::BIGINT AS paid, 0::BIGINT AS period_end, NULL::BIGINT AS win_start, 0::BIGINT AS wv, 0::BIGINT AS ws,
        false AS banned, 0::BIGINT AS total, MAP {'': 0::BIGINT} AS seen, MAP {'': 0::BIGINT} AS used FROM full_log
      UNION ALL
      SELECT account, rn, event_id, ts, status, source, charged, cost, deducted, shown, vr, sr, reset, init2, balance2, plan2, paid2, end2, win2, wv2, ws2, banned2, total2, seen2, used2 FROM (
       SELECT s.account, s.rn, s.event_id, s.ts,
        s.op IN ('charge', 'credit') AS starts, s.kind IN ('image', 'similar') AS views,
        r.balance + CASE WHEN NOT r.init AND s.op IN ('charge', 'credit', 'check') THEN 200 ELSE 0 END AS bal0,
        r.plan IS NOT NULL AND r.period_end > s.ts AS active, CASE r.plan WHEN 'basic' THEN 3 END AS pv, CASE r.plan WHEN 'basic' THEN 1 WHEN 'pro' THEN 2 END AS ps,
        CASE WHEN active THEN r.paid * least(r.period_end - s.ts, 2592000) // 2592000 ELSE 0 END AS refund,
        r.win_start IS NULL OR s.ts >= r.win_start + 18000 AS elapsed, active AND elapsed AS roll,
        CASE WHEN roll THEN s.ts ELSE r.win_start END AS w0, CASE WHEN roll THEN 0 ELSE r.wv END AS v0, CASE WHEN roll THEN 0 ELSE r.ws END AS s0,
        s.kind || (s.ts // 86400) AS slot, CASE s.op WHEN 'credit' THEN 'credit ' ELSE 'plan ' END || s.k AS mark, CASE s.asked WHEN 'basic' THEN 50 ELSE 120 END AS asked_price, asked_price - refund AS net,
        CASE WHEN s.op IN ('charge', 'check', 'subscribe') AND r.banned THEN 'suspended'
          WHEN s.op IN ('charge', 'check') THEN CASE WHEN r.seen[s.key] > s.ts - 86400 THEN 'repeat'
            WHEN s.in_scope AND coalesce(r.used[slot], 0) < 2 THEN 'free'
            WHEN active AND views AND pv IS NULL THEN 'unlimited' WHEN active AND views AND v0 + s.price <= pv THEN 'window'
            WHEN active AND NOT views AND s0 < ps THEN 'window' WHEN bal0 >= s.price THEN 'balance' ELSE 'refused' END
          WHEN s.op IN ('credit', 'grant') AND r.seen[mark] IS NOT NULL THEN 'known' WHEN s.op = 'credit' THEN 'credited' WHEN s.op = 'grant' THEN 'granted'
          WHEN s.op = 'subscribe' THEN CASE WHEN net > 0 AND r.balance < net THEN 'refused' ELSE 'subscribed' END
          WHEN s.op = 'unsubscribe' THEN 'unsubscribed' WHEN s.k % 4 = 0 THEN 'banned' ELSE 'unbanned' END AS made,
        CASE WHEN s.op = 'check' AND made IN ('free', 'unlimited', 'window', 'balance') THEN 'allowed' ELSE made END AS source,
        s.op = 'charge' AND made IN ('free', 'unlimited', 'window', 'balance') AS accepted,
        v0 + CASE WHEN accepted AND made = 'window' AND views THEN s.price ELSE 0 END AS v1, s0 + CASE WHEN accepted AND made = 'window' AND NOT views THEN 1 ELSE 0 END AS s1,
        CASE WHEN s.op = 'charge' THEN bal0 - CASE WHEN made = 'balance' THEN s.price ELSE 0 END WHEN made = 'credited' THEN greatest(0, bal0 + s.k * 3 - 60) WHEN s.op = 'credit' THEN bal0
          WHEN made = 'subscribed' THEN greatest(0, r.balance - net) WHEN made IN ('unsubscribed', 'granted') THEN r.balance + refund ELSE r.balance END AS balance2,
        r.init OR starts AS init2, CASE WHEN made IN ('subscribed', 'granted') THEN s.asked WHEN made = 'unsubscribed' THEN NULL ELSE r.plan END AS plan2,
        CASE WHEN made = 'subscribed' THEN asked_price WHEN made IN ('unsubscribed', 'granted') THEN 0 ELSE r.paid END AS paid2,
        CASE WHEN made = 'subscribed' THEN s.ts + 2592000 WHEN made = 'granted' THEN s.ts + (s.k % 5 + 1) * 86400 WHEN made = 'unsubscribed' THEN 0 ELSE r.period_end END AS end2,
        made IN ('subscribed', 'granted') AS bought, accepted AND (roll OR made = 'window') AS moved,
        CASE WHEN moved THEN w0 WHEN bought AND elapsed THEN s.ts ELSE r.win_start END AS win2, CASE WHEN moved THEN v1 WHEN bought AND elapsed THEN 0 ELSE r.wv END AS wv2,
        CASE WHEN moved THEN s1 WHEN bought AND elapsed THEN 0 ELSE r.ws END AS ws2, CASE WHEN s.op = 'ban' THEN s.k % 4 = 0 ELSE r.banned END AS banned2,
        r.total + CASE WHEN accepted THEN 1 ELSE 0 END AS total2,
        CASE WHEN accepted THEN map_concat(r.seen, MAP {s.key: s.ts}) WHEN made IN ('credited', 'granted') THEN map_concat(r.seen, MAP {mark: s.ts}) ELSE r.seen END AS seen2,
        CASE WHEN accepted AND made = 'free' THEN map_concat(r.used, MAP {slot: coalesce(r.used[slot], 0) + 1}) ELSE r.used END AS used2,
        CASE made WHEN 'suspended' THEN 403 WHEN 'refused' THEN 402 ELSE 200 END AS status, (accepted AND made <> 'free') OR made = 'subscribed' AS charged,
        (CASE WHEN s.op IN ('charge', 'check') AND (made IN ('repeat', 'refused') OR (accepted AND made <> 'free')) THEN s.price WHEN s.op = 'subscribe' AND made <> 'suspended' THEN net
          WHEN made IN ('unsubscribed', 'granted') THEN -refund ELSE 0 END)::BIGINT AS cost,
        (CASE WHEN accepted AND made = 'balance' THEN s.price WHEN made = 'credited' THEN bal0 - balance2 WHEN made = 'subscribed' THEN r.balance - balance2 WHEN made IN ('unsubscribed', 'granted') THEN -refund ELSE 0 END)::BIGINT AS deducted,
        CASE WHEN s.op = 'check' AND made <> 'suspended' THEN bal0 ELSE balance2 END AS shown,
        bought OR (s.op = 'grant' AND made = 'known') OR made = 'repeat' AS stored, accepted OR (s.op IN ('charge', 'check') AND made = 'refused') AS counted,
        CASE WHEN bought THEN true ELSE active END AS on2, CASE WHEN bought THEN CASE s.asked WHEN 'basic' THEN 3 END ELSE pv END AS pv2, CASE WHEN bought THEN CASE s.asked WHEN 'basic' THEN 1 ELSE 2 END ELSE ps END AS ps2,
        win2 IS NULL OR s.ts >= win2 + 18000 AS stale,
        CASE WHEN counted AND on2 THEN greatest(0, pv2 - v1) WHEN stored AND on2 THEN greatest(0, pv2 - CASE WHEN stale THEN 0 ELSE wv2 END) END AS vr0,
        (CASE WHEN pv2 IS NULL THEN NULL ELSE vr0 END)::BIGINT AS vr,
        (CASE WHEN counted AND on2 THEN greatest(0, ps2 - s1) WHEN stored AND on2 THEN greatest(0, ps2 - CASE WHEN stale THEN 0 ELSE ws2 END) END)::BIGINT AS sr,
        (CASE WHEN counted AND on2 THEN w0 + 18000 WHEN stored AND on2 AND NOT stale THEN win2 + 18000 ELSE 0 END)::BIGINT AS reset
       FROM run r JOIN full_log s ON s.account = r.account AND s.rn = r.rn + 1))
    """
H11 = "WITH RECURSIVE log AS (" + LOG + "), revs AS (" + REVISIONS + "), priced AS (" + PRICED + "), " + FULL + H11_FOLD


@query("h11_meter_all_operations", H11 + """SELECT account, event_id, ts, status::INT AS status, source, charged, cost, deducted,
    shown AS balance, vr AS views_remaining, sr AS searches_remaining, reset AS window_reset FROM run WHERE rn > 0""")
def h11(t):
    return metering.meter_with_figures(full_log(t), revisions(t))


@query("h14_account_status", H11 + """SELECT account, balance, CASE WHEN act THEN plan END AS plan, CASE WHEN act THEN period_end ELSE 0 END AS period_end,
    (CASE WHEN act AND plan = 'basic' THEN greatest(0, 3 - CASE WHEN fresh THEN 0 ELSE wv END) END)::BIGINT AS views_remaining,
    (CASE WHEN act THEN greatest(0, CASE plan WHEN 'basic' THEN 1 ELSE 2 END - CASE WHEN fresh THEN 0 ELSE ws END) END)::BIGINT AS searches_remaining,
    CASE WHEN act AND NOT fresh THEN win_start + 18000 ELSE 0 END AS window_reset, banned, total AS total_views
    FROM (SELECT *, plan IS NOT NULL AND period_end > 1706000000 AS act, win_start IS NULL OR win_start + 18000 <= 1706000000 AS fresh
      FROM run QUALIFY row_number() OVER (PARTITION BY account ORDER BY rn DESC) = 1)""")
def h14(t):
    states = metering.account_states(full_log(t), revisions(t))
    return metering.account_status(states, policy.latest_policy(revisions(t)), 1_706_000_000)


CREDITS = f"""SELECT (user_id % 5)::VARCHAR AS address, (event_id % 4000)::VARCHAR AS key, {K} * 7 - 340 AS points, floor(epoch(ts))::BIGINT AS sec, event_id AS seq FROM events"""


@query("h10_apply_credits", "WITH RECURSIVE first AS (SELECT address, key, arg_min(points, (sec, seq)) AS points, min((sec, seq)) AS o FROM (" + CREDITS + """) GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY o) AS rn FROM first),
    run AS (SELECT DISTINCT address, 0 AS rn, 100::BIGINT AS balance FROM n UNION ALL
      SELECT r.address, r.rn + 1, greatest(r.balance + n.points, 0) FROM run r JOIN n ON n.address = r.address AND n.rn = r.rn + 1)
    SELECT address, arg_max(balance, rn) AS balance, max(rn)::BIGINT AS applied FROM run GROUP BY 1""")
def h10(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    credits = t.events.select((c("user_id") % 5).cast("string").alias("address"), (c("event_id") % 4000).cast("string").alias("key"),
                              (k * 7 - 340).alias("points"), F.unix_seconds(c("ts").cast("timestamp")).alias("at"), c("event_id").alias("seq"))
    balances = credits.select("address").distinct().withColumn("balance", F.lit(100).cast("bigint"))
    return ledger.apply_credits(balances, credits)
