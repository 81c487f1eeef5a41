"""Deposits and the ledger: B1-B9, A8, A9, J18, J22, M10-M12."""

import json

from pyspark.sql import functions as F

from checks.base import query, with_cte
from checks.metering_checks import REVISIONS, revisions
from lumicat.operators import billing, ledger, policy

c = F.col
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
DEPOSIT = "0x" + "ab" * 20
USDC = "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48"


def k_of(t):
    return F.get_json_object("props", "$.k").cast("bigint")


def word(v):
    return F.lpad(F.lower(F.hex(v)), 64, "0")


def address(v):
    return F.concat(F.lit("0x"), F.substring(F.sha2(v.cast("string"), 256), 1, 40))


# receipts: each order is a transaction, its lines are logs; 'R' lines go elsewhere,
# 'A' lines are of another contract, line 1 is written in upper case; lines 2 and 3
# move 2^127 more, line 4 moves 2^126 more
UNIT = f"'{2**126}'::UHUGEINT"
BIG_LINES = "CASE WHEN l_linenumber IN (2, 3) THEN 2 WHEN l_linenumber = 4 THEN 1 ELSE 0 END"


def receipts(t):
    sender = address(c("o_custkey"))
    to = F.when(c("l_returnflag") == "R", address(c("l_suppkey"))).otherwise(F.lit(DEPOSIT))
    topic = lambda a: F.concat(F.lit("0x"), F.lit("0" * 24), F.substring(a, 3, 40))
    first = F.when(c("l_linenumber").isin(2, 3), "8").when(c("l_linenumber") == 4, "4").otherwise("0")
    top = F.concat(first, F.lit("0" * 15))
    log = F.struct(
        F.when(c("l_returnflag") == "A", F.lit("0x" + "11" * 20)).when(c("l_linenumber") == 1, F.lit(USDC.upper().replace("0X", "0x"))).otherwise(F.lit(USDC)).alias("address"),
        F.array(F.lit(billing.TRANSFER_SIGNATURE), topic(sender), topic(to)).alias("topics"),
        F.concat(F.lit("0x" + "0" * 32), top, F.lpad(F.lower(F.hex((c("l_quantity") * 1000000).cast("bigint"))), 16, "0")).alias("data"))
    lines = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    return lines.select("o_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", log.alias("log"), F.lit(USDC).alias("contract"),
                        sender.alias("sender"), F.lit(DEPOSIT).alias("deposit"))


@query("b1_match_transfers", f"""SELECT o_orderkey, amount, CASE WHEN amount IS NULL THEN 'no_transfer' END AS error FROM
    (SELECT o_orderkey, CASE WHEN n < 4 THEN (n::UHUGEINT * {UNIT} + small::UHUGEINT)::VARCHAR END AS amount FROM
    (SELECT l_orderkey AS o_orderkey, sum(CASE WHEN hit THEN (l_quantity * 1000000)::BIGINT END) AS small, sum(CASE WHEN hit THEN {BIG_LINES} END) AS n
    FROM (SELECT *, l_returnflag NOT IN ('R', 'A') AS hit FROM lineitem) GROUP BY 1))""")
def b1(t):
    rows = billing.match_transfer_logs(receipts(t), ["o_orderkey"])
    return rows.select("o_orderkey", "amount", "error")


@query("a8_transfer_total", f"""SELECT l_orderkey, l_suppkey, l_linenumber, l_extendedprice, CASE WHEN l_returnflag NOT IN ('R', 'A') AND {BIG_LINES} < 2
    THEN (2 * ((l_quantity * 1000000)::BIGINT::UHUGEINT + ({BIG_LINES})::UHUGEINT * {UNIT}))::VARCHAR END AS amount FROM lineitem""")
def a8(t):
    rows = receipts(t).withColumn("logs", F.array("log", "log"))
    amount = billing.transfer_total(c("logs"), c("contract"), c("sender"), c("deposit"))
    return rows.select(c("o_orderkey").alias("l_orderkey"), "l_suppkey", "l_linenumber", "l_extendedprice", amount.alias("amount"))


@query("b2_match_native", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 = 0 THEN ('{2**128 - 2**64}'::UHUGEINT + (o_custkey + 1)::UHUGEINT)::VARCHAR
    WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 <> 1 THEN (o_custkey + 1)::VARCHAR END AS amount,
    CASE o_orderkey % 5 WHEN 1 THEN 'no_recipient' WHEN 2 THEN 'self_transfer' WHEN 3 THEN 'other_recipient' WHEN 4 THEN 'value_malformed' ELSE CASE WHEN o_orderkey % 7 = 1 THEN 'value_malformed' END END AS error FROM orders""")
def b2(t):
    r = c("o_orderkey") % 5
    plain = F.lower(F.hex(c("o_custkey") + 1))
    value = F.when(c("o_orderkey") % 7 > 1, plain).when(c("o_orderkey") % 7 == 0, F.concat(F.lit("f" * 16), F.lpad(plain, 16, "0")))
    value = F.coalesce(value, F.concat(F.lit("1"), F.lpad(plain, 32, "0")))
    txs = t.orders.select(
        "o_orderkey", F.when(r == 2, F.lit(DEPOSIT.upper().replace("0X", "0x"))).otherwise(address(c("o_custkey"))).alias("from"),
        F.when(r == 3, address(c("o_orderkey"))).when(r != 1, F.lit(DEPOSIT)).alias("to"),
        F.when(r == 4, "0xzz").otherwise(F.concat(F.lit("0x"), value)).alias("value"),
        F.lit(DEPOSIT).alias("deposit"))
    return billing.match_native(txs).select("o_orderkey", "amount", "error")


@query("b3_confirmed", """SELECT o_orderkey, CASE WHEN 1400 - o_custkey + 1 < 6 OR o_orderkey % 7 = 0 OR c_custkey IS NULL THEN 'too early' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'confirmed' END AS state,
    CASE WHEN c_custkey IS NOT NULL THEN 1700000000 + c_custkey END AS block_time FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def b3(t):
    block = lambda v: F.sha2(v.cast("string"), 256)
    txs = t.orders.select("o_orderkey", c("o_custkey").alias("block_number"), F.upper(block(c("o_custkey"))).alias("receipt_block_hash"),
                          F.when(c("o_orderkey") % 7 == 0, "other").when(c("o_orderkey") % 2 == 0, block(c("o_custkey"))).alias("tx_block_hash"),
                          F.when(c("o_orderstatus") == "F", "0x0").otherwise("0x1").alias("tx_status"))
    blocks = t.customer.select(c("c_custkey").alias("number"), block(c("c_custkey")).alias("hash"), (1700000000 + c("c_custkey")).alias("timestamp"))
    return billing.confirmed(txs, blocks, 1400).select("o_orderkey", "state", "block_time")


# second chain: native transfers, one per order; the parsed JSON is made per row
def second_chain(t):
    r = c("o_orderkey") % 6
    paid = c("o_custkey") * 10 + 5
    text = lambda s: F.lit(json.dumps(s))
    source = F.when(r == 4, text("other")).otherwise(text("me"))
    doc = F.concat(
        F.lit('{"transaction":{"message":{"accountKeys":['), F.when(r == 1, text("stranger")).otherwise(text("me")),
        F.lit(',"vault","11111111111111111111111111111111"],"instructions":[{"programId":"11111111111111111111111111111111","parsed":{"type":"transfer","info":{"source":'),
        source, F.lit(',"destination":"vault","lamports":'), paid.cast("string"),
        F.lit('}}}]}},"meta":{"err":'), F.when(r == 2, '"boom"').otherwise("null"),
        F.lit(',"preBalances":[100,7,1],"postBalances":[0,'),
        F.when(r == 3, F.lit("7")).when(r == 5, (paid + 2).cast("string")).otherwise((paid + 7).cast("string")),
        F.lit(',1],"preTokenBalances":[],"postTokenBalances":[]}}'))
    parsed = F.from_json(doc, billing.SECOND_CHAIN_DDL)
    return t.orders.select("o_orderkey", parsed.alias("p")).select(
        "o_orderkey", "p.transaction", "p.meta", F.lit(None).cast("string").alias("contract"),
        F.lit("vault").alias("deposit"), F.lit("me").alias("linked"))


@query("b4_verify_second_chain", """SELECT o_orderkey, CASE r WHEN 1 THEN 'wrong sender' WHEN 2 THEN 'rejected' WHEN 3 THEN 'rejected' WHEN 4 THEN 'wrong sender' ELSE CASE WHEN r = 5 AND paid - 5 <= 0 THEN 'rejected' ELSE 'credited' END END AS outcome,
    CASE WHEN r = 0 THEN paid WHEN r = 5 AND paid > 5 THEN paid - 5 END::VARCHAR AS amount FROM (SELECT o_orderkey, o_orderkey % 6 AS r, o_custkey * 10 + 5 AS paid FROM orders)""")
def b4(t):
    return billing.verify_second_chain(second_chain(t)).select("o_orderkey", "outcome", c("amount").cast("string").alias("amount"))


@query("a9_net_received", """SELECT o_orderkey, CASE r WHEN 3 THEN 0 WHEN 5 THEN paid - 5 ELSE paid END::BIGINT AS received, CASE r WHEN 4 THEN 0 ELSE paid END::BIGINT AS funded
    FROM (SELECT o_orderkey, o_orderkey % 6 AS r, o_custkey * 10 + 5 AS paid FROM orders)""")
def a9(t):
    rows = billing.net_received(second_chain(t).withColumn("sender", c("linked")))
    return rows.select("o_orderkey", c("received").cast("bigint").alias("received"), c("funded").cast("bigint").alias("funded"))


ASSET = {"view": ("ethereum", "eth"), "click": ("solana", "usdc"), "purchase": ("ethereum", "usdt")}


def asset(i):
    return F.coalesce(*[F.when(c("event_type") == e, v[i]) for e, v in ASSET.items()], F.lit("none"))


PRICE_SQL = "CASE event_type WHEN 'view' THEN 300000000000 ELSE 100000000 END::HUGEINT"
QUOTES = f"""SELECT *, CASE WHEN event_type IN ('view', 'click', 'purchase') AND {K} % 9 <> 0 THEN
    (round(value * 1000000)::HUGEINT * CASE event_type WHEN 'view' THEN 1000000 ELSE 1 END * {PRICE_SQL} * 10000 // (pow(10, CASE event_type WHEN 'view' THEN 18 ELSE 6 END)::HUGEINT * 100000000))::BIGINT END AS points FROM events"""


def deposits(t):
    micro = F.round(c("value") * 1000000).cast("decimal(38,0)")
    amount = F.when(c("event_type") == "view", micro * 1000000).otherwise(micro).cast("decimal(38,0)").cast("string")
    return t.events.select("event_id", asset(0).alias("chain"), asset(1).alias("token"), amount.alias("amount"),
                           F.when(k_of(t) % 9 == 0, "no_transfer").alias("error"),
                           F.lit(10000).cast("bigint").alias("points_per_usd"), F.lit(200000).cast("bigint").alias("minimum_topup"))


def prices(t):
    """Feed prices, as the newest event of each feed reports them."""
    return t.events.where("event_type = 'view'").groupBy(F.lit("0x5f4ec3df9cbd43714fe2740f5e3616155c5b8419").alias("feed")).agg(
        (F.count(F.lit(1)) * 0 + 3000 * 100000000).cast("string").alias("price"))


@query("b5_quote_deposits", with_cte("", f"""SELECT event_id, points, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'asset_unknown'
      WHEN {K} % 9 = 0 THEN 'no_transfer' WHEN points < CASE event_type WHEN 'view' THEN 190000 ELSE 200000 END THEN 'below_minimum' END AS reason FROM quotes""", quotes=QUOTES))
def b5(t):
    return billing.quote_deposits(deposits(t), prices(t)).select("event_id", "points", "reason")


@query("b9_estimate_points", f"""SELECT event_id, CASE WHEN e IS NULL THEN points END AS estimate, e AS error FROM (SELECT event_id, points,
    CASE WHEN event_type NOT IN ('click', 'purchase', 'view') THEN 'chain_unknown' WHEN round(value * 100) <= 0 THEN 'amount_malformed'
      WHEN event_type = 'click' AND {K} % 2 = 0 THEN 'wallet_missing' WHEN event_type = 'click' THEN 'deposits_closed'
      WHEN {K} = 7 THEN 'self_transfer' WHEN points < 200000 THEN 'below_minimum' END AS e
    FROM (SELECT *, (round(value * 100)::HUGEINT * CASE event_type WHEN 'view' THEN 3000 ELSE 1 END * 100)::BIGINT AS points FROM events))""")
def b9(t):
    k = k_of(t)
    wallet = "7Np41oeYqPefeNQEHSv1UDhYrehxin3NStELsSKCT4K2"
    cents = F.round(c("value") * 100).cast("decimal(30,0)")
    asked = t.events.select(
        "event_id", F.when(k == 7, DEPOSIT).otherwise(address(c("user_id"))).alias("account"),
        F.when(k % 2 == 1, wallet).alias("linked"), asset(0).alias("chain"), F.upper(asset(1)).alias("token"),
        (cents / 100).cast("decimal(32,2)").cast("string").alias("amount"))
    terms = t.nation.agg(F.lit(10000).cast("bigint").alias("points_per_usd"), (F.count(F.lit(1)) * 0 + 200000).alias("minimum_topup"),
                         F.lit(DEPOSIT).alias("eth_deposit"), F.lit("").alias("sol_deposit"))
    return billing.estimate_points(asked, terms, prices(t)).select("event_id", "estimate", "error")


@query("b8_valid_adjustments", """SELECT event_id FROM events WHERE round(value * 100) % 100 <> 0 AND event_type <> 'error' AND event_id % 1000 <= 300""")
def b8(t):
    rows = t.events.select("event_id", (F.round(c("value") * 100) % 100).cast("bigint").alias("points"),
                           F.when(c("event_type") == "error", " \t").otherwise(F.repeat(F.lit("r"), F.greatest((c("event_id") % 1000).cast("int"), F.lit(1)))).alias("reason"))
    return billing.valid_adjustments(rows).select("event_id")


@query("j18_match_deposit", with_cte("", """SELECT event_id, arg_min(revision, priority) FILTER (ok) AS revision, arg_min(rate, priority) FILTER (ok) AS rate,
    CASE WHEN count(*) FILTER (ok) = 0 THEN 'rate of ' || arg_min(rate, priority) END AS error FROM (SELECT *, rate % 4 = event_id % 4 AS ok FROM attempts) GROUP BY 1""",
    revs=REVISIONS, attempts="""SELECT event_id, r.revision, r.revision % 6 AS rate, row_number() OVER (PARTITION BY event_id ORDER BY r.revision DESC) - 1 AS priority
      FROM (SELECT event_id, floor(epoch(ts))::BIGINT AS ts FROM events) e JOIN revs r ON r.updated_at <= ts AND r.updated_at > ts - 259200"""))
def j18(t):
    second = F.unix_seconds(c("ts").cast("timestamp"))
    day = F.floor(c("ts") / 86400)
    revs = revisions(t).select("revision", "updated_at", F.explode(F.sequence(
        F.floor(c("updated_at") / 86400), F.floor(c("updated_at") / 86400) + 3)).alias("slot"))
    near = t.events.select("event_id", second.alias("ts")).withColumn("slot", day).join(revs, "slot").where(
        (c("updated_at") <= c("ts")) & (c("updated_at") > c("ts") - 259200))
    newest = near.groupBy("event_id").agg(F.max("revision").alias("top"))
    rate = (c("revision") % 6).alias("rate")
    attempts = near.join(newest, "event_id").select("event_id", "revision", rate, (c("top") - c("revision")).alias("priority")).withColumn(
        "error", F.when(c("rate") % 4 != c("event_id") % 4, F.concat(F.lit("rate of "), c("rate").cast("string"))))
    return policy.match_deposit(attempts, ["event_id"], ["rate"])


# the ledger: one payment per order, claims from the events
PAYMENTS = """SELECT 'tx-' || o_orderkey AS tx_hash, o_custkey::VARCHAR AS address, 'ethereum' AS chain, 'eth' AS token, '5' AS amount, (o_orderkey % 2) * 10 AS points,
    CASE o_orderstatus WHEN 'F' THEN 'credited' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, epoch(o_orderdate)::BIGINT AS created_at FROM orders"""
CLAIMS = f"""SELECT 'tx-' || event_id * 2 AS tx_hash, user_id::VARCHAR AS address, 'ethereum' AS chain, 'usdc' AS token, {K}::VARCHAR AS amount, {K} AS points, floor(epoch(ts))::BIGINT AS created_at FROM events"""


def payments(t):
    status = F.when(c("o_orderstatus") == "F", "credited").when(c("o_orderstatus") == "O", "pending").otherwise("rejected")
    return t.orders.select(
        F.concat(F.lit("tx-"), c("o_orderkey").cast("string")).alias("tx_hash"), c("o_custkey").cast("string").alias("address"),
        F.lit("ethereum").alias("chain"), F.lit("eth").alias("token"), F.lit("5").alias("amount"),
        ((c("o_orderkey") % 2) * 10).alias("points"), status.alias("status"),
        F.unix_seconds(c("o_orderdate").cast("timestamp")).alias("created_at"))


def claims(t):
    return t.events.select(
        F.concat(F.lit("tx-"), (c("event_id") * 2).cast("string")).alias("tx_hash"), c("user_id").cast("string").alias("address"),
        F.lit("ethereum").alias("chain"), F.lit("usdc").alias("token"), k_of(t).cast("string").alias("amount"), k_of(t).alias("points"),
        F.unix_seconds(c("ts").cast("timestamp")).alias("created_at"))


OPEN = "p.tx_hash IS NULL OR p.status = 'rejected' OR (p.status = 'pending' AND p.points = 0)"


@query("m10_merge_payment_claims", f"""SELECT coalesce(p.tx_hash, n.tx_hash) AS tx_hash, CASE WHEN take THEN n.address ELSE p.address END AS address, CASE WHEN take THEN n.token ELSE p.token END AS token,
    CASE WHEN take THEN n.amount ELSE p.amount END AS amount, CASE WHEN take THEN n.points ELSE p.points END AS points, CASE WHEN take THEN 'pending' ELSE p.status END AS status, coalesce(p.created_at, n.created_at) AS created_at
    FROM ({PAYMENTS}) p FULL JOIN (SELECT *, true AS claim FROM ({CLAIMS})) n ON n.tx_hash = p.tx_hash, LATERAL (SELECT claim IS NOT NULL AND ({OPEN}) AS take)""")
def m10(t):
    return ledger.merge_payment_claims(payments(t), claims(t)).drop("chain")


@query("m11_merge_rejections", f"""SELECT tx_hash, address, points, status FROM ({PAYMENTS}) UNION ALL SELECT tx_hash, address, 0, 'rejected' FROM ({CLAIMS}) WHERE tx_hash NOT IN (SELECT tx_hash FROM ({PAYMENTS}))""")
def m11(t):
    return ledger.merge_rejections(payments(t), claims(t).drop("points")).select("tx_hash", "address", "points", "status")


@query("m12_finalize_credits", f"""SELECT tx_hash, CASE WHEN status = 'pending' AND address::BIGINT % 2 = 0 THEN 'credited' ELSE status END AS status FROM ({PAYMENTS})""")
def m12(t):
    done = payments(t).select("tx_hash", F.when(c("address").cast("bigint") % 2 == 0, c("address")).otherwise("x").alias("address"))
    return ledger.finalize_credits(payments(t), done).select("tx_hash", "status")


@query("b6_resume_deposits", f"""SELECT n.tx_hash, CASE WHEN p.tx_hash IS NULL OR p.status = 'rejected' THEN 'verify' WHEN p.status = 'credited' AND same THEN 'already credited'
    WHEN p.status = 'pending' AND p.points = 0 AND NOT applied THEN 'verify' WHEN p.status = 'pending' AND p.points = 0 AND p.address = n.address THEN 'needs support'
    WHEN p.status = 'pending' AND p.points <> 0 AND same THEN 'finalize' ELSE 'already submitted' END AS action
    FROM (SELECT 'tx-' || o_orderkey AS tx_hash, CASE WHEN o_orderkey % 3 = 0 THEN 'z' ELSE o_custkey::VARCHAR END AS address, o_orderkey % 4 = 0 AS applied FROM orders UNION ALL SELECT 'new-' || event_id, 'q', false FROM events) n
    LEFT JOIN ({PAYMENTS}) p ON p.tx_hash = n.tx_hash, LATERAL (SELECT p.address = n.address AS same)""")
def b6(t):
    known = payments(t).select("tx_hash", c("address").alias("a")).withColumn("k", F.regexp_extract("tx_hash", r"(\d+)", 1).cast("bigint"))
    asked = known.select("tx_hash", F.when(c("k") % 3 == 0, "z").otherwise(c("a")).alias("address"), (c("k") % 4 == 0).alias("applied"))
    fresh = t.events.select(F.concat(F.lit("new-"), c("event_id").cast("string")).alias("tx_hash"), F.lit("q").alias("address"), F.lit(False).alias("applied"))
    both = asked.union(fresh).withColumn("chain", F.lit("ethereum")).withColumn("token", F.lit("eth"))
    return ledger.resume_deposits(both, payments(t)).select("tx_hash", "action")


@query("j22_payment_history", f"""SELECT address, tx_hash, rank FROM (SELECT address, tx_hash, row_number() OVER (PARTITION BY address ORDER BY created_at DESC, tx_hash) AS rank FROM ({PAYMENTS})) WHERE rank <= 5""")
def j22(t):
    return ledger.payment_history(payments(t), limit=5).select("address", "tx_hash", "rank")
