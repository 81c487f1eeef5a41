"""H4-H14, A11 in batch: meter an access log, many accounts at once.

Accounts that provably cannot run out of points are metered with joins and
aggregates alone, so even one huge account spreads over the cluster. Only the
rest goes through the ordered fold, which streams over sorted partitions and
never holds an account's log in memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicat.functions.money import BIG, day_bucket
from lumicat.functions.paths import in_free_scope
from lumicat.operators import account as machine
from lumicat.operators.ordered import running_total
from lumicat.operators.policy import PLANS, item_of, parse_document, policy_asof
from lumicat.sources.snapshots import stage

c = F.col
OPTIONAL = {
    "op": ("string", "charge"), "plan": ("string", None), "points": ("bigint", None),
    "token": ("string", None), "expected_price": ("bigint", None), "days": ("int", None),
    "flag": ("boolean", None),
}
DECISION_DDL = (
    "account string, event_id bigint, ts bigint, status int, source string, charged boolean, "
    "cost bigint, deducted bigint"
)
FIGURE_DDL = "balance bigint, views_remaining bigint, searches_remaining bigint, window_reset bigint"
STATE_DDL = (
    "account string, init boolean, balance bigint, plan string, plan_paid bigint, period_end bigint, "
    "win_start bigint, win_views bigint, win_search bigint, banned boolean, total_views bigint"
)
PLAN_OPS = ("subscribe", "unsubscribe", "grant")
LIFTING_OPS = ("credit", "ban", "init")  # without a plan, only these can turn a refusal around
EVENT_COLUMNS = [
    "account", "event_id", "ts", "op", "kind", "key", "price", "daily_free", "in_scope", "signup",
    "terms", "plan", "points", "token", "expected_price", "days", "flag",
]
POINTS = EVENT_COLUMNS.index("points") - EVENT_COLUMNS.index("ts")


def prepare(log: DataFrame, revisions: DataFrame) -> DataFrame:
    """Log rows with the policy terms in force at their time (J16): price, daily
    allowance and scope of the item, signup points, plan terms."""
    rows = log
    for name, (kind, default) in OPTIONAL.items():
        if name not in log.columns:
            rows = rows.withColumn(name, F.lit(default).cast(kind))
    policies = revisions.withColumn("policy", parse_document(c("document"))).withColumn(
        "document", F.struct("policy", F.to_json("policy.plans").alias("terms"))
    )
    known = policy_asof(rows, policies.select("revision", "document", "updated_at")).select(
        *rows.columns, "document.policy", "document.terms"
    )
    item = item_of(c("policy"), c("kind"))
    zero = F.lit(0).cast("bigint")
    scope = in_free_scope(c("key"), c("kind"), c("policy.free_media_folders"))
    return known.select(
        c("account").cast("string").alias("account"), "event_id", "ts", "op", "kind", "key",
        F.coalesce(item["price"], zero).alias("price"),
        F.coalesce(item["daily_free"], zero).alias("daily_free"),
        F.coalesce(scope, F.lit(False)).alias("in_scope"),
        c("policy.signup_points").alias("signup"), "terms",
        "plan", "points", "token", "expected_price", "days", "flag",
        c("policy.login_required").alias("login_required"),
    )


# ------------------------------------------------------------------ ordered fold
_TERMS: dict[str, dict] = {}  # plan terms by their JSON text; a handful per policy history


def plan_terms(text: str | None) -> dict:
    """Plan terms (price, views, searches) by name."""
    if text is None:
        return {}
    known = _TERMS.get(text)
    if known is None:
        rows = json.loads(text)
        known = {n: (r["price"], r.get("views"), r["searches"]) for n, r in zip(PLANS, rows)}
        if len(_TERMS) > 10_000:
            _TERMS.clear()
        _TERMS[text] = known
    return known


def to_event(op, ts, kind, key, price, daily_free, in_scope, signup, terms, plan, points, token,
             expected_price, days, flag) -> machine.Event:
    """A prepared log row as an event of the account machine."""
    return machine.Event(
        op, ts, kind, key, price or 0, daily_free or 0, bool(in_scope), signup or 0, plan_terms(terms),
        plan, points or 0, token, expected_price, days or 0, bool(flag),
    )


def _fold(prepared: DataFrame, ddl: str, emit_states: bool) -> DataFrame:
    """Run the machine over each account in (ts, event_id) order. Partitions are
    sorted by Spark (spilling to disk) and read batch by batch; only the state of
    the current account is held."""
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, store = None, None, None

        def snapshot() -> list:
            dump = state.dump()
            return [current if n == "account" else dump[n] for n in names]

        for batch in batches:
            out = []
            for account, event_id, *fields in zip(*(column.to_pylist() for column in batch.columns)):
                if account != current:
                    if emit_states and current is not None:
                        out.append(snapshot())
                    current, state, store = account, machine.Account(), machine.MemoryStore()
                ts, op = fields[0], fields[1]
                if op == "open":
                    state.init, state.balance = True, fields[POINTS]
                    continue
                decision = machine.step(state, store, to_event(op, ts, *fields[2:]))
                if not emit_states:
                    here = {"account": account, "event_id": event_id, "ts": ts, "key": fields[3]}
                    out.append([here[n] if n in here else getattr(decision, n) for n in names])
            if out:
                yield _columns(out, schema)
        if emit_states and current is not None:
            yield _columns([snapshot()], schema)

    spark = prepared.sparkSession
    schema = _arrow_schema(spark.createDataFrame([], ddl))
    ordered = prepared.select(EVENT_COLUMNS).repartition("account").sortWithinPartitions(
        "account", "ts", "event_id"
    )
    return ordered.mapInArrow(run, ddl)


def _arrow_schema(empty: DataFrame) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in empty.dtypes])


def _columns(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)], schema=schema
    )


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _opening(accounts: DataFrame | None, prepared: DataFrame) -> DataFrame:
    """Opening balances as first log rows of their accounts."""
    if accounts is None:
        return prepared
    rows = accounts.select(
        c("account").cast("string").alias("account"), F.lit(-1).cast("bigint").alias("event_id"),
        F.lit(-1).cast("bigint").alias("ts"), F.lit("open").alias("op"), c("balance").alias("points"),
    )
    return prepared.unionByName(rows, allowMissingColumns=True)


# -------------------------------------------------- accounts that never run out
def _summaries(prepared: DataFrame) -> DataFrame:
    """Per account: operations on plans and others than charges, the most its charges can cost
    (each key once per UTC day), points it starts with, and whether
    the terms of its items changed within a day."""
    terms = F.struct("kind", "price", "daily_free", "in_scope")
    limit = F.when(c("in_scope") & (c("daily_free") > 0) & (c("price") > 0), c("daily_free"))
    day = day_bucket(c("ts")).alias("day")
    per_key = prepared.where(c("op") == "charge").groupBy("account", day, "key").agg(
        F.max("price").alias("p"), F.max("kind").alias("kind"), F.min(limit).alias("lo"),
        F.max(limit).alias("hi"), (F.min(terms) != F.max(terms)).alias("mixed"),
    )
    per_kind = per_key.groupBy("account", "day", "kind").agg(
        F.sum(c("p").cast(BIG)).alias("p"),
        (F.coalesce(F.min("lo") < F.max("hi"), F.lit(False)) | F.max("mixed")).alias("varies"),
    )
    costs = per_kind.groupBy("account").agg(F.sum("p").alias("most"), F.max("varies").alias("varies"))
    opening = F.max(F.when(c("op") == "open", c("points")))
    first_signup = F.min_by("signup", F.when(c("op") != "open", F.struct("ts", "event_id")))
    heads = prepared.groupBy("account").agg(
        F.count_if(~c("op").isin("charge", "open")).alias("other_ops"),
        F.count_if(c("op").isin(*PLAN_OPS)).alias("plan_ops"),
        F.coalesce(opening, first_signup).cast(BIG).alias("starts_with"),
    )
    steady = (c("plan_ops") == 0) & ~F.coalesce(c("varies"), F.lit(False))
    solvent = steady & (c("other_ops") == 0) & (c("most") <= c("starts_with"))
    return heads.join(costs, "account", "left").select(
        "account", steady.alias("steady"), (c("other_ops") > 0).alias("mixed"),
        F.coalesce(solvent, F.lit(False)).alias("solvent"),
    )


def dedupe_repeats(log: DataFrame) -> DataFrame:
    """H4 when nothing is refused: (account, key, ts, recorded). A second in which a
    key is asked for counts once; ``recorded`` marks the ones that start a new 24 h.

    The log is first reduced to different seconds, so a hot key is a bounded
    number of rows per day, and work is spread by (account, key).
    """
    seconds = log.select("account", "key", "ts").distinct()
    ordered = seconds.repartition("account", "key").sortWithinPartitions("account", "key", "ts")
    horizon = machine.REPEAT

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            owners, names, times = (batch.column(i).to_pylist() for i in range(3))
            flags = []
            for pair, now in zip(zip(owners, names), times):
                if pair != current:
                    current, last = pair, None
                fresh = last is None or last <= max(now - horizon, 0)
                last = now if fresh else last
                flags.append(fresh)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(flags)],
                names=["account", "key", "ts", "recorded"],
            )

    return ordered.mapInArrow(mark, "account string, key string, ts bigint, recorded boolean")


def usage_windows(log: DataFrame) -> DataFrame:
    """H5: windows of five hours anchored at the first counted request, as
    (account, win_start, views, searches). Requests are added up per second before
    they are brought together, which bounds the rows of one busy account."""
    view = c("kind").isin(*machine.VIEW_KINDS)
    amount = F.when(view, c("price")).otherwise(0).cast("bigint")
    seconds = log.groupBy("account", "ts").agg(
        F.sum(amount).alias("views"), F.count_if(~view).alias("searches")
    )
    ordered = seconds.repartition("account").sortWithinPartitions("account", "ts")

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row = None
        schema = pa.schema([("account", pa.string()), ("win_start", pa.int64()),
                            ("views", pa.int64()), ("searches", pa.int64())])
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if (open_row is None or open_row["account"] != row["account"]
                        or machine.elapsed(open_row["win_start"], row["ts"])):
                    if open_row:
                        done.append(open_row)
                    open_row = {"account": row["account"], "win_start": row["ts"], "views": 0, "searches": 0}
                open_row["views"] += row["views"]
                open_row["searches"] += row["searches"]
            if done:
                yield _batch(done, schema)
        if open_row:
            yield _batch([open_row], schema)

    return ordered.mapInArrow(roll, "account string, win_start bigint, views bigint, searches bigint")


def free_allowance(items: DataFrame, most: int | None = None) -> DataFrame:
    """H7: adds ``free``. ``items`` has account, kind, key, ts, event_id, daily_free
    and ``writes`` (a check writes nothing); one limit per (account, day, kind).

    A resource takes a slot at its first use while slots are left. Slots are the
    ``limit`` first different resources of the day: a per-key minimum followed by
    a top-n per group, both reduced before their shuffle (``most`` is an upper
    bound of the limits). A check is allowed until the day is full, or for a
    resource that holds a slot by then.
    """
    group = ["account", "day", "kind"]
    rows = items.withColumn("day", day_bucket(c("ts"))).withColumn("__at", F.struct("ts", "event_id"))
    firsts = rows.where(c("writes") & (c("daily_free") > 0)).groupBy(*group, "key").agg(
        F.min("__at").alias("since"), F.max("daily_free").alias("n")
    )
    order = Window.partitionBy(*group).orderBy("since")
    slots = firsts.withColumn("slot", F.row_number().over(order))
    if most is not None:
        slots = slots.where(c("slot") <= most)
    slots = slots.where(c("slot") <= c("n"))
    full = slots.where(c("slot") == c("n")).select(*group, c("since").alias("full_at"))
    held = slots.select(*group, "key", "since")
    joined = rows.join(held, [*group, "key"], "left").join(full, group, "left")
    has_slot = F.coalesce(c("since") <= c("__at"), F.lit(False))
    has_room = ~c("writes") & (c("full_at").isNull() | (c("__at") <= c("full_at")))
    free = F.when(c("daily_free") < 0, True).when(c("daily_free") == 0, False).otherwise(has_slot | has_room)
    return joined.withColumn("free", free).drop("day", "__at", "since", "full_at")


def _largest_limit(prepared: DataFrame) -> int | None:
    """The largest daily allowance, to cut groups early. One number."""
    top = prepared.where(c("daily_free") > 0).agg(F.max("daily_free").alias("n")).first()["n"]
    return top if top is not None and top <= 100_000 else None


def _decision(source: Column, cost: Column, charged: Column, deducted: Column) -> list[Column]:
    status = F.when(source == "refused", 402).when(source == "suspended", 403).otherwise(200).cast("int")
    return [
        "account", "event_id", "ts", status.alias("status"), source.alias("source"),
        charged.alias("charged"), cost.cast("bigint").alias("cost"), deducted.cast("bigint").alias("deducted"),
    ]


def _meter_solvent(charges: DataFrame) -> DataFrame:
    """Decisions of accounts that never run out, without any ordered fold."""
    zero = F.lit(0).cast("bigint")
    recorded = dedupe_repeats(charges).where("recorded").select("account", "key", "ts")
    first = charges.groupBy("account", "key", "ts").agg(F.min("event_id").alias("event_id"))
    heads = first.join(recorded, ["account", "key", "ts"]).select(
        "account", "event_id", F.lit(True).alias("head")
    )
    marked = charges.join(heads, ["account", "event_id"], "left")
    repeat = c("head").isNull()
    again = marked.where(repeat).select(*_decision(F.lit("repeat"), c("price"), F.lit(False), zero))
    new = marked.where(~repeat)
    asks = (c("price") > 0) & c("in_scope")
    limited = free_allowance(
        new.where(asks).withColumn("writes", F.lit(True)), _largest_limit(charges)
    )
    plain = new.where(~asks).withColumn("free", c("price") == 0)
    judged = limited.select(*plain.columns).unionByName(plain)
    source = F.when(c("free"), "free").otherwise("balance")
    cost = F.when(c("free"), zero).otherwise(c("price"))
    return judged.select(*_decision(source, cost, ~c("free"), cost)).unionByName(again)


def _epochs(rows: DataFrame) -> DataFrame:
    """Adds ``epoch``: how many credits and bans of the account came before the row.
    Only accounts that have any are counted, on narrow rows in time buckets."""
    plain = rows.where(~c("mixed")).withColumn("epoch", F.lit(0).cast("bigint"))
    mixed = rows.where("mixed")
    lifts = F.when(c("op").isin(*LIFTING_OPS), 1).otherwise(0).alias("lifts")
    counted = running_total(
        mixed.select("account", "event_id", "ts", lifts), ["account"], "ts", "lifts", "event_id", "epoch"
    ).select("account", "event_id", c("epoch").cast("bigint").alias("epoch"))
    return plain.unionByName(mixed.join(counted, ["account", "event_id"]))


def turning_points(charges: DataFrame) -> DataFrame:
    """(account, key, ts, epoch, head): ``head`` numbers the moments of a key that
    decide its outcome, ``first`` marks the second in which one begins.

    Between two credits, without plans and changing terms, points and free slots
    only run down within a UTC day. So after the first request for a key, a later
    one is a repeat if that one was accepted and refused if it was refused. The
    only other moment that matters is when yesterday's acceptance turns 24 hours
    old, and that was itself such a moment. Work is spread by (account, key).
    """
    moments = charges.select("account", "key", "ts", "epoch").distinct()
    order = ["account", "key", "ts", "epoch"]
    ordered = moments.repartition("account", "key").sortWithinPartitions(*order)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, day, epoch, head, now_heads, due = None, None, None, 0, [], []
        for batch in batches:
            owners, names, times, epochs = (batch.column(i).to_pylist() for i in range(4))
            heads, firsts = [], []
            for pair, ts, lifted in zip(zip(owners, names), times, epochs):
                today, clock = divmod(ts, machine.DAY)
                first = True
                if pair != current or today != day:
                    follows = pair == current and today == day + 1
                    due = sorted(d for d in now_heads if d > clock) if follows else []
                    head, now_heads = (head + 1 if pair == current else 0), [clock]
                elif lifted != epoch or (due and clock >= due[0]):
                    due = [d for d in due if d > clock]
                    head += 1
                    now_heads.append(clock)
                else:
                    first = False
                current, day, epoch = pair, today, lifted
                heads.append(head)
                firsts.append(first)
            yield pa.record_batch(
                [batch.column(i) for i in range(4)] + [pa.array(heads, pa.int64()), pa.array(firsts)],
                names=[*order, "head", "first"],
            )

    return ordered.mapInArrow(
        mark, "account string, key string, ts bigint, epoch bigint, head bigint, first boolean"
    )


def _meter_rest(rows: DataFrame) -> DataFrame:
    """Decisions by the fold. An account on steady terms without plans only sends the
    requests that can change its course; the others take over their outcome."""
    simple = _epochs(rows.where("steady"))
    charges = simple.where(c("op") == "charge")
    moment = ["account", "key", "ts", "epoch"]
    heads = turning_points(charges)
    begins = charges.groupBy(*moment).agg(F.min("event_id").alias("event_id"))
    turning = heads.where("first").join(begins, moment).select("account", "event_id", "head")
    kept = charges.join(turning.select("account", "event_id"), ["account", "event_id"], "left_semi")
    others = rows.where(~c("steady") | (c("op") != "charge"))
    made = _fold(kept.select(EVENT_COLUMNS).unionByName(others.select(EVENT_COLUMNS)), f"{DECISION_DDL}, key string", False)
    outcome = made.join(turning, ["account", "event_id"]).select(
        "account", "key", "head", c("event_id").alias("decided"), "source"
    )
    late = charges.join(heads, moment).join(outcome, ["account", "key", "head"])
    late = late.where(c("event_id") != c("decided"))
    refused = c("source").isin("refused", "suspended")
    zero = F.lit(0).cast("bigint")
    cost = F.when(c("source") == "suspended", zero).otherwise(c("price"))
    derived = late.withColumn("source", F.when(refused, c("source")).otherwise("repeat")).select(
        *_decision(c("source"), cost, F.lit(False), zero)
    )
    return made.drop("key").unionByName(derived)


def meter(log: DataFrame, revisions: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """H6: one decision per log row (account, event_id, ts, status, source, charged,
    cost, deducted). ``log`` has account, event_id, ts, kind, key and optionally op
    with its arguments; ``accounts`` gives opening balances."""
    return meter_prepared(_opening(accounts, prepare(log, revisions)))


def meter_prepared(prepared: DataFrame) -> DataFrame:
    """H6 on a prepared log. The log is read for the summaries and for each way of
    metering, so it is stored once in the shared checkpoint folder."""
    prepared = stage(prepared)
    rows = prepared.join(stage(_summaries(prepared)), "account")
    solvent = _meter_solvent(rows.where(c("solvent") & (c("op") == "charge")))
    return solvent.unionByName(_meter_rest(rows.where(~c("solvent"))))


def meter_with_figures(log: DataFrame, revisions: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """H6 with the balance and the remaining quota after each row (H14). The
    figures depend on every earlier row, so all accounts take the fold."""
    prepared = _opening(accounts, prepare(log, revisions))
    return _fold(prepared, f"{DECISION_DDL}, {FIGURE_DDL}", False)


def account_states(log: DataFrame, revisions: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """The state of every account after the log."""
    return _fold(_opening(accounts, prepare(log, revisions)), STATE_DDL, True)


def account_status(states: DataFrame, policy: DataFrame, now: int) -> DataFrame:
    """What an account page shows at ``now`` under one policy (a one-row
    DataFrame with ``document``), without rolling the window."""
    terms = parse_document(c("document"))["plans"]
    rows = states.join(F.broadcast(policy.select(terms.alias("terms"))))
    plan = F.coalesce(*[F.when(c("plan") == n, F.get("terms", F.lit(i))) for i, n in enumerate(PLANS)])
    active = c("plan").isNotNull() & (c("period_end") > now)
    fresh = c("win_start").isNull() | (c("win_start") + machine.WINDOW <= now)
    zero = F.lit(0).cast("bigint")
    used = lambda n: F.when(active & ~fresh, c(n)).otherwise(zero)
    left = lambda top, n: F.when(active & top.isNotNull(), F.greatest(top - used(n), zero))
    return rows.select(
        "account", "balance", F.when(active, c("plan")).alias("plan"),
        F.when(active, c("period_end")).otherwise(zero).alias("period_end"),
        left(plan["views"], "win_views").alias("views_remaining"),
        left(plan["searches"], "win_search").alias("searches_remaining"),
        F.when(active & ~fresh, c("win_start") + machine.WINDOW).otherwise(zero).alias("window_reset"),
        "banned", "total_views",
    )


def daily_usage(log: DataFrame) -> DataFrame:
    """Different resources per (account, day, kind)."""
    return log.groupBy("account", day_bucket(c("ts")).alias("day"), "kind").agg(
        F.countDistinct("key").alias("resources")
    )


def meter_guests(log: DataFrame, revisions: DataFrame) -> DataFrame:
    """H8: guests may use the daily allowance where no login is required. ``op`` is
    ``charge`` or ``check``. Days in which the allowance changed take a small fold
    per (account, day, kind); all others are decided by ranking."""
    rows = stage(prepare(log, revisions))
    open_rows = rows.where(~c("login_required"))
    refused = rows.where("login_required").select("account", "event_id", "ts", F.lit(401).alias("status"))
    day = day_bucket(c("ts"))
    group = ["account", "day", "kind"]
    limit = F.when(c("in_scope") & (c("daily_free") > 0), c("daily_free"))
    items = open_rows.withColumn("writes", c("op") == "charge").withColumn("day", day)
    spread = items.groupBy(*group).agg((F.min(limit) < F.max(limit)).alias("varies")).where("varies")
    changing = spread.select(*group, F.lit(True).alias("varies"))
    inside = items.where("in_scope").join(changing, group, "left")
    steady = free_allowance(inside.where(c("varies").isNull()), _largest_limit(rows))
    moving = _fold_allowance(inside.where("varies"))
    status = F.when(c("free"), 200).otherwise(402)
    columns = ["account", "event_id", "ts", status.alias("status")]
    outside = items.where(~c("in_scope")).select("account", "event_id", "ts", F.lit(402).alias("status"))
    return (
        steady.select(*columns).unionByName(moving.select(*columns)).unionByName(outside).unionByName(refused)
    )


def _fold_allowance(items: DataFrame) -> DataFrame:
    """H7 for groups whose limit changes within the day, one use per resource and
    limit kept in state."""
    ordered = items.select(
        "account", "day", "kind", "ts", "event_id", "key", "daily_free", "writes"
    ).repartition("account", "day", "kind").sortWithinPartitions("account", "day", "kind", "ts", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, store = None, None, None
        for batch in batches:
            rows, free = batch.to_pylist(), []
            for row in rows:
                group = (row["account"], row["day"], row["kind"])
                if group != current:
                    current, state, store = group, machine.Account(), machine.MemoryStore()
                event = machine.Event("charge", row["ts"], row["kind"], row["key"], daily_free=row["daily_free"])
                place = machine.free_place(state, store, event)
                if place == "new" and row["writes"]:
                    machine.take_place(state, store, event)
                free.append(place is not None)
            yield pa.record_batch(
                [batch.column("account"), batch.column("event_id"), batch.column("ts"), pa.array(free, pa.bool_())],
                names=["account", "event_id", "ts", "free"],
            )

    return ordered.mapInArrow(run, "account string, event_id bigint, ts bigint, free boolean")


