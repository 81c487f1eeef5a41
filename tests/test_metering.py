"""Batch metering against a plain loop over the account machine, and the stream against the batch."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumicat.operators import account as machine
from lumicat.operators import metering, ordered
from lumicat.operators.ledger import apply_credits
from lumicat.streaming.metering import meter_stream
from lumicat.streaming.sinks import write_stream

c = F.col
T0 = 1_700_000_000
KINDS = ("image", "video", "upload", "similar", "description")
LOG_DDL = "account string, event_id bigint, ts bigint, op string, kind string, key string, plan string, points bigint, token string, expected_price bigint, days int, flag boolean"


def revisions(spark, terms):
    """terms: list of (updated_at, signup, daily_free, price factor)."""
    rows = []
    for i, (at, signup, free, factor) in enumerate(terms):
        items = [{"price": p * factor, "daily_free": free} for p in (1, 3, 9, 2, 10)]
        plans = [{"price": 40, "views": 6, "searches": 1}, {"price": 90, "views": None, "searches": 2}]
        rows.append((i, json.dumps({"login_required": False, "free_media_folders": ["/images/1", "/videos"],
                                    "items": items, "plans": plans, "signup_points": signup}), at, "x"))
    return spark.createDataFrame(rows, "revision int, document string, updated_at bigint, updated_by string")


def random_log(seed, n, ops, span=4 * 86400, accounts=4, keys=12):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # one account holds a good third of the rows
        account = "hot" if rng.random() < 0.4 else f"a{rng.randrange(accounts)}"
        kind = rng.choice(KINDS)
        k = rng.randrange(keys)
        key = f"/images/{k % 3}/{k}" if kind == "image" else f"{kind}:{k}"
        ts = T0 + rng.randrange(span) // 50 * 50
        op = rng.choice(ops)
        rows.append((account, i, ts, op, kind, key, rng.choice(["basic", "pro", "none", "gold"]), rng.randrange(-30, 60),
                     str(rng.randrange(40)), rng.choice([None, None, 40]), rng.randrange(0, 4), rng.random() < 0.3))
    return rows


def in_scope(kind, key):
    if kind not in ("image", "video"):
        return True
    return any(key == f or key.startswith(f + "/") for f in ("/images/1", "/videos"))


def expected(rows, terms):
    out, accounts = {}, {}
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        account, event_id, ts, op, kind, key, plan, points, token, expected_price, days, flag = row
        _, signup, free, factor = [t for t in terms if t[0] <= ts][-1]
        state, store = accounts.setdefault(account, (machine.Account(), machine.MemoryStore()))
        price = dict(zip(KINDS, (1, 3, 9, 2, 10)))[kind] * factor
        out[event_id] = machine.step(state, store, machine.Event(
            op, ts, kind, key, price, free, in_scope(kind, key), signup,
            {"basic": (40, 6, 1), "pro": (90, None, 2)}, plan, points, token, expected_price, days, flag))
    return out


CHARGES, EVERYTHING = ["charge"], ["charge"] * 6 + ["check", "credit", "subscribe", "unsubscribe", "grant", "ban"]
NO_PLANS = ["charge"] * 8 + ["check", "credit", "ban"]
STEADY = lambda signup, free: [(0, signup, free, 1)]
MOVING = [(0, 60, 2, 1), (T0 + 100_000, 60, 1, 2), (T0 + 200_000, 60, 3, 1)]


@pytest.mark.parametrize("ops,terms", [
    (CHARGES, STEADY(10**9, 2)), (CHARGES, STEADY(60, 2)), (CHARGES, STEADY(25, 0)), (CHARGES, STEADY(0, 1)),
    (CHARGES, MOVING), (EVERYTHING, STEADY(60, 1)), (EVERYTHING, MOVING),
    (NO_PLANS, STEADY(60, 1)), (NO_PLANS, STEADY(0, 0)), (NO_PLANS, MOVING)])
def test_batch_equals_the_plain_loop(spark, ops, terms):
    rows = random_log(len(ops) + terms[0][1], 900, ops)
    log = spark.createDataFrame(rows, LOG_DDL)
    want = expected(rows, terms)
    got = metering.meter(log, revisions(spark, terms)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.event_id]
        assert (r.status, r.source, r.charged, r.cost, r.deducted) == (w.status, w.source, w.charged, w.cost, w.deducted), r


def test_figures_equal_the_plain_loop(spark):
    rows = random_log(7, 600, EVERYTHING)
    want = expected(rows, MOVING)
    for r in metering.meter_with_figures(spark.createDataFrame(rows, LOG_DDL), revisions(spark, MOVING)).collect():
        assert {k: v for k, v in r.asDict().items() if k in vars(want[r.event_id])} == vars(want[r.event_id])


def test_turning_points_shrink_a_hot_key(spark):
    rows = [("hot", i, T0 + i, "charge", "image", "same", None, None, None, None, None, None) for i in range(3000)]
    heads = metering.turning_points(spark.createDataFrame(rows, LOG_DDL).withColumn("epoch", F.lit(0).cast("bigint")))
    assert heads.where("first").count() <= 2


def test_opening_balances(spark):
    rows = [("a", 1, T0, "charge", "video", "v", None, None, None, None, None, None)]
    opening = spark.createDataFrame([("a", 2)], "account string, balance bigint")
    got = metering.meter(spark.createDataFrame(rows, LOG_DDL), revisions(spark, STEADY(100, 0)), opening).collect()
    assert [r.source for r in got] == ["refused"]


@pytest.mark.parametrize("terms", [STEADY(0, 2), MOVING, STEADY(0, 0), STEADY(0, -1)])
def test_guests(spark, terms):
    rows = random_log(3, 800, ["charge", "charge", "check"])
    got = {r.event_id: r.status for r in metering.meter_guests(spark.createDataFrame(rows, LOG_DDL), revisions(spark, terms)).collect()}
    states = {}
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        account, event_id, ts, op, kind, key = row[:6]
        free = [t for t in terms if t[0] <= ts][-1][2]
        state, store = states.setdefault((account, kind), (machine.Account(), machine.MemoryStore()))
        event = machine.Event("charge", ts, kind, key, daily_free=free)
        place = machine.free_place(state, store, event) if in_scope(kind, key) else None
        if place == "new" and op == "charge":
            machine.take_place(state, store, event)
        ok = place is not None
        assert got[event_id] == (200 if ok else 402), row


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(random_log(11, 500, EVERYTHING), key=lambda r: (r[2], r[1]))
    log = spark.createDataFrame(rows, LOG_DDL)
    # files in time order, one micro-batch each
    for i, lo in enumerate(range(0, 500, 125)):
        part = spark.createDataFrame(rows[lo:lo + 125], LOG_DDL).coalesce(1)
        part.write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG_DDL).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    revs = revisions(spark, MOVING)
    query = write_stream(meter_stream(stream, revs), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert query.awaitTermination(240)
    got = {r.event_id: r.asDict() for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: r.asDict() for r in metering.meter_with_figures(log, revs).collect()}
    assert got.keys() == want.keys()
    assert {k: got[k] for k in got if got[k] != want[k]} == {}


def test_late_rows_change_nothing(spark, tmp_path):
    def row(i, ts):
        return ("a", i, ts, "charge", "image", f"k{i}", None, None, None, None, None, None)

    for part in ([row(1, T0 + 100)], [row(2, T0 + 50), row(3, T0 + 100)]):
        spark.createDataFrame(part, LOG_DDL).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG_DDL).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = write_stream(meter_stream(stream, revisions(spark, STEADY(50, 0))), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert query.awaitTermination(240)
    got = {r.event_id: (r.source, r.balance) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == ("balance", 49) and got[2] == ("late", 49) and got[3] == ("balance", 48)


def test_credits_equal_the_plain_loop(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"a{rng.randrange(3)}", str(rng.randrange(300)), rng.randrange(-50, 50), T0 + rng.randrange(40_000), i)
            for i in range(1000)]
    credits = spark.createDataFrame(rows, "address string, key string, points bigint, at bigint, seq bigint")
    opening = spark.createDataFrame([("hot", 20), ("idle", 7)], "address string, balance bigint")
    balance, seen = {"hot": 20, "idle": 7}, set()
    for address, key, points, _, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        if (address, key) not in seen:
            seen.add((address, key))
            balance[address] = max(0, balance.get(address, 30) + points)
    got = {r.address: r.balance for r in apply_credits(opening, credits, signup_points=30).collect()}
    assert got == balance


def test_bucketed_windows_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(3)}", rng.randrange(20_000), i, rng.randrange(-9, 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, at bigint, seq bigint, v bigint")
    totals = {r.seq: int(r.total) for r in ordered.running_total(df, ["k"], "at", "v", "seq").collect()}
    nexts = {r.seq: r.next for r in ordered.next_value(df, ["k"], "at", "seq", "v").collect()}
    for key in {r[0] for r in rows}:
        run, mine = 0, sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, row in enumerate(mine):
            run += row[3]
            assert totals[row[2]] == run
            assert nexts[row[2]] == (mine[i + 1][3] if i + 1 < len(mine) else None)


def test_stream_files_hold_few_rows_in_order(spark, tmp_path):
    from types import SimpleNamespace

    from checks.stream_checks import feed

    rows = spark.range(1000).selectExpr("id", "id * id DIV 7 AS ts")
    feed(SimpleNamespace(spark=spark), rows, str(tmp_path / "in"), "ts", most=100)
    files = sorted((tmp_path / "in").glob("part-*.json"), key=lambda p: p.stat().st_mtime_ns)
    parts = [[json.loads(line)["ts"] for line in p.read_text().splitlines()] for p in files]
    assert max(map(len, parts)) <= 150 and sum(map(len, parts)) == 1000
    assert all(max(a) < min(b) for a, b in zip(parts, parts[1:]))


def test_stream_rows_in_order_by_chunks(monkeypatch):
    from lumicat.streaming import metering as streaming

    monkeypatch.setattr(streaming, "CHUNK", 3)
    frames = [pd.DataFrame({"ts": [5, 1, 5], "event_id": [2, 9, 1], "plan": ["a", None, "b"]}), pd.DataFrame({"ts": [3, 1], "event_id": [4, 8], "plan": [None, None]})]
    chunks = list(streaming._in_order(frames))
    assert [len(x) for x in chunks] == [3, 2]
    assert [(r["ts"], r["event_id"], r["plan"]) for x in chunks for r in x] == [(1, 8, None), (1, 9, None), (3, 4, None), (5, 1, "b"), (5, 2, "a")]


def test_settings_fields_are_read_once(spark):
    from lumicat.operators import policy

    forms = spark.sql("SELECT map('revision', concat('', id)) AS form FROM range(3)")
    plan = policy.parse_policy_rows(forms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("element_at(form") <= 30


class CountedState:
    """A state variable in memory that counts its calls."""

    def __init__(self, calls):
        self._calls, self._values = calls, {}

    def _call(self):
        self._calls.append(1)
        return self._values

    def exists(self):
        return () in self._call()

    def get(self):
        return self._call()[()]

    def update(self, value):
        self._call()[()] = value

    def containsKey(self, key):
        return key in self._call()

    def getValue(self, key):
        return self._call()[key]

    def updateValue(self, key, value):
        self._call()[key] = value

    def removeKey(self, key):
        del self._call()[key]

    def iterator(self):
        return iter(list(self._call().items()))

    def clear(self):
        self._call().clear()


class CountedHandle:
    def __init__(self):
        self.calls, self._states = [], {}

    def getValueState(self, name, *schema):
        return self._states.setdefault(name, CountedState(self.calls))

    getMapState = getValueState


def metered(handle, rows, terms, frame=100):
    """What the processor answers to the rows of one account in a micro-batch."""
    from lumicat.operators.metering import EVENT_COLUMNS
    from lumicat.streaming.metering import MeterProcessor

    plans = json.dumps([{"price": 40, "views": 6, "searches": 1}, {"price": 90, "searches": 2}])
    events = []
    for account, event_id, ts, op, kind, key, plan, points, token, expected_price, days, flag in rows:
        _, signup, free, factor = [t for t in terms if t[0] <= ts][-1]
        price = dict(zip(KINDS, (1, 3, 9, 2, 10)))[kind] * factor
        events.append((account, event_id, ts, op, kind, key, price, free, in_scope(kind, key), signup, plans, plan, points, token,
                       None if expected_price is None else str(expected_price), days, flag))
    frames = [pd.DataFrame(events[at:at + frame], columns=EVENT_COLUMNS) for at in range(0, len(events), frame)]
    processor = MeterProcessor()
    processor.init(handle)
    return [r for f in processor.handleInputRows((rows[0][0],), iter(frames), None) for r in f.to_dict("records")]


def test_stream_calls_the_state_less_than_once_a_row():
    charges = [("a", i, T0 + i * 8, "charge", "video", f"v{i}", None, 0, None, None, 0, False) for i in range(20_000)]
    handle = CountedHandle()
    got = [r for at in (0, 10_000) for r in metered(handle, charges[at:at + 10_000], STEADY(10**9, 2), 2500)]
    want = expected(charges, STEADY(10**9, 2))
    assert {r["event_id"]: (r["source"], r["balance"]) for r in got} == {k: (d.source, d.balance) for k, d in want.items()}
    assert len(handle.calls) < len(charges) / 2


@pytest.mark.parametrize("held,slices", [(500_000, 1024), (5, 4), (0, 1)])
def test_stream_state_in_slices(monkeypatch, held, slices):
    from lumicat.streaming import metering as streaming

    monkeypatch.setattr(streaming, "HELD", held, raising=False)
    monkeypatch.setattr(streaming, "SLICES", slices, raising=False)
    rows = sorted((("a", *r[1:]) for r in random_log(17, 900, EVERYTHING)), key=lambda r: (r[2], r[1]))
    want, handle = expected(rows, MOVING), CountedHandle()
    cuts = [i for i in range(1, len(rows)) if i % 200 == 0]
    while any(rows[i - 1][2] == rows[i][2] for i in cuts):
        cuts = [i + (rows[i - 1][2] == rows[i][2]) for i in cuts]
    got = [r for a, b in zip([0, *cuts], [*cuts, len(rows)]) for r in metered(handle, random.Random(a).sample(rows[a:b], b - a), MOVING, 30)]
    assert len(got) == len(rows)
    for r in got:
        w = vars(want[r["event_id"]])
        assert {k: None if pd.isna(r[k]) else r[k] for k in w} == w


def test_stream_keeps_large_whole_numbers_beside_nulls(spark, tmp_path):
    rows = [("a", 1, T0, "credit", "image", "k", None, 2**53 + 1, "t1", None, None, None),
            ("a", 2, T0 + 1, "credit", "image", "k", None, None, "t2", 2**53 + 1, 3, True)]
    log = spark.createDataFrame(rows, LOG_DDL)
    log.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG_DDL).json(str(tmp_path / "in"))
    query = write_stream(meter_stream(stream, revisions(spark, STEADY(0, 0))), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert query.awaitTermination(240)
    got = {r.event_id: r.balance for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 2**53 + 1, 2: 2**53 + 1}


def test_stream_files_are_of_equal_size_beyond_the_limit(spark, tmp_path):
    from types import SimpleNamespace

    from checks.stream_checks import feed

    rows = spark.range(1000).selectExpr("id", "id * id DIV 7 AS ts")
    feed(SimpleNamespace(spark=spark), rows, str(tmp_path / "in"), "ts", most=400)
    sizes = [len(p.read_text().splitlines()) for p in (tmp_path / "in").glob("part-*.json")]
    assert sum(sizes) == 1000 and max(sizes) <= 400
