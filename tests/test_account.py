"""The account machine on its own."""

import pytest

from lumicat.operators.account import (
    DAY, PERIOD, TABLE, WINDOW, Account, Event, MemoryStore, elapsed, figures, step,
)

PLANS = {"basic": (20_000, 2_000, 10), "pro": (50_000, None, 50)}
T0 = 1_700_000_000


def charge(ts, key="k", kind="image", price=1, **more):
    return Event("charge", ts, kind, key, price, plans=PLANS, **more)


def run(events, account=None):
    account, store = account or Account(), MemoryStore()
    return account, [step(account, store, e) for e in events]


@pytest.mark.parametrize("plan,active,kind,views,searches,balance,cost,want", [
    ("pro", True, "image", 10**6, 0, 0, 1, "unlimited"),
    ("pro", True, "similar", 0, 0, 0, 10, "unlimited"),
    ("pro", True, "upload", 0, 49, 0, 100, "window"),
    ("pro", True, "upload", 0, 50, 99, 100, "refused"),
    ("basic", True, "image", 1999, 0, 0, 1, "window"),
    ("basic", True, "image", 2000, 0, 1, 1, "balance"),
    ("basic", True, "image", 2000, 0, 0, 1, "refused"),
    ("basic", True, "similar", 1990, 0, 0, 10, "window"),
    ("basic", True, "similar", 1991, 0, 0, 10, "refused"),
    ("basic", True, "description", 0, 9, 0, 100, "window"),
    ("basic", False, "image", 0, 0, 5, 1, "balance"),
    (None, False, "video", 0, 0, 4, 5, "refused"),
])
def test_source(plan, active, kind, views, searches, balance, cost, want):
    def account():
        return Account(init=True, balance=balance, plan=plan, period_end=T0 + (DAY if active else 0),
                       win_start=T0 - 60, win_views=views, win_search=searches)

    after, (got,) = run([charge(T0, kind=kind, price=cost)], account())
    assert got.source == want and got.cost == cost and got.charged == (want != "refused")
    assert after.balance == balance - (cost if want == "balance" else 0)
    drawn = (after.win_views - views, after.win_search - searches)
    view = kind in ("image", "video", "similar")
    assert drawn == ((0, 0) if want != "window" else (cost, 0) if view else (0, 1))
    checked, (may,) = run([Event("check", T0, kind, "k", cost, plans=PLANS)], account())
    assert may.source == ("refused" if want == "refused" else "allowed") and checked == account()


def test_window_edges():
    assert elapsed(None, T0) and elapsed(T0, T0 + WINDOW) and not elapsed(T0, T0 + WINDOW - 1)


@pytest.mark.parametrize("plan,paid,left,want", [
    ("basic", 20_000, 15 * DAY, 10_000), ("basic", 20_000, 99 * DAY, 20_000), ("basic", 20_000, 0, 0),
    ("basic", 20_000, -5, 0), ("basic", 0, DAY, 0), ("pro", None, 15 * DAY, 25_000), ("other", 900, DAY, 0),
    ("basic", 7, DAY, 0), (None, 20_000, DAY, 0),
])
def test_refunds(plan, paid, left, want):
    account = Account(init=True, plan=plan, plan_paid=paid, period_end=T0 + left)
    account, (got,) = run([Event("unsubscribe", T0, plans=PLANS)], account)
    assert account.balance == want and got.cost == got.deducted == -want and account.plan is None


def test_every_operation_always_has_an_answer():
    for op in TABLE:
        for flag in (False, True):
            _, got = run([Event(op, T0, "image", "k", 1, plan="x", flag=flag)] * 2)
            assert all(d.status in (200, 400, 402, 403, 409) for d in got)
    with pytest.raises(ValueError):
        run([Event("other", T0)])


def test_repeats_end_after_a_day_and_are_not_extended():
    _, got = run([charge(T0, signup=10), charge(T0 + 10), charge(T0 + DAY - 1), charge(T0 + DAY), charge(T0 + DAY + 1)])
    assert [d.source for d in got] == ["balance", "repeat", "repeat", "balance", "repeat"]
    assert [d.deducted for d in got] == [1, 0, 0, 1, 0]


def test_refused_requests_are_not_recorded():
    account, got = run([charge(T0, price=5), charge(T0 + 1, price=5)])
    assert [d.source for d in got] == ["refused", "refused"] and account.total_views == 0
    assert account.init


def test_checks_write_nothing():
    account, got = run([Event("check", T0, "image", "k", 1, signup=3, plans=PLANS)])
    assert got[0].source == "allowed" and got[0].balance == 3
    assert account.balance == 0 and not account.init


def test_daily_allowance():
    rows = [charge(T0 + i, f"k{i}", daily_free=2) for i in range(3)] + [charge(T0 + DAY, "k9", daily_free=2)]
    _, got = run(rows)
    assert [d.source for d in got] == ["free", "free", "refused", "free"]
    assert [d.charged for d in got] == [False] * 4
    _, out = run([charge(T0, daily_free=-1), charge(T0, "z", daily_free=-1, in_scope=False)])
    assert [d.source for d in out] == ["free", "refused"]


def test_plan_quota_then_balance():
    plans = {"basic": (50, 3, 1), "pro": (120, None, 2)}
    events = [Event("subscribe", T0, plan="basic", plans=plans)]
    events += [Event("charge", T0 + i, "image", f"k{i}", 1, plans=plans) for i in range(5)]
    events += [Event("charge", T0 + WINDOW, "image", "later", 1, plans=plans)]
    account = Account(init=True, balance=51)
    _, got = run(events, account)
    assert [d.source for d in got] == ["subscribed", "window", "window", "window", "balance", "refused", "window"]
    assert got[1].views_remaining == 2 and got[1].window_reset == T0 + WINDOW
    assert account.win_start == T0 + WINDOW and account.win_views == 1


def test_refusal_does_not_store_a_rolled_window():
    plans = {"basic": (0, 0, 0), "pro": (1, None, 1)}
    account, _ = run([Event("subscribe", T0, plan="basic", plans=plans),
                      Event("charge", T0 + WINDOW + 5, "image", "k", 1, plans=plans)])
    assert account.win_start == T0


def test_plan_changes():
    account = Account(init=True, balance=60_000)
    sub = lambda ts, plan, **m: Event("subscribe", ts, plan=plan, plans=PLANS, **m)
    _, got = run([
        sub(T0, "none"), sub(T0, "basic", expected_price=1), sub(T0, "basic"), sub(T0 + 15 * DAY, "pro"),
        Event("unsubscribe", T0 + 30 * DAY, plans=PLANS), sub(T0 + 31 * DAY, "pro")], account)
    assert [d.status for d in got] == [400, 409, 200, 200, 200, 402]
    # 60000 - 20000, then pro 50000 - 10000 back, then half of pro back
    assert [d.balance for d in got[2:5]] == [40_000, 0, 25_000]
    assert account.plan is None


def test_grants_have_no_refund_and_apply_once():
    grant = Event("grant", T0, plan="pro", token="t", days=10, plans=PLANS)
    account, got = run([grant, grant, Event("unsubscribe", T0 + DAY, plans=PLANS)])
    assert [d.source for d in got] == ["granted", "known", "unsubscribed"] and account.balance == 0
    _, bad = run([Event("grant", T0, plan="pro", token="t", days=3651, plans=PLANS)])
    assert bad[0].status == 400


def test_bans_and_credits():
    credit = lambda token, points: Event("credit", T0, token=token, points=points, signup=5)
    account, got = run([credit("a", 10), credit("a", 10), credit("b", -100), Event("ban", T0, flag=True), charge(T0)])
    assert [d.balance for d in got[:3]] == [15, 15, 0]
    assert got[-1].status == 403


def test_expired_plan_counts_as_none():
    account = Account(init=True, balance=20_000)
    run([Event("subscribe", T0, plan="basic", plans=PLANS)], account)
    assert figures(account, PLANS, T0 + PERIOD - 1)["searches_remaining"] == 10
    assert figures(account, PLANS, T0 + PERIOD)["searches_remaining"] is None
