"""The account machine (H4-H13) as a transition table, shared by batch and stream.

``TABLE`` gives for each operation its rules in order of precedence. A rule has a
condition on the situation, an answer and the moves that change the account; the
first rule that holds decides. A check runs the rules of a charge with their moves
taken out. Ordering, policy lookup and pricing happen before, as DataFrame
operations; ``step`` is the only per-row Python of metering.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

# fixed values: window, dedupe horizon and plan periods in seconds
WINDOW = 5 * 3600
REPEAT = 86_400
DAY = 86_400
PERIOD = 30 * 86_400
DEFAULT_PLAN_PRICE = {"basic": 20_000, "pro": 50_000}
MAX_GRANT_DAYS = 3650
I64_MAX, I64_MIN = 2**63 - 1, -(2**63)
VIEW_KINDS = ("image", "video", "similar")  # the others draw from the search quota

VIEWS, SEARCHES = 1, 2  # places of the two quotas in plan terms and in a window
OPENING = ("charge", "credit", "init")  # grant the signup points if that is still to do


def clamp64(value: int) -> int:
    return max(I64_MIN, min(value, I64_MAX))


def elapsed(start: int | None, now: int) -> bool:
    """H5: no window is open at ``now``."""
    return start is None or now - start >= WINDOW


@dataclass
class Account:
    """Scalar state; the three collections live in a store."""

    init: bool = False
    balance: int = 0
    plan: str | None = None
    plan_paid: int | None = None
    period_end: int = 0
    win_start: int | None = None
    win_views: int = 0
    win_search: int = 0
    banned: bool = False
    total_views: int = 0
    free_day: int = -1
    free_used: dict = field(default_factory=dict)
    last_ts: int = -1

    def dump(self) -> dict:
        return asdict(self)

    @property
    def window(self) -> tuple:
        """(start, views, searches), so that quotas have the places of plan terms."""
        return self.win_start, self.win_views, self.win_search

    @window.setter
    def window(self, value: tuple) -> None:
        self.win_start, self.win_views, self.win_search = value

    def on_plan(self, now: int) -> bool:
        """A plan ends by its time, nothing has to be written for that."""
        return self.plan is not None and now < self.period_end

    def move_balance(self, by: int) -> None:
        self.balance = clamp64(self.balance + by)


class MemoryStore:
    """Seen keys, free resources of the day and used tokens, in memory."""

    def __init__(self):
        self.seen: dict[str, int] = {}
        self.free: set[tuple[str, str]] = set()
        self.tokens: set[str] = set()
        self._swept = 0

    def last_seen(self, key: str):
        return self.seen.get(key)

    def record(self, key: str, now: int) -> None:
        self.seen[key] = now
        if len(self.seen) > 1024 and now >= self._swept + 3600:  # forget what cannot repeat
            self.seen = {k: t for k, t in self.seen.items() if t > now - REPEAT}
            self._swept = now

    def has_free(self, kind: str, key: str) -> bool:
        return (kind, key) in self.free

    def add_free(self, kind: str, key: str) -> None:
        self.free.add((kind, key))

    def clear_free(self) -> None:
        self.free.clear()

    def has_token(self, token: str) -> bool:
        return token in self.tokens

    def add_token(self, token: str) -> None:
        self.tokens.add(token)


@dataclass
class Event:
    """One log row with the policy terms in force at its time."""

    op: str
    ts: int
    kind: str | None = None
    key: str | None = None
    price: int = 0
    daily_free: int = 0
    in_scope: bool = True
    signup: int = 0
    plans: dict = field(default_factory=dict)  # name -> (price, views, searches)
    plan: str | None = None  # subscribe, grant
    points: int = 0  # credit
    token: str | None = None  # credit, grant
    expected_price: int | None = None  # subscribe
    days: int = 0  # grant
    flag: bool = False  # ban


@dataclass
class Decision:
    """The answer. ``deducted`` is what the balance really lost."""

    status: int
    source: str
    charged: bool = False
    cost: int = 0
    deducted: int = 0
    balance: int = 0
    views_remaining: int | None = None
    searches_remaining: int | None = None
    window_reset: int = 0


def figures(a: Account, plans: dict, now: int, window: tuple | None = None) -> dict:
    """Remaining quotas (NULL: no plan, or no limit) and the end of ``window``;
    by default of the stored one, which counts as unused once it has elapsed."""
    out = {"views_remaining": None, "searches_remaining": None, "window_reset": 0}
    if not a.on_plan(now):
        return out
    used = window or ((None, 0, 0) if elapsed(a.win_start, now) else a.window)
    terms = plans.get(a.plan)
    for name, quota in (("views_remaining", VIEWS), ("searches_remaining", SEARCHES)):
        if terms is not None and terms[quota] is not None:
            out[name] = max(0, terms[quota] - used[quota])
    if not elapsed(used[0], now):
        out["window_reset"] = used[0] + WINDOW
    return out


def free_place(a: Account, store, e: Event) -> str | None:
    """H7: ``always``, ``held`` (the resource is one of today's), ``new`` (it would take
    a place that is left today) or None."""
    if e.daily_free <= 0:
        return "always" if e.daily_free < 0 else None
    today = a.free_day == e.ts // DAY
    if today and store.has_free(e.kind, e.key):
        return "held"
    return "new" if (a.free_used.get(e.kind, 0) if today else 0) < e.daily_free else None


def take_place(a: Account, store, e: Event) -> None:
    """Writes down a ``new`` place. Places of an earlier day are forgotten."""
    if a.free_day != e.ts // DAY:
        a.free_day, a.free_used = e.ts // DAY, {}
        store.clear_free()
    a.free_used[e.kind] = a.free_used.get(e.kind, 0) + 1
    store.add_free(e.kind, e.key)


class Situation:
    """An event and the account that it meets; what the conditions ask for."""

    def __init__(self, a: Account, store, e: Event):
        self.a, self.store, self.e, self.now = a, store, e, e.ts
        self.before = a.balance
        unopened = e.op == "check" and not a.init and not a.banned
        self.funds = clamp64(a.balance + e.signup) if unopened else a.balance
        self.place = None

    # ---- charges
    def repeated(self) -> bool:
        last = self.store.last_seen(self.e.key)
        return last is not None and last > max(self.now - REPEAT, 0)

    def included(self) -> bool:
        """Free by its price or by the daily allowance."""
        if self.e.price and self.e.in_scope:
            self.place = free_place(self.a, self.store, self.e)
        return not self.e.price or self.place is not None

    def window(self) -> tuple:
        """The window that counts now; it is stored only with an accepted charge."""
        due = self.a.on_plan(self.now) and elapsed(self.a.win_start, self.now)
        return (self.now, 0, 0) if due else self.a.window

    def draw(self) -> tuple[int, int]:
        """The quota that the kind draws from, and how much."""
        return (VIEWS, self.e.price) if self.e.kind in VIEW_KINDS else (SEARCHES, 1)

    def covered(self, unlimited: bool) -> bool:
        """The plan pays: without a limit, or from what is left in the window."""
        terms = self.e.plans.get(self.a.plan) if self.a.on_plan(self.now) else None
        if terms is None:
            return False
        quota, amount = self.draw()
        if unlimited or terms[quota] is None:
            return unlimited and terms[quota] is None
        return self.window()[quota] + amount <= terms[quota]

    # ---- plans and points
    def refund(self) -> int:
        """C18 on what was paid for the running period."""
        if self.a.plan not in DEFAULT_PLAN_PRICE or not self.a.on_plan(self.now):
            return 0
        paid = DEFAULT_PLAN_PRICE[self.a.plan] if self.a.plan_paid is None else self.a.plan_paid
        return paid * min(self.a.period_end - self.now, PERIOD) // PERIOD

    def price(self) -> int:
        return self.e.plans[self.e.plan][0]

    def net(self) -> int:
        return self.price() - self.refund()

    def token(self) -> str:
        return f"{'plan' if self.e.op == 'grant' else self.e.op}:{self.e.token}"

    def used(self) -> bool:
        return self.store.has_token(self.token())


# ------------------------------------------------------------------------ moves
def _keep_place(s: Situation) -> None:
    if s.place == "new":
        take_place(s.a, s.store, s.e)


def _keep_window(s: Situation) -> None:
    s.a.window = s.window()


def _draw_quota(s: Situation) -> None:
    quota, amount = s.draw()
    s.a.window = tuple(n + amount if i == quota else n for i, n in enumerate(s.window()))


def _pay_price(s: Situation) -> None:
    s.a.move_balance(-s.e.price)


def _remember(s: Situation) -> None:
    s.store.record(s.e.key, s.now)
    s.a.total_views += 1


def _pay_net(s: Situation) -> None:
    s.a.balance = max(0, clamp64(s.a.balance - s.net()))


def _pay_back(s: Situation) -> None:
    s.a.move_balance(s.refund())


def _add_points(s: Situation) -> None:
    s.a.balance = max(0, clamp64(s.a.balance + s.e.points))


def _use_token(s: Situation) -> None:
    s.store.add_token(s.token())


def _start_plan(paid: Callable[[Situation], int], length: Callable[[Situation], int]):
    def move(s: Situation) -> None:
        s.a.plan, s.a.plan_paid, s.a.period_end = s.e.plan, paid(s), s.now + length(s)
        _keep_window(s)

    return move


def _stop_plan(s: Situation) -> None:
    s.a.plan, s.a.plan_paid, s.a.period_end = None, 0, 0


def _set_ban(s: Situation) -> None:
    s.a.banned = s.e.flag


# ------------------------------------------------------------------------ table
def _always(s: Situation) -> bool:
    return True


def _nothing(s: Situation) -> int:
    return 0


def _asked(s: Situation) -> int:
    return s.e.price


def _returned(s: Situation) -> int:
    return -s.refund()


@dataclass(frozen=True)
class Rule:
    when: Callable[[Situation], bool]
    status: int
    source: str
    cost: Callable[[Situation], int] = _nothing
    moves: tuple[Callable[[Situation], None], ...] = ()
    charged: bool = False
    shows: str | None = None  # figures of the "stored" window or of the one that "counts"


SUSPENDED = Rule(lambda s: s.a.banned, 403, "suspended")
CHARGE = (
    SUSPENDED,
    Rule(Situation.repeated, 200, "repeat", _asked, shows="stored"),
    Rule(Situation.included, 200, "free", moves=(_keep_place, _keep_window, _remember), shows="stored"),
    Rule(lambda s: s.covered(True), 200, "unlimited", _asked, (_keep_window, _remember), True, "stored"),
    Rule(lambda s: s.covered(False), 200, "window", _asked, (_draw_quota, _remember), True, "stored"),
    Rule(lambda s: s.funds >= s.e.price, 200, "balance", _asked, (_keep_window, _pay_price, _remember), True, "stored"),
    Rule(_always, 402, "refused", _asked, shows="counts"),
)
TABLE = {
    "charge": CHARGE,
    "check": tuple(Rule(r.when, r.status, "allowed") if r.moves else r for r in CHARGE),
    "subscribe": (
        SUSPENDED,
        Rule(lambda s: s.e.plan not in s.e.plans, 400, "unknown plan"),
        Rule(lambda s: s.e.expected_price not in (None, s.price()), 409, "price changed", Situation.price),
        Rule(lambda s: s.net() > 0 and s.funds < s.net(), 402, "refused", Situation.net),
        Rule(_always, 200, "subscribed", Situation.net,
             (_pay_net, _start_plan(Situation.price, lambda s: PERIOD)), True, "stored"),
    ),
    "unsubscribe": (Rule(_always, 200, "unsubscribed", _returned, (_pay_back, _stop_plan)),),
    "grant": (
        Rule(Situation.used, 200, "known", shows="stored"),
        Rule(lambda s: s.e.plan == "none", 200, "granted", _returned, (_pay_back, _stop_plan, _use_token)),
        Rule(lambda s: s.e.plan in s.e.plans and 1 <= s.e.days <= MAX_GRANT_DAYS, 200, "granted", _returned,
             (_pay_back, _start_plan(_nothing, lambda s: s.e.days * DAY), _use_token), shows="stored"),
        Rule(_always, 400, "unknown plan"),
    ),
    "credit": (
        Rule(Situation.used, 200, "known"),
        Rule(_always, 200, "credited", moves=(_add_points, _use_token)),
    ),
    "ban": (
        Rule(lambda s: s.e.flag, 200, "banned", moves=(_set_ban,)),
        Rule(_always, 200, "unbanned", moves=(_set_ban,)),
    ),
    "init": (Rule(_always, 200, "initialised", shows="stored"),),
}


def step(a: Account, store, e: Event) -> Decision:
    """Apply one event to the account."""
    if e.op not in TABLE:
        raise ValueError(f"unknown operation {e.op!r}")
    if e.op in OPENING and not a.init:  # H9
        a.init = True
        a.move_balance(e.signup)
    s = Situation(a, store, e)
    rule = next(r for r in TABLE[e.op] if r.when(s))
    cost = rule.cost(s)
    for move in rule.moves:
        move(s)
    made = Decision(rule.status, rule.source, rule.charged, cost, s.before - a.balance,
                    s.funds if e.op == "check" else a.balance)
    if rule.shows is None:
        return made
    return replace(made, **figures(a, e.plans, s.now, s.window() if rule.shows == "counts" else None))
