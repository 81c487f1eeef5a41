"""The payment ledger, users and balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.functions.money import BIG, I64_MAX
from lumicat.functions.text import live_contains_pattern
from lumicat.operators.ordered import running_total
from lumicat.operators.paging import page, ranked, top_per_key

c = F.col
PAYMENT = ["tx_hash", "address", "chain", "token", "amount", "points", "status", "created_at"]


def _first_per_hash(rows: DataFrame) -> DataFrame:
    """One row per transaction in a batch: the earliest, then the smallest address."""
    rest = [n for n in rows.columns if n != "tx_hash"]
    first = rows.groupBy("tx_hash").agg(
        F.min_by(F.struct(*rest), F.struct("created_at", "address")).alias("__r")
    )
    return first.select("tx_hash", "__r.*")


def merge_payment_claims(payments: DataFrame, claims: DataFrame) -> DataFrame:
    """A verified claim becomes ``pending``. It replaces a rejected row or a
    pending row without points, and leaves every other row alone."""
    new = _first_per_hash(claims).select(
        "tx_hash", F.struct("address", "chain", "token", "amount", "points", "created_at").alias("__n")
    )
    both = payments.join(new, "tx_hash", "full")
    known = c("status").isNotNull()
    open_row = (c("status") == "rejected") | ((c("status") == "pending") & (c("points") == 0))
    take = c("__n").isNotNull() & (~known | open_row)
    pick = lambda n: F.when(take, c(f"__n.{n}")).otherwise(c(n)).alias(n)
    return both.select(
        "tx_hash", *[pick(n) for n in ("address", "chain", "token", "amount", "points")],
        F.when(take, "pending").otherwise(c("status")).alias("status"),
        F.coalesce("created_at", "__n.created_at").alias("created_at"),
    )


def merge_rejections(payments: DataFrame, rejects: DataFrame) -> DataFrame:
    """Record a rejected deposit unless its transaction is known already."""
    fresh = _first_per_hash(rejects).join(payments, "tx_hash", "left_anti")
    rows = fresh.withColumn("points", F.lit(0).cast("bigint")).withColumn("status", F.lit("rejected"))
    return payments.select(PAYMENT).unionByName(rows.select(PAYMENT))


def finalize_credits(payments: DataFrame, credits: DataFrame) -> DataFrame:
    """Pending rows of applied credits (tx_hash, address) become credited."""
    done = credits.select("tx_hash", "address", F.lit(True).alias("__done")).distinct()
    hit = F.coalesce("__done", F.lit(False)) & (c("status") == "pending")
    rows = payments.join(done, ["tx_hash", "address"], "left")
    return rows.withColumn("status", F.when(hit, "credited").otherwise(c("status"))).select(PAYMENT)


def resume_deposits(claims: DataFrame, payments: DataFrame) -> DataFrame:
    """What to do with a claim given the ledger row of its transaction.
    ``claims`` carries ``applied``: whether the owner's account already holds the credit."""
    row = payments.select("tx_hash", F.struct(*PAYMENT[1:7]).alias("p"))
    same = (
        (c("p.address") == c("address")) & (c("p.token") == c("token")) & (c("p.chain") == c("chain"))
    )
    quoted = c("p.points") != 0
    pending = c("p.status") == "pending"
    action = (
        F.when(c("p").isNull() | (c("p.status") == "rejected"), "verify")
        .when((c("p.status") == "credited") & same, "already credited")
        .when(pending & ~quoted & ~c("applied"), "verify")
        .when(pending & ~quoted & (c("p.address") == c("address")), "needs support")
        .when(pending & quoted & same, "finalize")
        .otherwise("already submitted")
    )
    return claims.join(row, "tx_hash", "left").withColumn("action", action).drop("p")


def payment_history(payments: DataFrame, addresses: DataFrame | None = None,
                    limit: int = 50) -> DataFrame:
    """The newest payments of each address."""
    rows = payments
    if addresses is not None:
        rows = rows.join(addresses.select("address"), "address", "left_semi")
    order = [c("created_at").desc(), c("tx_hash")]
    return top_per_key(rows, ["address"], order, limit).withColumn("rank", c("rank").cast("bigint"))


# ------------------------------------------------------------------------ users
def merge_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """A first login creates the user, a later one only moves ``last_login``."""
    seen = logins.groupBy("address").agg(F.min("at").alias("__first"), F.max("at").alias("__last"))
    value = {
        "created_at": F.coalesce("created_at", "__first"),
        "last_login": F.coalesce("__last", "last_login"),
        "banned": F.coalesce("banned", F.lit(False)),
    }
    return users.join(seen, "address", "full").select(
        *[value.get(n, c(n)).alias(n) for n in users.columns]
    )


def update_users(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest change per user and field (``plan``, ``banned``, ``linked``; NULL
    clears). A second address belongs to one user: a claim on an owned address,
    and every claim but the first on a new one, comes back as a reject."""
    def latest(field: str):
        order = F.when(c("field") == field, c("seq"))
        return F.max_by(F.struct("value", "seq"), order).alias(field)

    news = changes.join(users.select("address"), "address", "left_semi").groupBy("address").agg(
        latest("plan").alias("__plan"), latest("banned").alias("__banned"), latest("linked").alias("__linked")
    )
    claims = news.where(c("__linked.value").isNotNull()).select(
        "address", c("__linked.value").alias("linked"), c("__linked.seq").alias("seq")
    )
    owners = users.where(c("linked").isNotNull()).select("linked", c("address").alias("owner"))
    firsts = claims.groupBy("linked").agg(F.min_by("address", F.struct("seq", "address")).alias("winner"))
    judged = claims.join(firsts, "linked").join(owners, "linked", "left")
    lost = F.when(c("owner").isNotNull(), c("owner") != c("address")).otherwise(c("winner") != c("address"))
    rejects = judged.where(lost).select("address", "linked")
    refused = rejects.select("address", F.lit(True).alias("__refused"))
    value = {
        "plan": F.when(c("__plan").isNotNull(), c("__plan.value")).otherwise(c("plan")),
        "banned": F.when(c("__banned").isNotNull(), c("__banned.value") == "true").otherwise(c("banned")),
        "linked": F.when(
            c("__linked").isNotNull() & c("__refused").isNull(), c("__linked.value")
        ).otherwise(c("linked")),
    }
    rows = users.join(news, "address", "left").join(refused, "address", "left")
    return rows.select(*[value.get(n, c(n)).alias(n) for n in users.columns]), rejects


def list_users(users: DataFrame, prefix: str = "", limit: int = 200) -> DataFrame:
    """Users whose address starts with the prefix (wildcards stay live),
    newest login first."""
    order = [c("last_login").desc(), c("address")]
    pattern = live_contains_pattern(prefix)[1:]
    rows = users.where(c("address").ilike(pattern)) if prefix else users
    return ranked(page(rows, order, limit), order)


def linked_owner(users: DataFrame, addresses: DataFrame) -> DataFrame:
    """The owner of each second address that is linked."""
    return users.select("address", "linked").join(addresses.select("linked"), "linked", "left_semi")


# --------------------------------------------------------------------- balances
def apply_credits(balances: DataFrame, credits: DataFrame, signup_points: int = 0) -> DataFrame:
    """Balances after an ordered log (address, key, points, at, seq).

    A key counts once per account, the first time. The balance never falls below
    zero, which makes the order matter: with S the running sum including the
    opening balance, the result is the last S minus the lowest S below zero. Both
    parts come from bucketed running totals, so one busy account spreads out.
    """
    first = credits.groupBy("address", "key").agg(
        F.min_by(F.struct("points", "at", "seq"), F.struct("at", "seq")).alias("c")
    )
    effective = first.select("address", "c.*")
    opening = balances.select("address", c("balance").alias("__open"))
    totals = running_total(effective, ["address"], "at", "points", tie="seq", name="sum")
    folded = totals.groupBy("address").agg(
        F.min("sum").alias("low"), F.sum(c("points").cast(BIG)).alias("all"), F.count(F.lit(1)).alias("applied")
    )
    rows = opening.join(folded, "address", "full")
    start = F.coalesce(c("__open"), F.lit(signup_points)).cast(BIG)
    zero = F.lit(0).cast(BIG)
    end = start + F.coalesce("all", zero) - F.least(start + F.coalesce("low", zero), zero)
    return rows.select(
        "address", F.least(end, F.lit(I64_MAX).cast(BIG)).cast("bigint").alias("balance"),
        F.coalesce("applied", F.lit(0)).cast("bigint").alias("applied"),
    )
