"""Exact amounts, prices and periods.

Amounts have up to 39 digits. What provably fits decimal(38,0) is computed with
built-in expressions; the rest goes through one Arrow function on Python ints.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

I64_MAX = 2**63 - 1
U128_MAX = 2**128 - 1
ONE_USD = 100_000_000  # a price of one dollar at eight decimals
MAX_PRICE_AGE = 86_400
DAY_SECONDS = 86_400
BIG = "decimal(38,0)"


def exact_points(amount: int, decimals: int, price: int | None, rate: int) -> int:
    """Floor of amount * price * rate / (10**decimals * 1e8), saturating."""
    if rate <= 0 or amount <= 0:
        return 0
    unit = 10**decimals * ONE_USD
    if unit > U128_MAX:
        return 0
    price = ONE_USD if price is None else price
    if price * rate > U128_MAX:  # the order of rounding changes for absurd prices
        points = amount * price // unit * rate
    else:
        points = amount * price * rate // unit
    return min(points, I64_MAX)


@F.pandas_udf(T.LongType())
def _points_big(
    amount: pd.Series, decimals: pd.Series, price: pd.Series, rate: pd.Series
) -> pd.Series:
    def one(a, d, p, r):
        if a is None or pd.isna(d) or pd.isna(r):
            return None
        return exact_points(int(a), int(d), None if p is None else int(p), int(r))

    return pd.Series(
        [one(*row) for row in zip(amount, decimals, price, rate)], dtype="Int64"
    )


def points_at_rate(amount: Column, decimals: Column, price: Column, rate: Column) -> Column:
    """C15. ``amount`` and ``price`` are whole numbers or digit strings. One
    Arrow call; use :func:`points_at_rate_fast` where 38 digits are enough."""
    return _points_big(
        amount.cast("string"), decimals.cast("int"), price.cast("string"), rate.cast("bigint")
    )


def points_at_rate_fast(amount: Column, decimals: Column, price: Column, rate: Column) -> Column:
    """C15 for products below 1e38, all built-in; NULL where that does not hold."""
    a = amount.cast("string").try_cast(BIG)
    p = F.coalesce(price.cast("string").try_cast(BIG), F.lit(ONE_USD).cast(BIG))
    r = rate.cast(BIG)
    digits = F.length(a.cast("string")) + F.length(p.cast("string")) + F.length(r.cast("string"))
    unit = F.rpad(F.lit("1"), decimals.cast("int") + 9, "0").try_cast(BIG)
    fits = (digits <= 38) & unit.isNotNull() & a.isNotNull()
    product = F.try_multiply(F.try_multiply(a, p).cast(BIG), r).cast(BIG)
    points = F.least(whole_quotient(product, unit), F.lit(I64_MAX).cast(BIG)).cast("bigint")
    return F.when((rate <= 0) | (a <= 0), F.lit(0).cast("bigint")).when(fits, points)


def whole_quotient(dividend: Column, divisor: Column) -> Column:
    """Exact integer division of two decimal(38,0)."""
    remainder = dividend % divisor
    return ((dividend - remainder) / divisor).cast(BIG)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


HALF = "decimal(20,0)"
HALVES = "struct<high: decimal(38,0), low: decimal(38,0)>"


def hex_halves(text: Column) -> Column:
    """A ``0x`` quantity as its upper and lower 64 bits; NULL when malformed or
    above 128 bits. Two halves carry what no decimal can, all built-in."""

    def cut(digits: Column) -> Column:
        def half(start: int) -> Column:
            return F.conv(F.substring(F.lpad(digits, 32, "0"), start, 16), 16, 10).cast(HALF).cast(BIG)

        return F.when(F.length(digits) <= 32, F.struct(half(1).alias("high"), half(17).alias("low")))

    well_formed = text.rlike(r"^0x\+?[0-9a-fA-F]+$")
    bare = F.when(well_formed, F.regexp_extract(text, r"^0x\+?0*([0-9a-fA-F]*)$", 1))
    return let(bare, cut)


def carried(high: Column, low: Column) -> Column:
    """Sums of halves as halves again, with the carry moved up; NULL above 128 bits."""
    base = F.lit(str(2**64)).cast(BIG)

    def settle(parts: Column) -> Column:
        rest = (parts["low"] % base).cast(BIG)
        top = F.try_add(parts["high"], ((parts["low"] - rest) / base).cast(BIG)).cast(BIG)
        return F.when(top < base, F.struct(top.alias("high"), rest.alias("low")))

    return let(F.struct(high.cast(BIG).alias("high"), low.cast(BIG).alias("low")), settle)


def halves_to_digits(halves: Column) -> Column:
    """Halves as a digit string. The number is split at its tenth digit, which keeps
    every product below 1e30."""
    base, cut = F.lit(str(2**64)).cast(BIG), F.lit(str(10**10)).cast(BIG)

    def split(h: Column) -> Column:
        rest = (h["high"] % cut).cast(BIG)
        tail = (F.try_multiply(rest.cast("decimal(10,0)"), base.cast(HALF)).cast(BIG) + h["low"]).cast(BIG)
        last = (tail % cut).cast(BIG)
        head = F.try_multiply(whole_quotient(h["high"], cut).cast("decimal(10,0)"), base.cast(HALF)).cast(BIG)
        return F.struct((head + whole_quotient(tail, cut)).cast(BIG).alias("head"), last.alias("last"))

    def text(p: Column) -> Column:
        last = p["last"].cast("string")
        return F.when(p["head"] == 0, last).otherwise(F.concat(p["head"].cast("string"), F.lpad(last, 10, "0")))

    return F.when(halves.isNotNull(), let(let(halves, split), text))


def hex_to_digits(text: Column) -> Column:
    """A ``0x`` quantity as a digit string, over all unsigned 128 bits; NULL when
    malformed or larger."""
    return let(hex_halves(text), halves_to_digits)


def hex_to_decimal(text: Column) -> Column:
    """C16 for arithmetic: as decimal(38,0); NULL also from 1e38 on."""
    base = F.lit(str(2**64)).cast(HALF)
    return let(hex_halves(text), lambda h: F.try_add(
        F.try_multiply(h["high"].cast(HALF), base).cast(BIG), h["low"]).cast(BIG))


def base_units(text: Column, decimals: Column | int) -> Column:
    """C17: decimal text to base units as a digit string, exact; NULL when the
    text is malformed, too precise, zero or above 128 bits."""
    places = F.lit(decimals) if isinstance(decimals, int) else decimals
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    whole = F.regexp_extract(trimmed, r"^([0-9]*)(?:\.([0-9]*))?$", 1)
    fraction = F.regexp_extract(trimmed, r"^([0-9]*)(?:\.([0-9]*))?$", 2)
    well_formed = trimmed.rlike(r"^[0-9]*(\.[0-9]*)?$") & (F.octet_length(trimmed) <= 80)
    digits = F.concat(whole, F.rpad(fraction, places, "0"))
    number = F.regexp_replace(digits, "^0+", "")
    limit = str(U128_MAX)
    small = (F.length(number) < len(limit)) | (
        (F.length(number) == len(limit)) & (number <= limit)
    )
    return F.when(well_formed & (F.length(fraction) <= places) & (number != "") & small, number)


def prorated_refund(price: Column, period: Column, remaining: Column) -> Column:
    """The unused part of a paid period, rounded towards zero."""
    left = F.greatest(F.least(remaining, period), F.lit(0)).cast(BIG)
    product = (price.cast(BIG) * left).cast(BIG)
    share = whole_quotient(product, F.nullif(period.cast(BIG), F.lit(0).cast(BIG)))
    return F.coalesce(share.cast("bigint"), F.lit(0).cast("bigint"))


def settlement_min(minimum: Column, feed: Column) -> Column:
    """Assets with a price feed may fall 5 % short of the minimum."""
    eased = F.greatest(F.floor(minimum.cast(BIG) * 95 / 100).cast("bigint"), F.lit(1).cast("bigint"))
    return F.when(feed.isNotNull(), eased).otherwise(minimum.cast("bigint"))


def day_bucket(epoch: Column) -> Column:
    """The UTC day of an epoch second."""
    return F.floor(epoch / DAY_SECONDS).cast("bigint")


def decode_price(result: Column, now: Column) -> Column:
    """struct(price, error) of a five-word price answer; the price is a digit string."""
    def words(body: Column) -> Column:
        def low(start: int) -> Column:  # low half of a word; the high half must be zero
            return F.concat(F.lit("0x"), F.substring(body, start + 32, 32))

        return F.struct(
            body.alias("body"), hex_to_digits(low(65)).alias("price"), hex_to_decimal(low(193)).alias("updated"),
            F.substring(body, 65, 32).alias("price_high"), F.substring(body, 193, 32).alias("updated_high"),
        )

    def judged(w: Column) -> Column:
        zeros, newest = "0" * 32, F.lit(str(2**64 - 1)).cast(BIG)
        error = (
            F.when(~F.startswith(result, F.lit("0x")), "prefix_missing")
            .when(w["body"] == "", "length_wrong")
            .when(F.substring(w["price_high"], 1, 1) >= "8", "price_negative")
            .when(w["price_high"] != zeros, "price_too_large")
            .when(w["price"] == "0", "price_zero")
            .when(
                (w["updated_high"] != zeros) | w["updated"].isNull() | (w["updated"] > newest),
                "time_too_large",
            )
            .when(now.cast(BIG) - w["updated"] > MAX_PRICE_AGE, "price_stale")
        )
        return F.struct(w["price"].alias("price"), error.alias("error"))

    body = F.regexp_extract(result, r"^0x([0-9a-fA-F]{320})$", 1)
    done = let(let(body, words), judged)
    return let(done, lambda r: F.struct(
        F.when(r["error"].isNull(), r["price"]).alias("price"), r["error"].alias("error")
    ))


def usd_price(points: Column, rate: Column) -> Column:
    """What a price in points costs in dollars."""
    return F.try_divide(points.cast("double"), rate.cast("double"))


def topic_address(topic: Column) -> Column:
    """The 40 hex digits of an address topic, padded or bare."""
    found = F.regexp_extract(topic, r"^0x(?:0{24})?([0-9a-fA-F]{40})$", 1)
    return F.when(found != "", found)
