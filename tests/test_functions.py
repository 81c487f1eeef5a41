"""Input/expected pairs of the scalar functions."""

import base64
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from lumicat.functions import hashing, money, paths, text, validity

c = F.col


def values(spark, rows, ddl, expr):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


def test_escape_like(spark):
    given = ["blue_sky", "100%_raw\\x", "黄玫瑰"]
    want = ["blue\\_sky", "100\\%\\_raw\\\\x", "黄玫瑰"]
    assert [text.escape_like(g) for g in given] == want
    assert values(spark, given, "s string", text.escape_like(c("s"))) == want


def test_autocomplete_pattern(spark):
    given, want = ["花", "ab", "sky", "黄玫瑰"], ["花%", "ab%", "%sky%", "%黄玫瑰%"]
    assert [text.autocomplete_pattern(g) for g in given] == want
    assert values(spark, given, "s string", text.autocomplete_pattern(c("s"))) == want


def test_live_patterns_never_break(spark):
    rows = ["50% off", "a_b", "back\\slash", "ends\\"]
    hits = lambda q: values(spark, rows, "s string", text.ilike_contains(c("s"), q))
    assert hits("0%F") == [True, False, False, False]
    assert hits("A_B") == [False, True, False, False]
    assert hits("k\\s") == [False, False, False, False]  # the backslash vanishes
    assert hits("k\\\\s") == [False, False, True, False]
    assert hits("off\\") == [False, False, False, False]  # now looks for a literal percent at the end


def test_should_suggest(spark):
    rows = [("tag", "a"), ("tag", "bl"), ("tag", "花"), ("clip", "sunset"), ("title", "  "), ("author", "　x　")]
    got = values(spark, rows, "m string, q string", text.should_suggest(c("m"), c("q")))
    assert got == [False, True, True, False, False, False]


def test_gallery_params(spark):
    df = spark.createDataFrame([(None, None, None), ("title", "x", 5), ("zzz", "", None)], "m string, q string, l int")
    got = df.select(text.gallery_params(c("m"), c("q"), c("l")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [("tag", "", 50), ("title", "x", 5), ("tag", "", 50)]


def test_parse_items(spark):
    kinds = ("post", "image", "video")
    rows = ["post:12, image:34, post:12, bad:1, image:nan, video:9", ",".join(f"image:{i}" for i in range(100)),
            ",".join(f"image:{i}" for i in range(101)), ",".join(["bad"] * 205)]
    got = values(spark, rows, "s string", text.parse_items(c("s"), kinds))
    assert [(i.kind, i.id) for i in got[0]] == [("post", 12), ("image", 34), ("video", 9)]
    assert len(got[1]) == 100 and got[2] is None and got[3] is None
    cut = values(spark, rows, "s string", text.parse_items(c("s"), kinds, "truncate"))
    assert [len(x) for x in cut] == [3, 100, 100, 0]


def test_format_duration(spark):
    assert values(spark, [0, 9, 84, 3665, -5], "s int", paths.format_duration(c("s"))) == [
        "0:00", "0:09", "1:24", "1:01:05", "0:00"]


def test_paths(spark):
    rows = ["foo/bar - photo 1", "v1.0/by A - site.com v1.0 - photo 1", "foo/bar.jpg", "foo/legacy.bin",
            "foo/bar.webp", "foo/bar.WEBP", "foo/video.mp4", "foo/", ""]
    assert values(spark, rows, "s string", paths.convertible(c("s"))) == [True] * 4 + [False] * 5
    targets = values(spark, ["foo/bar - photo 1", "foo/legacy.bin", "foo/bar.PNG", "v1.0/x"], "s string", paths.target_path(c("s")))
    assert [tuple(t) for t in targets] == [
        ("foo/bar - photo 1.webp", "foo/bar - photo 1"), ("foo/legacy.webp", "foo/legacy"),
        ("foo/bar.webp", "foo/bar"), ("v1.0/x.webp", "v1.0/x")]
    keys = ["a/b", "a//b", "/a", "a/..", " a ", "", "  ", "　a/b", "a\0b"]
    assert values(spark, keys, "s string", paths.valid_key(c("s"))) == [True, False, False, False, True, False, False, True, False]


def test_decoding(spark):
    rows = ["a+b%20c", "%zz", "%4", "caf%C3%A9", "%FF"]
    assert values(spark, rows, "s string", paths.decode_form(c("s"))) == ["a b c", None, None, "café", None]
    assert values(spark, ["a b/ü~*", "x+y"], "s string", paths.encode_path(c("s"))) == ["a%20b/%C3%BC~%2A", "x%2By"]


def test_free_scope(spark):
    rows = [("/images/free/a.webp", "image"), ("/images/fr%65e/a", "video"), ("/images/freeze", "image"),
            ("/images/free/../x", "image"), ("/images/free", "image"), ("search:x", "upload")]
    got = values(spark, rows, "p string, k string", paths.in_free_scope(c("p"), c("k"), F.array(F.lit("/images/free"))))
    assert got == [True, True, False, False, True, True]


def test_points(spark):
    price, top = 3000 * 10**8, 2**128 - 1
    rows = [("1000000", 6, None, 10000), ("2500000", 6, None, 10000), (str(10**18), 18, str(price), 10000),
            ("1000000", 18, str(price), 10**9), ("999999", 18, str(price), 10**9), (str(top), 0, str(top), 10000),
            ("1000000", 6, None, 0), ("1000000", 6, None, -5), (None, 6, None, 1)]
    got = values(spark, rows, "a string, d int, p string, r bigint", money.points_at_rate(c("a"), c("d"), c("p"), c("r")))
    assert got == [10000, 25000, 30_000_000, 3, 2, 2**63 - 1, 0, 0, None]
    fast = values(spark, rows, "a string, d int, p string, r bigint", money.points_at_rate_fast(c("a"), c("d"), c("p"), c("r")))
    assert fast == [10000, 25000, 30_000_000, 3, 2, None, 0, 0, None]


@pytest.mark.parametrize("raw,places,want", [
    (" .25 ", 6, "250000"), ("1.000000000000000001", 18, str(10**18 + 1)), ("9007199254.740993", 6, "9007199254740993"),
    ("", 6, None), (".", 6, None), ("0.00", 6, None), ("-1", 6, None), ("+1", 6, None), ("1e3", 6, None),
    ("1.2.3", 6, None), ("0.0000001", 6, None), (str(2**128 - 1), 18, None), (str(2**128 - 1), 0, str(2**128 - 1))])
def test_base_units(spark, raw, places, want):
    assert values(spark, [raw], "s string", money.base_units(c("s"), places)) == [want]


def test_hex(spark):
    rows = ["0x0", "0xff", "0xFFFFFFFFFFFFFFFFFF", "ff", "0x", "0xg", "0x" + "0" * 40 + "1", "0x" + "f" * 32]
    assert values(spark, rows, "s string", money.hex_to_decimal(c("s")).cast("string")) == [
        "0", "255", str(16**18 - 1), None, None, None, "1", None]
    assert values(spark, rows, "s string", money.hex_to_digits(c("s"))) == [
        "0", "255", str(16**18 - 1), None, None, None, "1", str(2**128 - 1)]


def test_hex_up_to_the_largest_decimal(spark):
    numbers = [2**124, 16**31 + 5, 10**38 - 1, 10**38, 2**128 - 1, 2**64 - 1, 2**64]
    rows = [hex(n) for n in numbers] + ["0x1" + "0" * 32]
    assert values(spark, rows, "s string", money.hex_to_decimal(c("s")).cast("string")) == [str(n) if n < 10**38 else None for n in numbers] + [None]


def test_hex_over_all_128_bits(spark):
    rng = random.Random(5)
    numbers = [0, 1, 9_999_999_999, 10**10, 10**10 - 1, 10**38, 2**64 - 1, 2**64, 2**64 * 10**10, 2**127, 2**128 - 1]
    numbers += [rng.getrandbits(rng.randrange(1, 129)) for _ in range(300)]
    rows = [hex(n) for n in numbers] + ["0x+0f", "0x" + "0" * 8 + "f" * 32, "0x1" + "0" * 32, "0x", "f", None]
    assert values(spark, rows, "s string", money.hex_to_digits(c("s"))) == [str(n) for n in numbers] + [
        "15", str(2**128 - 1), None, None, None, None]


def test_halves_carry(spark):
    top = 2**64 - 1
    rows = [(0, 0), (top, top), (0, 2**64 * 5 + 7), (top, 2**64), (top - 3, 2**64 * 3 + 9), (None, None)]
    got = values(spark, [(None if h is None else str(h), None if w is None else str(w)) for h, w in rows], "h string, w string",
                 money.halves_to_digits(money.carried(c("h"), c("w"))))
    sums = [None if h is None else h * 2**64 + w for h, w in rows]
    assert got == [str(n) if n is not None and n < 2**128 else None for n in sums]


def test_refund_and_minimum(spark):
    rows = [(20000, 30 * 86400, 15 * 86400), (20000, 30 * 86400, 99 * 86400), (20000, 0, 5), (7, 3, 2)]
    assert values(spark, rows, "p bigint, d bigint, r bigint", money.prorated_refund(c("p"), c("d"), c("r"))) == [10000, 20000, 0, 4]
    got = values(spark, [(1000, "f"), (1000, None), (1, "f"), (1001, "f")], "m bigint, f string", money.settlement_min(c("m"), c("f")))
    assert got == [950, 1000, 1, 950]


def round_data(answer, updated):
    return "0x" + "".join(f"{v:064x}" for v in (1, answer, 2, updated, 1))


def test_price_words(spark):
    now, price = 1_700_000_000, 3000 * 10**8
    negative = "0x" + f"{1:064x}" + "f" * 64 + f"{2:064x}{now:064x}{1:064x}"
    rows = [round_data(price, now), round_data(price, now - 86400), round_data(price, now - 86401), round_data(0, now),
            negative, "0x1234", "", "a" * 322, "0x" + "z" * 320]
    got = values(spark, rows, "s string", money.decode_price(c("s"), F.lit(now)))
    assert [None if g.price is None else int(g.price) for g in got] == [price, price] + [None] * 7
    assert all(g.error for g in got[2:])


def test_pseudonym(spark):
    secret = b"k" * 80
    want = "guest:" + base64.urlsafe_b64encode(hmac.new(secret, b"guest/v1\x001.2.3.4", hashlib.sha256).digest()).decode().rstrip("=")
    assert values(spark, ["1.2.3.4", "::ffff:1.2.3.4"], "ip string", hashing.pseudonym(c("ip"), secret)) == [want, want]


def test_principals(spark):
    rows = ["0x" + "a" * 40, "0x" + "A" * 40, "0x" + "a" * 39, "7Np41oeYqPefeNQEHSv1UDhYrehxin3NStELsSKCT4K2", "1" * 32, "1" * 33, None, "0x" + "a" * 40 + "\n"]
    assert values(spark, rows, "s string", validity.valid_principal(c("s"))) == [True, False, False, True, True, False, False, False]
    topics = ["0x" + "0" * 24 + "a" * 40, "0x" + "a" * 40, "0x" + "1" * 24 + "a" * 40, "a" * 40]
    assert values(spark, topics, "s string", money.topic_address(c("s"))) == ["a" * 40, "a" * 40, None, None]


def test_wallets_are_points_of_the_curve(spark):
    """Next to the curve's equation: multiples of the base point, their neighbours, points of small order."""
    p, d = validity.PRIME, validity.CURVE_D

    def add(a, b):
        (x, y), (u, v) = a, b
        k = d * x * u * y * v % p
        return (x * v + u * y) * pow(1 + k, -1, p) % p, (y * v + x * u) * pow(1 - k, -1, p) % p

    base_y = 4 * pow(5, -1, p) % p
    base_x = validity._sqrt_ratio(base_y * base_y - 1, d * base_y * base_y + 1)
    point, keys = (base_x, base_y), []
    for _ in range(20):
        keys.append((point[1] | (point[0] & 1) << 255).to_bytes(32, "little"))
        assert (-point[0] ** 2 + point[1] ** 2 - 1 - d * point[0] ** 2 * point[1] ** 2) % p == 0
        point = add(point, (base_x, base_y))
    assert all(validity.on_curve(k) for k in keys)
    for k in range(2, 40):
        y = base_y + k
        square = (y * y - 1) * pow(d * y * y + 1, -1, p) % p
        assert validity.on_curve((y % p).to_bytes(32, "little")) == (pow(square, (p - 1) // 2, p) == 1)
    assert not any(validity.on_curve(y.to_bytes(32, "little")) for y in (0, 1, p - 1, p, p + 1))
    texts = ["7Np41oeYqPefeNQEHSv1UDhYrehxin3NStELsSKCT4K2", "7A8QpSaBFfp5oymDuiAYtVRwZacTU63fy1ap9w9bkBc4", "Gx9dDNxzpALCowVuZb7pBceBLJugLA8sPa6TJDXrpfeW", "0O", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "i int, t string")
    got = df.select("i", validity.valid_wallet(F.col("t")).alias("wallet"), validity.valid_principal(F.col("t")).alias("known")).orderBy("i").collect()
    assert [r.wallet for r in got] == [True, False, False, False, False, False] * 2
    assert [bool(r.known) for r in got] == [True, True, True, False, False, False] * 2
