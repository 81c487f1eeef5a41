"""Q7-Q9: address and transaction-id predicates, and the asset registry."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

# fixed values: accepted assets (chain, symbol, decimals, contract, price feed)
FEED_ETH_USD = "0x5f4ec3df9cbd43714fe2740f5e3616155c5b8419"
FEED_SOL_USD = "0x4ffc43a60e009b551865a93d232e33fce9f01507"
ASSETS = (
    ("ethereum", "eth", 18, None, FEED_ETH_USD),
    ("ethereum", "usdt", 6, "0xdac17f958d2ee523a2206206994597c13d831ec7", None),
    ("ethereum", "usdc", 6, "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48", None),
    ("solana", "sol", 9, None, FEED_SOL_USD),
    ("solana", "usdt", 6, "Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB", None),
    ("solana", "usdc", 6, "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v", None),
)
ASSET_DDL = "chain string, token string, decimals int, contract string, feed string"

# fixed values: second-chain programs and mints that never are a deposit wallet
CLOSED_RECIPIENTS = (
    "11111111111111111111111111111111",
    "So11111111111111111111111111111111111111112",
    "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA",
    "TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb",
    "ATokenGPvbdGVxr1b2hvZbsiqW5xWH25efTNsLJA8knL",
    "MemoSq4gqABAXKb96qnH8TysNcWxMyWCqXgDLGmfcHr",
    "Memo1UhkJRfHyvLMcVucJwxXeuD728EqVDDwQDxFMNo",
)


def token_registry(spark: SparkSession) -> DataFrame:
    """The six accepted assets."""
    return spark.createDataFrame(list(ASSETS), ASSET_DDL)


def valid_account(text: Column) -> Column:
    """First-chain account: ``0x`` and 40 lower-case hex digits."""
    return F.coalesce(text.rlike(r"\A0x[0-9a-f]{40}\z"), F.lit(False))


def _decode(text: str) -> bytes | None:
    """The 32 bytes of a base58 text, or None if it has another length."""
    number = 0
    for ch in text:
        number = number * 58 + BASE58.index(ch)
    zeros, size = len(text) - len(text.lstrip("1")), (number.bit_length() + 7) // 8
    return number.to_bytes(32, "big") if zeros + size == 32 else None


def _each_once(test: Callable[[str], bool]):
    """A test of texts as a column function; a text that stands several times in a batch is tested once, null is False."""

    @F.pandas_udf(T.BooleanType())
    def run(text: pd.Series) -> pd.Series:
        place, names = pd.factorize(text)
        answers = np.array([test(name) for name in names] + [False], dtype=bool)
        return pd.Series(answers[place])  # null has the place -1: the last

    return run


_decodes_to_32_bytes = _each_once(lambda text: _decode(text) is not None)

# fixed values: the prime field and the constant of the twisted Edwards curve -x^2 + y^2 = 1 + d x^2 y^2 (RFC 8032)
PRIME = 2**255 - 19
CURVE_D = -121665 * pow(121666, -1, PRIME) % PRIME


def _sqrt_ratio(u: int, v: int) -> int | None:
    """A square root of u / v in the field, or None; of 0 it is 0."""
    root = u * pow(v, 3, PRIME) * pow(u * pow(v, 7, PRIME), (PRIME - 5) // 8, PRIME) % PRIME
    check = v * root * root % PRIME
    if check == u % PRIME:
        return root
    if check == -u % PRIME:
        return root * pow(2, (PRIME - 1) // 4, PRIME) % PRIME
    return None


def on_curve(key: bytes) -> bool:
    """Whether 32 bytes (little endian, the top bit is x's sign) are a point of the curve that is not of small order.

    Small order means that three doublings end at the neutral point (0, 1); such a point is nobody's key."""
    y = (int.from_bytes(key, "little") & (2**255 - 1)) % PRIME
    x = _sqrt_ratio(y * y - 1, CURVE_D * y * y + 1)
    if x is None:
        return False
    for _ in range(3):
        xx, yy, xy = x * x % PRIME, y * y % PRIME, x * y % PRIME
        cross = CURVE_D * xx * yy % PRIME
        x, y = 2 * xy * pow(1 + cross, -1, PRIME) % PRIME, (yy + xx) * pow(1 - cross, -1, PRIME) % PRIME
    return (x, y) != (0, 1)


_is_wallet_key = _each_once(lambda text: (key := _decode(text)) is not None and on_curve(key))


def base58_candidate(text: Column) -> Column:
    return F.when(text.rlike(rf"\A[{BASE58}]{{32,44}}\z"), text)


def valid_second_chain(text: Column) -> Column:
    """Second-chain account: base58 text of exactly 32 bytes."""
    return _decodes_to_32_bytes(base58_candidate(text))


def valid_wallet(text: Column) -> Column:
    """Second-chain account that somebody can hold the key of: a point of the curve. Accounts derived from others lie beside it."""
    return _is_wallet_key(base58_candidate(text))


def valid_principal(text: Column) -> Column:
    """Q7: an account name of either chain."""
    return valid_account(text) | valid_second_chain(text)


def valid_tx_hash(text: Column) -> Column:
    """Q8: ``0x`` and 64 lower-case hex digits."""
    return F.coalesce(text.rlike(r"\A0x[0-9a-f]{64}\z"), F.lit(False))


def valid_deposit(address: Column, chain: Column) -> Column:
    """Q9: a wallet that may receive deposits; on the second chain its address has to be a point of the curve."""
    contracts = [a[3].lower() for a in ASSETS if a[3]] + [a[4] for a in ASSETS if a[4]]
    mints = [a[3] for a in ASSETS if a[0] == "solana" and a[3]]
    first = (
        valid_account(address)
        & ~address.rlike(r"\A0x0{40}\z")
        & ~F.lower(address).isin(*contracts)
    )
    second = valid_wallet(address) & ~address.isin(*CLOSED_RECIPIENTS, *mints)
    return F.coalesce(
        F.when(chain == "ethereum", first).when(chain == "solana", second), F.lit(False)
    )
