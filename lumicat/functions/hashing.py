"""Hashes, keys and pseudonyms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: multipliers and shifts of the splitmix64 finaliser
MIX_ROUNDS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
MIX_LAST_SHIFT = 31
GUEST_PURPOSE = b"guest/v1\0"


def mix64_numpy(values: np.ndarray) -> np.ndarray:
    z = values.astype(np.uint64, copy=True)
    for shift, factor in MIX_ROUNDS:
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(MIX_LAST_SHIFT))


@F.pandas_udf(T.LongType())
def mix64(values: pd.Series) -> pd.Series:
    """The mixed 64 bits, shown as a signed bigint."""
    return pd.Series(mix64_numpy(values.to_numpy("int64").view("uint64")).view("int64"))


def resource_key(text: Column) -> Column:
    """The first 32 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 32)


def resource_digest(text: Column) -> Column:
    """The whole 32-byte digest, the key of a daily-usage entry."""
    return F.unhex(F.sha2(text, 256))


def base64url(raw: Column) -> Column:
    return F.rtrim(F.translate(F.base64(raw), "+/=", "-_ "))


def hmac_sha256_hex(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 out of two built-in SHA-256 calls, so it stays in the JVM."""
    import hashlib

    key = secret if len(secret) <= 64 else hashlib.sha256(secret).digest()
    key = key.ljust(64, b"\0")
    inner_pad, outer_pad = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def canonical_ip(ip: Column) -> Column:
    """An IPv4 address carried in IPv6 counts as the IPv4 address."""
    v4 = F.regexp_extract(F.lower(ip), r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    return F.when(v4 != "", v4).otherwise(F.lower(ip))


def pseudonym(ip: Column, secret: bytes) -> Column:
    """C14: the keyed guest name of a client address."""
    message = F.concat(F.lit(GUEST_PURPOSE), canonical_ip(ip).cast("binary"))
    return F.concat(F.lit("guest:"), base64url(F.unhex(hmac_sha256_hex(message, secret))))
