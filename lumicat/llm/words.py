"""Words of Arrow text columns as 64-bit hashes, without a Python object per word.

A text is cut into runs of bytes of one class. The hash of a run is a polynomial over its bytes, so prefix sums over a
piece of text give all hashes at once; it does not depend on where the run stands. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 18  # bytes of text handled at a time: the working arrays stay in the processor's cache
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Spec(NamedTuple):
    """How bytes form words: ``kind`` has 0 for separators, ``code`` a random value per byte (one for A-Z and a-z if they are folded)."""

    kind: np.ndarray
    code: np.ndarray


def spec(separators: bytes, fold: bool, symbols: bool = False) -> Spec:
    """``separators``: bytes outside words. ``symbols``: ASCII punctuation forms words of its own, apart from letters and digits."""
    kind = np.ones(256, dtype=np.uint8)
    if symbols:
        for b in range(128):
            if not chr(b).isalnum():
                kind[b] = 2
    kind[list(separators)] = 0
    byte = np.arange(256, dtype=U64)
    if fold:
        byte[65:91] = byte[97:123]
    return Spec(kind, mix((byte + U64(1)) * U64(BASE)) * (kind > 0))


SPACES = bytes([0x20, *range(0x09, 0x0E)])
WORDS = spec(SPACES, fold=False)
FOLDED = spec(SPACES, fold=True)
RUNS = spec(bytes(range(0x21)) + b"\x7f", fold=True, symbols=True)
ALNUM = spec(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)

_power = np.ones(1, dtype=U64)
_inverse = np.ones(1, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_power", BASE), ("_inverse", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            globals()[name] = np.cumprod(table, dtype=U64)
    return _power, _inverse


class Words(NamedTuple):
    """Words of rows ``lo`` to ``hi`` of a batch; ``counts`` per row, ``starts`` and ``ends`` in bytes from the first row's begin."""

    lo: int
    hi: int
    hashes: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), places


def _runs(kind: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one kind other than 0; a run also ends at a break."""
    edge = np.empty(len(kind) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[breaks] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] > 0
    return starts[keep], ends[keep]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, how: Spec) -> np.ndarray:
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(how.code[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def words(column: pa.Array, how: Spec) -> Iterator[Words]:
    """The words of all rows, for some rows at a time: as many as fit into ``PIECE`` bytes, at least one. A longer row is
    worked through piece by piece, so beyond its text it takes memory for its words only."""
    data, places = buffers(column)
    lo, n = 0, len(places) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(places, places[lo] + PIECE, side="right")) - 1)
        a, b = int(places[lo]), int(places[hi])
        if hi == lo + 1 and b - a > PIECE:
            yield _long_row(data[a:b], how, lo)
        else:
            part, rows = data[a:b], places[lo: hi + 1] - a
            if len(part):
                starts, ends = _runs(how.kind[part], rows)
                hashes = _hashes(part, starts, ends, how)
            else:
                starts = ends = np.zeros(0, np.int64)
                hashes = np.zeros(0, U64)
            counts = np.diff(np.searchsorted(starts, rows))
            yield Words(lo, hi, hashes, counts, starts, ends)
        lo = hi


def _long_row(data: np.ndarray, how: Spec, lo: int) -> Words:
    found, at = [], 0
    while at < len(data):
        size = PIECE
        while True:
            part = data[at: at + size]
            starts, ends = _runs(how.kind[part], np.zeros(0, np.int64))
            # the last run may go on beyond the piece
            if at + len(part) == len(data) or not len(starts) or ends[-1] < len(part):
                step = len(part)
                break
            if starts[-1] > 0:
                step, starts, ends = int(starts[-1]), starts[:-1], ends[:-1]
                break
            size *= 2
        if len(starts):
            found.append((_hashes(part[:step], starts, ends, how), starts + at, ends + at))
        at += step
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Words(lo, lo + 1, hashes, np.array([len(hashes)]), starts, ends)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words; the caller leaves out those that cross rows. Order counts."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= U64(BASE)
        out += hashes[k: k + size]
    return mix(out)


def sequence(hashes: np.ndarray) -> int:
    """A hash of a whole sequence, as a signed number; order and length count."""
    total = (mix(hashes) * _powers(len(hashes) + 1)[0][: len(hashes)]).sum(dtype=U64, keepdims=True)
    return int(mix(total + U64(len(hashes)))[0].astype(np.int64))
