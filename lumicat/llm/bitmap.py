"""A bitmap of hashed ids: tells tasks which rows a later join can need, so that the others are never shuffled.

It lets every wanted id through and some others besides (the join drops those). Its size follows the number of ids up to
``MAX_BITS``; with more ids it only lets more through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm.words import U64, mix

MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
SLICES, LOTS = 64, 32


class Bitmap:
    def __init__(self, bits: np.ndarray):
        self.bits = bits  # uint8, eight ids a byte

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = _places(ids, len(self.bits) * 8)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _places(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) >> U64(64 - (size.bit_length() - 1))).astype(np.int64)


def bitmap(ids: DataFrame, count: int) -> Bitmap:
    """Of the first column of ``ids`` (long; nulls are left out); ``count``: about how many there are. At most 32 MB reach the driver."""
    size = MIN_BITS
    while size < min(MAX_BITS, 16 * count):
        size *= 2
    part = size // SLICES

    def mark(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), size)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(SLICES):
            piece = bits[k * part // 8: (k + 1) * part // 8]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["slice", "bits"])

    def merge(key, slices):
        bits = np.zeros(part // 8, np.uint8)
        for value in slices["bits"]:
            bits |= np.frombuffer(value.as_py(), np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    form = "slice int, bits binary"
    out = np.zeros(size // 8, np.uint8)
    # in two steps, so that no task holds what all tasks have sent for a slice
    some = ids.mapInArrow(mark, form).withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(LOTS))).groupBy("slice", "lot").applyInArrow(merge, form)
    for row in some.groupBy("slice").applyInArrow(merge, form).collect():
        out[row.slice * part // 8: (row.slice + 1) * part // 8] = np.frombuffer(row.bits, np.uint8)
    return Bitmap(out)

