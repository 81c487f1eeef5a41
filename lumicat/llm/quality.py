"""Quality classifier: logistic regression over hashed word n-grams.

Learning takes follow-the-regularised-leader updates (FTRL-proximal: a running sum of gradients and of their squares per
weight, L1 and L2 terms applied when a weight is read). The labelled rows are dealt over ``SHARDS`` tasks, each learns in
a fixed order, and the weights are averaged. Scoring is a sparse dot product per text, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm import words as W
from lumicat.llm.base import filter_rows, rows_of

BITS = 18
#: Labelled rows that are learnt from, at most about: more are thinned out by a hash of the id, alike in all of the table.
MAX_ROWS = 16_384
SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
THRESHOLD = 0.3
STUTTER = W.mix(np.array([1], W.U64))[0]


class Model(NamedTuple):
    weights: np.ndarray  # float32, one per hashed n-gram
    bias: float


def features(w: W.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, n-gram numbers and values of a piece of text, by row. One- and two-word runs are counted, a row has norm 1.
    A word that follows itself makes the same two-word run whichever word it is, so stuttering can be learnt."""
    row = np.repeat(np.arange(len(w.counts)), w.counts)
    pairs = np.where(w.hashes[1:] == w.hashes[:-1], STUTTER, W.grams(w.hashes, 2))
    inside = row[1:] == row[:-1]
    keys = np.concatenate((w.hashes >> W.U64(64 - bits), pairs[inside] >> W.U64(64 - bits))).astype(np.int64)
    keys |= np.concatenate((row, row[1:][inside])) << bits
    keys, counts = np.unique(keys, return_counts=True)
    row, number = keys >> bits, keys & ((1 << bits) - 1)
    norm = np.sqrt(np.bincount(row, weights=counts.astype(float) ** 2, minlength=len(w.counts)))
    return row, number, counts / np.maximum(norm, 1)[row]


def _learn(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, epochs: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows in their order. The bias is the last weight, without L1."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, L1)
    l1[size] = 0

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1[at], 0.0, (np.sign(zs) * l1[at] - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for number, value, label in rows:
            at, x = np.append(number, size), np.append(value, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    out = weights(np.arange(size + 1))
    return out[:size], float(out[size])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Learn from the labelled documents (``labels``: doc_id and a label from 0 to 1) outside the held-out fold.

    Several labels of one id count as their mean, null ids and labels are left out, several documents of one id all count.
    Without any row every score is 0.5. Only weights come to the driver: ``SHARDS`` arrays of fixed size.
    """
    given = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("_label"))
        .where("_id IS NOT NULL AND _label IS NOT NULL").where(~held_out(F.col("_id"))).groupBy("_id").agg(F.avg("_label").alias("_label"))
    )
    total = given.count()
    grain = max(1_000_000, total)  # as fine as the table, so that the share never rounds to nothing
    share = int(min(1.0, max_rows / max(1, total)) * grain)
    sample = given.where(F.pmod(F.xxhash64("_id"), F.lit(grain)) < share)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
        .join(F.broadcast(sample), "_id")  # at most max_rows narrow rows, give or take the hash
        .select(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(SHARDS)).cast("int").alias("shard"), "_id", "_text", "_label")
    )

    def learn(key, batch):
        batch = batch.sort_by("_id")
        label_of = batch["_label"].to_numpy()
        data = []
        for w in W.words(batch["_text"], W.RUNS):
            row, number, value = features(w, bits)
            cuts = np.searchsorted(row, np.arange(len(w.counts) + 1))
            data += [(number[a:b], value[a:b], label_of[w.lo + i]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
        order = np.random.default_rng(0).permutation(len(data))
        weights, bias = _learn([data[i] for i in order], bits, epochs)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bias": [bias], "weights": [weights.astype("<f4").tobytes()]})

    got = sorted(rows.groupBy("shard").applyInArrow(learn, "shard int, bias double, weights binary").collect(), key=lambda r: r.shard)
    if not got:
        return Model(np.zeros(1 << bits, np.float32), 0.0)
    return Model(np.mean([np.frombuffer(r.weights, "<f4") for r in got], axis=0, dtype=np.float64).astype(np.float32), float(np.mean([r.bias for r in got])))


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """One score per text, 0 to 1. A text without words gets that of the bias alone."""
    bits = len(model.weights).bit_length() - 1
    out = np.empty(len(column))
    for w in W.words(column, W.RUNS):
        row, number, value = features(w, bits)
        dot = np.bincount(row, weights=model.weights[number] * value, minlength=len(w.counts))
        out[w.lo: w.hi] = 1 / (1 + np.exp(-np.clip(dot + model.bias, -35, 35)))
    return out


def held_out(doc_id) -> F.Column:
    """The fifth of the ids that is never learnt from. Null ids belong to it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1: keep) for each row of ``docs``; null and empty texts are scored too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scores(batch.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(got), pa.array((got >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return rows_of(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    return filter_rows(docs, "text", lambda texts: scores(texts, model) >= threshold)
