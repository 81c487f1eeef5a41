"""Embedding near-dedup: spherical k-means cells, blocked cosine products within a cell, one kept vector per group.

1. Equal vectors form a class with a count, so copies are compared once.
2. Centroids come from a sample of at most ``SAMPLE`` classes by Lloyd rounds on the unit sphere, each a Spark job. Those closer
   than ``APART`` are merged, so no group of near copies is divided between centroids of its own. Up to ``WHOLE`` classes
   one cell holds all, which is exact.
3. Every class goes to its ``NEAREST`` cells. A cell is cut into blocks of about ``BLOCK`` classes by hash, and every two
   blocks meet in a task of their own. A pair that meets in several cells counts in the one with the smallest number.
4. A task multiplies its blocks in double precision and returns, per class, how many vectors it links with and the smallest
   class it is linked to there. Pairs are never listed. These stars give the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm.base import stage
from lumicat.llm.components import components

SIMILAR = 0.95
WHOLE = 2_048
SAMPLE, SAMPLE_FLOATS = 16_384, 1 << 22
PER_CELL, MAX_CELLS = 256, 4_096
ROUNDS = 6
APART = 0.7
NEAREST = 4
BLOCK = 1_024


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose rows have one length; doubles. Rows are first scaled by a power of
    two, which rounds nothing, so that no square leaves the range of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, class; class null: never linked) and classes (class, dim, vector, copies, first)."""
    vector = F.col("embedding")
    fine = vector.isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding").withColumn("class", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("embedding")))
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(
        F.first("embedding").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    return rows.select("vec_id", "class"), classes.withColumn("dim", F.size("vector"))


def centroids(classes: DataFrame, dim: int, count: int) -> np.ndarray:
    """Unit centroids of the classes of one dimension, on a bounded sample; one row if a single cell is enough."""
    if count <= WHOLE:
        return np.zeros((1, dim))
    size = max(WHOLE, min(SAMPLE, SAMPLE_FLOATS // dim))
    share = max(1, int(min(1.0, size / count) * 1_000_000))
    sample = stage(classes.where((F.col("dim") == dim) & (F.pmod(F.col("class"), F.lit(1_000_000)) < share)).select("class", "vector"))
    k = min(MAX_CELLS, max(2, count // PER_CELL))
    found = _matrix(sample.orderBy("class").limit(min(size, 2 * k)).select("vector").toArrow()["vector"])
    now = _spread(found, k)
    for _ in range(ROUNDS):
        def sums(batches, now=now):
            total, n = np.zeros_like(now), np.zeros(len(now), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0))
                best = (x @ now.T).argmax(axis=1)
                np.add.at(total, best, x)
                n += np.bincount(best, minlength=len(now))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["total", "n"])

        # a few partitions, each returns one sum per cell
        got = sample.select("vector").repartition(4).mapInArrow(sums, "total binary, n binary").collect()
        total = np.sum([np.frombuffer(r.total).reshape(now.shape) for r in got], axis=0)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        now = np.where(length > 1e-9, total / np.maximum(length, 1e-9), now)
    return _spread(now, k)


def _spread(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` of the vectors, in order, none closer than ``APART`` to one before it."""
    out = np.empty((k, x.shape[1]))
    n = 0
    for row in x:
        if n < k and (n == 0 or (out[:n] @ row).max() < APART):
            out[n] = row
            n += 1
    return out[:n]


def _meet(here: int, left: pa.Table, right: pa.Table, same: bool, similar: float, total: np.ndarray, root: np.ndarray, offset: int) -> None:
    """Count links between two blocks into ``total`` and join their roots (places; the right block begins at ``offset``)."""
    x, y = _matrix(left["vector"]), _matrix(right["vector"])
    cx, cy = (np.stack(t["cells"].to_pylist()) for t in (left, right))
    nx, ny = left["copies"].to_numpy(), right["copies"].to_numpy()
    for a in range(0, len(x), 128):
        i, j = np.nonzero(x[a: a + 128] @ y.T >= similar)
        i += a
        if same:
            i, j = i[j > i], j[j > i]
        # the smallest cell that both lie in takes the pair
        both = cx[i][:, :, None] == cy[j][:, None, :]
        mine = np.where(both.any(axis=2), cx[i], np.iinfo(np.int64).max).min(axis=1) == here
        i, j = i[mine], j[mine]
        np.add.at(total, i, ny[j])
        np.add.at(total, j + offset, nx[i])
        for p, q in zip(i.tolist(), (j + offset).tolist()):
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            while root[q] != q:
                root[q] = root[root[q]]
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)


def near_copies(vectors: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors (vec_id long, embedding array<float or double>)``.

    Linked: cosine of at least ``similar``; copies of a vector link with each other. Vectors that are null, empty, zero or hold
    null or non-finite numbers link with nothing, nor do vectors of different lengths. ``component_id`` is the smallest
    vec_id reached by links. Rows are counted one by one, also with equal ids. Empty tables give no rows.
    """
    rows, classes = _classes(vectors)
    classes = stage(classes)
    dims = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    spaces = {d: centroids(classes, d, n) for d, n in sorted(dims.items())}
    base = {d: k << 32 for k, d in enumerate(sorted(dims))}

    def place(batches):
        for batch in batches:
            dim = batch.column(1).to_numpy()
            for d in np.unique(dim).tolist():
                part = batch.filter(pa.array(dim == d))
                near = _matrix(part.column(2)) @ spaces[d].T
                cells = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :NEAREST], axis=1) + base[d]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(cells.tolist(), pa.list_(pa.int64()))], ["class", "vector", "copies", "cells"])

    kind = classes.schema["vector"].dataType.simpleString()
    placed = stage(classes.select("class", "dim", "vector", "copies").mapInArrow(place, f"class long, vector {kind}, copies long, cells array<long>"))
    each = placed.withColumn("cell", F.explode("cells"))
    # one row per cell: MAX_CELLS per dimension
    blocks = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        each.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    )

    def compare(key, table):
        here, low, high = (k.as_py() for k in key)
        block = table["block"].to_numpy()
        left, right = table.filter(pa.array(block == low)), table.filter(pa.array(block == high))
        left, right = left.sort_by("class"), right.sort_by("class")
        both = left if low == high else pa.concat_tables([left, right])
        offset = 0 if low == high else len(left)
        total, root = np.zeros(len(both), np.int64), list(range(len(both)))
        if len(left) and len(right):
            _meet(here, left, right, low == high, similar, total, root, offset)
        names = both["class"].to_numpy()
        ends = []
        for p in range(len(root)):
            q = p
            while root[q] != q:
                q = root[q]
            ends.append(q)
        at = np.flatnonzero(total)
        return pa.table({"class": pa.array(names[at]), "links": pa.array(total[at]), "root": pa.array(names[np.array(ends, np.int64)[at]])})

    found = stage(
        dealt.select("cell", "low", "high", "block", "class", "vector", "copies", "cells").groupBy("cell", "low", "high").applyInArrow(compare, "class long, links long, root long"))
    linked = components(found.where("class <> root").select(F.col("class").alias("u"), F.col("root").alias("v")))
    named = (
        classes.select("class", "copies", "first").join(found.groupBy("class").agg(F.sum("links").alias("links")), "class", "left")
        .join(linked.withColumnRenamed("node", "class"), "class", "left")
        .select("class", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    )
    named = stage(named)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stage(named.join(smallest, "component").select("class", "n_links", "component_id"))
    return rows.join(named, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
