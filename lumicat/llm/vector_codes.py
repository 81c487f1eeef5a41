"""Vector code compression: product codes whose codebooks come from Lloyd rounds over two trees.

Components are whole numbers, floor(256 * x). A vector is cut into ``PARTS`` parts; every part position has a codebook of
``ENTRIES`` entries. A task takes blocks of vectors. Per part position it builds a tree over the block's parts and one over the
entries, both balanced and cut at medians, with a box per node and cached sums and counts per part node.

The trees are gone through together from their roots: for each part node the entry nodes that can hold a nearest entry of one
of its parts. The smallest of the largest distances between the boxes bounds the nearest entry from above; a node pair whose
smallest distance is beyond that goes. A part node with one entry left is assigned as a whole, by its cached sums. What is
uncertain in the leaves is compared number by number; ties go to the lower index. Results are those of comparing all.

Each round is one Spark job that returns sums and counts per (position, entry): a bounded table, whatever the input.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm.base import stage

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Numbers of one block of vectors (held once as 64-bit numbers), parts of a leaf, and bits of one limb of a sum.
BLOCK, LEAF, LIMB = 1 << 21, 8, 32
#: Up to here squares and sums of a block fit 64 bits; beyond, Python's whole numbers are used.
SMALL = 1 << 22


def whole(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as whole numbers, filled with zeros up to ``width``; int64, or objects if any is large."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if x.size and np.abs(x).max() * SCALE >= SMALL:
        exact = [[n * SCALE // d for n, d in map(float.as_integer_ratio, row)] for row in x.tolist()]
        out = np.array(exact, dtype=object).reshape(x.shape)
    else:
        out = np.floor(x * SCALE).astype(np.int64)
    return np.concatenate((out, np.zeros((len(out), width - out.shape[1]), out.dtype)), axis=1)


class Tree(NamedTuple):
    """Levels from the root down, each with 2^level nodes of equal size. ``order``: rows by node; padding repeats the last row with
    weight 0 in ``real``."""

    order: np.ndarray
    real: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    total: list[np.ndarray]
    count: list[np.ndarray]


def tree(x: np.ndarray, leaf: int) -> Tree:
    n = len(x)
    depth = max(0, (-(-n // leaf) - 1).bit_length())
    each = -(-n // (1 << depth))
    order = np.minimum(np.arange(each << depth), n - 1)
    real = np.arange(each << depth) < n
    for level in range(depth):
        nodes, at = 1 << level, order.reshape(1 << level, -1)
        part = x[at]
        wide = (part.max(axis=1) - part.min(axis=1)).argmax(axis=1)
        by = np.argsort(part[np.arange(nodes)[:, None], np.arange(at.shape[1])[None, :], wide[:, None]], axis=1, kind="stable")
        order = np.take_along_axis(at, by, axis=1).ravel()
        real = np.take_along_axis(real.reshape(nodes, -1), by, axis=1).ravel()
    part, weight = x[order].reshape(1 << depth, each, -1), real.reshape(1 << depth, each)
    low, high = [part.min(axis=1)], [part.max(axis=1)]
    total, count = [(part * weight[:, :, None]).sum(axis=1)], [weight.sum(axis=1)]
    for _ in range(depth):
        low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
        high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
        total.insert(0, total[0][::2] + total[0][1::2])
        count.insert(0, count[0][::2] + count[0][1::2])
    return Tree(order, real, low, high, total, count)


def _keep(node: np.ndarray, entry: np.ndarray, x: Tree, a: int, c: Tree, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of part nodes (level ``a``; sorted) and entry nodes (level ``b``) that can hold a nearest entry."""
    xl, xh, cl, ch = x.low[a][node], x.high[a][node], c.low[b][entry], c.high[b][entry]
    far = np.maximum(xh - cl, ch - xl)
    gap = np.maximum(np.maximum(xl - ch, cl - xh), 0)
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    bound = np.minimum.reduceat((far * far).sum(axis=1), first)
    # an equal distance stays: its entry may have the lower index
    near = (gap * gap).sum(axis=1) <= np.repeat(bound, np.diff(np.append(first, len(node))))
    return node[near], entry[near]


def assign(x: np.ndarray, x_tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``x``, and per entry the sum and the number of its rows."""
    c_tree = tree(entries, 1)
    code = np.zeros(len(x), np.int64)
    total, count = np.zeros(entries.shape, x_tree.total[0].dtype), np.zeros(len(entries), np.int64)
    node, entry, a, b = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    deep_x, deep_c = len(x_tree.low) - 1, len(c_tree.low) - 1
    each = len(x_tree.order) >> deep_x
    while True:
        if b < deep_c:
            b, node, entry = b + 1, np.repeat(node, 2), (entry[:, None] * 2 + np.arange(2)).ravel()
            node, entry = _keep(node, entry, x_tree, a, c_tree, b)
        if b == deep_c:
            # the padding of the entry tree repeats an entry
            named = c_tree.order[entry]
            key = np.unique(node * len(entries) + named)
            node, named = key // len(entries), key % len(entries)
            first = np.concatenate(([True], node[1:] != node[:-1]))
            alone = first & np.append(first[1:], True)
            if alone.any():
                mine, to = node[alone], named[alone]
                np.add.at(total, to, x_tree.total[a][mine])
                np.add.at(count, to, x_tree.count[a][mine])
                size = len(x_tree.order) >> a
                code[x_tree.order.reshape(-1, size)[mine]] = to[:, None]
                node, named = node[~alone], named[~alone]
            if not len(node):
                break
            place = np.empty(len(entries), np.int64)
            place[c_tree.order[::-1]] = np.arange(len(c_tree.order))[::-1]
            entry = place[named]
        if a == deep_x:
            if b == deep_c:
                rows = x_tree.order.reshape(-1, each)[node]
                apart = x[rows] - entries[named][:, None, :]
                # distance first, then index
                key = (apart * apart).sum(axis=2) * len(entries) + named[:, None]
                first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
                best = (np.minimum.reduceat(key, first, axis=0) % len(entries)).astype(np.int64)
                real = x_tree.real.reshape(-1, each)[node[first]]
                rows, best = rows[first][real], best[real]
                code[rows] = best
                np.add.at(total, best, x[rows])
                np.add.at(count, best, 1)
                break
            continue
        a, entry, node = a + 1, np.tile(entry, 2), np.concatenate((node * 2, node * 2 + 1))
        by = np.argsort(node, kind="stable")
        node, entry = _keep(node[by], entry[by], x_tree, a, c_tree, b)
    return code, total, count


def _blocks(batches, width: int, vector: int):
    """(batches, whole numbers) of about ``BLOCK`` numbers each."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows * max(1, width) >= BLOCK:
            yield held, _joined([whole(b.column(vector), width) for b in held])
            held, rows = [], 0
    if held:
        yield held, _joined([whole(b.column(vector), width) for b in held])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    kind = object if any(p.dtype == object for p in parts) else np.int64
    return np.concatenate([p.astype(kind, copy=False) for p in parts])


def _same(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit numbers if they are small enough, else both as objects."""
    if x.dtype != object and (not book.size or np.abs(book).max() < SMALL):
        return x, book.astype(np.int64)
    return x.astype(object), book.astype(object)


def _cut(x: np.ndarray, k: int) -> np.ndarray:
    step = x.shape[1] // PARTS
    return x[:, k * step: (k + 1) * step]


def _limbs(value: int):
    """(place, limb) of a whole number; limbs of one place can be summed."""
    place, sign = 0, -1 if value < 0 else 1
    value = abs(value)
    while value:
        yield place, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        place += 1


def _update(kept: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """One Lloyd round: entries become the floored means of their parts, unused ones stay."""
    form = "part int, entry int, at int, limb int, value long"

    def sums(batches):
        total = np.zeros(books.shape, object)
        count = np.zeros(books.shape[:2], np.int64)
        for _, x in _blocks(batches, width, 0):
            for k in range(PARTS):
                mine, book = _same(_cut(x, k), books[k])
                _, t, n = assign(mine, tree(mine, LEAF), book)
                total[k] += t
                count[k] += n
        # a place of -1 is the count
        rows = [(k, e, at, limb, v) for (k, e, at), value in np.ndenumerate(total) for limb, v in _limbs(int(value))]
        rows += [(k, e, -1, 0, int(n)) for (k, e), n in np.ndenumerate(count) if n]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 4 else pa.int32()) for i, c in enumerate(zip(*rows))], ["part", "entry", "at", "limb", "value"]) if rows \
            else pa.RecordBatch.from_pylist([], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))

    # PARTS * ENTRIES * (width / PARTS + 1) rows, more only for very large numbers
    got = kept.select("vector").mapInArrow(sums, form).groupBy("part", "entry", "at", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    total, count = np.zeros(books.shape, object), np.zeros(books.shape[:2], object)
    for r in got:
        if r.at < 0:
            count[r.part, r.entry] = int(r.value)
        else:
            total[r.part, r.entry, r.at] += int(r.value) << (LIMB * r.limb)
    used = np.broadcast_to((count > 0)[:, :, None], books.shape)
    return np.where(used, total // np.maximum(count, 1)[:, :, None], books)


def encode(vectors: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for ``vectors (vec_id long, embedding array<float or double>, label)``.

    Rows go whose vector is null or holds null or non-finite numbers, and those whose vector is not as long as that of the first kept
    row. The first rows, whose parts are the starting entries, are those with the smallest vec_ids (rows without id come last; of equal
    ids the smaller vector comes first); with fewer rows than ``ENTRIES`` the codebooks are that short. Lengths that ``PARTS``
    doesn't divide, and empty vectors, are filled up with zeros. An error or a sum beyond 64 bits is null. An empty table gives no rows.
    """
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.col("embedding").alias("vector"), "label")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector", F.size("vector").alias("n")).limit(1).collect()
    size = first[0].n if first else 0
    kept = kept.where(F.size("vector") == size)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow()["vector"].combine_chunks()
    width = max(1, -(-size // PARTS)) * PARTS
    x = whole(start, width) if len(start) else np.zeros((0, width), np.int64)
    books = np.stack([_cut(x, k) for k in range(PARTS)]).astype(object)
    for _ in range(rounds if len(start) else 0):
        books = _update(kept, books, width)
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()

    def run(batches):
        for held, x in _blocks(batches, width, 1):
            codes, error = np.zeros((len(x), PARTS), np.uint8), 0
            for k in range(PARTS):
                mine, book = _same(_cut(x, k), books[k])
                code, _, _ = assign(mine, tree(mine, LEAF), book)
                apart = mine - book[code]
                error = error + (apart * apart).sum(axis=1)
                codes[:, k] = code
            text = codes.tobytes().hex()
            step = 2 * PARTS
            errors = [e if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(2) for b in held]),
                 pa.array([text[a: a + step] for a in range(0, len(text), step)], pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    coded = stage(kept.select("vec_id", "vector", "label").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(
        F.when(F.count("error") == F.count("*"), F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)")).alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
