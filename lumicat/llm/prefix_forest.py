"""Approximate nearest neighbours by largest inner product, with a hash-prefix forest.

1. Equal vectors are one class. Classes fall into shells of similar length. Within a shell a vector x gets one more component, so that
   all have one length; a query gets 0 there. The angle then follows from the inner product alone.
2. Each of ``TREES`` trees gives a class a string of ``BITS`` signs of random planes. The rows of a tree, sorted by that string, are
   dealt to tasks by its first bits (segments of about ``SEGMENT`` rows; larger ones are cut into blocks, each sorted by itself).
3. Descent: in ``FIRST`` trees a query goes to the place of its own string and compares the rows with the longest common prefixes. The
   20th best of them, or of a sample, is an angle that the true 20th neighbour can't exceed.
4. Ascent: from that angle follows the prefix length at which a neighbour that near is met in one tree at least with probability
   ``FOUND``. All trees ascend to that length alike, and the query is compared with every row that shares so long a prefix.
   Queries differ in length, segments in depth: dense places are left early, sparse ones later, down to no bit at all.
5. Each task returns the best per query; equal candidates of several trees are merged.

Inner products that order the result are summed in double precision, component by component, in one order for all rows.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumicat.llm.base import stage

NEAREST, EVERY = 20, 20
TREES, BITS, FIRST, FOUND = 12, 64, 2, 0.97
#: Rows of a segment, queries of one task, rows that a descent compares per tree, classes of the sample, numbers of a score block.
SEGMENT, QUERIES, AROUND, SAMPLE, SCORES = 8_192, 2_048, 64, 1_024, 1 << 22
U64 = np.uint64


class Space(NamedTuple):
    """Classes of one dimension and shell: the largest length in it, and the bits that name a segment."""

    dim: int
    reach: float
    bits: int


@lru_cache(maxsize=8)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([dim, 0x5EED]).standard_normal((dim + 1, TREES * BITS))


def _keys(x: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """The sign strings of each row, one column per tree; the first plane is the highest bit."""
    side = np.concatenate((x, extra[:, None]), axis=1) @ _planes(x.shape[1]) > 0
    packed = np.packbits(side.reshape(len(x), TREES, BITS), axis=2)
    return np.ascontiguousarray(packed).view(">u8")[:, :, 0].astype(U64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), dim)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 8), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def _length(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    return (top * np.linalg.norm(x / np.where(top > 0, top, 1), axis=1, keepdims=True))[:, 0]


def _segment(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row; the sum runs alike for every pair. Sums that are no number are the worst."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.add.accumulate(x * y, axis=-1)[..., -1]
    return np.where(np.isnan(out), -np.inf, out)


def _best(score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best, ties to the smaller ``first``."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((first[at], -score[at]))[:k]]


def level_for(cosine: np.ndarray, found: float = FOUND) -> np.ndarray:
    """The longest prefix at which a vector of this cosine is met in one of the trees with probability ``found``; 0 to ``BITS``."""
    same = np.minimum(1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi, 1 - 1e-12)
    need = 1 - (1 - found) ** (1 / TREES)
    with np.errstate(divide="ignore"):
        level = np.where(same > 0, np.log(need) / np.log(np.maximum(same, 1e-300)), 0)
    return np.clip(np.floor(level), 0, BITS).astype(np.int64)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, class) and classes (class, vector as doubles, first, dim, shell, length, asked)."""
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = fine & F.exists("embedding", lambda v: v != 0)
    # 0.0 and -0.0 are one number
    taken = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("vector"))
    hashed = taken.withColumn("class", F.xxhash64("vector"))
    rows = stage(hashed.select("vec_id", "class").groupBy("vec_id").agg(F.min("class").alias("class")))
    owners = rows.groupBy("class").agg(F.min("vec_id").alias("first"), F.max((F.col("vec_id") % EVERY == 0).cast("int")).alias("asked"))
    grouped = hashed.groupBy("class").agg(F.first("vector").alias("vector")).join(owners, "class").select("class", "vector", "first", "asked")

    def measure(batches):
        for batch in batches:
            vector = batch.column(1)
            size = vector.value_lengths().to_numpy()
            for dim in np.unique(size).tolist():
                part = batch.filter(pa.array(size == dim))
                x = part.column(1).flatten().to_numpy().reshape(-1, dim)
                length = _length(x)
                shell = np.floor(np.log2(length) + 0.5).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _binary(x), part.column(2), part.column(3), pa.array(np.full(len(x), dim, np.int32)), pa.array(shell), pa.array(length)],
                    ["class", "vector", "first", "asked", "dim", "shell", "length"])

    classes = grouped.mapInArrow(measure, "class long, vector binary, first long, asked int, dim int, shell int, length double")
    return rows, classes


def _placed(classes: DataFrame, spaces: dict, trees: range, vectors: bool) -> DataFrame:
    """One row per class and tree: its place, and if wanted its string and vector."""
    plain = "tree int, space int, segment long"

    def run(batches):
        for batch in batches:
            dim, shell = (batch.column(k).to_numpy() for k in (3, 4))
            for k, ((d, s), space) in enumerate(spaces.items()):
                at = np.flatnonzero((dim == d) & (shell == s))
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                x = _matrix(part.column(1), d) / space.reach
                keys = _keys(x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1))))
                for t in trees:
                    columns = [pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(_segment(keys[:, t], space.bits))]
                    names = ["tree", "space", "segment"]
                    if vectors:
                        columns += [pa.array(keys[:, t].view(np.int64)), *part.columns[:3]]
                        names += ["key", "class", "vector", "first"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return classes.select("class", "vector", "first", "dim", "shell").mapInArrow(run, plain + (", key long, class long, vector binary, first long" if vectors else ""))


def _asked(queries: DataFrame, spaces: dict, trees: range, ascend: bool) -> DataFrame:
    """One row per query, tree, space and segment that it has to look into: the own one to descend, to ascend all that begin with the
    prefix. ``queries``: class, vector, dim, and the worst score that a neighbour can have (``least``)."""
    sure = FOUND

    def run(batches):
        for batch in batches:
            dim, least = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            for k, ((d, _), space) in enumerate(spaces.items()):
                at = np.flatnonzero(dim == d)
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                x = _matrix(part.column(1), d)
                length = _length(x)
                keys = _keys(x / length[:, None], np.zeros(len(x)))
                with np.errstate(over="ignore", invalid="ignore"):
                    level = level_for(np.nan_to_num(least[at] / space.reach / length, nan=-1.0), sure) if ascend else np.full(len(at), space.bits)
                wide = np.maximum(0, space.bits - level)
                for t in trees:
                    begin = _segment(keys[:, t], space.bits) >> wide << wide
                    # a query that shares few bits looks into many segments: some queries at a time
                    ends = np.cumsum(1 << wide)
                    lo = 0
                    while lo < len(at):
                        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4_096, side="right")))
                        of = np.repeat(np.arange(lo, hi), 1 << wide[lo:hi])
                        step = np.arange(len(of)) - np.repeat((ends - (1 << wide))[lo:hi] - (ends[lo - 1] if lo else 0), 1 << wide[lo:hi])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(of), t, np.int32)), pa.array(np.full(len(of), k, np.int32)), pa.array(begin[of] + step), pa.array(keys[of, t].view(np.int64)),
                             pa.array(level[of].astype(np.int32)), part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of))],
                            ["tree", "space", "segment", "key", "level", "query", "vector"])
                        lo = hi

    return queries.select("class", "vector", "dim", "least").mapInArrow(run, "tree int, space int, segment long, key long, level int, query long, vector binary")


def _compare(dims: list[int], near: int, ascend: bool):
    """The task of one block of queries and one block of sorted rows."""

    def run(key, asked, rows):
        out = [[], [], [], []]
        dim = dims[key[1].as_py()]
        if len(asked) and len(rows):
            k = rows["key"].to_numpy().view(U64)
            by = np.argsort(k, kind="stable")
            k, y, names, first = k[by], _matrix(rows["vector"], dim)[by], rows["class"].to_numpy()[by], rows["first"].to_numpy()[by]
            q, x, query = asked["key"].to_numpy().view(U64), _matrix(asked["vector"], dim), asked["query"].to_numpy()
            if ascend:
                level = asked["level"].to_numpy().astype(U64)
                rest = np.where(level > 0, ~U64(0) >> np.minimum(level, U64(63)), ~U64(0))
                rest = np.where(level >= BITS, U64(0), rest)
                lo, hi = np.searchsorted(k, q & ~rest), np.searchsorted(k, q | rest, side="right")
            else:
                # the longest common prefixes stand next to the own place
                at = np.searchsorted(k, q)
                lo, hi = np.maximum(0, at - AROUND // 2), np.minimum(len(k), at + AROUND // 2)
            step = max(1, SCORES // len(k))
            for a in range(0, len(q), step):
                some = slice(a, a + step)
                # many rows for most queries: one matrix product, else only the rows of each
                full = (hi[some] - lo[some]).sum() * 8 > len(k) * len(q[some])
                with np.errstate(over="ignore", invalid="ignore"):
                    block = x[some] @ y.T if full else None
                for i in range(a, min(a + step, len(q))):
                    if lo[i] == hi[i]:
                        continue
                    here = slice(lo[i], hi[i])
                    with np.errstate(over="ignore", invalid="ignore"):
                        rough = block[i - a, here] if full else y[here] @ x[i]
                    if len(rough) > near:
                        rough = np.where(np.isnan(rough), -np.inf, rough)
                        cut = np.partition(rough, len(rough) - near)[len(rough) - near]
                        # the product sums in another order: what comes close is summed again
                        slack = 1e-9 * (np.abs(x[i]).max() * np.abs(y[here]).max() * dim) if np.isfinite(cut) else 0
                        pick = np.flatnonzero(rough >= cut - slack) + lo[i]
                    else:
                        pick = np.arange(lo[i], hi[i])
                    score = scores(y[pick], x[i])
                    best = _best(score, first[pick], near)
                    out[0].append(np.full(len(best), query[i]))
                    out[1].append(names[pick[best]])
                    out[2].append(first[pick[best]])
                    out[3].append(score[best])
        columns = [np.concatenate(c) if c else np.zeros(0, np.float64 if j == 3 else np.int64) for j, c in enumerate(out)]
        return pa.table(dict(zip(("query", "class", "first", "score"), columns)))

    return run


def _search(classes: DataFrame, queries: DataFrame, spaces: dict, trees: range, near: int, ascend: bool) -> DataFrame:
    """query, class, first, score: the ``near`` best classes of each task for each query."""
    asked = _asked(queries, spaces, trees, ascend)
    place = ["tree", "space", "segment"]
    rows = _placed(classes, spaces, trees, False).groupBy(place).agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("blocks"))
    lots = asked.groupBy(place).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("lots"))
    cells = stage(rows.join(lots, place))
    left = (
        asked.join(cells, place).withColumn("lot", F.pmod(F.xxhash64("query"), F.col("lots")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*place, "block", "lot", "key", "level", "query", "vector")
    )
    right = (
        _placed(classes, spaces, trees, True).join(cells, place).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        .select(*place, "block", "lot", "key", "class", "vector", "first")
    )
    dims = [space.dim for space in spaces.values()]
    by = [*place, "block", "lot"]
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(_compare(dims, near, ascend), "query long, class long, first long, score double")


def _sampled(classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The queries with ``floor``: their ``k``-th best score among at most ``SAMPLE`` classes; null where a sample is too small."""
    # at most SAMPLE * 1,024 numbers
    sample = classes.orderBy("class").limit(SAMPLE).where(F.col("dim") <= 1_024).select("class", "vector", "dim").toArrow()
    held = {}
    for d in sorted(set(sample["dim"].to_pylist())):
        part = sample.filter(pa.array(sample["dim"].to_numpy() == d))
        held[d] = (part["class"].to_numpy(), _matrix(part["vector"], d))

    def run(batches):
        for batch in batches:
            dim, floor = batch.column(2).to_numpy(), np.full(batch.num_rows, np.nan)
            for d in np.unique(dim).tolist():
                names, y = held.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
                at = np.flatnonzero(dim == d)
                own = batch.column(0).to_numpy()[at]
                if len(names) > k:
                    with np.errstate(over="ignore", invalid="ignore"):
                        got = np.nan_to_num(_matrix(batch.column(1).take(pa.array(at)), d) @ y.T, nan=-np.inf)
                    got[own[:, None] == names[None, :]] = -np.inf
                    floor[at] = np.partition(got, len(names) - k, axis=1)[:, len(names) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor, mask=~np.isfinite(floor))], ["class", "vector", "dim", "floor"])

    return queries.select("class", "vector", "dim").mapInArrow(run, "class long, vector binary, dim int, floor double")


def nearest(vectors: DataFrame, *, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose vec_id ``EVERY`` divides, among all other rows.

    ``vectors (vec_id long, embedding array<float or double>)``. Nearness is the inner product; ties go to the smaller vec_id. Rows
    without vec_id and vectors that are null, empty, zero or hold null or non-finite numbers take no part; vectors of different lengths
    are not compared. Repeated rows count once; an id with several different vectors stands for one of them (that with the smallest
    hash). Fewer than ``k`` others give as many. An empty table gives no rows.
    """
    rows, classes = classes_of(vectors)
    classes = stage(classes)
    # one row per dimension and power of two of the length
    found = classes.groupBy("dim", "shell").agg(F.count("*").alias("n"), F.max("length").alias("reach")).orderBy("dim", "shell").collect()
    spaces = {(r.dim, r.shell): Space(r.dim, r.reach, max(0, (-(-r.n // SEGMENT) - 1).bit_length())) for r in found}
    queries = stage(_sampled(classes, classes.where("asked = 1"), k))
    near = k + 1  # one of them may be the query's own row

    first = stage(_search(classes, queries.withColumn("least", F.lit(0.0)), spaces, range(FIRST), near, False)).where("query <> class")
    merged = first.groupBy("query", "class").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))
    bound = merged.withColumn("place", place).where(F.col("place") == k).select(F.col("query").alias("class"), "score")
    # without k others every row is a candidate
    least = F.greatest("floor", "score")
    asked = stage(queries.join(bound, "class", "left").withColumn("least", F.coalesce(least, F.lit(float("-inf")))).select("class", "vector", "dim", "least"))

    got = _search(classes, asked, spaces, range(TREES), near, True)
    merged = got.groupBy("query", "class", "first").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))
    best = stage(merged.withColumn("place", place).where(F.col("place") <= near).select("query", "class", "score"))

    # of a class, more than k + 1 ids are never needed
    members = F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))
    ids = stage(rows.withColumn("place", members).where(F.col("place") <= near).select("class", "vec_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    lists = best.join(ids, "class").withColumn("place", place).where(F.col("place") <= near).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    answered = rows.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("class", "query").join(lists, "query")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("vec_id")), 1, k)
    return answered.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "f")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
