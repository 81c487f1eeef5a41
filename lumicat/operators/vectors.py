"""Vector search and vector arithmetic.

Distances are double-precision cosine distances rounded to nine places, so that
copies of one vector tie exactly and the smaller id wins. An undefined distance
(zero vector) sorts after all numbers, a missing vector last.

A search scans only (id, vector). Each task keeps the best ``k`` rows per query
in NumPy and emits nothing else, so no pairs travel and no group is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumicat.operators.paging import bounded, check_page, page, ranked, top_per_key
from lumicat.sources.snapshots import stage

c = F.col
QUERY_BLOCK, ROW_BLOCK = 1024, 8192  # vectors of a tile, about: a task multiplies one tile of either side at a time
# A bucket's queries and rows are cut into so many blocks of whole tiles, and into more only where a block would hold more vectors than
# ``LARGE_BLOCK``. Each vector travels once per block of the other side.
QUERY_BLOCKS, ROW_BLOCKS, LARGE_BLOCK = 8, 4, 32_768
HIT_DDL = "query_id bigint, id bigint, sort_key double"
UNDEFINED, MISSING = 1e300, 1e301  # sort keys after every distance


# ------------------------------------------------------------ vector columns
def l2_normalize(vector: Column) -> Column:
    """V5: unit length; the norm counts as at least 1e-12."""
    square = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    norm = F.greatest(F.sqrt(square), F.lit(1e-12))
    return F.transform(vector, lambda x: (x / norm).cast("float"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def to_half(vectors: pd.Series) -> pd.Series:
    """V7: round to half precision, as the vectors are stored."""
    return vectors.map(
        lambda v: None if v is None else np.asarray(v, "float32").astype("float16").astype("float32")
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two array columns, built-in expressions only."""
    def dot(x, y):
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(1 - F.try_divide(dot(a, b), F.nullif(scale, F.lit(0.0))), 9)


def mean_vector(df: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """Element-wise mean per key, NULL vectors skipped, not normalised again.
    Summarizer combines before the shuffle, so one key costs one row per task."""
    present = df.where(c(col).isNotNull()).withColumn("__v", array_to_vector(c(col)))
    mean = vector_to_array(Summarizer.mean(c("__v"))).alias(col)
    by = keys or [F.lit(0).alias("__all")]  # a constant key: no row for no input
    return present.groupBy(*by).agg(mean).drop("__all")


def pool_queries(df: DataFrame, col: str, key: str) -> DataFrame:
    """V6: one query vector per key, the plain mean of its normalised inputs."""
    return mean_vector(df.withColumn(col, l2_normalize(c(col))), col, [key])


# ---------------------------------------------------------------- tag scores
TAG_DDL = "tag_index int, name string, score float"


def top_tags(df: DataFrame, vocabulary: list[tuple[str, bool]], k: int = 36,
             general: float = 0.3, character: float = 0.75, key: str = "id",
             scores: str = "scores") -> DataFrame:
    """V4: the ``k`` best tags per row that reach the threshold of their type, as
    rows (key, rank, tag_index, name, score). ``vocabulary`` lists (name,
    is_character) per score position; equal scores keep index order."""
    names = np.array([name for name, _ in vocabulary], dtype=object)
    floor = np.array([character if is_char else general for _, is_char in vocabulary], "float32")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            if len(rows) == 0:
                continue
            table = _matrix(rows, len(floor), "float32")
            keep = ~np.isnan(table) & (table >= floor)
            rank_by = np.where(keep, -table, np.inf)
            order = np.argsort(rank_by, axis=1, kind="stable")[:, :k]
            hit = np.take_along_axis(keep, order, axis=1)
            row, place = np.nonzero(hit)
            index = order[row, place]
            yield pa.record_batch(
                {
                    key: ids.take(pa.array(row)),
                    "rank": pa.array(place + 1, pa.int32()),
                    "tag_index": pa.array(index, pa.int32()),
                    "name": pa.array(names[index], pa.string()),
                    "score": pa.array(table[row, index], pa.float32()),
                }
            )

    ids = df.select(c(key).cast("bigint"), scores)
    return ids.mapInArrow(pick, f"{key} bigint, rank int, {TAG_DDL}")


def _matrix(rows: pa.Array, dim: int, dtype: str) -> np.ndarray:
    """List column to a matrix; a missing or wrongly sized row is an error for
    the latter and all NaN for the former."""
    lengths = np.asarray(rows.value_lengths().fill_null(-1))
    if ((lengths != dim) & (lengths != -1)).any():
        raise ValueError(f"expected vectors of {dim} dimensions, got {set(lengths.tolist())}")
    out = np.full((len(rows), dim), np.nan, dtype)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    out[lengths == dim] = flat.reshape(-1, dim)
    return out


# -------------------------------------------------------------------- search
@dataclass(frozen=True)
class HyperplaneIndex:
    """V8: a query is compared with the rows of some buckets of each table: its own, and the ``probes`` buckets beyond the planes
    that it lies nearest to, where its neighbours are likeliest to have got. More bits compare fewer pairs, more tables or probes
    find more of the nearest."""

    tables: int = 20
    bits: int = 7
    seed: int = 7
    probes: int = 2

    def planes(self, dim: int) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((dim, self.tables * self.bits))

    def buckets(self, unit: np.ndarray, probed: bool) -> np.ndarray:
        """Of each vector: the bucket in every table, and for queries (``probed``) the buckets beyond the nearest planes. Equal
        distances go by the plane's place."""
        away = (unit @ self.planes(unit.shape[1])).reshape(len(unit), self.tables, self.bits)
        own = ((away > 0) * (1 << np.arange(self.bits))).sum(axis=2) + (np.arange(self.tables) << self.bits)
        if not probed:
            return own
        nearest = np.argsort(np.abs(away), axis=2, kind="stable")[:, :, : self.probes]
        return np.concatenate((own[:, :, None], own[:, :, None] ^ (1 << nearest)), axis=2).reshape(len(unit), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / norm


def _best(query: np.ndarray, ident: np.ndarray, dist: np.ndarray, k: int):
    """The first ``k`` hits per query by (distance, id)."""
    order = np.lexsort((ident, dist, query))
    query, ident, dist = query[order], ident[order], dist[order]
    starts = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.array([], int)
    sizes = np.diff(np.r_[starts, len(query)])
    keep = np.arange(len(query)) - np.repeat(starts, sizes) < k
    return query[keep], ident[keep], dist[keep]


def _scan(corpus: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    """Partial top ``k`` per query and task; for a page of few queries."""
    shared = corpus.sparkSession.sparkContext.broadcast((ids, _unit(matrix)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        held = (np.array([], "int64"), np.array([], "int64"), np.array([], "float64"))
        for batch in batches:
            if batch.num_rows:
                held = _best(*(np.concatenate(p) for p in zip(held, _nearest(queries, batch.column(0), batch.column(1), k))), k)
        yield _hits(query_ids[held[0]], held[1], held[2])

    return corpus.mapInArrow(search, HIT_DDL)


def _nearest(queries: np.ndarray, ids: pa.Array, vectors: pa.Array, k: int):
    """The rows that can be among the first ``k`` of each query: (query, id, sort key)."""
    row_ids = ids.to_numpy(zero_copy_only=False)
    dist = np.round(1.0 - queries @ _unit(_matrix(vectors, queries.shape[1], "float64")).T, 9) + 0.0
    dist[np.isnan(dist)] = UNDEFINED
    dist[:, np.asarray(vectors.is_null())] = MISSING
    last = min(k, dist.shape[1]) - 1
    query, row = np.nonzero(dist <= np.partition(dist, last, axis=1)[:, last][:, None])
    return query, row_ids[row], dist[query, row]


def _hits(query_ids, ids, keys) -> pa.RecordBatch:
    return pa.record_batch({"query_id": pa.array(query_ids, pa.int64()), "id": pa.array(ids, pa.int64()), "sort_key": pa.array(keys, pa.float64())})


def _block_join(asked: DataFrame, rows: DataFrame, k: int, col: str) -> DataFrame:
    """Hits of every query among the rows of its buckets. Both sides are cut into blocks by hash, and every two blocks
    of a bucket meet in a task of their own, tile by tile, so neither a query table nor a busy bucket has to fit anywhere.
    Buckets of one block are put together until they make up one."""
    def count(side, tile, blocks, name):
        number = F.count(F.lit(1))
        size = F.least(F.greatest(F.lit(tile), number / blocks), F.lit(LARGE_BLOCK))
        return side.groupBy("bucket").agg(number.alias(f"{name}n"), F.ceil(number / size).cast("int").alias(f"{name}s"))

    # a row per bucket
    sizes = stage(count(asked, QUERY_BLOCK, QUERY_BLOCKS, "q").join(count(rows, ROW_BLOCK, ROW_BLOCKS, "r"), "bucket"))
    single = (c("qs") == 1) & (c("rs") == 1)
    small = sizes.where(single).agg(F.coalesce(F.sum(F.greatest(c("rn"), c("qn") * (ROW_BLOCK // QUERY_BLOCK))), F.lit(0))).first()[0]
    slot = F.when(single, -1 - F.pmod(F.xxhash64("bucket"), F.lit(small // ROW_BLOCK + 1))).otherwise(c("bucket"))
    sizes = F.broadcast(sizes.select("bucket", "qs", "rs", slot.alias("slot")))

    def deal(side, key, own, other):
        block = F.pmod(F.xxhash64(key), c(own)).cast("int")
        return side.join(sizes, "bucket").select(
            c("slot").alias("slot"), block.alias(own[0]), F.explode(F.sequence(F.lit(0), c(other) - 1)).alias(other[0]), c("bucket").alias("bucket"), c(key).alias(key), c(col).alias("vector"))

    left, right = deal(asked, "query_id", "qs", "rs"), deal(rows, "id", "rs", "qs")

    def compare(queries, found):
        held = [(np.array([], "int64"), np.array([], "int64"), np.array([], "float64"))]
        if queries.num_rows and found.num_rows:
            queries, found = queries.sort_by("bucket").combine_chunks(), found.sort_by("bucket").combine_chunks()
            of_query, of_row = queries["bucket"].to_numpy(), found["bucket"].to_numpy()
            names, vectors = queries["query_id"].to_numpy(), queries["vector"].chunk(0)
            unit = _unit(_matrix(vectors, len(vectors[0]), "float64"))
            for bucket in np.intersect1d(of_query, of_row):
                (a, b), (x, y) = (np.searchsorted(side, [bucket, bucket + 1]) for side in (of_query, of_row))
                for at in range(a, b, QUERY_BLOCK):
                    some, best = slice(at, min(at + QUERY_BLOCK, b)), None
                    for row in range(x, y, ROW_BLOCK):
                        those = slice(row, min(row + ROW_BLOCK, y))
                        hits = _nearest(unit[some], found["id"].chunk(0)[those], found["vector"].chunk(0)[those], k)
                        best = _best(*(hits if best is None else (np.concatenate(p) for p in zip(best, hits))), k)
                    held.append((names[some][best[0]], best[1], best[2]))
        return pa.Table.from_batches([_hits(*(np.concatenate(p) for p in zip(*held)))])

    keys = ["slot", "q", "r"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, HIT_DDL)


def _distance() -> Column:
    key = c("sort_key")
    return F.when(key == UNDEFINED, F.lit(float("nan"))).when(key < UNDEFINED, key).alias("distance")


def _buckets(side: DataFrame, key: str, col: str, index: HyperplaneIndex, probed: bool = False) -> DataFrame:
    """Each vector once per bucket that it lies in or, if ``probed``, is looked for in. Missing vectors meet nothing."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            dim = int(np.asarray(batch.column(1).value_lengths().fill_null(0)).max())
            unit = _unit(_matrix(batch.column(1), dim, "float64"))
            found = index.buckets(unit, probed)
            lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel(), pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), lists], [key, col, "buckets"])

    kind = side.schema[col].dataType.simpleString()
    coded = side.where(c(col).isNotNull()).mapInArrow(codes, f"{key} bigint, {col} {kind}, buckets array<bigint>")
    return coded.select(key, col, F.explode("buckets").alias("bucket"))


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, col: str = "embedding",
             index: HyperplaneIndex | None = None) -> DataFrame:
    """V9 (V8 with an index): the ``k`` nearest corpus rows of every query, as
    (query_id, rank, id, distance). ``queries`` has (query_id, vector), ids unique.

    Blocks of queries meet blocks of rows in tasks; an index lets only those of one bucket meet.
    """
    rows = corpus.select(c("id").cast("bigint"), c(col))
    asked = queries.where(c(col).isNotNull()).select(c("query_id").cast("bigint"), c(col))
    if index:
        hits = _block_join(_buckets(asked, "query_id", col, index, probed=True), _buckets(rows, "id", col, index), k, col).distinct()
    else:
        one = F.lit(0).cast("bigint").alias("bucket")
        hits = _block_join(asked.select("*", one), rows.select("*", one), k, col)
    top = top_per_key(hits, ["query_id"], [c("sort_key"), c("id")], k)
    return top.select("query_id", c("rank").cast("bigint").alias("rank"), "id", _distance())


def ann_knn(queries: DataFrame, corpus: DataFrame, k: int, col: str = "embedding",
            index: HyperplaneIndex = HyperplaneIndex()) -> DataFrame:
    """V8: approximate search; candidates from hash buckets, ranked exactly."""
    return knn_join(queries, corpus, k, col, index)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search returned."""
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def knn(df: DataFrame, q: list[float], col: str = "embedding", limit: int = 50,
        offset: int = 0) -> DataFrame:
    """V1, V2: the page of rows nearest to one query vector, as (rank, id, distance)."""
    check_page(limit, offset)
    rows = df.select(c("id").cast("bigint"), c(col))
    hits = _scan(rows, np.zeros(1, "int64"), np.asarray([q], "float64"), max(1, limit + offset))
    order = [c("sort_key"), c("id")]
    return ranked(page(hits.drop("query_id"), order, limit, offset), order).select(
        "rank", "id", _distance()
    )


def knn_by_ids(df: DataFrame, ids: list[int], col: str = "embedding", limit: int = 50,
               offset: int = 0) -> DataFrame:
    """V3: search by the mean vector of stored rows, which stay among the hits.
    Without any stored vector the result is empty (the reference returns
    arbitrary rows)."""
    query = mean_vector(df.where(c("id").isin(*ids)), col).take(1)
    if not query:
        return df.sparkSession.createDataFrame([], "rank bigint, id bigint, distance double")
    return knn(df, list(query[0][col]), col, limit, offset)


def with_media(hits: DataFrame, media: DataFrame, limit: int) -> DataFrame:
    """The wide columns of a page of hits."""
    return media.join(bounded(hits, limit), "id")


def exclude_same_post(hits: DataFrame, post_images: DataFrame, image_id: int) -> DataFrame:
    """Drop hits of the query image's own post from an already cut page."""
    own = post_images.where(c("image_id") == image_id).agg(F.min("post_id").alias("post_id"))
    siblings = post_images.join(F.broadcast(own), "post_id").select(c("image_id").alias("id"))
    return hits.join(siblings, "id", "left_anti")
