"""Vector search against brute force in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicat.operators import sampling, vectors

c = F.col


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).astype("float32").tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # a third of all rows are copies
    rows += [(2000, [0.0] * 16), (2001, None)]
    return rows, spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(6)


def brute(rows, q, k):
    out = []
    for ident, v in rows:
        if v is None:
            out.append((vectors.MISSING, ident))
            continue
        v = np.asarray(v, "float64")
        norm = np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())
        out.append((round(1 - float(v @ q) / norm, 9) + 0.0 if norm else vectors.UNDEFINED, ident))
    return [i for _, i in sorted(out)][:k]


def test_copies_tie_by_id(data):
    rows, df = data
    q = np.asarray(rows[5][1], "float64")
    got = [r.id for r in vectors.knn(df, q.tolist(), limit=200).orderBy("rank").collect()]
    assert got == brute(rows, q, 200)
    assert got[:3] == [5, 1000, 1001]


def test_undefined_and_missing_sort_last(data):
    rows, df = data
    got = vectors.knn(df, rows[0][1], limit=500).orderBy("rank").collect()
    assert [r.id for r in got[-2:]] == [2000, 2001]
    assert np.isnan(got[-2].distance) and got[-1].distance is None and len(got) == len(rows)


def test_paging_is_a_window_of_the_ranking(data):
    rows, df = data
    whole = brute(rows, np.asarray(rows[9][1], "float64"), 60)
    got = [r.id for r in vectors.knn(df, rows[9][1], limit=25, offset=30).orderBy("rank").collect()]
    assert got == whole[30:55]


def test_batch_search_in_several_blocks(spark, data, monkeypatch):
    rows, df = data
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 100)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(20)], "query_id bigint, embedding array<float>")
    got = {}
    for r in vectors.knn_join(asked, df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {i: brute(rows, np.asarray(rows[i][1], "float64"), 5) for i in range(20)}


def test_wrong_dimension_is_an_error(data):
    with pytest.raises(Exception, match="dimensions"):
        vectors.knn(data[1], [1.0, 2.0]).collect()


def test_approximate_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 32))
    rows = [(i, (centres[i % 20] + 0.2 * rng.standard_normal(32)).astype("float32").tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    asked = df.where("id < 50").withColumnRenamed("id", "query_id")
    found = vectors.ann_knn(asked, df, 10)
    assert vectors.recall(found, vectors.knn_join(asked, df, 10)).first()["recall"] >= 0.95


def test_approximate_search_saves_work(spark):
    """At sf0.1, whose vectors are nearly random: share of pairs compared, and recall of the three nearest."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(c("vec_id").alias("id"), "embedding")
    asked = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    index = vectors.HyperplaneIndex()
    sides = [vectors._buckets(d, k, "embedding", index, probed).groupBy("bucket").count().withColumnRenamed("count", k) for d, k, probed in ((asked, "query_id", True), (df, "id", False))]
    pairs = sides[0].join(sides[1], "bucket").agg(F.sum(c("query_id") * c("id"))).first()[0]
    assert pairs <= 0.6 * asked.count() * df.count()
    assert vectors.recall(vectors.ann_knn(asked, df, 3), vectors.knn_join(asked, df, 3)).first()["recall"] >= 0.9


def test_probes_are_the_buckets_beyond_the_nearest_planes():
    index = vectors.HyperplaneIndex(tables=3, bits=4, probes=2)
    x = np.random.default_rng(3).standard_normal((5, 16))
    away = (x @ index.planes(16)).reshape(5, 3, 4)
    own, asked = index.buckets(x, False), index.buckets(x, True).reshape(5, 3, 3)
    for i in range(5):
        for t in range(3):
            first, second = sorted(range(4), key=lambda b: abs(away[i, t, b]))[:2]
            assert asked[i, t].tolist() == [own[i, t], own[i, t] ^ (1 << first), own[i, t] ^ (1 << second)]


def test_batch_search_leaves_queries_on_the_executors(spark, data):
    rows, df = data
    plan = vectors.knn_join(df.withColumnRenamed("id", "query_id"), df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan


def test_ids_without_vectors_give_no_hits(data):
    assert vectors.knn_by_ids(data[1], [-1, 2001]).count() == 0


def test_normalise_and_half(spark):
    df = spark.createDataFrame([([float(i) for i in range(128)],), ([0.0] * 128,), (None,)], "v array<float>")
    got = [r[0] for r in df.select(vectors.l2_normalize(c("v"))).collect()]
    assert abs(np.linalg.norm(got[0]) - 1) < 1e-5 and not any(got[1]) and got[2] is None
    half = [r[0] for r in df.select(vectors.to_half(F.transform("v", lambda x: (x / 7).cast("float")))).collect()]
    want = (np.arange(128, dtype="float32") / np.float32(7)).astype("float16").astype("float32")
    assert np.allclose(half[0], want, rtol=1e-3) and half[2] is None


def test_top_tags_keep_index_order_on_ties(spark):
    vocabulary = [("a", False), ("b", True), ("c", False), ("d", False)]
    df = spark.createDataFrame([(1, [0.5, 0.7, 0.5, 0.2]), (2, [0.1, 0.9, 0.1, 0.1])], "id bigint, scores array<float>")
    got = [(r.id, r.rank, r.name) for r in vectors.top_tags(df, vocabulary, k=2).orderBy("id", "rank").collect()]
    assert got == [(1, 1, "a"), (1, 2, "c"), (2, 1, "b")]


@pytest.mark.parametrize("seed,low,high,limit,offset,want", [
    (42, 0, 499, 10, 0, [462, 380, 448, 155, 33, 285, 112, 431, 467]),
    (42, 0, 499, 10, 10, [36, 429, 368, 265, 67, 222, 173, 210, 305, 333]),
    (-7, 1, 20, 12, 0, [12, 2, 11, 10, 5, 9, 7, 4, 8]),
    (0, 1, 1, 5, 0, [1])])
def test_golden_samples(spark, seed, low, high, limit, offset, want):
    rows = sampling.random_ids(spark, seed, low, high, limit, offset).orderBy("pos").collect()
    assert [r.id for r in rows] == want


def test_vectors_travel_to_few_blocks(spark, data, monkeypatch):
    rows, df = data
    for name, size in (("QUERY_BLOCK", 7), ("ROW_BLOCK", 20), ("LARGE_BLOCK", 200)):
        monkeypatch.setattr(vectors, name, size)
    staged, stage = [], vectors.stage
    monkeypatch.setattr(vectors, "stage", lambda df: staged.append(stage(df)) or staged[-1])
    asked = df.where("embedding IS NOT NULL").select(c("id").alias("query_id"), "embedding")
    got = {}
    for r in vectors.knn_join(asked, df, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert [(r.qs, r.rs) for r in staged[0].collect()] == [(8, 4)]  # by tiles alone: 65 and 23
    for ident, v in rows[::25]:
        assert got[ident] == brute(rows, np.asarray(v, "float64"), 4)
