"""Vectors and samples: V1-V9, A6, A7, J24, R1-R3, C12."""

from pyspark.sql import functions as F

from checks.base import query, with_cte
from lumicat.functions.hashing import mix64
from lumicat.operators import sampling, vectors

c = F.col
E = "SELECT vec_id AS id, embedding FROM embeddings"
DIST = "round(list_cosine_distance({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def corpus(t):
    return t.embeddings.select(c("vec_id").alias("id"), "embedding", "label")


def show(df):
    return df.withColumn("distance", F.round("distance", 6) + 0.0)


PROBE = [round(0.5 - (i * 37 % 64) / 64, 4) for i in range(64)]


@query("v1_knn", f"""SELECT row_number() OVER (ORDER BY d, id) AS rank, id, round(d, 6) AS distance FROM
    (SELECT vec_id AS id, round(list_cosine_distance(embedding::DOUBLE[], {PROBE}::DOUBLE[]), 9) AS d FROM embeddings
     ORDER BY d, id LIMIT 25 OFFSET 5)""")
def v1(t):
    return show(vectors.knn(corpus(t), PROBE, limit=25, offset=5))


@query("v2_knn_second_space", """SELECT row_number() OVER (ORDER BY d, id) AS rank, id, round(d, 6) AS distance FROM
    (SELECT vec_id AS id, round(list_cosine_distance(list_reverse(embedding::DOUBLE[]), q), 9) AS d FROM embeddings,
      (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3) ORDER BY d, id LIMIT 30)""")
def v2(t):
    second = corpus(t).withColumn("dinov3", F.reverse("embedding"))
    q = second.where("id = 3").select(F.reverse("dinov3").alias("q")).take(1)[0]["q"]
    return show(vectors.knn(second, q, "dinov3", limit=30))


MEAN = """SELECT list(m ORDER BY pos) AS q FROM (SELECT pos, avg(x::DOUBLE) AS m FROM
    (SELECT unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings WHERE vec_id IN {ids}) GROUP BY pos)"""


@query("v3_knn_by_ids", f"""SELECT row_number() OVER (ORDER BY d, id) AS rank, id, round(d, 6) AS distance FROM
    (SELECT vec_id AS id, round(list_cosine_distance(embedding::DOUBLE[], q), 9) AS d FROM embeddings, ({MEAN.format(ids='(7, 340, 425)')})
     ORDER BY d, id LIMIT 20 OFFSET 2)""")
def v3(t):
    return show(vectors.knn_by_ids(corpus(t), [7, 340, 425], limit=20, offset=2))


@query("a7_mean_vector", """SELECT label, pos, round(avg(x::DOUBLE), 6) AS mean FROM
    (SELECT label, unnest(embedding) AS x, unnest(range(64))::INT AS pos FROM embeddings) GROUP BY ALL""")
def a7(t):
    means = vectors.mean_vector(t.embeddings, "embedding", ["label"])
    return means.select("label", F.posexplode("embedding").alias("pos", "mean")).withColumn(
        "mean", F.round("mean", 6) + 0.0)


@query("v5_l2_normalize", """SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS norm, round(v[1], 5) AS first FROM
    (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12)) AS v FROM
     (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id + 1)) AS e FROM embeddings))""")
def v5(t):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (c("vec_id") + 1))
    unit = t.embeddings.select("vec_id", vectors.l2_normalize(scaled).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return unit.select("vec_id", F.round(norm, 5).alias("norm"),
                       (F.round(c("v")[0].cast("double"), 5) + 0.0).alias("first"))


@query("v6_pool_queries", """SELECT label, pos, round(avg(x), 5) AS mean FROM (SELECT label, unnest(v) AS x, unnest(range(64))::INT AS pos FROM
    (SELECT label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM
     (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS e FROM embeddings))) GROUP BY ALL""")
def v6(t):
    scaled = t.embeddings.select("label", F.transform("embedding", lambda x: x * 3).alias("embedding"))
    means = vectors.pool_queries(scaled, "embedding", "label")
    return means.select("label", F.posexplode("embedding").alias("pos", "mean")).withColumn(
        "mean", F.round("mean", 5) + 0.0)


@query("v7_to_half", """SELECT vec_id, pos, round(CASE WHEN x = 0 THEN 0 ELSE sign(x) * pow(2, e) * round_even(abs(x) / pow(2, e) * 1024, 0) / 1024 END, 8) AS x FROM
    (SELECT vec_id, pos, x, greatest(floor(log2(abs(x))), -14) AS e FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64))::INT AS pos FROM embeddings))""")
def v7(t):
    half = t.embeddings.select("vec_id", vectors.to_half("embedding").alias("v"))
    return half.select("vec_id", F.posexplode("v").alias("pos", "x")).withColumn(
        "x", F.round(c("x").cast("double"), 8) + 0.0)


VOCABULARY = [(f"tag_{i}", i % 4 == 0) for i in range(64)]


@query("v4_top_tags", """SELECT id, rank, tag_index, 'tag_' || tag_index AS name, score FROM
    (SELECT id, tag_index, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, tag_index)::INT AS rank FROM
     (SELECT vec_id AS id, unnest(embedding) AS score, unnest(range(64))::INT AS tag_index FROM embeddings)
     WHERE score >= CASE WHEN tag_index % 4 = 0 THEN 0.15::FLOAT ELSE 0.05::FLOAT END) WHERE rank <= 5""")
def v4(t):
    rows = t.embeddings.select(c("vec_id").alias("id"), c("embedding").alias("scores"))
    return vectors.top_tags(rows, VOCABULARY, k=5, general=0.05, character=0.15)


@query("v9_knn_join", """SELECT query_id, rank, id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank
    FROM (SELECT q.label AS query_id, e.vec_id AS id, round(list_cosine_distance(e.embedding::DOUBLE[], q.q), 9) AS d FROM embeddings e,
      (SELECT label, list(m ORDER BY pos) AS q FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM
        (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label) q)) WHERE rank <= 10""")
def v9(t):
    means = vectors.mean_vector(t.embeddings, "embedding", ["label"])
    asked = means.select(c("label").cast("bigint").alias("query_id"), "embedding")
    return show(vectors.knn_join(asked, corpus(t), 10))


@query("v9_knn_all_rows", """SELECT query_id, rank, id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank
    FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS d
      FROM embeddings e, embeddings q)) WHERE rank <= 3""")
def v9_all(t):
    asked = t.embeddings.select(c("vec_id").alias("query_id"), "embedding")
    return show(vectors.knn_join(asked, corpus(t), 3))


INDEX = vectors.HyperplaneIndex()
PLANES = ", ".join(str(p) for p in INDEX.planes(64).T.tolist())


@query("v8_ann_knn", f"""WITH away AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform([{PLANES}], lambda p: list_dot_product(embedding::DOUBLE[], p)) AS a FROM embeddings),
    cut AS (SELECT vec_id, v, list_transform(range({INDEX.tables}), lambda t: a[t * {INDEX.bits} + 1:(t + 1) * {INDEX.bits}]) AS a FROM away),
    near AS (SELECT *, list_transform(a, lambda x: list_transform(x, lambda y: CASE WHEN y > 0 THEN 1 ELSE 0 END)) AS s,
      list_transform(a, lambda x: list_grade_up(list_transform(x, lambda y: abs(y)))[1:{INDEX.probes}]) AS n FROM cut),
    codes AS (SELECT vec_id, v, list_transform(range(1, {INDEX.tables} + 1), lambda t: t || ':' || array_to_string(s[t], '')) AS c,
      flatten(list_transform(range(1, {INDEX.tables} + 1), lambda t: list_transform(range(0, {INDEX.probes} + 1), lambda k: t || ':' || array_to_string(
        list_transform(range(1, {INDEX.bits} + 1), lambda i: CASE WHEN k > 0 AND n[t][k] = i THEN 1 - s[t][i] ELSE s[t][i] END), '')))) AS asked FROM near)
    SELECT query_id, rank, id, round(d, 6) AS distance FROM (SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM
      (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_distance(e.v, q.v), 9) AS d FROM codes q, codes e WHERE list_has_any(q.asked, e.c))) WHERE rank <= 3""")
def v8(t):
    asked = t.embeddings.select(c("vec_id").alias("query_id"), "embedding")
    return show(vectors.ann_knn(asked, corpus(t), 3))


@query("j24_exclude_same_post", """SELECT rank, id, round(d, 6) AS distance FROM (SELECT row_number() OVER (ORDER BY d, id) AS rank, id, d FROM
    (SELECT e.vec_id AS id, round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS d FROM embeddings e, embeddings q
     WHERE q.vec_id = 7 ORDER BY d, id LIMIT 100)) JOIN embeddings ON vec_id = id
    WHERE label <> (SELECT label FROM embeddings WHERE vec_id = 7)""")
def j24(t):
    links = t.embeddings.select(c("label").alias("post_id"), c("vec_id").alias("image_id"))
    hits = vectors.knn_by_ids(corpus(t), [7], limit=100)
    return show(vectors.exclude_same_post(hits, links, 7))


M64 = "18446744073709551616::UHUGEINT"


def mix_sql(x):
    """splitmix64 finaliser on an unsigned 64-bit value held in UHUGEINT."""
    z = f"({x})"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = f"(xor({z}, {z} // {2**shift}::UHUGEINT) * {factor}::UHUGEINT % {M64})"
    return f"xor({z}, {z} // {2**31}::UHUGEINT)"


@query("c12_mix64", f"""SELECT o_orderkey, (CASE WHEN m >= 9223372036854775808::UHUGEINT THEN m::HUGEINT - 18446744073709551616::HUGEINT ELSE m::HUGEINT END)::BIGINT AS mixed
    FROM (SELECT o_orderkey, {mix_sql('o_orderkey::UHUGEINT')} AS m FROM orders)""")
def c12(t):
    return t.orders.select("o_orderkey", mix64("o_orderkey").alias("mixed"))


def sample_sql(table, cols, seed, limit, offset):
    inner = mix_sql("i::UHUGEINT")
    outer = mix_sql("x")
    return with_cte(table, f"""SELECT pos, id, {cols} FROM (SELECT min(i) AS pos, id FROM
        (SELECT i, lo + ({outer} % (hi - lo + 1)::UHUGEINT)::BIGINT AS id FROM
          (SELECT i, xor({seed % 2**64}::UHUGEINT, {inner}) AS x, lo, hi FROM range({offset}, {offset + limit}) r(i), (SELECT min(id) AS lo, max(id) AS hi FROM {table})))
        GROUP BY id) JOIN {table} USING (id)""")


@query("r1_random_ids", f"""SELECT min(i) AS pos, id FROM (SELECT i, lo + ({mix_sql('x')} % (hi - lo + 1)::UHUGEINT)::BIGINT AS id FROM
    (SELECT i, xor(42::UHUGEINT, {mix_sql('i::UHUGEINT')}) AS x, lo, hi FROM range(0, 5000) r(i), (SELECT min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings))) GROUP BY id""")
def r1(t):
    return sampling.draw_ids(sampling.id_bounds(corpus(t)), 42, 5000)


@query("r2_random_posts", sample_sql("posts", "title", 42, 50, 10))
def r2(t):
    return sampling.random_rows(t.catalog.posts, 42, 50, 10)


@query("r3_random_images", sample_sql("images", "name, width, height", -7, 200, 0))
def r3(t):
    rows = t.catalog.images.select("id", "name", "width", "height")
    return sampling.random_rows(rows, -7, 200, 0)


@query("a6_id_bounds", with_cte("images", "SELECT min(id) AS min_id, max(id) AS max_id FROM images"))
def a6(t):
    return sampling.id_bounds(t.catalog.images)
