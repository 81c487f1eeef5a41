"""Stored tables in buckets: what a write touches, repeated batches, scoring rounds that die half way."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumicat.catalog import empty_catalog
from lumicat.operators.paging import first_rows
from lumicat.sources.snapshots import Buckets
from lumicat.streaming import sinks

c = F.col


def files_of(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_an_untouched_bucket_keeps_its_file(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), "id bigint, v string", ["id"], 8)
    assert table.read().count() == 0
    table.replace(spark.range(100).select("id", F.lit("a").alias("v")), list(range(8)), "first")
    before, held = files_of(tmp_path), table.versions()
    one = spark.range(7, 8).select("id", F.lit("b").alias("v"))
    touched = table.touched(one)
    assert len(touched) == 1
    rest = table.read(touched).where("id <> 7")
    table.replace(rest.unionByName(one), touched, "second", note="x")
    now = table.versions()
    assert {k for k in held if now[k] != held[k]} == {f"b{touched[0]}"} and now["note"] == "x"
    assert all(files_of(tmp_path)[p] == at for p, at in before.items())
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(i, "b" if i == 7 else "a") for i in range(100)]
    table.replace(table.read(touched).limit(0), touched, "third")
    assert f"b{touched[0]}" not in table.versions() and table.read(touched).count() == 0
    assert 0 < table.read().count() < 100


def test_likes_of_two_batches(spark, tmp_path):
    root, log = str(tmp_path / "likes"), tmp_path / "log"
    ddl = "address string, kind string, target_id bigint, action string, created_at bigint, seq bigint"

    def feed(rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(str(log))
        stream = spark.readStream.schema(ddl).json(str(log))
        assert sinks.likes_stream(stream, root, str(tmp_path / "ckpt"), buckets=16).awaitTermination(120)
        return {(r.address, r.target_id, r.created_at) for r in sinks.read_likes(spark, root, 16).collect()}

    first = feed([(f"a{k}", "post", k, "add", 10 + k, k) for k in range(40)])
    assert first == {(f"a{k}", k, 10 + k) for k in range(40)}
    held = sinks._likes(spark, root, 16).versions()
    second = feed([("a3", "post", 3, "remove", 99, 1), ("b", "post", 1, "add", 99, 2)])
    assert second == first - {("a3", 3, 13)} | {("b", 1, 99)}
    now = sinks._likes(spark, root, 16).versions()
    changed = {k for k in held if k != "batch" and now.get(k) != held[k]}
    assert 1 <= len(changed) <= 2 and int(now["batch"]) > int(held["batch"])


@pytest.mark.parametrize("dies", [False, True])
def test_scoring_rounds_in_buckets(spark, tmp_path, dies):
    images = spark.createDataFrame(
        [(i, f"n{i}", 1, 1, "completed" if i > 20 else "pending", 0, None, None, [9.0] if i > 20 else None) for i in range(1, 31)], empty_catalog(spark).images.schema)
    tables = sinks.ScoringTables(spark, str(tmp_path / "s"), 8)
    tables.begin(empty_catalog(spark).with_(images=images))
    vectors = files_of(tmp_path / "s" / "vectors")
    assert tables.claim(4, 1800).count() == 4
    assert files_of(tmp_path / "s" / "vectors") == vectors

    def score(rows):
        tag = F.array(F.struct(F.lit("t").alias("name"), F.lit(0.5).cast("float").alias("score")))
        return rows.select("id", tag.alias("tags"), F.array(c("id").cast("float")).alias("clip"), F.array(F.lit(1.0).cast("float")).alias("dinov3"), F.when(c("id") % 10 == 0, "bad").alias("error"))

    if dies:
        # the state is written last: all else of this round is there, and its images are claimed once more
        replace, tables.work.replace = tables.work.replace, None
        with pytest.raises(TypeError):
            tables.record(score(tables.work.read().where("status = 'processing'").select("id", "name")))
        tables.work.replace = replace
        assert tables.work.read().where("status = 'processing'").count() == 4
    assert tables.run(score, 7, ttl=-60) >= 3
    got = {r.id: (r.status, r.clip) for r in tables.images().collect()}
    want = {i: ("completed", [9.0]) if i > 20 else ("pending", None) if i % 10 == 0 else ("completed", [float(i)]) for i in range(1, 31)}
    assert got == want
    assert tables.scores.read().count() == 18 and tables.tags.read().count() == 1


def test_the_first_rows_without_a_sort(spark):
    rng = random.Random(4)
    rows = [(p, i) for p in (0, 1, 2) for i in rng.sample(range(-(10**12), 10**12), 300)] + [(1, k) for k in range(400)]
    df = spark.createDataFrame(rows, "priority int, id bigint").repartition(7)
    for n in (0, 1, 299, 300, 301, 500, 777, 999, 1_000, 1_299, 1_300, 5_000):
        got = sorted((r.priority, r.id) for r in first_rows(df, "priority", "id", n, ranges=8, small=20).collect())
        assert got == sorted(rows)[:n]
    assert first_rows(df.limit(0), "priority", "id", 5).count() == 0
    plan = first_rows(df, "priority", "id", 900, small=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
