"""Sources and streaming sinks over real files."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from lumicat.catalog import empty_catalog
from lumicat.operators import events, ingest, scoring
from lumicat.sources import files, snapshots
from lumicat.streaming import sinks

c = F.col


def test_metadata_files(spark, tmp_path):
    path = tmp_path / "metas.json"
    path.write_text(json.dumps([
        {"title": "A", "authors": ["x"], "cosplayers": ["y"], "characters": ["c"], "tags": ["t"], "extra": 1,
         "images": [{"name": "i", "width": 3, "height": 4, "more": 0}]}, {"title": "B"}], indent=1))
    got = files.read_metas(spark, str(path)).orderBy("ord").collect()
    assert [(r.title, r.authors, r.tags, len(r.images)) for r in got] == [("A", ["y"], ["c", "t"], 1), ("B", [], [], 0)]
    out = str(tmp_path / "out")
    snapshots.write_metas(files.read_metas(spark, str(path)), out)
    assert files.read_metas(spark, out).count() == 2
    names = tmp_path / "t.json"
    names.write_text('[{"name": "n", "translations": ["a", "b"]}, {"name": "m"}]')
    assert [tuple(r) for r in files.read_translations(spark, str(names)).collect()] == [("n", ["a", "b"]), ("m", [])]


def test_vocabulary(spark, tmp_path):
    path = tmp_path / "tags.csv"
    path.write_text('tag_id,name,category,count\n1,"a,b",0,5\n2,hero,4,5\n')
    assert files.read_vocabulary(spark, str(path), 2) == [("a,b", False), ("hero", True)]
    with pytest.raises(ValueError, match="expected 3"):
        files.read_vocabulary(spark, str(path), 3)


def test_objects(spark, tmp_path):
    (tmp_path / "d" / "e f").mkdir(parents=True)
    (tmp_path / "d" / "e f" / "a+b%.webp").write_bytes(b"123")
    (tmp_path / "d" / "c.webp").write_bytes(b"4")
    listed = {r.path: r.length for r in files.list_objects(spark, str(tmp_path), "/d/").collect()}
    assert listed == {"d/e f/a+b%.webp": 3, "d/c.webp": 1}
    names = spark.createDataFrame([(1, "d/e f/a+b%"), (2, "gone")], "id bigint, name string")
    got = {r.id: (bytes(r.content) if r.content is not None else None, r.error) for r in files.read_objects(spark, names, str(tmp_path)).collect()}
    assert got == {1: (b"123", None), 2: (None, "object not found")}
    for bad in ("a//b", "../x", ""):
        with pytest.raises(ValueError):
            files.normalize_prefix(bad)


def b64(text, pad=True):
    raw = base64.b64encode(text.encode()).decode()
    return raw if pad else raw.rstrip("=")


EVENT = {"bucket": "my", "action": "PutObject", "object": {"key": "post/photo 2", "size": 1}}
MESSAGES = [
    ({}, {"key": "post/photo 1"}, "convert", "post/photo 1"),
    ({}, EVENT, "convert", "post/photo 2"),
    ({}, EVENT | {"bucket": "other"}, "ignore", None),
    ({}, EVENT | {"bucket": 5}, "malformed", None),
    ({}, {"action": "DeleteObject", "object": {"key": "k"}}, "ignore", None),
    ({}, {"action": "LifecycleDeletion", "object": {"key": "k"}}, "ignore", None),
    ({}, {"action": "Unknown", "object": {"key": "k"}}, "malformed", None),
    ({}, {"object": {"key": 7}}, "malformed", None),
    ({}, {"object": {"key": "k"}}, "convert", "k"),
    ({}, '{"key":"post/photo 3"}', "convert", "post/photo 3"),
    ({}, "post/photo 4", "convert", "post/photo 4"),
    ({}, "post/photo 4 ", "convert", "post/photo 4 "),
    ({}, "　相册/照片", "convert", "　相册/照片"),
    ({}, "post//photo.jpg", "malformed", None),
    ({}, "/post/photo.jpg", "malformed", None),
    ({}, {"foo": "bar"}, "malformed", None),
    ({}, "", "malformed", None), ({}, 123, "malformed", None), ({}, None, "malformed", None), ({}, ["k"], "malformed", None),
    ({"CF-Content-Type": "json"}, b64('{"key":"album/photo 1"}'), "convert", "album/photo 1"),
    ({"CF-Content-Type": "json"}, b64('{"key":"album/photo 8"}', False), "convert", "album/photo 8"),
    ({"CF-Content-Type": "json"}, '{"key":"album/photo 8"}', "convert", "album/photo 8"),
    ({"CF-Content-Type": "json"}, '"album/photo 8"', "convert", "album/photo 8"),
    ({"CF-Content-Type": "json"}, "not base64!", "malformed", None),
    ({"CF-Content-Type": "json"}, "{broken", "malformed", None),
    ({"CF-Content-Type": "bytes"}, b64("album/photo 2"), "convert", "album/photo 2"),
    ({"CF-Content-Type": "bytes"}, {"key": "k"}, "malformed", None),
    ({"CF-Content-Type": "v8"}, "AAAA", "malformed", None),
    ({"contentType": "JSON"}, b64('{"key":"album/photo 8"}', False), "convert", "album/photo 8"),
    ({}, b64('{"key":"album/photo 8"}', False), "convert", "album/photo 8"),
    ({}, "album/photo 9", "convert", "album/photo 9"), ({}, "abcd", "convert", "abcd"),
    ({"content_type": "text"}, "album/photo 9", "convert", "album/photo 9"),
]


def test_object_events(spark):
    lines = [(json.dumps({"id": str(i), "attempts": i % 3, "metadata": m | {"n": 1}, "body": b}),) for i, (m, b, _, _) in enumerate(MESSAGES)]
    rows = files.object_event_columns(spark.createDataFrame(lines, "value string"))
    got = {int(r.id): (r.action, r.key) for r in events.classify_object_events(rows, "my").collect()}
    assert {i: got[i] for i in got if got[i] != MESSAGES[i][2:]} == {}
    assert len(got) == len(MESSAGES)


def test_event_stream_routes_to_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        lines = [json.dumps({"id": f"{i}-{j}", "attempts": i * 3, "metadata": {}, "body": b}) for j, b in enumerate(["a/b.jpg", "a/b.mp4", "a//b"])]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
    stream = files.read_object_events(spark, str(tmp_path / "in"), 1)
    query = sinks.route_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), max_attempts=5)
    assert query.awaitTermination(120)
    routes = {r.route: r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("route").agg(F.count("*").alias("n")).collect()}
    assert routes == {"work": 3, "done": 3, "retry": 2, "dead letter": 1}


def test_likes_stream(spark, tmp_path):
    ddl = "address string, kind string, target_id bigint, action string, created_at bigint, seq bigint"
    for i, part in enumerate([[("a", "post", 1, "add", 1, 1), ("a", "post", 2, "add", 2, 2)], [("a", "post", 1, "remove", 3, 3), ("a", "post", 2, "add", 4, 4)]]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = sinks.likes_stream(stream, str(tmp_path / "likes"), str(tmp_path / "ckpt"))
    assert query.awaitTermination(120)
    assert [tuple(r) for r in sinks.read_likes(spark, str(tmp_path / "likes")).collect()] == [("a", "post", 2, 2)]


def load_scorer():
    def score(rows):
        if any(bytes(r["content"]) == b"bad" for r in rows):
            raise RuntimeError("device lost")
        return [scoring.Scores([("tag", 0.5)], [1.0], [2.0]) for _ in rows]

    return score


def test_scoring_rounds(spark, tmp_path):
    root, store = tmp_path / "objects", str(tmp_path / "catalog")
    root.mkdir()
    for name, data in (("a", b"1"), ("b", b"2"), ("c", b"bad")):
        (root / f"{name}.webp").write_bytes(data)
    images = spark.createDataFrame(
        [(i, n, 1, 1, "pending", 0, None, None, None) for i, n in enumerate(["a", "b", "c", "gone"], 1)],
        empty_catalog(spark).images.schema)
    snapshots.write_catalog(empty_catalog(spark).with_(images=images), store, spark)

    def score(rows):
        return scoring.score_batches(files.read_objects(spark, rows, str(root)), load_scorer, 1)

    worked = sinks.run_scoring(
        lambda: snapshots.read_catalog(spark, store),
        lambda cat: snapshots.write_catalog(cat, store, spark, ["images", "wd_tags", "wd_tag_images"]), score, 2)
    cat = snapshots.read_catalog(spark, store)
    got = {r["name"]: (r.status, r.attempt) for r in cat.images.collect()}
    assert got == {"a": ("completed", 1), "b": ("completed", 1), "c": ("pending", 6), "gone": ("pending", 6)}
    assert worked >= 6 and cat.wd_tag_images.count() == 2 and cat.wd_tags.count() == 1


def test_alias_rule(spark):
    html = """<div id="content"><p>x <a class="wiki-other-name" href="/1">花 &amp; co</a>
      <a class="wiki-other-name-x"><b>two</b></a><a class="other">no</a></p>
      <p><i><a class="wiki-other-name">nested</a></i></p><div><p><a class="wiki-other-name">deep</a></p></div></div>
      <p><a class="wiki-other-name">outside</a></p>"""
    got = ingest.extract_aliases(spark.createDataFrame([("t", html), ("u", None)], "name string, html string")).collect()
    assert {r["name"]: r.translations for r in got} == {"t": ["花 & co", "two"], "u": []}


def test_requests(spark):
    form = "application/x-www-form-urlencoded"
    rows = [("GET", "/images/a", None, None), ("HEAD", "/videos", None, None), ("GET", "/imagesx", None, None),
            ("POST", "/api/search_similar", form, "q=a%20b"), ("POST", "/api/search_similar", form, "q=1&q=2"),
            ("POST", "/api/search_similar", form, "x"), ("POST", "/api/search_similar", "text/plain", "q=1"),
            ("POST", "/api/search_by_desc", form + "; charset=x", "&x=%zz&q=1"), ("POST", "/other", form, "q=1"), ("PUT", "/images/a", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, method string, path string, content_type string, body string")
    got = [(r.outcome, r.kind, r.key) for r in events.classify_requests(df).orderBy("i").collect()]
    assert got == [("metered", "image", "/images/a"), ("metered", "video", "/videos"), ("unmetered", None, None),
                   ("metered", "similar", "search:sim:a b"), ("bad request", None, None), ("bad request", None, None),
                   ("bad request", None, None), ("metered", "description", "search:desc:1"), ("unmetered", None, None), ("unmetered", None, None)]


def test_folders_mix_arrays_and_lines(spark, tmp_path):
    """Each file is read for what it is; text that is no record is reported, not turned into an empty record."""
    (tmp_path / "a.json").write_text('[\n {"title": "A", "authors": ["x"]},\n {"title": "B"}\n]')
    (tmp_path / "b.json").write_text('{"title": "C"}\n{"title": "D"}\n{broken\n{"title": "E"}\n')
    (tmp_path / "c.json").write_text('[{"title": "F"}]\n')
    got = files.read_metas(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.title for r in got] == ["A", "B", "C", "D", "E", "F"]
    assert [r.text for r in files.rejected_metas(spark, str(tmp_path)).collect()] == ["{broken"]
