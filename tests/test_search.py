"""Search corner cases on a tiny catalog."""

import pytest

from lumicat.catalog import DDL, empty_catalog
from lumicat.operators import search
from lumicat.operators.paging import page
from lumicat.plans import dispatch
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def cat(spark):
    make = lambda name, rows: spark.createDataFrame(rows, DDL[name])
    images = [(i, f"i{i}", 10 * i, 5, "pending", 0, None, None, None) for i in range(1, 31)]
    return empty_catalog(spark).with_(
        posts=make("posts", [(1, "Blue Sky"), (2, "blue_sky"), (3, "sky"), (4, "100%")]),
        images=make("images", images),
        videos=make("videos", [(7, "v7", 1, 1, 60)]),
        authors=make("authors", [(1, "Ann"), (2, "Anna"), (3, "Bob")]),
        author_posts=make("author_posts", [(1, 1), (2, 1), (3, 2)]),
        post_images=make("post_images", [(1, i) for i in range(1, 26)] + [(2, 1), (2, 30)]),
        post_videos=make("post_videos", [(3, 7)]),
        wd_tags=make("wd_tags", [(1, "blue_sky"), (2, "sky"), (3, "rain"), (4, "blue sky high")]),
        wd_tag_translations=make("wd_tag_translations", [(3, "blue sky"), (3, "雨"), (2, "空")]),
        wd_tag_images=make("wd_tag_images", [(1, 1, 0.5), (3, 1, 0.9), (2, 2, 0.7), (4, 3, 0.9), (3, 4, 0.1)]),
    )


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_images_by_tag_joins_names_and_aliases(cat):
    assert ids(search.images_by_tag(cat, "  Blue Sky ", 10)) == [3, 1, 4]
    assert ids(search.images_by_tag(cat, "空", 10)) == [2]
    assert ids(search.images_by_tag(cat, "%", 10)) == []
    assert ids(search.images_by_tag(cat, "blue sky", 1, 1)) == [1]
    with pytest.raises(ValueError):
        search.images_by_tag(cat, "  ", 10)


def test_wildcards_are_live_for_posts_only(cat):
    assert ids(search.posts_by_title(cat, "blue_sky", 10)) == [2, 1]
    assert ids(search.posts_by_title(cat, "100\\%", 10)) == [4]


def test_a_post_counts_once_per_author(cat):
    assert ids(search.posts_by_author(cat, "ann", 10)) == [1, 1]
    assert ids(search.posts_by_author(cat, "ann", 10, distinct_posts=True)) == [1]


def test_suggestions(cat):
    got = search.suggest_tags(cat, "blue sky", 10).orderBy("rank").collect()
    assert [(r["name"], r.aliases) for r in got] == [
        ("rain", ["blue sky", "雨"]), ("blue_sky", []), ("blue sky high", [])]
    assert search.suggest_tags(cat, "   ").count() == 0
    assert [r["name"] for r in search.suggest_tags(cat, "空").collect()] == ["sky"]
    assert ids(search.suggest_authors(cat, "ann")) == [1, 2]
    assert ids(search.suggest_titles(cat, "sky")) == [3, 2, 1]


def test_batch_suggestions_equal_single_ones(spark, cat):
    asked = [(1, "tag", "blue sky"), (2, "tag", "sk"), (3, "author", "ann"), (4, "title", "SKY"), (5, "tag", "空"), (6, "clip", "sky"), (7, "tag", "sky"), (8, "title", "b")]
    got = {}
    for r in search.suggest(cat, spark.createDataFrame(asked, "query_id int, mode string, q string")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r["id"])
    one = {"tag": search.suggest_tags, "author": search.suggest_authors, "title": search.suggest_titles}
    want = {i: ids(one[m](cat, q)) for i, m, q in asked if m in one and (len(q) > 1 or not q.isascii())}
    assert got == want


def test_frequent_grams_are_dealt_over_parts(spark, cat, monkeypatch):
    asked = [(i, m, q) for i, (m, q) in enumerate([("tag", "blue sky"), ("tag", "sky"), ("author", "ann"), ("title", "SKY"), ("title", "e s"), ("tag", "空"), ("title", "nowhere")])]
    frame = spark.createDataFrame(asked, "query_id int, mode string, q string")
    plain = sorted(map(tuple, search.suggest(cat, frame).collect()))
    monkeypatch.setattr(search, "COUNTED", 1)
    monkeypatch.setattr(search, "HOT_GRAM", 1)
    assert plain and sorted(map(tuple, search.suggest(cat, frame).collect())) == plain


def test_nested_media_is_split_into_parts(spark, cat):
    posts = search.newest_posts(cat, 4)
    whole = {r.id: r for r in search.posts_with_media(cat, posts).collect()}
    assert [i.id for i in whole[1].images] == list(range(1, 26)) and whole[4].images == [] and [v.id for v in whole[3].videos] == [7]
    parts = [r for r in search.posts_with_media(cat, posts, 10).collect() if r.id == 1]
    assert len(parts) > 1 and sorted(i.id for r in parts for i in r.images) == list(range(1, 26))


def test_details(spark, cat):
    got = {r.id: (r.post_id, r.post_title) for r in search.image_details(cat).collect()}
    assert got[1] == (1, "Blue Sky") and got[30] == (2, "blue_sky") and got[29] == (None, None)
    one = search.nested_image_details(cat, spark.createDataFrame([(1,), (29,)], "id bigint")).orderBy("id").collect()
    assert [a["name"] for a in one[0].authors] == ["Ann", "Anna"] and [t.id for t in one[0].tags] == [3, 1]
    assert one[1].authors == [] and one[1].tags == []
    video = search.video_details(cat).first()
    assert (video.id, video.post_id) == (7, 3)


def test_previews_keep_posts_without_media(cat):
    got = {r.post_id: (r.image_id, r.image_count, r.video_count) for r in search.post_previews(cat).collect()}
    assert got == {1: (1, 25, 0), 2: (1, 2, 0), 3: (None, 0, 1), 4: (None, 0, 0)}


def test_offset_comes_before_limit(cat):
    assert [r.id for r in page(cat.posts, [F.col("id")], 2, 1).collect()] == [2, 3]
    with pytest.raises(ValueError):
        page(cat.posts, [F.col("id")], -1)


def test_dispatch(cat):
    assert ids(dispatch.search(cat, "odd mode", "")) == [4, 3, 2, 1]
    assert ids(dispatch.search(cat, "odd mode", "空")) == [2]
    assert dispatch.search(cat, "random", "x", seed=1, limit=5).count() > 0
    assert "width" in dispatch.search(cat, "random", "images", seed=1, limit=5).columns
    assert dispatch.search(cat, "clip", "words").count() == 0
    with pytest.raises(ValueError):
        dispatch.search(cat, "similar", "1")
