"""Merges: idempotence, last write wins, constraints; and the metadata job."""

import pytest
from pyspark.sql import functions as F

from lumicat.catalog import META_DDL, empty_catalog
from lumicat.operators import ingest, likes, merge, quality
from lumicat.plans.ingest_job import ingest_metas
from lumicat.sources import snapshots

c = F.col


def metas(spark, rows):
    return spark.createDataFrame(rows, META_DDL)


BATCH = [
    (0, "One", ["ann", " "], ["red", "blue"], [("a", 1, 2), ("b", 3, 4), ("a", 9, 9)]),
    (1, "Two", ["bob", "ann"], ["red"], [("b", 5, 6)]),
    (2, "  ", ["eve"], [], [("c", 1, 1), (" ", 1, 1)]),
]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_metadata_merge_is_idempotent(spark):
    once = merge.merge_metas(empty_catalog(spark), metas(spark, BATCH))
    assert rows(once.posts, "title") == [("One",), ("Two",)]
    assert rows(once.authors, "name") == [("ann",), ("bob",), ("eve",)]
    assert rows(once.images, "name", "width", "height", "status") == [
        ("a", 9, 9, "pending"), ("b", 5, 6, "pending"), ("c", 1, 1, "pending")]
    assert once.post_images.count() == 3 and once.author_posts.count() == 3 and once.tag_posts.count() == 3
    for name in ("posts", "images", "authors", "tags"):
        table = getattr(once, name)
        assert sorted(r.id for r in table.collect()) == list(range(1, table.count() + 1))
    twice = merge.merge_metas(once, metas(spark, BATCH))
    for name in ("posts", "authors", "tags", "post_images", "author_posts", "tag_posts"):
        assert sorted(map(tuple, getattr(twice, name).collect())) == sorted(map(tuple, getattr(once, name).collect()))
    assert rows(twice.images, "id", "name", "width") == rows(once.images, "id", "name", "width")


def test_stored_snapshots(spark, tmp_path):
    root = str(tmp_path / "catalog")
    snapshots.write_catalog(empty_catalog(spark), root, spark)
    ingest_metas(spark, root, metas(spark, BATCH))
    ingest_metas(spark, root, metas(spark, [(0, "Three", ["ann"], [], [("a", 7, 7)])]))
    cat = snapshots.read_catalog(spark, root)
    assert rows(cat.posts, "title") == [("One",), ("Three",), ("Two",)]
    assert ("a", 7) in rows(cat.images, "name", "width")
    assert cat.author_posts.count() == 4 and cat.videos.count() == 0


def test_scores_reject_a_repeated_pair(spark):
    tags = spark.createDataFrame([(1, "x")], "id bigint, name string")
    old = spark.createDataFrame([(1, 5, 0.25), (9, 5, 0.5)], "wd_tag_id bigint, image_id bigint, score float")
    fresh = spark.createDataFrame([(5, "x", 0.75), (6, "x", 1.0), (6, "unknown", 1.0)], "image_id bigint, name string, score float")
    got = rows(merge.merge_scores(old, tags, fresh), "wd_tag_id", "image_id", "score")
    assert got == [(1, 5, 0.75), (1, 6, 1.0), (9, 5, 0.5)]
    with pytest.raises(Exception, match="twice"):
        merge.merge_scores(old, tags, fresh.union(fresh)).collect()


def test_translations_are_trimmed(spark):
    tags = spark.createDataFrame([(1, "x")], "id bigint, name string")
    old = spark.createDataFrame([(1, "y")], "tag_id bigint, translation string")
    new = spark.createDataFrame([("x", [" y ", "z", "", "z"]), ("q", ["w"])], "name string, translations array<string>")
    once = merge.merge_translations(old, tags, new)
    assert rows(once, "translation") == [("y",), ("z",)]
    assert rows(merge.merge_translations(once, tags, new), "translation") == [("y",), ("z",)]


def test_large_folders_are_spread_over_records(spark):
    listing = spark.createDataFrame(
        [(f"Big Folder/p{i}.png", i, i + 1, 5) for i in range(50)] + [("root.jpg", 99, 1, 1), ("Big Folder/p3.jpg", 100, 77, 7)],
        "path string, seq bigint, width int, height int")
    got = ingest.metas_from_listing(listing, 10).collect()
    big = [r for r in got if r.title == "Big Folder"]
    assert len(big) > 1 and {tuple(r.authors) for r in big} == {("Big",)}
    dims = {i.name: i.width for r in big for i in r.images}
    assert len(dims) == 50 and dims["Big Folder/p3"] == 77
    assert [(r.title, r.authors) for r in got if r.title == "/"] == [("/", ["Unknown"])]


def test_like_log_order(spark):
    ddl = "address string, kind string, target_id bigint, action string, created_at bigint, seq bigint"
    log = [("a", "post", 1, "add", 10, 1), ("a", "post", 1, "add", 20, 2), ("a", "post", 2, "add", 10, 3),
           ("a", "post", 2, "remove", 10, 4), ("a", "post", 3, "remove", 5, 5), ("a", "post", 3, "add", 5, 6)]
    old = spark.createDataFrame([("a", "post", 1, 5), ("a", "post", 3, 1), ("b", "post", 1, 9)], "address string, kind string, target_id bigint, created_at bigint")
    got = rows(likes.apply_like_log(old, spark.createDataFrame(log, ddl)), "address", "target_id", "created_at")
    assert got == [("a", 1, 5), ("a", 3, 5), ("b", 1, 9)]


def test_keyset_cursor_only_on_full_pages(spark):
    table = spark.createDataFrame([("a", "image", i, 10 * i) for i in (1, 2, 3)], "address string, kind string, target_id bigint, created_at bigint")
    cursor = lambda n: {r.next_cursor for r in likes.likes_page(table, n).collect()}
    assert cursor(4) == {None} and cursor(3) == {10} and cursor(2) == {20}
    assert [r.target_id for r in likes.likes_page(table, 2, cursor=20).collect()] == [1]


def test_checks(spark):
    df = spark.createDataFrame([(1, "ok", 5, 5, "pending"), (2, " ", 0, 5, "odd"), (3, None, 1, 1, "pending")],
                               "id bigint, name string, width int, height int, status string")
    good, bad = quality.check_rows(df, quality.image_rules())
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.failures for r in bad.collect()} == {2: ["name_blank", "width", "status"], 3: ["name_blank", "name_long"]}
    assert quality.check_unique(df.select("width"), ["width"]).count() == 0


def test_walking_all_pages_gives_the_whole_table(spark):
    """Rows of one second at a page edge are not lost."""
    table = spark.createDataFrame([("a", k, i, 7 + i // 5) for k in ("image", "post") for i in range(8)], "address string, kind string, target_id bigint, created_at bigint")
    seen, cursor = [], None
    while True:
        page = likes.likes_page(table, 3, cursor=cursor).orderBy("rank").collect()
        seen += [(r.kind, r.target_id) for r in page]
        if not page or page[0].next_cursor is None:
            break
        cursor = (page[0].next_cursor, page[0].next_kind, page[0].next_target_id)
    assert len(seen) == 16 and sorted(seen) == sorted((r.kind, r.target_id) for r in table.collect())


def test_adjustments_of_any_size(spark):
    from lumicat.operators import billing

    given = [(-(1 << 63), "r"), ((1 << 63) - 1, "r"), (-1_000_000_000, "r"), (1_000_000_001, "r"), (0, "r"), (None, "r"), (5, " ")]
    got = billing.valid_adjustments(spark.createDataFrame(given, "points bigint, reason string"))
    assert [r.points for r in got.collect()] == [-1_000_000_000]
