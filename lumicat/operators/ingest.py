"""From object listings to catalog metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.functions.paths import MAX_PIXELS, MAX_SOURCE_BYTES, folder_of, target_path
from lumicat.functions.text import WHITE_SPACE
from lumicat.operators.paging import page

c = F.col
RECORD_IMAGES = 1000


# ------------------------------------------------------------- listing to metas
def listing_images(df: DataFrame) -> DataFrame:
    """A10 as rows: (title, author, name, width, height) from (path, seq, width,
    height). The title is the folder, the author its first word; of several
    objects for one name the last wins."""
    key = target_path(c("path"))["key"]
    folder = folder_of(c("path"))
    rows = df.select(
        F.coalesce(folder, F.lit("/")).alias("title"),
        F.coalesce(F.when(folder.isNotNull(), F.regexp_extract(folder, f"([^{WHITE_SPACE}]+)", 1)), F.lit("Unknown")).alias("author"),
        key.alias("name"), "width", "height", "seq",
    )
    return rows.groupBy("title", "author", "name").agg(
        F.max_by(F.struct("width", "height"), c("seq")).alias("d"), F.min("seq").alias("seq")
    ).select("title", "author", "name", "d.width", "d.height", "seq")


def metas_from_listing(df: DataFrame, record_images: int = RECORD_IMAGES) -> DataFrame:
    """A10: metadata records. A folder with more images than ``record_images`` is
    spread over several records of the same title, which every merge takes as one
    post; so no record grows with the folder."""
    images = listing_images(df)
    sizes = images.groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(c("n") / record_images).cast("bigint")
    spread = images.join(sizes, "title").withColumn("part", F.pmod(F.xxhash64("name"), parts))
    records = spread.groupBy("title", "part", "author").agg(
        F.array_sort(F.collect_list(F.struct("seq", "name", "width", "height"))).alias("__i")
    )
    return records.select(
        F.struct("title", "part").alias("ord"), "title", F.array("author").alias("authors"),
        F.array().cast("array<string>").alias("tags"),
        F.transform("__i", lambda x: F.struct(x["name"].alias("name"), x["width"].alias("width"), x["height"].alias("height"))).alias("images"),
    )


# -------------------------------------------------------------------- planning
def same_identity(a: str, b: str) -> Column:
    """Whether two object structs (etag, modified, length) are the same object."""
    x, y = c(a), c(b)
    etags = x["etag"].isNotNull() & y["etag"].isNotNull() & (x["etag"] == y["etag"])
    neither = x["etag"].isNull() & y["etag"].isNull()
    times = x["modified"].isNotNull() & (x["modified"] == y["modified"])
    return F.coalesce((x["length"] == y["length"]) & (etags | (neither & times)), F.lit(False))


def plan_conversions(requested: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """P5: what to do with each requested path. ``sources`` is (path, etag),
    ``targets`` is (target, source_key, source_etag) of existing results.

    Outcomes: convert, unchanged, collision (the target belongs or will belong to
    another source), recovered (source gone, result there), missing.
    """
    wanted = requested.select("path").distinct().withColumn("__t", target_path(c("path"))).select(
        "path", c("__t.target").alias("target"), c("__t.key").alias("key")
    )
    rows = wanted.join(sources.select("path", F.struct("etag").alias("src")), "path", "left").join(
        targets.select("target", F.struct("source_key", "source_etag").alias("dst")), "target", "left"
    )
    first = rows.where(c("src").isNotNull()).groupBy("target").agg(F.min("path").alias("first"))
    rows = rows.join(first, "target", "left")
    owner = F.coalesce(c("dst.source_key"), F.when(c("src").isNotNull(), c("first")))
    collides = owner.isNotNull() & (owner != c("path"))
    outcome = (
        F.when(collides, "collision")
        .when(c("src").isNull() & c("dst").isNotNull(), "recovered")
        .when(c("src").isNull(), "missing")
        .when(c("dst.source_key").isNotNull() & (c("dst.source_etag") == c("src.etag")), "unchanged")
        .otherwise("convert")
    )
    return rows.select("path", "target", "key", outcome.alias("outcome"))


# ------------------------------------------------------------------ conversion
Codec = Callable[[bytes], tuple[bytes, int, int]]
CONVERTED_DDL = "path string, target string, key string, outcome string, width int, height int, content binary, error string"


def convert_objects(df: DataFrame, codec: Codec) -> DataFrame:
    """Run a codec over (path, content). One broken object fails its own row;
    objects beyond the size or pixel limit are refused."""
    def convert(content: bytes | None) -> dict:
        try:
            if content is None:
                raise ValueError("source_missing")
            if len(content) > MAX_SOURCE_BYTES:
                raise ValueError("source_too_large")
            data, width, height = codec(content)
            if width <= 0 or height <= 0:
                raise ValueError("no_pixels")
            if width * height > MAX_PIXELS:
                raise ValueError(f"too_many_pixels {width}x{height}")
            return {"outcome": "converted", "content": data, "width": width, "height": height}
        except Exception as exc:  # noqa: BLE001 - any codec error belongs to its row
            return {"outcome": "failed", "error": str(exc)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # one object at a time bounds the memory
                made = convert(row["content"])
                yield pa.RecordBatch.from_pylist(
                    [{**{k: row[k] for k in ("path", "target", "key")}, **made}], schema=schema
                )

    schema = pa.schema([
        ("path", pa.string()), ("target", pa.string()), ("key", pa.string()), ("outcome", pa.string()),
        ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary()), ("error", pa.string()),
    ])
    t = target_path(c("path"))
    rows = df.select("path", t["target"].alias("target"), t["key"].alias("key"), "content")
    return rows.mapInArrow(run, CONVERTED_DDL)


def scan_summary(results: DataFrame) -> DataFrame:
    """Counts and the first three failing keys with their cause."""
    failed = c("outcome") == "failed"
    counts = results.agg(
        F.count_if(c("outcome") == "converted").alias("converted"), F.count_if(failed).alias("failed")
    )
    shown = page(results.where(failed).select("path", "error"), [c("path"), c("error")], 3)
    examples = shown.agg(F.array_sort(F.collect_list(F.concat_ws(": ", "path", "error"))).alias("examples"))
    return counts.join(examples)


def write_stats(results: DataFrame, batch: str = "batch") -> DataFrame:
    """Completed and failed items per write."""
    return results.groupBy(batch).agg(
        F.count_if(c("error").isNull()).alias("completed"), F.count_if(c("error").isNotNull()).alias("failed")
    )


# -------------------------------------------------------------- alias harvesting
@dataclass(frozen=True)
class AnchorRule:
    """Anchors whose enclosing elements are, from outer to inner, ``parents`` of
    (tag, id), NULL for any, and whose class starts with ``class_prefix``."""

    parents: tuple[tuple[str | None, str | None], ...] = ((None, "content"), ("p", None))
    class_prefix: str = "wiki-other-name"


VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "wbr"}
CLOSES_P = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "article", "section", "nav", "form"}


class _Anchors(HTMLParser):
    def __init__(self, rule: AnchorRule):
        super().__init__(convert_charrefs=True)
        self.rule, self.stack, self.open, self.found = rule, [], None, []

    def _close(self, tag):
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and self.stack and self.stack[-1][0] == "p":
            self._close("p")
        if tag == "a" and self.open is None:
            values = dict(attrs)
            near = self.stack[-len(self.rule.parents):] if self.rule.parents else []
            fits = len(near) == len(self.rule.parents) and all(
                (t is None or t == tag_) and (i is None or i == id_)
                for (t, i), (tag_, id_) in zip(self.rule.parents, near)
            )
            if fits and (values.get("class") or "").startswith(self.rule.class_prefix):
                self.open = []
        if tag not in VOID:
            self.stack.append((tag, dict(attrs).get("id")))

    def handle_endtag(self, tag):
        if tag == "a" and self.open is not None:
            self.found.append("".join(self.open))
            self.open = None
        self._close(tag)

    def handle_data(self, data):
        if self.open is not None:
            self.open.append(data)


def extract_aliases(pages: DataFrame, rule: AnchorRule = AnchorRule(), key: str = "name") -> DataFrame:
    """(key, translations) from (key, html): the texts of the matching anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html in batch.column(1).to_pylist():
                parser = _Anchors(rule)
                parser.feed(html or "")
                parser.close()
                texts.append(parser.found)
            yield pa.record_batch(
                [batch.column(0), pa.array(texts, pa.list_(pa.string()))], names=[key, "translations"]
            )

    kind = dict(pages.dtypes)[key]
    return pages.select(key, "html").mapInArrow(run, f"{key} {kind}, translations array<string>")


def untranslated(vocabulary: DataFrame, translations: DataFrame) -> DataFrame:
    """Vocabulary entries without a translation record."""
    return vocabulary.join(translations.select("name"), "name", "left_anti")
