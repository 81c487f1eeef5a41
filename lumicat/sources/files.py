"""Metadata, vocabularies, object listings and logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
META_FILE_DDL = (
    "title string, authors array<string>, cosplayers array<string>, characters array<string>, "
    "tags array<string>, images array<struct<name:string,width:int,height:int>>"
)
ACCESS_DDL = (
    "event_id bigint, ts timestamp, principal string, method string, path string, "
    "content_type string, body string"
)


def _ordinal() -> Column:
    """A place for each record that grows along each file. It orders the records
    of a merge: file name first, position inside the file second."""
    return F.struct(
        c("_metadata.file_path"), c("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")
    )


REJECT = "_reject"


def _records(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """``ord``, ``record`` of all files, whichever way each is written: one JSON array, or one record per line. A file that has a
    line which begins with a bracket is an array, as records are objects. Text that is no record is in ``record._reject``."""
    kind = f"struct<{', '.join(x.replace(' ', ':', 1) for x in ddl.split(', '))}, {REJECT}:string>"
    given = spark.read.text(path)
    arrays = [r[0] for r in given.where(F.ltrim("value").startswith("[")).select(c("_metadata.file_path")).distinct().collect()]  # file names only
    is_array = c("_metadata.file_path").isin(arrays)
    lines = given.where(~is_array & (F.trim("value") != "")).select(
        _ordinal().alias("ord"), F.from_json("value", kind, {"columnNameOfCorruptRecord": REJECT}).alias("record"))
    whole = spark.read.text(path, wholetext=True).where(is_array).select(
        c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("start"), "value", F.from_json("value", f"array<{kind}>").alias("all"))
    broken = F.array(F.from_json(F.to_json(F.struct(c("value").alias(REJECT))), kind))
    items = whole.select("file", "start", F.posexplode(F.coalesce("all", broken)).alias("n", "record"))
    items = items.select(F.struct(c("file").alias("file_path"), c("start").alias("file_block_start"), c("n").cast("long").alias("n")).alias("ord"), "record")
    return lines.unionByName(items) if arrays else lines


def read_metas(spark: SparkSession, path: str) -> DataFrame:
    """Catalog metadata, files of JSON arrays and files of one record per line in any mix. ``cosplayers``
    replace ``authors``, ``characters`` come before ``tags``. What can't be read is in ``rejected_metas``."""
    raw = _records(spark, path, META_FILE_DDL).select("ord", "record.*").where(c(REJECT).isNull())
    none = F.array().cast("array<string>")
    return raw.select(
        "ord",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("cosplayers", "authors", none).alias("authors"),
        F.concat(F.coalesce("characters", none), F.coalesce("tags", none)).alias("tags"),
        F.coalesce("images", F.array().cast("array<struct<name:string,width:int,height:int>>")).alias("images"),
    )


def rejected_metas(spark: SparkSession, path: str) -> DataFrame:
    """The texts in metadata files that are no records."""
    return _records(spark, path, META_FILE_DDL).select("ord", c(f"record.{REJECT}").alias("text")).where("text IS NOT NULL")


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """(name, translations) out of files of either kind."""
    rows = _records(spark, path, "name string, translations array<string>").select("record.*").where(c(REJECT).isNull()).drop(REJECT)
    return rows.withColumn("translations", F.coalesce("translations", F.array().cast("array<string>")))


def read_vocabulary(spark: SparkSession, path: str, expected: int) -> list[tuple[str, bool]]:
    """S3: (name, is_character) per model output. The file is a model's fixed list,
    read in file order; another number of rows than the model's is an error."""
    lines = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(lines) != 1:
        raise ValueError("a vocabulary is exactly one file")
    import csv
    import io

    rows = list(csv.reader(io.StringIO(lines[0]["value"])))[1:]
    if len(rows) != expected:
        raise ValueError(f"expected {expected} tags, found {len(rows)}")
    pick = lambda row, i: row[i] if len(row) > i else ""
    return [(pick(row, 1), pick(row, 2) == "4") for row in rows]


def vocabulary_table(spark: SparkSession, vocabulary: list[tuple[str, bool]]) -> DataFrame:
    rows = [(i, name, char) for i, (name, char) in enumerate(vocabulary)]
    return spark.createDataFrame(rows, "tag_index int, name string, is_character boolean")


def normalize_prefix(prefix: str) -> str:
    """A folder to scan, without outer slashes; ``/`` is the root."""
    if prefix == "/":
        return ""
    folder = prefix.removeprefix("/").removesuffix("/")
    if "\0" in folder or any(s in ("", ".", "..") for s in folder.split("/")):
        raise ValueError(f"not a folder prefix: {prefix!r}")
    return folder


def _objects(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    folder = normalize_prefix(prefix)
    base = f"{root.rstrip('/')}/{folder}" if folder else root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    plain = root.rstrip("/").split("://")[-1].removeprefix("file:")
    key = F.expr(f"substring(path, instr(path, {_quoted(plain + '/')}) + {len(plain) + 1})")
    return files.withColumn("key", F.coalesce(F.try_url_decode(F.regexp_replace(key, r"\+", "%2B")), key))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def list_objects(spark: SparkSession, root: str, prefix: str = "/") -> DataFrame:
    """(path, length, modified) of all files below a prefix; contents are not read.
    Spark's file sources pass over empty files, which no step could use either."""
    rows = _objects(spark, root, prefix)
    return rows.select(c("key").alias("path"), "length", c("modificationTime").alias("modified"))


def read_objects(spark: SparkSession, names: DataFrame, root: str, suffix: str = ".webp") -> DataFrame:
    """Adds ``content`` to (id, name); a missing object leaves it NULL and is
    reported in ``error``, the job goes on. The file system comes from the URL."""
    files = _objects(spark, root, "/").select("key", "content")
    wanted = names.withColumn("key", F.concat("name", F.lit(suffix)))
    return wanted.join(files, "key", "left").drop("key").withColumn(
        "error", F.when(c("content").isNull(), "object not found")
    )


EVENT_LINE = T.StructType([T.StructField("value", T.StringType())])


def object_event_columns(lines: DataFrame) -> DataFrame:
    """Messages out of JSON lines: id, attempts, metadata and the body as JSON text,
    so that a text body and an object body stay apart."""
    v = F.try_parse_json(c("value"))
    return lines.select(
        F.try_variant_get(v, "$.id", "string").alias("id"),
        F.coalesce(F.try_variant_get(v, "$.attempts", "int"), F.lit(0)).alias("attempts"),
        F.try_variant_get(v, "$.metadata", "map<string,variant>").alias("__m"),
        F.to_json(F.try_variant_get(v, "$.body", "variant")).alias("body"),
    ).select(
        "id", "attempts",
        F.transform_values("__m", lambda k, x: F.try_variant_get(x, "$", "string")).alias("metadata"),
        "body",
    )


def read_object_events(spark: SparkSession, path: str, batch_files: int = 100) -> DataFrame:
    """Stream of object events; the checkpoint of the query replaces leases."""
    lines = spark.readStream.schema(EVENT_LINE).option("maxFilesPerTrigger", batch_files).text(path)
    return object_event_columns(lines)


def read_access_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Access log rows, as a table or as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ACCESS_DDL).json(path)
