"""Stored tables: staged intermediate results, versioned snapshots, JSON output.

There is no table format on the class path, so a snapshot is a new folder plus a
pointer file that is replaced in one rename. Readers follow the pointer; a job
that dies leaves an unreferenced folder behind and nothing else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.catalog import DDL, Catalog
from lumicat.session import checkpoint_dir

POINTER = "_CURRENT"


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared checkpoint folder and read
    them back. For results that several branches of a plan use; columns are
    pruned per branch and a lost executor rereads files. The folder goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _, fs, folder = _fs(spark, path)
    fs.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def current_version(spark: SparkSession, root: str) -> str | None:
    jvm, fs, pointer = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def swap_pointer(spark: SparkSession, root: str, version: str) -> None:
    """Make ``version`` current: write the pointer aside, then rename over the old one."""
    jvm, fs, aside = _fs(spark, f"{root}/{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(version.encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), options)


def write_catalog(cat: Catalog, root: str, spark: SparkSession, tables: list[str] | None = None) -> str:
    """Store a new snapshot of the catalog and make it current. Tables that did not
    change (not listed in ``tables``) keep pointing at their last version."""
    old = read_pointer(spark, root)
    version = uuid.uuid4().hex
    entries = dict(old)
    for name in tables or list(DDL):
        getattr(cat, name).write.parquet(f"{root}/{version}/{name}")
        entries[name] = version
    swap_pointer(spark, root, ",".join(f"{k}={v}" for k, v in sorted(entries.items())))
    return version


def read_pointer(spark: SparkSession, root: str) -> dict[str, str]:
    text = current_version(spark, root)
    return dict(part.split("=") for part in text.split(",")) if text else {}


def read_catalog(spark: SparkSession, root: str) -> Catalog:
    """The current snapshot; tables are opened on first use."""
    entries = read_pointer(spark, root)
    return Catalog(**{
        name: (lambda n=name, v=v: spark.read.schema(DDL[n]).parquet(f"{root}/{v}/{n}"))
        for name, v in entries.items()
    })


class Buckets:
    """A stored table cut into ``count`` buckets by the hash of its key. The pointer names the version of each bucket; a write stores new
    versions of the buckets that it touches and leaves the files of all others where they are. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, ddl: str, key: list[str], count: int = 64):
        self.spark, self.root, self.ddl, self.key, self.count = spark, root.rstrip("/"), ddl, key, count

    def of(self, *key: str | Column) -> Column:
        return F.pmod(F.xxhash64(*(key or self.key)), F.lit(self.count)).cast("int")

    def versions(self) -> dict[str, str]:
        """``b<bucket>``: version, and what writers have noted."""
        return read_pointer(self.spark, self.root)

    def touched(self, rows: DataFrame, *key: str | Column) -> list[int]:
        """The buckets that ``rows`` reach; at most ``count``."""
        return sorted(r[0] for r in rows.select(self.of(*key).alias("b")).distinct().collect())

    def read(self, only: list[int] | None = None) -> DataFrame:
        held = self.versions()
        wanted = range(self.count) if only is None else only
        paths = [f"{self.root}/{held[f'b{b}']}/__bucket={b}" for b in wanted if f"b{b}" in held]
        return self.spark.read.schema(self.ddl).parquet(*paths) if paths else self.spark.createDataFrame([], self.ddl)

    def replace(self, rows: DataFrame, touched: list[int], version: str, **notes: str) -> None:
        """Make ``rows`` the content of the touched buckets. A version that a dead writer has begun is written over."""
        where = f"{self.root}/{version}"
        rows.withColumn("__bucket", self.of()).repartition(max(1, len(touched)), "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(where)
        held = self.versions() | notes
        for b in touched:
            _, fs, path = _fs(self.spark, f"{where}/__bucket={b}")
            if fs.exists(path):
                held[f"b{b}"] = version
            else:
                held.pop(f"b{b}", None)  # nothing is left in it
        swap_pointer(self.spark, self.root, ",".join(f"{k}={v}" for k, v in sorted(held.items())))


def write_metas(metas: DataFrame, path: str) -> None:
    """Metadata records as JSON, one record per line."""
    metas.select("title", "authors", "tags", "images").write.mode("errorifexists").json(path)
