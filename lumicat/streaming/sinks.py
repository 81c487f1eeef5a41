"""Streaming jobs with idempotent sinks.

A batch writes below its own batch id and then becomes current in one rename, so
a batch that is run again after a crash replaces itself and is applied once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumicat.catalog import Catalog
from lumicat.operators.events import classify_object_events, route_events
from lumicat.operators.likes import apply_like_log
from lumicat.operators.merge import merge_names, merge_scores
from lumicat.operators.scoring import claim_work, record_results
from lumicat.sources.snapshots import Buckets, stage

c = F.col
BUCKETS = 64
LIKES_DDL = "address string, kind string, target_id bigint, created_at bigint"


def _trigger(drain: bool, seconds: int) -> dict:
    """Stop when the input is drained, or keep polling."""
    return {"availableNow": True} if drain else {"processingTime": f"{seconds} seconds"}


def write_stream(df: DataFrame, path: str, checkpoint: str, drain: bool = True, seconds: int = 3) -> StreamingQuery:
    """Append a stream to files; results are stored before the input counts as
    read, and the file sink's log makes a repeated batch harmless."""
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(drain, seconds)).start()
    )


def route_stream(events: DataFrame, root: str, checkpoint: str, bucket: str | None = None,
                 max_attempts: int = 5, drain: bool = True, seconds: int = 3) -> StreamingQuery:
    """H3: classify object events and write each route below its batch id. A batch
    is written once and then split by partition folders."""
    def store(batch: DataFrame, batch_id: int) -> None:
        routed = route_events(classify_object_events(batch, bucket), max_attempts)
        routed.drop("metadata").write.mode("overwrite").partitionBy("route").parquet(f"{root}/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(drain, seconds)).start()
    )


def _likes(spark: SparkSession, root: str, buckets: int) -> Buckets:
    return Buckets(spark, root, LIKES_DDL, ["address", "kind", "target_id"], buckets)


def likes_stream(log: DataFrame, root: str, checkpoint: str, drain: bool = True, seconds: int = 3, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the favourites table current from a stream of adds and removes. A batch rewrites the buckets that its keys lie in;
    the pointer says which batch was the last."""
    def store(batch: DataFrame, batch_id: int) -> None:
        table = _likes(batch.sparkSession, root, buckets)
        if int(table.versions().get("batch", -1)) >= batch_id:
            return  # applied before the crash
        touched = table.touched(batch)
        if touched:
            table.replace(apply_like_log(table.read(touched), batch), touched, str(batch_id), batch=str(batch_id))

    return (
        log.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(drain, seconds)).start()
    )


def read_likes(spark: SparkSession, root: str, buckets: int = BUCKETS) -> DataFrame:
    """The current favourites."""
    return _likes(spark, root, buckets).read()


WORK_DDL = "id bigint, name string, width int, height int, status string, attempt int, claimed_at timestamp"
VECTOR_DDL = "id bigint, clip array<float>, dinov3 array<float>"
SCORE_DDL = "wd_tag_id bigint, image_id bigint, score float"
TAG_DDL = "id bigint, name string"


class ScoringTables:
    """The images' work state, their vectors, tag names and scores, stored apart and in buckets by image. A claim writes
    work state alone; results write the buckets of the images they are for. The state comes last, so a job that dies
    before has its work claimed again and merges it once more."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.work = Buckets(spark, f"{root}/work", WORK_DDL, ["id"], buckets)
        self.vectors = Buckets(spark, f"{root}/vectors", VECTOR_DDL, ["id"], buckets)
        self.scores = Buckets(spark, f"{root}/scores", SCORE_DDL, ["image_id"], buckets)
        self.tags = Buckets(spark, f"{root}/tags", TAG_DDL, ["name"], 1)

    def begin(self, cat: Catalog) -> None:
        """Store a catalog's images, vectors, tag names and scores."""
        names = [part.split()[0] for part in WORK_DDL.split(", ")]
        every = list(range(self.work.count))
        if "clip" in cat.images.columns:
            self.vectors.replace(cat.images.select("id", "clip", "dinov3").where("clip IS NOT NULL OR dinov3 IS NOT NULL"), every, _version())
        self.scores.replace(cat.wd_tag_images.select("wd_tag_id", "image_id", "score"), every, _version())
        self.tags.replace(cat.wd_tags.select("id", "name"), [0], _version())
        self.work.replace(cat.images.select(*names), every, _version())

    def claim(self, n: int, ttl: int) -> DataFrame:
        """id and name of up to ``n`` images, marked as in work."""
        now = F.timestamp_seconds(F.lit(int(time.time())))
        state = self.work.read()
        claimed = stage(claim_work(state, n, ttl, now)[0].select("id", "name"))
        touched = self.work.touched(claimed)
        if touched:
            hit = F.coalesce(c("__mine"), F.lit(False))
            marked = self.work.read(touched).join(claimed.select("id", F.lit(True).alias("__mine")), "id", "left").select(
                "id", "name", "width", "height", F.when(hit, "processing").otherwise(c("status")).alias("status"),
                F.when(hit, c("attempt") + 1).otherwise(c("attempt")).cast("int").alias("attempt"), F.when(hit, now).otherwise(c("claimed_at")).alias("claimed_at"))
            self.work.replace(marked, touched, _version())
        return claimed

    def record(self, results: DataFrame) -> None:
        """P4 on buckets: new tag names, scores, vectors, and last the state of done and failed images."""
        results = stage(results)
        done, failed = results.where(c("error").isNull()), results.where(c("error").isNotNull())
        preds = stage(done.select(c("id").alias("image_id"), F.inline("tags")))
        known = self.tags.read()
        if not preds.join(known, "name", "left_anti").isEmpty():
            self.tags.replace(merge_names(known, preds), [0], _version())
        touched = self.scores.touched(preds, "image_id")
        if touched:
            self.scores.replace(merge_scores(self.scores.read(touched), self.tags.read(), preds), touched, _version())
        touched = self.vectors.touched(done)
        if touched:
            new = done.select("id", "clip", "dinov3")
            kept = self.vectors.read(touched).join(new.select("id"), "id", "left_anti")
            self.vectors.replace(kept.unionByName(new), touched, _version())
        touched = self.work.touched(results)
        if touched:
            outcome = results.select("id", F.when(c("error").isNull(), "completed").otherwise("pending").alias("__now"))
            state = self.work.read(touched).join(outcome, "id", "left").withColumn("status", F.coalesce("__now", "status")).drop("__now")
            self.work.replace(state.select(*[part.split()[0] for part in WORK_DDL.split(", ")]), touched, _version())

    def run(self, score: Callable[[DataFrame], DataFrame], n: int, ttl: int = 1800, rounds: int | None = None) -> int:
        """Rounds of claim, score and record until nothing is left to claim; returns how many had work."""
        done = 0
        while rounds is None or done < rounds:
            claimed = self.claim(n, ttl)
            if claimed.isEmpty():
                break
            self.record(score(claimed))
            done += 1
        return done

    def images(self) -> DataFrame:
        """All images with their vectors, as in the catalog."""
        return self.work.read().join(self.vectors.read(), "id", "left")


def _version() -> str:
    return uuid.uuid4().hex


def run_scoring(load: Callable[[], Catalog], store: Callable[[Catalog], None],
                score: Callable[[DataFrame], DataFrame], n: int, ttl: int = 1800,
                stop_when_empty: bool = True, wait: float = 3.0, rounds: int | None = None) -> int:
    """Claim, score and record rounds of up to ``n`` images until none are
    left. Each round is one distributed job per step; the claim is stored before
    scoring starts, so work of a job that dies is claimed again after ``ttl``.
    Returns how many rounds had work."""
    done = 0
    while rounds is None or done < rounds:
        cat = load()
        now = F.timestamp_seconds(F.lit(int(time.time())))
        claimed, images = claim_work(cat.images, n, ttl, now)
        if claimed.isEmpty():
            if stop_when_empty:
                return done
            time.sleep(wait)
            continue
        store(cat.with_(images=images))
        mine = load().images.where(c("status") == "processing").join(claimed.select("id"), "id", "left_semi")
        store(record_results(load(), score(mine.select("id", "name"))))
        done += 1
    return done
