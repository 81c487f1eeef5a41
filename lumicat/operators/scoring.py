"""Batch scoring of catalog images with pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.catalog import Catalog
from lumicat.operators.merge import complete_images, merge_names, merge_scores, reset_failed
from lumicat.operators.paging import BROADCAST_ROWS, bounded, first_rows, page
from lumicat.sources.snapshots import stage

c = F.col
MAX_ATTEMPT = 5  # checked before the claim counts it


def claim_work(images: DataFrame, n: int, ttl: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(claimed id and name, new snapshot). Pending images come first, then
    images stuck in processing for more than ``ttl`` seconds; at most ``n``.
    A snapshot has one writer, which replaces row locks."""
    live = c("attempt") <= MAX_ATTEMPT
    stuck = (c("status") == "processing") & (c("claimed_at") < now - F.make_interval(secs=F.lit(float(ttl))))
    priority = F.when(live & (c("status") == "pending"), 0).when(live & stuck, 1)
    ready = images.withColumn("priority", priority).where(c("priority").isNotNull())
    waiting = ready.select("priority", "id", "name")
    # a large page is cut by a filter, not by a sort of its rows in one task
    claimed = page(waiting, [c("priority"), c("id")], n) if n <= BROADCAST_ROWS else first_rows(waiting, "priority", "id", n)
    mark = bounded(claimed.select("id", F.lit(True).alias("__mine")), n)
    hit = F.coalesce("__mine", F.lit(False))
    value = {
        "status": F.when(hit, "processing").otherwise(c("status")),
        "attempt": F.when(hit, c("attempt") + 1).otherwise(c("attempt")).cast("int"),
        "claimed_at": F.when(hit, now).otherwise(c("claimed_at")),
    }
    rows = images.join(mark, "id", "left")
    return claimed.select("id", "name", "priority"), rows.select(
        *[value.get(x, c(x)).alias(x) for x in images.columns]
    )


# ------------------------------------------------------------------ preparation
@dataclass(frozen=True)
class InputSpec:
    """How one model wants its pictures. ``letterbox`` keeps the aspect on black and
    gives HWC in BGR; otherwise the picture is stretched to normalised CHW."""

    size: int
    letterbox: bool = False
    mean: tuple[float, float, float] = (0.0, 0.0, 0.0)
    std: tuple[float, float, float] = (1.0, 1.0, 1.0)


# fixed values: inputs of the three models
TAGGER_INPUT = InputSpec(448, letterbox=True)
TEXT_IMAGE_INPUT = InputSpec(384, mean=(0.5, 0.5, 0.5), std=(0.5, 0.5, 0.5))
IMAGE_INPUT = InputSpec(256, mean=(0.485, 0.456, 0.406), std=(0.229, 0.224, 0.225))

Decoder = Callable[[bytes], np.ndarray]  # to height x width x 3, RGB, uint8
Resizer = Callable[[np.ndarray, int, int], np.ndarray]  # (picture, width, height)


def nearest(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """A plain resizer; production jobs plug in the one the models were trained with."""
    rows = np.minimum(np.arange(height) * picture.shape[0] // height, picture.shape[0] - 1)
    cols = np.minimum(np.arange(width) * picture.shape[1] // width, picture.shape[1] - 1)
    return picture[rows][:, cols]


def to_tensor(picture: np.ndarray, spec: InputSpec, resize: Resizer = nearest) -> np.ndarray:
    size = spec.size
    if not spec.letterbox:
        stretched = resize(picture, size, size).astype("float64") / 255.0
        return ((stretched - spec.mean) / spec.std).transpose(2, 0, 1).astype("float32")
    height, width = picture.shape[:2]
    scale = min(size / width, size / height)
    new_w, new_h = max(1, round(width * scale)), max(1, round(height * scale))
    left, top = (size - new_w) // 2, (size - new_h) // 2
    out = np.zeros((size, size, 3), "uint8")
    out[top:top + new_h, left:left + new_w] = resize(picture, new_w, new_h)
    return out[:, :, ::-1].astype("float32")


def prepare_inputs(df: DataFrame, specs: dict[str, InputSpec], decoder: Decoder,
                   resize: Resizer = nearest) -> DataFrame:
    """(id, one tensor column per spec, error) from (id, content)."""
    schema = pa.schema([("id", pa.int64()), *[(n, pa.list_(pa.float32())) for n in specs], ("error", pa.string())])

    def one(ident: int, content: bytes | None) -> dict:
        try:
            if content is None:
                raise ValueError("object not found")
            picture = decoder(content)
            return {"id": ident, **{n: to_tensor(picture, s, resize).ravel().tolist() for n, s in specs.items()}}
        except Exception as exc:  # noqa: BLE001 - a broken picture fails its own row
            return {"id": ident, "error": str(exc)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([one(row["id"], row["content"])], schema=schema)

    columns = ", ".join(f"{n} array<float>" for n in specs)
    return df.select(c("id").cast("bigint"), "content").mapInArrow(run, f"id bigint, {columns}, error string")


# ---------------------------------------------------------------------- scoring
@dataclass
class Scores:
    tags: list[tuple[str, float]]
    clip: list[float]
    dinov3: list[float]


Scorer = Callable[[list[dict]], list[Scores]]
RESULT_DDL = "id bigint, tags array<struct<name:string,score:float>>, clip array<float>, dinov3 array<float>, error string"
_MODELS: dict[str, Scorer] = {}


def loaded(load: Callable[[], Scorer], model_key: str | None) -> Scorer:
    """The scorer of this worker process; with a key it stays loaded between tasks."""
    if model_key is None:
        return load()
    if model_key not in _MODELS:
        _MODELS[model_key] = load()
    return _MODELS[model_key]


def score_batches(df: DataFrame, load: Callable[[], Scorer], batch_size: int = 4,
                  model_key: str | None = None) -> DataFrame:
    """Score rows in batches of ``batch_size``. ``load`` builds the scorer, once
    per worker process where ``model_key`` names the model. Rows that arrive with an ``error`` skip the scorer; a batch
    that fails fails all its rows."""
    schema = pa.schema([
        ("id", pa.int64()), ("tags", pa.list_(pa.struct([("name", pa.string()), ("score", pa.float32())]))),
        ("clip", pa.list_(pa.float32())), ("dinov3", pa.list_(pa.float32())), ("error", pa.string()),
    ])

    def score(rows: list[dict], scorer: Scorer) -> list[dict]:
        try:
            made = scorer(rows)
            if len(made) != len(rows):
                raise ValueError("the scorer answered another number of rows")
            return [
                {"id": r["id"], "tags": [{"name": n, "score": s} for n, s in m.tags], "clip": m.clip, "dinov3": m.dinov3}
                for r, m in zip(rows, made)
            ]
        except Exception as exc:  # noqa: BLE001 - reported per row
            return [{"id": r["id"], "error": str(exc)} for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = loaded(load, model_key)
        waiting: list[dict] = []
        for batch in batches:
            rows = batch.to_pylist()
            broken = [{"id": r["id"], "error": r["error"]} for r in rows if r.get("error") is not None]
            if broken:
                yield pa.RecordBatch.from_pylist(broken, schema=schema)
            waiting += [r for r in rows if r.get("error") is None]
            while len(waiting) >= batch_size:
                head, waiting = waiting[:batch_size], waiting[batch_size:]
                yield pa.RecordBatch.from_pylist(score(head, scorer), schema=schema)
        if waiting:
            yield pa.RecordBatch.from_pylist(score(waiting, scorer), schema=schema)

    return df.mapInArrow(run, RESULT_DDL)


def record_results(cat: Catalog, results: DataFrame) -> Catalog:
    """Store the scored rows and give the failed ones back, in this order: new tag
    names, scores, vectors and status, failures. The results feed several merges, so
    they are stored first and nothing is scored twice."""
    results = stage(results)
    done, failed = results.where(c("error").isNull()), results.where(c("error").isNotNull())
    preds = done.select(c("id").alias("image_id"), F.inline("tags"))
    tags = merge_names(cat.wd_tags, preds)
    images = reset_failed(complete_images(cat.images, done), failed)
    return cat.with_(wd_tags=tags, wd_tag_images=merge_scores(cat.wd_tag_images, tags, preds), images=images)
