"""Session defaults. Everything set here is a runtime SQL setting, so a session
that somebody else created can be tuned too."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a post, account or key may hold a third of all rows: let AQE split the
    # partition even where that costs one more exchange
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are written for."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "lumicat", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage. The cluster names it in
    ``spark.checkpoint.dir``; only local runs fall back to a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        spark.sparkContext.setCheckpointDir(shared)
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    current = os.environ.get("LUMICAT_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="lumicat-ckpt-")
    os.environ["LUMICAT_CHECKPOINT_DIR"] = current
    spark.sparkContext.setCheckpointDir(current)
    return current
