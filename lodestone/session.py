"""Workers that can import this package, and the folder that driver and executors share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

#: Workers give freed memory back instead of keeping it for themselves.
FRUGAL = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_MMAP_THRESHOLD_": "33554432", "MALLOC_ARENA_MAX": "2"}


def ship(spark: SparkSession) -> SparkSession:
    """Python workers started from now on find the package, wherever the driver was started, and Arrow batches have BATCH_BYTES where
    the session has Spark's default: a worker's memory goes by its batch, not by its partition, which grows with the input."""
    if spark.conf.get(BATCH, "64m") in ("64m", "67108864b", "67108864"):
        spark.conf.set(BATCH, BATCH_BYTES)
    env = spark.sparkContext.environment
    for name, value in FRUGAL.items():
        env.setdefault(name, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that a job writes for itself: spark.checkpoint.dir, else the context's. Where neither is set, as in
    tests on one machine, it lies in the warehouse; a cluster must name one, as its machines share no other folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/catalogue"
