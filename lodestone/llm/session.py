"""What the operators need from the session: importable workers and a shared folder for cut lineage."""

from __future__ import annotations

import ctypes
import gc
import os
import time
import uuid
from contextlib import suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

#: Workers give freed memory back instead of keeping it for themselves.
FRUGAL = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_MMAP_THRESHOLD_": "33554432", "MALLOC_ARENA_MAX": "2"}

#: Keys that spread_join() broadcasts.
FREQUENT = 1024
#: Keys of rows without an id begin here; real ids are smaller.
UNNAMED = 1 << 62

#: Spark's setting by which an execution that ends removes its shuffle files.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Stands for a null id: after all others.
LAST_ID = 2**63 - 1

#: release() waits so many seconds at least, and so many times what it took, before it works again.
RELEASE_EVERY, RELEASE_SHARE = 5.0, 20
_release_from = 0.0


def prepare(spark: SparkSession) -> SparkSession:
    """Python workers started from now on can import this package, and Arrow batches stay small.

    Batches of BATCH_BYTES (where the session has Spark's default) keep executors' memory low when texts are long.
    """
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
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's. None is made up: a folder of one
    machine would lose on a cluster what other machines wrote."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        # one machine is the whole cluster: the warehouse, which every session has, is shared
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodestone"
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def release(spark: SparkSession) -> None:
    """Memory that the driver's Python and JVM have freed goes back to the system.

    Operators of many steps leave plans, hash tables and compilers' work behind, which the JVM's heap and the allocators keep
    for themselves. It takes at most one RELEASE_SHARE-th of the time, however large the heap is. A JVM without the command that
    trims (it needs glibc and JDK 17.0.9 or later) collects its garbage only.
    """
    global _release_from
    began = time.monotonic()
    if began < _release_from:
        return
    gc.collect()  # plans that Python no longer refers to can go from the JVM as well
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    with suppress(Py4JError):
        # by the public interface: py4j can't reach the server's own class
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        command = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        command[0], command[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), command)
    ended = time.monotonic()
    _release_from = ended + max(RELEASE_EVERY, RELEASE_SHARE * (ended - began))


def cut(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: short lineage that survives lost executors. What the driver
    freed is released.

    With `free`, what was shuffled for it goes from the executors' disks once the table is complete (FREED).
    """
    path = f"{shared_dir(df.sparkSession)}/lodestone-{label}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(FREED, None)
    if free:
        conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            conf.unset(FREED) if before is None else conf.set(FREED, before)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_key(column: str = "doc_id"):
    """The id as a long that joins and sorts: null becomes LAST_ID."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def text_key(text: Column, doc_id: str = "doc_id") -> Column:
    """The id as a long; without an id one of UNNAMED and more made from the text, so that no key gathers all rows without id
    and equal rows have equal keys."""
    made = F.shiftrightunsigned(F.xxhash64(F.lit("unnamed"), text), 2).bitwiseOR(F.lit(UNNAMED))
    return F.coalesce(F.col(doc_id).cast("long"), made)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], spread: Column) -> DataFrame:
    """left with the `values` that right (keys, values, n) has for its keys; left rows without a match go.

    right has each key once and n, how many rows of left hold it. Its FREQUENT most frequent keys, a bounded table, are
    broadcast, and left's rows with these keys are dealt out by `spread`. Any other key holds at most 1 / FREQUENT of left's
    rows. So no task gets all rows of a hot key.
    """
    top = right.orderBy(F.desc("n"), *keys).limit(FREQUENT).select(*keys, F.lit(True).alias("_top"), *[F.col(v).alias(f"_t_{v}") for v in values])
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(True).alias("_found"), *[F.col(v).alias(f"_r_{v}") for v in values])
    marked = left.join(F.broadcast(top), keys, "left").withColumn("_deal", F.when(F.col("_top"), F.xxhash64(keys[0], spread)).otherwise(F.col(keys[0])))
    # what is dealt out by is the key itself for most rows, so that only frequent keys cross twice
    marked = marked.withColumn("_own", F.when(F.col("_top"), F.col(keys[0]))).drop(keys[0])
    on = [F.col("_deal") == F.col(f"_k_{keys[0]}"), *[F.col(k) == F.col(f"_k_{k}") for k in keys[1:]]]
    both = marked.join(other, on, "left").where("_top or _found")
    first = F.when(F.col("_top"), F.col("_own")).otherwise(F.col("_deal")).alias(keys[0])
    return both.select(*[first if c == keys[0] else c for c in left.columns], *[F.when(F.col("_top"), F.col(f"_t_{v}")).otherwise(F.col(f"_r_{v}")).alias(v) for v in values])
