"""Two-pass external shuffle into shards.

Pass one scatters the records by a seeded hash into buckets that fit a task's memory. Pass two shuffles each bucket by
Fisher-Yates, deals it out and writes it. Buckets are as many as the bytes ask for, so that a bucket's size doesn't depend
on the corpus; the hash also takes in a record's place in the scan, so that a third of all rows being equal still spreads.
Where each bucket's rows begin in the whole order is a running sum over the buckets' counts, kept as a table; the driver holds
one number, the corpus's bytes.

Law `rows`: the shuffled buckets, one after the other, are dealt to the shards in turn; shard sizes differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.session import cut, prepare

SHARDS = 40
SEED = 20240917
#: Bytes of text (uncompressed) that one bucket holds on average: a task holds one bucket, and a copy of it, at a time.
BUCKET_BYTES = 64 << 20
#: Buckets whose counts are summed up together.
STRIDE = 1024
ROW_OVERHEAD = 16


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A permutation of range(n): from the end, each place swaps with a random place not after it."""
    order = list(range(n))
    picks = rng.random(n).tolist()
    for i in range(n - 1, 0, -1):
        j = int(picks[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def starts(counts: DataFrame) -> DataFrame:
    """(bucket, start) of (bucket, n): how many rows the buckets before hold. Sums run within strides of buckets, then over the
    strides, which are 1 / STRIDE of the buckets."""
    placed = counts.withColumn("stride", F.floor(F.col("bucket") / STRIDE))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strides = placed.groupBy("stride").agg(F.sum("n").alias("n")).withColumn("base", before(Window.orderBy("stride"))).select("stride", "base")
    inner = placed.withColumn("inner", before(Window.partitionBy("stride").orderBy("bucket")))
    return inner.join(strides, "stride").select("bucket", (F.col("base") + F.col("inner")).alias("start"))


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of docs in shuffled order, with shard, slot, bucket and size.

    Null texts have size 16 and a null text_crc32 is never made: null counts as empty. Rows with null or repeated ids and
    equal rows are rows of their own. No rows: an empty result. The added columns are _shard, _slot, _bucket, _size and
    _crc32; older ones of these names give way, all others pass through. Order is fixed by seed, rows and the scan's splits.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("_shard", "_slot", "_bucket", "_size", "_crc32")
    sized = docs.select(
        F.struct(*docs.columns).alias("row"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD).cast("long")).alias("_size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_crc32"),
    )
    # the scatter key is drawn once per record and written: both passes see the same keys, whatever is lost meanwhile
    scattered = cut(sized.withColumn("key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), "_crc32", "_size")), "scatter")
    total = scattered.agg(F.sum("_size")).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    bucketed = scattered.withColumn("bucket", F.pmod("key", F.lit(n_buckets)))
    placed = bucketed.join(starts(bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))), "bucket")
    kinds = placed.select("row", "_size", "_crc32", "bucket", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema

    def deal(bucket: pa.Table) -> pa.Table:
        b, start = bucket.column("bucket")[0].as_py(), bucket.column("start")[0].as_py()
        # rows come in any order; their keys, which were written, put them into one
        order = bucket.column("key").to_numpy().argsort(kind="stable")
        order = order[fisher_yates(len(order), np.random.Generator(np.random.PCG64([seed, b])))]
        place = start + np.arange(len(order))
        out = bucket.select(["row", "_size", "_crc32", "bucket"]).take(pa.array(order))
        return out.append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))

    dealt = placed.groupBy("bucket").applyInArrow(deal, kinds)
    return dealt.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), F.col("bucket").alias("_bucket"), "_size", "_crc32")


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Shuffle and write one folder per shard; returns the written table. Rows in a file keep their slots' order."""
    out = shuffle_into_shards(docs, **options)
    out.write.mode("overwrite").partitionBy("_shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shuffle_into_shards(docs)
    return out.select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc32").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
