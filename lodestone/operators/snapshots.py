"""Snapshots: order, hashes, differences, the publish gate's counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stored_order(number: Column, id_: Column) -> list[Column]:
    return [F.coalesce(number, F.lit(0)), id_]


def content_hash(*columns: Column) -> Column:
    return F.substring(F.sha1(F.to_json(F.struct(*columns)).cast("binary")), 1, 12)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change) of tables (id, hash): added, removed or updated, by one outer join."""
    both = old.select("id", F.col("hash").alias("old_hash"), F.lit(True).alias("in_old")).join(new.select("id", F.col("hash").alias("new_hash"), F.lit(True).alias("in_new")), "id", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "updated")
    return both.select("id", change.alias("change")).where("change is not null")


def missing_both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side) of ids that only one table has."""
    a = left.select("id").distinct().withColumn("l", F.lit(True))
    b = right.select("id").distinct().withColumn("r", F.lit(True))
    return a.join(b, "id", "full_outer").where("l is null or r is null").select("id", F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def run_counters(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("item_count"), F.count_if(F.coalesce("url", F.lit("")) == "").alias("missing_url"), F.count_if(F.coalesce("expired", F.lit(False))).alias("expired_count"))
