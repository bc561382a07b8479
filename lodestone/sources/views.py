"""The driver's tables seen as catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items: the title goes up to the first full stop; toxic ones count as expired."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("summary"),
        F.col("lang").alias("contentType"), F.array("source").alias("topics"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("expired"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, summary) of documents(), which need no labels."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("summary"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.col("p_type").alias("contentType"), F.array("p_brand").alias("topics"), F.array(F.col("p_size").cast("string")).alias("locations"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publishDate"), F.col("o_orderpriority").alias("contentType"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_set("role")).alias("topics"))
