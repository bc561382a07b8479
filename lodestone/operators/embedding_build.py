"""Building item vectors and the quantised token table as written tables, kept up by content hash.

A build encodes only items whose text or model changed since the last one, carries the other vectors over, and drops those of
items that are gone. It is published as a version, behind a check that items and vectors have the same ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.encoding import item_text, missing_ids, quantise
from lodestone.operators.snapshots import content_hash, missing_both_ways
from lodestone.sources.catalogue import Snapshots

#: Decimals of stored vectors.
DIGITS = 6


def hashed(items: DataFrame, model: str) -> DataFrame:
    """(id, text, hash) of items (id, title, summary); the hash is of the model's name and the encoded text."""
    texts = items.select("id", item_text(F.col("title"), F.col("summary")).alias("text"))
    return texts.withColumn("hash", content_hash(F.lit(model).alias("model"), F.col("text")))


def to_encode(items: DataFrame, built: DataFrame | None) -> DataFrame:
    """Those of hashed items that the last build has not, or has with another hash."""
    return items if built is None else items.join(built.select("id", "hash"), ["id", "hash"], "left_anti")


def item_vectors(items: DataFrame, built: DataFrame | None, encode: Callable[[DataFrame], DataFrame], model: str, dim: int, version: str) -> DataFrame:
    """(id, hash, vector, encoded_in) of all items. built: the same of the last build, None at first; encode: from (id, text) to (id,
    vector), asked for changed items only; a text without tokens has the zero vector. encoded_in is the version whose build made
    the vector. Repeated items have one vector; an id with several texts has several, which the check tells."""
    wanted = hashed(items, model)
    new = to_encode(wanted, built).dropDuplicates(["id", "hash"])
    nothing = F.array_repeat(F.lit(0.0), dim)
    made = new.select("id", "hash").join(encode(new.select("id", "text")), "id", "left")
    made = made.select("id", "hash", F.transform(F.coalesce("vector", nothing), lambda x: F.round(x, DIGITS)).alias("vector"), F.lit(version).alias("encoded_in"))
    if built is None:
        return made
    kept = built.join(wanted.select("id", "hash"), ["id", "hash"], "left_semi").select("id", "hash", "vector", "encoded_in")
    return kept.unionByName(made)


def id_report(items: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What blocks publishing: ids that only items or only vectors have, and ids that have several vectors."""
    def report(vectors: DataFrame) -> DataFrame:
        sides = missing_both_ways(items, vectors).select(F.col("id").cast("string").alias("id"), F.when(F.col("side") == "left", "no vector").otherwise("stale vector").alias("message"))
        twice = vectors.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").cast("string").alias("id"), F.lit("several vectors").alias("message"))
        return sides.unionByName(twice).withColumn("severity", F.lit("error"))

    return report


def build(catalogue: Snapshots, items: DataFrame, encode: Callable[[DataFrame], DataFrame], model: str, dim: int, version: str) -> bool:
    """Publish the vectors of items as a version of the catalogue, from its last other version on; False if the check fails."""
    last = catalogue.previous(version)
    return catalogue.publish(item_vectors(items, last, encode, model, dim, version), version, id_report(items))


def write_token_table(rows: DataFrame, size: int, path: str) -> None:
    """(token_id, token, q, scale) of a model's rows (token_id, token, vector), quantised row by row, in order of ids. An id of 0 to
    size - 1 that is missing is an error."""
    lacking = missing_ids(rows, size).orderBy("token_id").limit(10).collect()
    if lacking:
        raise ValueError(f"the vocabulary lacks ids {[r.token_id for r in lacking]}")
    made = rows.select("token_id", "token", quantise(F.col("vector")).alias("r")).select("token_id", "token", "r.q", F.col("r.scale").cast("float").alias("scale"))
    made.repartitionByRange("token_id").sortWithinPartitions("token_id").write.mode("errorifexists").parquet(path)
