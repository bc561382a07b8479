"""Vectors as a table kept up by content hash; the quantised token table."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedding_build as B
from lodestone.operators import encoding
from lodestone.sources.catalogue import Snapshots


def encoder(spark, seen):
    """The lengths of a text and of its first word, scaled; counts what it is asked for."""
    def encode(texts):
        seen.append(sorted(r.id for r in texts.select("id").collect()))
        return texts.where("text <> ''").select("id", F.array(F.length("text") / 3.0, F.lit(1.0)).alias("vector"))

    return encode


def items(spark, n, changed=()):
    return spark.range(n).select("id", F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"), F.when(F.col("id").isin(*changed, -1), "new text").otherwise("text").alias("summary"))


def test_only_changed_items_are_encoded(spark, tmp_path):
    store, seen = Snapshots(spark, f"file://{tmp_path}/v"), []
    encode = encoder(spark, seen)
    assert B.build(store, items(spark, 300), encode, "m", 2, "a")
    assert seen.pop() == list(range(300))
    assert B.build(store, items(spark, 299, (7, 100, 250)), encode, "m", 2, "b")  # one is gone, a hundredth has changed
    assert seen.pop() == [7, 100, 250]
    out = {r.id: r for r in store.read("b").collect()}
    assert sorted(out) == list(range(299)) and {i for i, r in out.items() if r.encoded_in == "b"} == {7, 100, 250}
    text = "title 7. new text"
    assert out[7].vector == [round(len(text) / 3, 6), 1.0]
    assert B.build(store, items(spark, 299, (7, 100, 250)), encode, "m", 2, "c") and seen.pop() == []
    assert B.build(store, items(spark, 299, (7, 100, 250)), encode, "other model", 2, "d") and len(seen.pop()) == 299


def test_texts_without_tokens_and_failed_checks(spark, tmp_path):
    store, seen = Snapshots(spark, f"file://{tmp_path}/v"), []
    rows = spark.createDataFrame([(1, None, None), (2, "x", "y")], "id long, title string, summary string")
    assert B.build(store, rows, encoder(spark, seen), "m", 2, "a")
    assert {r.id: r.vector for r in store.read("a").collect()} == {1: [0.0, 0.0], 2: [round(4 / 3, 6), 1.0]}
    twice = rows.unionAll(rows.where("id = 2"))
    assert B.build(Snapshots(spark, f"file://{tmp_path}/u"), twice, encoder(spark, seen), "m", 2, "a")
    twice = rows.unionAll(rows.where("id = 2").withColumn("summary", F.lit("other")))
    assert not B.build(store, twice, encoder(spark, seen), "m", 2, "b")
    assert store.versions() == ["a"]
    report = B.id_report(rows)
    found = {(r.id, r.message) for r in report(spark.createDataFrame([(2,), (2,), (3,)], "id long")).collect()}
    assert found == {("1", "no vector"), ("3", "stale vector"), ("2", "several vectors")}
    assert B.build(Snapshots(spark, f"file://{tmp_path}/w"), rows.limit(0), encoder(spark, seen), "m", 2, "a")


def test_token_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", [0.0, 0.0]), (0, "a", [127.0, -63.5]), (2, "c", [1.0, 0.5])], "token_id int, token string, vector array<double>")
    B.write_token_table(rows, 3, f"{tmp_path}/t")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").orderBy("token_id").collect()]
    assert [(g[0], g[1], g[2]) for g in got] == [(0, "a", [127, -64]), (1, "b", [0, 0]), (2, "c", [127, 64])]
    assert [g[3] for g in got] == pytest.approx([1.0, 1.0, 1 / 127])
    with pytest.raises(ValueError, match=r"\[3\]"):
        B.write_token_table(rows, 4, f"{tmp_path}/u")
    # what was written encodes
    tokens = spark.createDataFrame([(1, [0, 0]), (2, [1])], "id long, tokens array<int>")
    vectors = {r.id: r.vector for r in encoding.encode(tokens, spark.read.parquet(f"{tmp_path}/t")).collect()}
    assert vectors[1] == pytest.approx([127 / (127**2 + 64**2) ** 0.5, -64 / (127**2 + 64**2) ** 0.5])
