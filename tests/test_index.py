"""The postings index against matching on texts, and ranks of all hits for any keys."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.plans import postings as P
from lodestone.plans import search as S

WORDS = "soil soils trial trialing trials corn cornell tool tooled Gésan straße c++ c++ed l'eau l'eaus farmer's farmers x_1 x_1s ed s 日本 a.b".split()
SCHEMA = "id string, ord string, title string, summary string, contentType string, topics array<string>, expired boolean"


def items(spark, n=300):
    rng = random.Random(4)
    some = lambda most: " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", "-"]) for _ in range(rng.randrange(most)))
    rows = [(f"i{k * 7919 % n}", f"{rng.random()}", some(3), some(12), rng.choice([None, "Video", "corn"]), [some(2)], rng.choice([True, False, None])) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("q", ["soil", "trial corn", "trial trial corn", "gesan", "stra", "straße", "c++", "c++ tool", "l'eau", "farmer's farmer", "x_1", "ed", "日本", "日本 soil", "a.b", "nothing", "tool nothing", "s"])
def test_postings_match_as_texts_do(spark, tmp_path_factory, q):
    own = items(spark)
    path = str(tmp_path_factory.getbasetemp() / "postings-of-items")
    index = S.keyword_index(own)
    try:
        table = spark.read.parquet(path)
    except Exception:  # the first of the queries writes it
        P.write_postings(index, path)
        table = spark.read.parquet(path)
    terms = X.query_terms(q)
    want = {(r.id, r.score) for r in S.keyword_scores(index, terms).collect()}
    assert {(r.id, r.score) for r in P.posting_scores(table, terms, index).collect()} == want


def test_a_query_reads_its_terms_and_no_texts(spark, tmp_path):
    P.write_postings(S.keyword_index(items(spark)), f"{tmp_path}/p", 4)
    S.keyword_index(items(spark)).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    hits = S.search(index, S.SearchRequest(q="soil trial", mode="keyword", limit=5), postings=spark.read.parquet(f"{tmp_path}/p"))
    plan = hits._jdf.queryExecution().explainString(hits.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PushedFilters: \[.*In\(term, \[soil,", plan)
    assert "summary" not in plan and "_rest" not in plan
    scan = S.search(index, S.SearchRequest(q="soil trial", mode="keyword", limit=5))
    assert hits.collect() == scan.select(*hits.columns).collect()


def test_terms_are_clustered(spark, tmp_path):
    import pyarrow.parquet as pq

    P.write_postings(S.keyword_index(items(spark)), f"{tmp_path}/p", 4)
    ranges = []
    for file in (tmp_path / "p").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        ranges += [(s.min, s.max) for s in (meta.row_group(g).column(0).statistics for g in range(meta.num_row_groups)) if s]
    ranges.sort()
    assert len(ranges) >= 3 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("kind", ["string", "hashed", "equal", "null"])
def test_ranks_for_any_keys(spark, kind):
    rng = random.Random(9)
    keys = {"string": lambda k: f"{rng.random()}", "hashed": lambda k: str(rng.randrange(-(1 << 62), 1 << 62)), "equal": lambda k: "same", "null": lambda k: None if k % 3 else str(k)}
    rows = [(k, keys[kind](k), rng.randrange(3)) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, key string, score int").repartition(5)
    order = [F.desc("score"), F.asc_nulls_last(F.col("key").cast("long") if kind == "hashed" else F.col("key"))]
    out = S.ranked(df, order).collect()
    value = lambda r: (-r.score, r.key is None, int(r.key) if kind == "hashed" else r.key or "")
    assert [r.rank for r in sorted(out, key=lambda r: r.rank)] == list(range(1, 2001))
    assert [value(r) for r in sorted(out, key=lambda r: r.rank)] == sorted(map(value, out))
    assert sorted(r.id for r in out) == list(range(2000))


def test_equal_keys_are_dealt_out(spark, monkeypatch):
    seen, kept = [], S._kept
    monkeypatch.setattr(S, "_kept", lambda df: seen.append(kept(df)) or seen[-1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert S.ranked(spark.range(20_000).select("id", F.lit("same").alias("key")), ["key"]).agg(F.max("rank")).first()[0] == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000


def test_ranks_of_nothing(spark):
    assert S.ranked(spark.createDataFrame([], "id long, ord string"), ["ord"]).count() == 0
