"""Enrichment and export as jobs, publishing and streaming that survive a second run."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import enrichment
from lodestone.sources import catalogue as C
from lodestone.sources.catalogue import Snapshots


def test_enrichment_routes(spark, tmp_path):
    works = {"10.1/a": {"concepts": [{"display_name": "Soil carbon (agronomy)", "score": 0.9, "level": 2}], "abstract_inverted_index": {"nitrogen": [0, 2], "uptake": [1]}}}
    records = {"10.1/b": {"message": {"subject": ["Agronomy"], "container-title": ["Field Crops"], "abstract": "<p>lodging lodging</p>"}}}
    videos = {"https://youtu.be/x": {"title": "Cover Crop Walk", "author_name": "Ann Lee"}}
    html = {"https://p.org": "<title>Page</title><p>" + "harvest timing matters. " * 30 + "</p>", "https://thin.org": "<p>x</p>", "https://wall.org": "<p>Just a moment</p>"}

    def page(url):
        if url not in html:
            raise OSError("gone")
        return "text/html", html[url], url

    ask = lambda table: lambda key: json.dumps(table[key]) if key in table else None
    rows = [("1", "https://u.org", "10.1/a"), ("2", "https://u.org", "10.1/b; 10.1/none"), ("3", "https://youtu.be/x", None), ("4", "https://p.org", None), ("5", "https://thin.org", None), ("6", "https://wall.org", None), ("7", "https://gone.org", None), ("8", None, None)]
    items = spark.createDataFrame([(i, "t", "s", u, d) for i, u, d in rows], "id string, title string, summary string, url string, doi string")

    def stage(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    out = stage(enrichment.enrich(items, ask(works), ask(records), ask(videos), page, stage, 2), "results")
    got = {r.id: (r.status, r.via, r.keywords) for r in out.collect()}
    assert got["1"] == ("ok", "doi:10.1/a", ["Soil carbon", "nitrogen"])
    assert got["2"] == ("ok", "doi:10.1/b,10.1/none", ["Agronomy", "Field Crops", "lodging"])
    assert got["3"] == ("ok", "youtube-oembed", ["Ann Lee", "Cover Crop Walk"])
    assert got["4"][:2] == ("ok", "scraped-page") and "harvest timing" in got["4"][2]
    assert [got[i][0] for i in "567"] == ["low_yield", "blocked", "failed"] and "8" not in got
    counts = {r.status: (r.n, len(r.detail)) for r in enrichment.report(out, F.lit("2026-01-01T00:00:00Z")).collect()}
    assert counts == {"ok": (4, 4), "low_yield": (1, 1), "blocked": (1, 1), "failed": (1, 1)}


def test_replacing_a_version_and_replaying_a_batch(spark, tmp_path):
    store = C.Snapshots(spark, str(tmp_path / "store"))
    good = lambda df: df.selectExpr("'warning' as severity")
    for x in ("a", "b"):
        assert store.publish(spark.createDataFrame([(x,)], "x string"), "2026-01", good)
    assert store.versions() == ["2026-01"] and store.read("2026-01").first().x == "b"
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_")]


def test_fences_in_a_text_are_not_markup(spark):
    df = spark.createDataFrame([("a\x03b trial\x04 \x01c\x02",)], "t string")
    assert df.select(X.highlight(F.col("t"), ["trial"]).alias("x")).first().x == "ab <mark>trial</mark> c"


@pytest.mark.parametrize("ends_at", ["write", "judge", "set_aside", "put_in_place", "tidy"])
def test_publish_that_ends_halfway(spark, tmp_path, monkeypatch, ends_at):
    """After each step of replacing a version: readers have the old one or, once it is in place, the new one."""
    root = f"file://{tmp_path}/s"
    fine = lambda items: items.sparkSession.createDataFrame([], "severity string")
    store = Snapshots(spark, root)
    assert store.publish(spark.range(3), "2026-01", fine) and store.publish(spark.range(4), "2026-02-x", fine)

    class Ended(Exception):
        pass

    class Fs:
        """The file system, ending the run at a step."""

        def __init__(self, fs):
            self.fs, self.renames = fs, 0

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            self.renames += 1
            if (ends_at, self.renames) in (("set_aside", 1), ("put_in_place", 2)):
                raise Ended
            return self.fs.rename(a, b)

        def delete(self, path, deep):
            if ends_at == "tidy" and "_old-" in path.toString():
                raise Ended
            return self.fs.delete(path, deep)

    def judge(items):
        if ends_at == "judge":
            raise Ended
        return fine(items)

    broken = Snapshots(spark, root)
    broken._fs = Fs(broken._fs)
    items = spark.range(9).selectExpr("id", "raise_error('x') AS y") if ends_at == "write" else spark.range(9)
    with pytest.raises(Exception):  # noqa: B017
        broken.publish(items, "2026-02-x", judge)
    after = Snapshots(spark, root)
    assert after.recover() == (["2026-02-x"] if ends_at == "put_in_place" else [])
    assert after.versions() == ["2026-01", "2026-02-x"]
    assert after.read("2026-02-x").count() == (9 if ends_at == "tidy" else 4)
    assert after.read("2026-01").count() == 3
    assert not [n for n in (tmp_path / "s").iterdir() if n.name.startswith(("_old-", "_staging-"))]
    assert after.publish(spark.range(9), "2026-02-x", fine) and after.read("2026-02-x").count() == 9


def test_vector_files_that_are_missing_or_broken(spark, tmp_path):
    from lodestone.operators import quality

    items = spark.createDataFrame([("a",), ("b",)], "id string")
    report = lambda name: sorted((r.severity, r.id or "", r.message) for r in quality.vector_file(items, f"{tmp_path}/{name}").collect())
    assert report("none.json") == [("warning", "", "no vector file")]
    (tmp_path / "broken.json").write_text('{"items": [')
    assert report("broken.json") == [("error", "", "the vector file is no JSON")]
    (tmp_path / "some.json").write_text(json.dumps({"model": "m", "dim": 1, "items": [{"id": "a", "vector": [1.0]}, {"id": "c", "vector": [1.0, 2.0]}, {"vector": [1.0]}, {"id": "b", "vector": None}]}))
    assert report("some.json") == [("error", "", "mixed lengths"), ("error", "c", "stale vector")]
