"""One pass over markup: nesting, entities, attributes, and pages that would make a scanner slow."""

import time

import pytest

from lodestone.functions.markup import page_text, read_page
from lodestone.operators import conformance as C


@pytest.mark.parametrize("page, body", [
    ("<nav>a<nav>b</nav>c</nav>d", "d"),
    ("<div><nav>a</div>b", "b"),
    ("<nav/>a", "a"),
    ("<a href=x/>a</a>b", "a b"),
    ("a</b>c", "a c"),
    ("a<!-- x > y -->b<!-->c", "a b c"),
    ("a<script>if (a<b) '</p>'</script>b", "a b"),
    ("caf&eacute; &#233;&#xe9; &copy 1 & < 2", "café éé © 1 & < 2"),
    ("<p title='a>b' x=\"</p>\">c", "c"),
    ("<P>a<BR/>b<HR>c</P>", "a b c"),
    ("a<ruby>b<rt>c</rt></ruby>d", "a b d"),
    ("a<![CDATA[b < c]]>d", "a b < c d"),
    ("a <unclosed x", "a"),
    ("<title>t</title>b", "t b"),
    ("<style>x", ""),
    ("", ""),
])
def test_bodies(page, body):
    assert read_page(page)[2] == body


@pytest.mark.parametrize("page, meta", [
    ("<title> A &amp;\n B </title><meta name='description' content='d &lt; e'>", "A & B d < e"),
    ("<META content=k name=keywords><meta property=\"og:title\" content=\"T\">", "T k"),
    ("<meta property=description content=p><meta name=description content=n>", "n"),
    ("<meta property=description content=p><meta name=description content=''>", ""),
    ("<meta name=description content=1><meta name=description content=2>", "1"),
    ("<title></title><title>b</title>", ""),
    ("<header><title>a</title><meta name=description content=1></header>", ""),
])
def test_metas(page, meta):
    assert read_page(page)[1] == meta


@pytest.mark.parametrize("page", [
    "<nav>" * 200_000 + "x", "<a x=\"' " * 200_000, "</b>" * 200_000 + "<!--" * 100_000, "<script>" * 200_000, "<" * 300_000 + "&" * 300_000,
    "<b>" * 200_000 + "</i>" * 200_000, "<a x=" * 200_000,
])
def test_long_markup_takes_linear_time(page):
    began = time.time()
    read_page(page)
    assert time.time() - began < 10


def test_page_text(spark):
    df = spark.createDataFrame([(1, "<title>t</title><p>a"), (2, None), (3, "")], "id int, html string")
    out = {r.id: r.p.asDict() for r in df.select("id", page_text(df.html).alias("p")).collect()}
    assert out[1] == {"title": "t", "meta": "t", "body": "t a", "full": "t t a"}
    assert out[2] == out[3] == {"title": "", "meta": "", "body": "", "full": " "}


SCHEMA = {
    "type": "object", "required": ["n", "items"], "additionalProperties": False,
    "properties": {"n": {"type": "integer", "minimum": 0}, "items": {"type": "array", "items": {"$ref": "#/definitions/item"}}, "at": {"type": "string", "format": "date-time"}},
    "definitions": {"item": {
        "type": "object", "required": ["id"],
        "properties": {
            "id": {"type": "string", "pattern": "^A-[0-9]{3}$"}, "kind": {"type": ["string", "null"], "enum": ["x", "y"]},
            "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}, "maxItems": 2}, "title": {"type": "string", "minLength": 1},
            "links": {"type": "array", "items": {"type": "object", "required": ["url"], "additionalProperties": False, "properties": {"url": {"type": "string", "format": "uri"}}}},
            "it's": {"not": {"type": "boolean"}}, "it's \"": {"type": "string"}, "": {"not": {"type": "boolean"}}, "one": {"oneOf": [{"type": "integer"}, {"minimum": 5}]}, "m": {"type": "object", "additionalProperties": {"type": "null"}},
        },
    }},
}


def wrong(spark, raw, formats=False, **more):
    rows = spark.createDataFrame([(1, raw)], "id int, raw string")
    return sorted((r.path, r.rule) for r in C.violations(rows, SCHEMA, formats=formats, **more).collect())


@pytest.mark.parametrize("raw, expected", [
    ('{"n":1.0,"items":[]}', []),
    ('{"n":1.5,"items":{}}', [("/items", "type"), ("/n", "type")]),
    ('{"n":null,"z":1}', [("", "additionalProperties"), ("", "required"), ("/n", "type")]),
    ('{"n":-1,"items":[{"id":"A-12"},{"id":"A-123","kind":null},{}, 3]}', [("/items/0/id", "pattern"), ("/items/1/kind", "enum"), ("/items/2", "required"), ("/items/3", "type"), ("/n", "minimum")]),
    ('{"n":0,"items":[{"id":"A-123","tags":["a","c",1],"title":"","links":[{},{"url":"u","x":1}]}]}',
     [("/items/0/links/0", "required"), ("/items/0/links/1", "additionalProperties"), ("/items/0/tags", "maxItems"), ("/items/0/tags/1", "enum"), ("/items/0/tags/2", "enum"), ("/items/0/tags/2", "type"), ("/items/0/title", "minLength")]),
    ('{"n":0,"items":[{"id":"A-123","it\'s":true,"it\'s \\"":1,"":true,"one":7,"m":{"k":1,"l":null}}]}', [("/items/0/", "not"), ("/items/0/it's", "not"), ("/items/0/it's \"", "type"), ("/items/0/m/k", "type"), ("/items/0/one", "oneOf")]),
    ("[]", [("", "type")]),
    ("no json", [("", "json")]),
    (None, [("", "json")]),
])
def test_conformance(spark, raw, expected):
    assert wrong(spark, raw) == expected


def test_formats_are_remarks_unless_asked_for(spark):
    raw = '{"n":0,"items":[{"id":"A-123","links":[{"url":"no address"}]}],"at":"yesterday"}'
    assert wrong(spark, raw) == []
    assert wrong(spark, raw, True) == [("/at", "format"), ("/items/0/links/0/url", "format")]


def test_parts_reports_and_refusals(spark):
    rows = spark.createDataFrame([(n, n, f'{{"id":"{n}"}}') for n in range(30)], "id int, ord int, raw string")
    out = C.conformance(rows, SCHEMA, part="#/definitions/item").collect()
    assert [r.id for r in out] == [*map(str, range(25)), None] and out[-1].message == "5 more errors not shown"
    assert out[0].message == "/id: pattern ^A-[0-9]{3}$"
    assert C.conformance(rows.limit(0), SCHEMA).count() == 0
    for schema in ({"uniqueItems": True}, {"$ref": "#"}, {"$ref": "other.json"}, {"enum": [[1]]}):
        with pytest.raises(ValueError):
            C.violations(rows, schema)


def test_pages_come_in_batches_of_bounded_bytes(spark):
    """A worker's batch goes by bytes, and by Arrow, not by 10,000 pages of whatever length."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from lodestone.functions.markup import _pages
    from lodestone.session import ship

    ship(spark)
    assert _pages(pa.array(["<title>t</title>b", None])).to_pylist() == [{"title": "t", "meta": "t", "body": "t b", "full": "t t b"}, {"title": "", "meta": "", "body": "", "full": " "}]
    assert len(_pages(pa.array([], pa.string()))) == 0
    size = F.arrow_udf(lambda x: pa.array([x.nbytes] * len(x), pa.int64()), "bigint")
    # one partition of 40 MB
    pages = spark.range(0, 200, 1, 1).select(F.repeat(F.concat(F.lit("<p>"), F.col("id").cast("string")), 60_000).alias("html"))
    assert pages.select(F.max(size("html"))).first()[0] < 12_000_000
