"""Queries on what Spark derives from the driver's tables, where these lack a rule's columns.

The derived columns are expressions that Spark and DuckDB read alike; what the rules make of them is written apart for each: by the
operators here, in SQL for DuckDB there.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.markup import page_text
from lodestone.operators import conformance, embedding_build, encoding, export_job, links, mining, quality
from lodestone.queries import _report, _SHOWS, _squeeze_sql, WORDS, curated, query
from lodestone.session import shared_dir
from lodestone.sources import catalogue
from lodestone.sources import views as V


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _from(table: str, columns: list[str]) -> str:
    return f"(SELECT {', '.join(columns)} FROM {table})"


# -- quality rules: events as items ----------------------------------------------------------------------------------
_ID, _DAY, _HASH = "CAST(event_id AS STRING)", "CAST(CAST(ts AS DATE) AS STRING)", "md5(CAST(event_id AS STRING))"
ITEMS = [
    "event_id AS id", "event_id AS ord",
    f"CASE event_id % 6 WHEN 0 THEN {_DAY} WHEN 1 THEN '2026-99-99' WHEN 2 THEN 'Jan 2026' WHEN 3 THEN '' WHEN 4 THEN {_DAY} || 'T10:00' END AS publishDate",
    f"CASE user_id % 4 WHEN 0 THEN '05/01/2026' WHEN 1 THEN {_DAY} END AS createdAt",
    f"""CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ftp://a.org/' || {_ID} WHEN 2 THEN 'HTTP://b.org/?utm_source=' || event_type || '&utm_campaign=y'
      WHEN 3 THEN 'https://x.list-manage.com/' || event_type ELSE 'https://a.org/' || {_ID} END AS url""",
    "CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'view' THEN 'live' END AS urlStatus",
    f"""CASE event_id % 11 WHEN 0 THEN 'token sk-' || {_HASH} WHEN 1 THEN 'secret_' || {_HASH} WHEN 2 THEN 'key AKIA' || upper(substr({_HASH}, 1, 16)) WHEN 3 THEN 'cafÃ© ' || event_type
      WHEN 4 THEN 'Â â€œ' || event_type WHEN 5 THEN 'sk-short' ELSE event_type || ' of ' || CAST(user_id AS STRING) END AS summary""",
    f"""'{{"id":' || {_ID} || CASE event_id % 3 WHEN 0 THEN ',"title":" "' WHEN 1 THEN ',"title":"t"' ELSE '' END || CASE user_id % 2 WHEN 0 THEN ',"summary":"","contentType":null,"topics":[]' ELSE '' END
      || CASE event_id % 5 WHEN 0 THEN ',"locations":[],"croppingSystems":[]' WHEN 1 THEN ',"Curator Notes ":1' WHEN 2 THEN ',"deep":{{"a":[{{"internalNotes":"x"}}]}}' ELSE '' END || ',"props":' || props || '}}' AS raw""",
]
_ITEMS = _from("events", ITEMS)


def _items(spark, sf_dir):
    return V.table(spark, sf_dir, "events").selectExpr(*ITEMS)


def _bad(column: str) -> str:
    return f"SELECT id, 'bad {column}' AS message FROM {_ITEMS} WHERE NOT regexp_matches({column}, {_q(quality.DATE_SHAPE)})"


@_report("v_dates", f"{_bad('publishDate')} UNION ALL {_bad('createdAt')}")
def _v_dates(spark, sf_dir):
    return quality.dates(_items(spark, sf_dir), "publishDate", "createdAt").select("id", "message")


@_report("v_urls", f"SELECT id, 'no url, yet not unavailable' AS message FROM {_ITEMS} WHERE url IS NULL AND coalesce(urlStatus, '') <> 'unavailable' UNION ALL SELECT id, 'not a web address' FROM {_ITEMS} WHERE NOT regexp_matches(url, {_q(quality.WEB_SHAPE)})")
def _v_urls(spark, sf_dir):
    return quality.urls(_items(spark, sf_dir)).select("id", "message")


_MISSING = " UNION ALL ".join(f"SELECT id, 'missing {k}' AS message FROM {_ITEMS} WHERE NOT contains(raw, '\"{k}\":')" for k in quality.REQUIRED)


@_report("v_required", f"{_MISSING} UNION ALL SELECT id, 'blank title' FROM {_ITEMS} WHERE regexp_matches(raw, '\"title\":\" *\"')")
def _v_required(spark, sf_dir):
    return quality.required(_items(spark, sf_dir)).select("id", "message")


_SECRETS = f"SELECT id, 'secret shape ' || n AS message FROM (SELECT id, CASE {' '.join(f'WHEN regexp_matches(summary, {_q(s)}) THEN {n}' for n, s in enumerate(quality.SECRET_SHAPES))} END AS n FROM {_ITEMS}) WHERE n IS NOT NULL"


@_report("v_secrets", _SECRETS)
def _v_secrets(spark, sf_dir):
    return quality.secrets(_items(spark, sf_dir), "summary").select("id", "message")


@_report("v_secrets_anywhere", _SECRETS)
def _v_secrets_anywhere(spark, sf_dir):
    return quality.secrets(_items(spark, sf_dir)).select("id", "message")


@_report("v_internal_keys", f"SELECT id, 'internal key' AS message FROM {_ITEMS} WHERE regexp_matches(lower(raw), '\"\\s*(?:{'|'.join(quality.INTERNAL_KEYS)})\\s*\"\\s*:')")
def _v_internal_keys(spark, sf_dir):
    return quality.internal_keys(_items(spark, sf_dir)).select("id", "message")


def _places(spark, sf_dir):
    """The items' JSON, each in an array in an object in an array."""
    return quality.walk(_items(spark, sf_dir).selectExpr("id", "concat('[{\"in\":[', raw, ']}]') AS raw"))


_TREE = f"""(SELECT i.id AS id, j.fullkey AS path, CASE WHEN NOT regexp_matches(j.key, '^[0-9]+$') THEN j.key END AS key, CASE WHEN j.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN j.value ->> '$' END AS value
  FROM (SELECT id, '[{{"in":[' || raw || ']}}]' AS raw FROM {_ITEMS}) i, json_tree(i.raw) j)"""


@query(f"SELECT id, key, value, count(*) AS n FROM {_TREE} GROUP BY ALL")
def v_walk(spark, sf_dir):
    """All places in the items' JSON by key and value."""
    return _places(spark, sf_dir).groupBy("id", "key", "value").agg(F.count(F.lit(1)).alias("n"))


_MARKERS = [*quality.WRAPPERS, *quality.TRACKERS]


@_report("p_wrapped", f"SELECT id, m AS message FROM {_ITEMS}, (SELECT unnest([{', '.join(map(_q, _MARKERS))}]) AS m) WHERE contains(url, m)")
def _p_wrapped(spark, sf_dir):
    return quality.wrapped_urls(_items(spark, sf_dir)).select("id", "message")


_BROKEN = f"SELECT id, 'marker ' || n AS message FROM (SELECT id, CASE {' '.join(f'WHEN contains(summary, {_q(m)}) THEN {n}' for n, m in enumerate(quality.MOJIBAKE))} END AS n FROM {_ITEMS}) WHERE n IS NOT NULL"


@_report("p_mojibake", _BROKEN)
def _p_mojibake(spark, sf_dir):
    return quality.mojibake(_items(spark, sf_dir).select("id", F.col("summary").alias("value"))).select("id", "message")


@_report("p_mojibake_anywhere", _BROKEN)
def _p_mojibake_anywhere(spark, sf_dir):
    return quality.mojibake(quality.item_strings(_items(spark, sf_dir))).select("id", "message")


# -- keywords of events ----------------------------------------------------------------------------------------------
KEYED = [
    "event_id AS id", "'what was said of ' || event_type AS blob",
    f"""CASE event_id % 8 WHEN 0 THEN split('a1,A1', ',') WHEN 1 THEN split(event_type || ',new', ',') WHEN 2 THEN NULL WHEN 3 THEN split(' ', ',')
      WHEN 4 THEN split('{','.join(f'k{i}' for i in range(quality.MOST_KEYWORDS + 1))}', ',') WHEN 5 THEN split('Said,other', ',') ELSE split('alone', ',') END AS pageKeywords""",
    f"CASE WHEN user_id % 3 = 0 THEN NULL ELSE {_DAY} END AS pageKeywordsUpdatedAt",
    "CASE user_id % 6 WHEN 0 THEN 'manual' WHEN 1 THEN 'odd' WHEN 2 THEN 'doi:10.1/' || CAST(user_id AS STRING) WHEN 3 THEN 'scraped-page' WHEN 4 THEN 'youtube-oembed' END AS pageKeywordsSource",
    "CASE event_id % 5 WHEN 0 THEN '10.' || CAST(1000 + user_id AS STRING) || '/x; bad' || CAST(event_id % 9 AS STRING) WHEN 1 THEN '10.' || CAST(1000 + user_id AS STRING) || '/x' WHEN 2 THEN '10.2000/' || CAST(event_id AS STRING) || ';' END AS doi",
]
_KEYED = _from("events", KEYED)
_LOW = "list_transform(pageKeywords, lambda w: lower(trim(w)))"
_PARTS = f"(SELECT id, unnest(list_filter(list_transform(string_split(doi, ';'), lambda d: trim(d)), lambda d: d <> '')) AS part FROM {_KEYED})"


def _keyed(spark, sf_dir):
    return V.table(spark, sf_dir, "events").selectExpr(*KEYED)


@_report("p_pairing", f"""SELECT id, 'keywords and time don''t pair' AS message FROM {_KEYED} WHERE (pageKeywords IS NULL) <> (pageKeywordsUpdatedAt IS NULL)
  UNION ALL SELECT id, 'no source' FROM {_KEYED} WHERE pageKeywords IS NOT NULL AND pageKeywordsSource IS NULL UNION ALL SELECT id, 'unknown source' FROM {_KEYED} WHERE pageKeywordsSource = 'odd'""")
def _p_pairing(spark, sf_dir):
    return quality.keyword_pairing(_keyed(spark, sf_dir)).select("id", "message")


@_report("p_lists", f"""SELECT id, 'too many' AS message FROM {_KEYED} WHERE len(pageKeywords) > {quality.MOST_KEYWORDS} UNION ALL SELECT id, 'blank' FROM {_KEYED} WHERE list_contains({_LOW}, '')
  UNION ALL SELECT id, 'repeated' FROM {_KEYED} WHERE len(list_distinct({_LOW})) < len(pageKeywords)
  UNION ALL SELECT id, 'already said' FROM {_KEYED} WHERE len(list_filter({_LOW}, lambda w: w <> '' AND contains(blob, w))) > 0""")
def _p_lists(spark, sf_dir):
    return quality.keyword_lists(_keyed(spark, sf_dir), F.col("blob")).select("id", "message")


@_report("p_identifiers", f"SELECT id, 'bad: ' || part AS message FROM {_PARTS} WHERE NOT regexp_matches(part, {_q(quality.DOI_SHAPE)})")
def _p_identifiers(spark, sf_dir):
    return quality.identifiers(_keyed(spark, sf_dir)).select("id", "message")


@query(f"SELECT part AS doi, array_to_string(list_sort(list(DISTINCT id)), '|') AS ids FROM {_PARTS} GROUP BY part HAVING count(DISTINCT id) > 1")
def p_shared(spark, sf_dir):
    return quality.shared_identifiers(_keyed(spark, sf_dir)).select("doi", F.array_join(F.col("ids").cast("array<string>"), "|").alias("ids"))


_VARIANTS = "(SELECT p_name AS value FROM part UNION ALL SELECT upper(p_name) FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT replace(p_name, ' ', '-') FROM part WHERE p_size > 25 UNION ALL SELECT p_brand FROM part)"


@query(f"SELECT key, array_to_string(list_sort(list(value)), '|') AS variants FROM (SELECT DISTINCT value, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS key FROM {_VARIANTS}) GROUP BY key HAVING count(*) > 1")
def a_near_dup(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    values = part.selectExpr("explode(array(p_name, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) END, CASE WHEN p_size > 25 THEN replace(p_name, ' ', '-') END, p_brand)) AS value")
    return quality.near_duplicate_values(values).select("key", F.array_join("variants", "|").alias("variants"))


# -- links of pages --------------------------------------------------------------------------------------------------
GATE = "safelinks.example.org"
_ORIGIN = "regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)"
_LINKS = f"""(SELECT id, pos - 1 AS pos, {_ORIGIN} || hrefs[pos] AS href, texts[pos] AS anchorText FROM (SELECT page_id AS id, url, unnest(range(1, len(hrefs) + 1)) AS pos, hrefs, texts
  FROM (SELECT *, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages)))"""
SHEET = [
    "id * 100000 + pos AS ord", "href AS url",
    """CASE length(href) % 12 WHEN 0 THEN 'Live' WHEN 1 THEN 'dead' WHEN 2 THEN 'DEAD ' WHEN 3 THEN 'Closed' WHEN 4 THEN 'gated (login)' WHEN 5 THEN 'Unreachable' WHEN 6 THEN 'odd'
      WHEN 7 THEN 'dead (domain hijacked)' WHEN 8 THEN 'Email contact, not a link' WHEN 9 THEN NULL ELSE 'live' END AS status""",
    "CASE WHEN length(anchorText) % 5 = 0 THEN 'Safe to drop' WHEN length(anchorText) % 5 = 1 THEN '' END AS recovery",
    "CASE WHEN length(anchorText) % 7 = 0 THEN 'https://web.archive.org/' || href WHEN length(anchorText) % 7 = 1 THEN 'https://n.org/' || anchorText WHEN length(anchorText) % 7 = 2 THEN '' END AS replacement",
]
_S = "lower(trim(coalesce(status, '')))"
_GONE = " OR ".join(f"{_S} = {_q(s)}" for s in links.DROP_STATUSES)
_KNOWN = f"""(SELECT url, CASE WHEN coalesce(replacement, '') <> '' THEN replacement WHEN gone THEN NULL WHEN alive THEN url WHEN {_S} LIKE 'dead%' THEN NULL ELSE url END AS final,
  CASE WHEN coalesce(replacement, '') <> '' THEN CASE WHEN contains(replacement, '{links.ARCHIVE}') THEN 'archived' ELSE 'alternate' END WHEN gone THEN 'unavailable' WHEN alive THEN 'live'
  WHEN {_S} LIKE 'dead%' THEN 'unavailable' ELSE 'live' END AS status FROM (SELECT *, lower(trim(coalesce(recovery, ''))) = 'safe to drop' OR {_GONE}
  OR {_S} LIKE 'dead (domain hijacked)%' AS gone, {_S} LIKE 'live%' OR {_S} = 'closed' OR {_S} LIKE 'gated%' AS alive, row_number() OVER (PARTITION BY url ORDER BY ord DESC) AS r
  FROM {_from(_LINKS, SHEET)} WHERE url <> '') WHERE r = 1)"""
#: Every second link was sought and is in the sheet's answers.
_SOME = f"(SELECT * FROM {_KNOWN} WHERE length(url) % 2 = 0)"
_RESOLVED = f"(SELECT l.id, l.pos, CASE WHEN k.status IS NOT NULL THEN k.final ELSE l.href END AS url, coalesce(k.status, 'live') AS st FROM {_LINKS} l LEFT JOIN {_SOME} k ON k.url = l.href WHERE k.status IS NULL OR k.final IS NOT NULL)"
_WANTED = f"(SELECT id, href AS url FROM {_LINKS} WHERE pos = 2 AND id % 3 = 0)"
_REBUILT = f"""(SELECT p.page_id AS id, p.url AS old, coalesce(w.url, f.url, p.url) AS url, coalesce(w.st, f.st, 'live') AS urlStatus, f.n FROM pages p
  LEFT JOIN (SELECT id, arg_min(url, pos) AS url, arg_min(st, pos) AS st, count(*) AS n FROM {_RESOLVED} GROUP BY id) f ON f.id = p.page_id
  LEFT JOIN (SELECT r.id, arg_min(r.url, r.pos) AS url, arg_min(r.st, r.pos) AS st FROM {_RESOLVED} r JOIN {_WANTED} x ON x.id = r.id AND x.url = r.url GROUP BY r.id) w ON w.id = p.page_id)"""


def _links(spark, sf_dir):
    return links.page_links(V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", "html"))


def _known(spark, sf_dir):
    return links.resolutions(_links(spark, sf_dir).selectExpr(*SHEET))


def _rebuild(spark, sf_dir):
    """Items, resolved links and rebuilt items, from the pages' own anchors."""
    found = _links(spark, sf_dir)
    none = F.lit(None).cast("array<struct<url:string,anchorText:string,urlStatus:string>>")
    items = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.lit("live").alias("urlStatus"), none.alias("links"))
    resolved = links.resolved_links(found.withColumn("unwrapped", X.unwrap(F.col("href"), GATE)), _known(spark, sf_dir).where("length(url) % 2 = 0"))
    wanted = found.where("pos = 2 AND id % 3 = 0").select("id", F.col("href").alias("url"))
    return items, resolved, links.rebuilt(items, resolved, wanted)


@query(f"SELECT * FROM {_LINKS}")
def l_anchors(spark, sf_dir):
    return _links(spark, sf_dir)


@query(f"SELECT * FROM {_KNOWN}")
def l_resolve(spark, sf_dir):
    return _known(spark, sf_dir)


@query(f"SELECT id, url, urlStatus, n FROM {_REBUILT}")
def l_primary(spark, sf_dir):
    return _rebuild(spark, sf_dir)[2].select("id", "url", "urlStatus", F.when(F.col("links").isNotNull(), F.size("links")).alias("n"))


@query(f"SELECT count(*) FILTER (WHERE n IS NOT NULL) AS changed, count(*) FILTER (WHERE n > 1) AS multi_link, count(*) FILTER (WHERE n IS NOT NULL AND (url <> old OR urlStatus <> 'live')) AS primary_fixed FROM {_REBUILT}")
def l_counters(spark, sf_dir):
    items, resolved, after = _rebuild(spark, sf_dir)
    return links.rebuild_counters(items, after, resolved)


WRAPPED = ["page_id AS id", f"CASE page_id % 3 WHEN 0 THEN 'https://g.{GATE}/?url=' || replace(replace(url, ':', '%3A'), '/', '%2F') || '&data=2' WHEN 1 THEN 'https://g.{GATE}/?d=1' ELSE url END AS url"]


@query(f"""SELECT id, CASE WHEN contains(url, '{GATE}') AND regexp_matches(url, '[?&]url=[^&#]') THEN replace(replace(regexp_extract(url, '[?&]url=([^&#]+)', 1), '%3A', ':'), '%2F', '/') ELSE url END AS url
  FROM {_from('pages', WRAPPED)}""")
def l_unwrap(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").selectExpr(*WRAPPED).select("id", X.unwrap(F.col("url"), GATE).alias("url"))


CHOICES = ["page_id AS id", "CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN '' ELSE url END AS url", f"CASE page_id % 4 WHEN 0 THEN 'https://{links.ARCHIVE}/' || url WHEN 1 THEN 'https://n.org/' WHEN 2 THEN '' END AS replacement"]


@query(f"""SELECT id, CASE WHEN replacement <> '' THEN replacement WHEN url <> '' THEN url END AS url, CASE WHEN contains(replacement, '{links.ARCHIVE}') THEN 'archived' WHEN replacement <> '' THEN 'alternate'
  WHEN url <> '' THEN 'live' ELSE 'unavailable' END AS status FROM {_from('pages', CHOICES)}""")
def l_choice(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").selectExpr(*CHOICES).select("id", links.chosen_url(F.col("url"), F.col("replacement")).alias("c")).select("id", "c.url", "c.status")


# -- lists and identifiers -------------------------------------------------------------------------------------------
_TURN = "conv_id * 1000 + turn AS id"
_FIRSTS = "list_filter({0}, lambda v, i: list_position(list_transform({0}, lambda z: lower(z)), lower(v)) = i)"
_PEOPLE = f"(SELECT {_TURN}, list_filter(list_transform(string_split(replace(text, ' ', ' ;'), ';'), lambda p: trim(p)), lambda p: p <> '') AS l FROM conversations)"


@query(f"SELECT id, array_to_string({_FIRSTS.format('l')}, '|') AS people FROM {_PEOPLE}")
def l_people(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations").selectExpr(_TURN, "replace(text, ' ', ' ;') AS people")
    return rows.select("id", F.array_join(X.distinct_ignoring_case(X.split_list(F.col("people"))), "|").alias("people"))


_SHOWN = _SHOWS.format("v")


@query(f"SELECT id, array_to_string((list_filter(l, lambda v: {_SHOWN}) || list_filter(l, lambda v: NOT ({_SHOWN})))[1:4], '|') AS topics FROM (SELECT {_TURN}, string_split(text, ' ') AS l FROM conversations)")
def x_topics_order(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations").selectExpr(_TURN, "split(text, ' ') AS topics")
    return rows.select("id", F.array_join(X.topics_in_order(F.col("topics"), WORDS.split()), "|").alias("topics"))


CITED = [
    "event_id AS id", "CASE event_id % 5 WHEN 0 THEN '10.1/' || event_type || '; 10.2/' || CAST(user_id AS STRING) WHEN 1 THEN '10.1/a;10.1/a' WHEN 2 THEN '10.3/c' WHEN 3 THEN ' ; ' END AS doi",
    "CASE event_id % 3 WHEN 0 THEN 'x;y' WHEN 1 THEN 'x' END AS citations", "CASE WHEN event_id % 2 = 0 THEN 'https://DOI.org/10.9/' || event_type ELSE 'https://a.org' END AS url",
    "event_type || ' of 10.2/' || CAST(user_id % 40 AS STRING) AS summary",
]
_CITED = _from("events", CITED)
_DOIS = "list_filter(list_transform(string_split(coalesce(doi, ''), ';'), lambda d: trim(d)), lambda d: d <> '')"
_N = f"CASE WHEN len(list_distinct({_DOIS})) >= 2 AND len(list_distinct({_DOIS})) = len(string_split(citations, ';')) THEN len(list_distinct({_DOIS})) END"


def _cited(spark, sf_dir):
    return V.table(spark, sf_dir, "events").selectExpr(*CITED)


@query(f"SELECT id, CASE WHEN len({_DOIS}) > 0 THEN array_to_string({_DOIS}, '|') ELSE regexp_extract(url, '(?i)doi\\.org/(.+)$', 1) END AS dois, {_N} AS papers FROM {_CITED}")
def l_doi(spark, sf_dir):
    papers = X.cited_papers(F.col("doi"), F.col("citations"))
    return _cited(spark, sf_dir).select("id", F.array_join(X.dois(F.col("doi"), F.col("url")), "|").alias("dois"), F.when(papers.isNotNull(), F.size(papers)).alias("papers"))


@query(f"SELECT id, {_N} IS NOT NULL AND len(list_filter({_DOIS}, lambda d: contains(summary, d))) > 0 AS dump FROM {_CITED}")
def x_citation_dump(spark, sf_dir):
    return _cited(spark, sf_dir).select("id", X.citation_dump(F.col("summary"), X.cited_papers(F.col("doi"), F.col("citations"))).alias("dump"))


DOI = ["event_id AS id", "CASE event_id % 4 WHEN 0 THEN '10.1/' || event_type WHEN 1 THEN 'HTTP://dx.doi.org/10.1/' || event_type WHEN 2 THEN 'https://doi.org/10.1/b' END AS doi"]


@query(f"SELECT id, CASE WHEN doi IS NOT NULL THEN 'https://doi.org/' || substr(doi, strpos(doi, '10.')) END AS url FROM {_from('events', DOI)}")
def x_doi_url(spark, sf_dir):
    return V.table(spark, sf_dir, "events").selectExpr(*DOI).select("id", X.doi_url(F.col("doi")).alias("url"))


ACTIONS = ["event_id AS id", "CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN '' ELSE event_type END AS url", "event_id % 3 = 0 AS dump", "CAST(event_id % 4 AS INT) AS n", "CASE WHEN value > 20 THEN 'archived' ELSE 'live' END AS status"]


@query(f"SELECT id, CASE WHEN coalesce(url, '') = '' THEN 'no link' WHEN dump OR n > 1 THEN NULL WHEN status = 'archived' THEN 'view archived' ELSE 'view' END AS action FROM {_from('events', ACTIONS)}")
def x_call_to_action(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").selectExpr(*ACTIONS)
    return rows.select("id", links.call_to_action(F.col("url"), F.col("dump"), F.col("n"), F.col("status")).alias("action"))


# -- terms -----------------------------------------------------------------------------------------------------------
@query(f"SELECT {_TURN}, text FROM conversations")
def t_inverted_index(spark, sf_dir):
    """Each turn's words by their places, and back."""
    rows = V.table(spark, sf_dir, "conversations").selectExpr(_TURN, "split(text, ' ') AS w")
    index = "map_from_entries(transform(array_distinct(w), x -> struct(x, filter(transform(w, (y, i) -> CASE WHEN y = x THEN i END), i -> i IS NOT NULL))))"
    return rows.selectExpr("id", f"{index} AS index").select("id", X.inverted_index_text(F.col("index")).alias("text"))


_NAME = "p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_type || ')' ELSE '' END"


@query("SELECT p_brand AS id, coalesce(string_agg(p_name, '|' ORDER BY p_partkey) FILTER (WHERE p_size >= 25 AND p_size % 3 >= 1), '') AS names FROM part GROUP BY p_brand")
def t_concepts(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").selectExpr("p_brand AS id", f"struct(p_partkey, {_NAME} AS display_name, p_size / 50.0D AS score, p_size % 3 AS level) AS c")
    works = part.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("concepts"))
    return works.select("id", F.array_join(mining.concepts(F.col("concepts")), "|").alias("names"))


_TERMS = f"(SELECT {_TURN}, role || ' said the la der' AS blob, string_split(text, ' ') AS l FROM conversations)"
_NEW = _FIRSTS.format("l") + ""


@query(f"SELECT id, array_to_string(list_filter({_NEW}, lambda v: trim(v) <> '' AND NOT contains(blob, lower(trim(v))))[1:{mining.MOST}], '|') AS terms FROM {_TERMS}")
def t_merged(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations").selectExpr(_TURN, "role || ' said the la der' AS blob", "split(text, ' ') AS l")
    return rows.select("id", F.array_join(mining.merged(F.col("l"), F.col("blob")), "|").alias("terms"))


_COVERED = f"(SELECT {_TURN}, array_to_string(w[1:2], ' ') AS phrase, w FROM (SELECT *, string_split(text, ' ') AS w FROM conversations))"


@query(f"SELECT id, array_to_string([phrase] || list_filter(w, lambda x: NOT (contains(phrase, ' ') AND list_contains(string_split(lower(phrase), ' '), lower(x)))), '|') AS terms FROM (SELECT * REPLACE (list_filter(w, lambda x: NOT regexp_matches(x, '\\s')) AS w) FROM {_COVERED} WHERE NOT regexp_matches(phrase, '[^\\S ]'))")
def t_covered_words(spark, sf_dir):
    """A turn's first two words as a phrase, and all words singly; turns with other white space in the phrase are of no use here."""
    rows = V.table(spark, sf_dir, "conversations").selectExpr(_TURN, "split(text, ' ') AS w")
    rows = rows.selectExpr("id", "array_join(slice(w, 1, 2), ' ') AS phrase", r"filter(w, x -> NOT x RLIKE '\\s') AS w").where(r"NOT phrase RLIKE '[^\\S ]'")
    return rows.select("id", F.array_join(mining.without_covered_words(F.concat(F.array("phrase"), F.col("w"))), "|").alias("terms"))


_WORD = "0-9A-Za-zÀ-ÖØ-öø-ÿ"
_ANCHOR = "la"


@query(f"""SELECT id, CASE WHEN hit THEN n || '-' || (n + {len(_ANCHOR)}) || ' u' || id ELSE '' END AS spans, text FROM (SELECT {_TURN}, text, regexp_matches(text, '(?:^|[^{_WORD}]){_ANCHOR}(?:$|[^{_WORD}])') AS hit,
  length(regexp_extract(text, '(?s)^((?:.*?[^{_WORD}])??){_ANCHOR}(?:$|[^{_WORD}])', 1)) AS n FROM conversations)""")
def x_anchors(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations").selectExpr(_TURN, "text", f"array('{_ANCHOR}', '') AS anchors").withColumn("urls", F.array(F.concat(F.lit("u"), F.col("id").cast("string")), F.lit("none")))
    spans = F.transform("s", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(" "), s["url"]))
    return rows.withColumn("s", links.anchor_spans("text", "anchors", "urls")).select("id", F.array_join(spans, ",").alias("spans"), "text")


# -- routes of enrichment --------------------------------------------------------------------------------------------
ROUTES = [
    "doc_id AS id", "CASE WHEN doc_id % 5 = 0 THEN split('d', ',') END AS doi_terms", "CASE WHEN doc_id % 7 = 0 THEN split('v', ',') END AS video_terms",
    "CASE WHEN doc_id % 4 = 1 THEN 'Just a moment: ' || text WHEN doc_id % 11 = 2 THEN 'short' ELSE text END AS page_text", "source AS page_meta", "CASE WHEN doc_id % 6 <> 1 THEN split(lang, ',') END AS page_terms", "doc_id % 9 = 0 AS failed",
]
_PAGE = " OR ".join(f"contains(lower(page_text), {_q(m)})" for m in mining.BLOCK_MARKERS)


@query(f"""SELECT id, status, CASE WHEN doi_terms IS NOT NULL THEN 'doi' WHEN video_terms IS NOT NULL THEN 'video' WHEN status = 'ok' THEN 'page' END AS via,
  array_to_string(CASE WHEN doi_terms IS NOT NULL THEN doi_terms WHEN video_terms IS NOT NULL THEN video_terms WHEN status = 'ok' THEN page_terms END, '|') AS keywords
  FROM (SELECT *, CASE WHEN doi_terms IS NOT NULL OR video_terms IS NOT NULL THEN 'ok' WHEN failed THEN 'failed' WHEN {_PAGE} THEN 'blocked'
  WHEN length(page_text) < {mining.THIN_BODY} AND length(page_meta) < {mining.THIN_META} OR page_terms IS NULL THEN 'low_yield' ELSE 'ok' END AS status FROM {_from('documents', ROUTES)})""")
def m_routes(spark, sf_dir):
    return mining.routed(V.table(spark, sf_dir, "documents").selectExpr(*ROUTES)).withColumn("keywords", F.array_join("keywords", "|"))


# -- embedding build -------------------------------------------------------------------------------------------------
#: A model of the documents' own most frequent words: so many whole words, so many numbers each.
VOCABULARY, DIM = 200, 8
_TOKENS = f"regexp_extract_all(lower(strip_accents(trim(trim(split_part(text, '.', 1)) || '. ' || trim(text), '. '))), {_q(f'[{encoding.PUNCTUATION}]|[^ {chr(92)}n{encoding.PUNCTUATION}]+')})"
_WORDS_OF = f"(SELECT doc_id AS id, unnest({_TOKENS}) AS token FROM documents)"
_VOCABULARY = f"(SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS token_id FROM {_WORDS_OF} GROUP BY token QUALIFY token_id <= {VOCABULARY})"
_SUMS = ", ".join(f"sum((coalesce(token_id, 0) * {k} % 11 - 5) * 0.5::DOUBLE) / count(*) AS m{k}" for k in range(1, DIM + 1))
_NORM = f"sqrt({' + '.join(f'm{k} * m{k}' for k in range(1, DIM + 1))})"


@query(f"""SELECT id, array_to_string([{', '.join(f'round(m{k} / ({_NORM} + 1e-32), 6)::DECIMAL(9, 6)' for k in range(1, DIM + 1))}], ',') AS vector, id % 3 = 0 OR id % 100 = 1 AS encoded
  FROM (SELECT id, {_SUMS} FROM {_WORDS_OF} LEFT JOIN {_VOCABULARY} USING (token) GROUP BY id) UNION ALL
  SELECT doc_id, '{','.join(['0.000000'] * DIM)}', doc_id % 3 = 0 OR doc_id % 100 = 1 FROM documents WHERE doc_id NOT IN (SELECT id FROM {_WORDS_OF})""")
def s_build(spark, sf_dir):
    """Two builds of the documents' vectors: at first a third of the items isn't there yet and a hundredth has another text; the second
    encodes these alone. The vocabulary is of fixed size and goes along with the encoder."""
    items = V.texts(spark, sf_dir)
    counted = encoding.token_counts(items.select(encoding.item_text(F.col("title"), F.col("summary")).alias("text")))
    vocabulary = {r.token: n + 1 for n, r in enumerate(counted.orderBy(F.desc("n"), "token").limit(VOCABULARY).collect())}
    rows = spark.createDataFrame([(i, [(i * k) % 11 - 5 for k in range(1, DIM + 1)], 0.5) for i in range(len(vocabulary) + 1)], "token_id int, q array<tinyint>, scale float")
    encoder = lambda texts: encoding.encode_texts(texts, encoding.Model(DIM, 0), vocabulary, rows)
    store = catalogue.Snapshots(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    before = items.where("id % 3 <> 0").withColumn("summary", F.when(F.col("id") % 100 == 1, "another text").otherwise(F.col("summary")))
    for version, some in (("2026-01", before), ("2026-02", items)):
        if not embedding_build.build(store, some, encoder, "words", DIM, version):
            raise ValueError("items and vectors have different ids")
    vector = F.array_join(F.transform("vector", lambda x: F.round(x, 6).cast("decimal(9,6)").cast("string")), ",")
    return store.read("2026-02").select("id", vector.alias("vector"), (F.col("encoded_in") == "2026-02").alias("encoded"))


# -- markup ----------------------------------------------------------------------------------------------------------
# Pages as they are, and with nested hidden elements, entities, and metas in single quotes or in none.
MARKED = """replace(replace(replace(html, '<meta charset="utf-8">', '<META content=''of ' || CAST(page_id AS STRING) || ' &eacute;&#233;'' name=description><meta property=og:title content=' || CAST(page_id AS STRING) || '>'),
  '<nav>', '<nav class="a>b"><nav>inner</nav>'), '<article>', '<article>&Auml;<header><form>h</header>')"""
_SHOWN = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
for _tag in X.HIDDEN_TAGS:
    _SHOWN = f"regexp_replace({_SHOWN}, '<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'gis')"


def _entities_sql(x: str) -> str:
    """Entities that the pages have; HTML lets these do without their semicolon."""
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{entity};?', '{char}', 'g')"
    return x


def _read_sql(shown: str, meta: str) -> str:
    title = _squeeze_sql(_entities_sql("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')"))
    body = _squeeze_sql(_entities_sql(f"regexp_replace({shown}, '<[^>]+>', ' ', 'g')"))
    return f"SELECT id, title, meta, body, meta || ' ' || body AS full FROM (SELECT page_id AS id, {title} AS title, trim({title} || {meta}) AS meta, {body} AS body FROM pages)"


@query(_read_sql(_SHOWN, "''"))
def m_page_text(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), page_text(F.col("html")).alias("p")).select("id", "p.*")


@query(_read_sql(_SHOWN.replace("html", "replace(html, '<article>', '<article>Ä')", 1), "' of ' || page_id || ' éé ' || page_id"))
def m_page_meta(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.expr(MARKED).alias("html"))
    return pages.select("id", page_text(F.col("html")).alias("p")).select("id", "p.*")


# -- conformance -----------------------------------------------------------------------------------------------------
SCHEMA = {
    "definitions": {"item": {
        "type": "object", "required": quality.REQUIRED, "additionalProperties": False,
        "properties": {
            "id": {"type": "integer", "minimum": 10}, "title": {"type": "string", "pattern": r"\S"}, "summary": {"type": "string", "minLength": 1},
            "contentType": {"type": ["string", "null"], "enum": ["Event", "Video"]}, "topics": {"type": "array", "items": {"type": "string"}, "minItems": 1},
            "locations": {"type": "array"}, "croppingSystems": {"type": "array", "items": {"type": "string"}},
            "deep": {"properties": {"a": {"items": {"type": "object", "additionalProperties": False, "properties": {"notes": {}}}}}},
            "props": {"$ref": "#/definitions/props"},
        },
    }, "props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 49, "not": {"enum": [7, 11]}}}}},
}
_K = "(raw ->> '$.props.k')::BIGINT"
_WRONG = " UNION ALL ".join([
    *(f"SELECT id, '' AS path, 'required' AS rule, '{k}' AS said FROM {_ITEMS} WHERE json_type(raw, '$.{k}') IS NULL" for k in quality.REQUIRED),
    f"SELECT id, '', 'additionalProperties', 'Curator Notes ' FROM {_ITEMS} WHERE json_type(raw, '$.\"Curator Notes \"') IS NOT NULL",
    f"SELECT id, '/id', 'minimum', '10' FROM {_ITEMS} WHERE (raw ->> '$.id')::BIGINT < 10",
    f"SELECT id, '/title', 'pattern', '\\S' FROM {_ITEMS} WHERE NOT regexp_matches(raw ->> '$.title', '\\S')",
    f"SELECT id, '/summary', 'minLength', '1' FROM {_ITEMS} WHERE length(raw ->> '$.summary') < 1",
    f"SELECT id, '/contentType', 'enum', 'not one of the values' FROM {_ITEMS} WHERE json_type(raw, '$.contentType') = 'NULL'",
    f"SELECT id, '/topics', 'minItems', '1' FROM {_ITEMS} WHERE json_array_length(raw, '$.topics') < 1",
    f"SELECT id, '/deep/a/0', 'additionalProperties', 'internalNotes' FROM {_ITEMS} WHERE json_type(raw, '$.deep.a[0].internalNotes') IS NOT NULL",
    f"SELECT id, '/props/k', 'maximum', '49' FROM {_ITEMS} WHERE {_K} > 49", f"SELECT id, '/props/k', 'not', 'fits what it must not' FROM {_ITEMS} WHERE {_K} IN (7, 11)",
])


@query(_WRONG)
def v_conformance(spark, sf_dir):
    """All that is wrong with the events' items by a schema document."""
    return conformance.violations(_items(spark, sf_dir), SCHEMA, part="#/definitions/item")


@_report("v_conformance_report", f"""SELECT id, message FROM (SELECT id, path || ': ' || rule || ' ' || said AS message FROM ({_WRONG}) ORDER BY id, message LIMIT 25)
  UNION ALL SELECT NULL, (n - 25) || ' more errors not shown' FROM (SELECT count(*) AS n FROM ({_WRONG})) WHERE n > 25""")
def _v_conformance_report(spark, sf_dir):
    return conformance.conformance(_items(spark, sf_dir), SCHEMA, part="#/definitions/item").select("id", "message")


# -- export as a job -------------------------------------------------------------------------------------------------
_IDS = "doc_id % 7 <> 0"


@query(f"""SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 5 = 1 THEN 'removed' ELSE 'updated' END AS change FROM documents
  WHERE {_IDS} AND (doc_id % 5 IN (0, 1) OR doc_id % 5 = 2 AND lang <> 'xx')""")
def m_export_job(spark, sf_dir):
    """Changes that the second of two exports of the documents logged: a fifth came, a fifth went, a fifth has another type. Secrets
    in the texts would stop both, so that the gate is on ids and the schema."""
    docs = V.table(spark, sf_dir, "documents")
    store = catalogue.Snapshots(spark, f"{shared_dir(spark)}/export-{uuid.uuid4().hex}")
    before = docs.where("doc_id % 5 <> 0").withColumn("lang", F.when(F.col("doc_id") % 5 == 2, "xx").otherwise(F.col("lang")))
    schema = {"definitions": {"item": {"type": "object", "required": quality.REQUIRED, "properties": {"id": {"type": "string", "pattern": "^[0-9]+$"}, "topics": {"type": "array"}, "url": {"type": ["string", "null"]}}}}}

    def judge(items, previous):
        rows = items.withColumns({"ord": F.monotonically_increasing_id(), "raw": F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"})})
        return quality.ids(rows).unionAll(conformance.conformance(rows, schema, part="#/definitions/item"))

    for version, some in (("2026-01", before), ("2026-02", docs.where("doc_id % 5 <> 1"))):
        if not export_job.export(store, curated(some), "2026-04-01", datetime(2026, int(version[-2:]), 2, tzinfo=timezone.utc), version, judge):
            raise ValueError("the export was judged bad")
    return export_job.changes(store).select("id", "change")
