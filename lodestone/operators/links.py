"""Links of items: choice, resolution, rebuilding, expiry, anchors, calls to action."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The archive's host, statuses that drop a link, types that expire, days that they live.
ARCHIVE = "web.archive.org"
DROP_STATUSES = ["unresolvable wrapper", "unreachable", "email contact, not a link"]
EXPIRING_TYPES, LIFETIME_DAYS = ("Job posting", "Survey"), 90


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("url", T.StringType())]))


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def replaced_status(url: Column) -> Column:
    return F.when(url.contains(ARCHIVE), "archived").otherwise("alternate")


def chosen_url(url: Column, replacement: Column) -> Column:
    """(url, status): the replacement, else the original, else none."""
    return (
        F.when(_given(replacement), F.struct(replacement.alias("url"), replaced_status(replacement).alias("status")))
        .when(_given(url), F.struct(url.alias("url"), F.lit("live").alias("status")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("url"), F.lit("unavailable").alias("status")))
    )


def resolution(url: Column, status: Column, recovery: Column, replacement: Column) -> Column:
    """(final, status) of a checked link; final is null where the link goes."""
    s, r = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (status, recovery))
    gone = (r == "safe to drop") | s.isin(DROP_STATUSES) | s.startswith("dead (domain hijacked)")
    alive = s.startswith("live") | (s == "closed") | s.startswith("gated")
    out = lambda final, st: F.struct(final.cast("string").alias("final"), st.alias("status"))
    return (
        F.when(_given(replacement), out(replacement, replaced_status(replacement)))
        .when(gone, out(F.lit(None), F.lit("unavailable")))
        .when(alive, out(url, F.lit("live")))
        .when(s.startswith("dead"), out(F.lit(None), F.lit("unavailable")))
        .otherwise(out(url, F.lit("live")))
    )


def resolutions(sheet: DataFrame) -> DataFrame:
    """(url, final, status) of a sheet (ord, url, status, recovery, replacement); of rows with a URL the last wins."""
    solved = sheet.where(_given(F.col("url"))).withColumn("r", resolution(F.col("url"), F.col("status"), F.col("recovery"), F.col("replacement")))
    return solved.groupBy("url").agg(F.max_by("r", "ord").alias("r")).select("url", "r.final", "r.status")


def resolved_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """links (id, pos, href, unwrapped, ...) with url and urlStatus: by href, else by the unwrapped address, else live as it
    is. A known link without final address is dropped, which a test of the match tells, not of the address."""
    side = lambda key, p: known.select(F.col("url").alias(key), F.col("final").alias(f"{p}_final"), F.col("status").alias(f"{p}_status"))
    both = links.join(side("href", "a"), "href", "left").join(side("unwrapped", "b"), "unwrapped", "left")
    pick = lambda what, other: F.when(F.col("a_status").isNotNull(), F.col(f"a_{what}")).when(F.col("b_status").isNotNull(), F.col(f"b_{what}")).otherwise(other)
    return both.withColumns({"url": pick("final", F.col("unwrapped")), "urlStatus": pick("status", F.lit("live"))}).where("url is not null").drop("a_final", "a_status", "b_final", "b_status")


def rebuilt(items: DataFrame, links: DataFrame, overrides: DataFrame) -> DataFrame:
    """items with links and their primary one: an override's URL if it is among the links, else the first. Items without
    resolved links stay unchanged."""
    lists = links.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url", "anchorText", "urlStatus"))), lambda s: F.struct(s["url"].alias("url"), s["anchorText"].alias("anchorText"), s["urlStatus"].alias("urlStatus"))).alias("new"))
    out = items.join(lists, "id", "left").join(overrides.withColumnRenamed("url", "wanted"), "id", "left")
    first = F.coalesce(F.try_element_at(F.filter("new", lambda s: s["url"] == F.col("wanted")), F.lit(1)), F.try_element_at("new", F.lit(1)))
    return out.withColumns({"links": F.coalesce("new", "links"), "_url": F.coalesce(first["url"], F.col("url")), "_status": F.coalesce(first["urlStatus"], F.col("urlStatus"))}).withColumns({"url": F.col("_url"), "urlStatus": F.col("_status")}).drop("new", "wanted", "_url", "_status")


def rebuild_counters(before: DataFrame, after: DataFrame, links: DataFrame) -> DataFrame:
    """(changed, multi_link, primary_fixed) of the items that resolved links touched; before, after: items by id."""
    side = lambda df, p: df.select("id", *[F.col(c).alias(p + c) for c in ("links", "url", "urlStatus")])
    both = side(before, "old_").join(side(after, "new_"), "id").join(links.select("id").distinct(), "id", "left_semi")
    same = lambda c: F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return both.agg(F.count_if(~same("links")).alias("changed"), F.count_if(F.size("new_links") > 1).alias("multi_link"), F.count_if(~(same("url") & same("urlStatus"))).alias("primary_fixed"))


def expired(kind: Column, date: Column, today: str) -> Column:
    """Only some types expire; after LIFETIME_DAYS, or if their date can't be read."""
    prefix = F.substring(F.coalesce(date, F.lit("")), 1, 10)
    day = F.when(prefix.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(prefix, "yyyy-MM-dd"))
    return F.when(kind.isin(*EXPIRING_TYPES), F.coalesce(F.datediff(F.lit(today).cast("date"), day) > LIFETIME_DAYS, F.lit(True))).otherwise(F.lit(False))


def call_to_action(url: Column, dump: Column, n_links: Column, status: Column) -> Column:
    return F.when(_given(url) & ~dump & (n_links <= 1), F.when(status == "archived", "view archived").otherwise("view")).when(~_given(url), "no link")


@F.pandas_udf(SPANS)
def anchor_spans(text: pd.Series, anchors: pd.Series, urls: pd.Series) -> pd.Series:
    """Where each link's anchor first stands as whole words, off the spans of earlier links; others are left out."""
    def word(c: str) -> bool:
        return bool(c) and ((c.isascii() and c.isalnum()) or ("À" <= c <= "ÿ" and c not in "×÷"))

    def spans(t, names, targets):
        taken: list[dict] = []
        for name, url in zip(names, targets) if t and names is not None and targets is not None else ():
            at = t.find(name) if name else -1
            while at >= 0:
                end = at + len(name)
                clear = not word(t[at - 1 : at]) and not word(t[end : end + 1])
                if clear and all(end <= s["start"] or at >= s["end"] for s in taken):
                    taken.append({"start": at, "end": end, "url": url})
                    break
                at = t.find(name, at + 1)
        return sorted(taken, key=lambda s: s["start"])

    return pd.Series([spans(*x) for x in zip(text, anchors, urls)])


#: An anchor with its attributes and what stands in it; an address between quotes of either kind, or bare.
ANCHOR = r"(?is)<a\s[^>]*>.*?</a\s*>"
ADDRESS = r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def resolved_address(base: Column, href: Column) -> Column:
    """An anchor's address as seen from its page's: absolute ones stay, others take the page's scheme, host, folder or path."""
    page = F.regexp_replace(base, r"#.*$", "")
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    path = F.regexp_replace(page, r"\?.*$", "")
    folder = F.when(F.length(path) > F.length(origin), F.regexp_replace(path, r"[^/]*$", "")).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href == "", page).when(href.startswith("//"), F.concat(F.regexp_extract(origin, "^([^:]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("#"), F.concat(page, href)).when(href.startswith("?"), F.concat(path, href)).otherwise(F.concat(folder, href))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(id, pos, href, anchorText) of all anchors in pages (id, url, html) that have an address: the address in full, and the text in
    the anchor without markup. Within the row; a null page has none."""
    each = pages.select("id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(f"({ANCHOR})"))).alias("pos", "anchor"))
    href = F.trim(F.concat(*[F.regexp_extract("anchor", ADDRESS, i) for i in (1, 2, 3)]))
    text = F.trim(F.regexp_replace(F.regexp_replace("anchor", "<[^>]*>", ""), r"\s+", " "))
    return each.where(F.col("anchor").rlike(ADDRESS)).select("id", "pos", resolved_address(F.col("url"), href).alias("href"), text.alias("anchorText"))
