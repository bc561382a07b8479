"""Scalar text functions as Columns: folding, terms, words, markup, URLs, identifiers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that a query word may lack.
SUFFIXES = ["'s", "es", "ers", "er", "ing", "ed", "s", "d"]
# Patterns of words and of capitalised phrases.
WORD = r"[a-zA-Z][a-zA-Z\-']*[a-zA-Z]"
CAPITALISED = r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3}\b"
DISPLAY_WORD = "[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)*"
#: White space of the query language; Java's \s lacks most of these.
SPACE = r"[\s   -     　﻿]+"
_SUFFIX = "(?:" + "|".join(SUFFIXES) + ")?"


def _fold_table() -> tuple[str, str]:
    """Characters of the basic plane that decompose into one character and marks of U+0300-U+036F; marks go to nothing."""
    source, target = [], []
    for code in range(0x80, 0xFFFF):
        if 0xD800 <= code < 0xE000 or 0x300 <= code <= 0x36F:
            continue
        plain = [c for c in unicodedata.normalize("NFD", chr(code)) if not "̀" <= c <= "ͯ"]
        if len(plain) == 1 and plain[0] != chr(code):
            source.append(chr(code))
            target.append(plain[0])
    return "".join(source) + "".join(map(chr, range(0x300, 0x370))), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def fold(text: Column) -> Column:
    """Without accents; letters that don't decompose (ß, ø) stay."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def fold_python(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")


def escape_regex(text: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\/" else c for c in text)


def query_terms(q: str) -> list[str]:
    """Words of a query, lower case and folded; a repeated word stays repeated."""
    import re

    return [w for w in re.split(SPACE, fold_python(q.strip().lower())) if w]


def _edge(before: bool, char: str) -> str:
    """A word boundary of ASCII words at a side of a term, by the term's character there."""
    word = char.isascii() and (char.isalnum() or char == "_")
    if before:
        return "(?<![A-Za-z0-9_])" if word else "(?<=[A-Za-z0-9_])"
    return "(?![A-Za-z0-9_])" if word else "(?=[A-Za-z0-9_])"


def term_pattern(term: str) -> str:
    """The term or the term with a suffix, between ASCII word boundaries. A suffix ends in a letter whatever the term ends in."""
    bare = f"{escape_regex(term)}{_edge(False, term[-1])}"
    suffixed = f"{escape_regex(term)}(?:{'|'.join(SUFFIXES)})(?![A-Za-z0-9_])"
    return f"{_edge(True, term[0])}(?:{suffixed}|{bare})"


def term_pattern_sql(term: str) -> str:
    """The same for engines whose \\b is ASCII and that lack lookaround."""
    return r"\b" + escape_regex(term) + _SUFFIX + r"\b"


def has_term(folded: Column, term: str) -> Column:
    """The literal test first: it is cheap and rules out most rows."""
    return folded.contains(term) & folded.rlike(term_pattern(term))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _ascii_terms(words: list[str]) -> list[str]:
    return [w for w in words if w.isascii()]


def display_match(words: list[str]) -> str:
    """Pattern of a whole display word that starts with a query word and adds nothing or a suffix."""
    usable = _ascii_terms(words)
    return f"(?:{'|'.join(map(escape_regex, usable))}){_SUFFIX}" if usable else r"[^\s\S]"


def highlight(text: Column, words: list[str]) -> Column:
    """Markup with matching words in <mark>. Words are fenced by control characters first, so that matching sees whole words."""
    text = F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03\x04", "")  # the fences are ours alone
    text = F.regexp_replace(text, f"({DISPLAY_WORD})", "\x01$1\x02")
    text = F.regexp_replace(text, f"(?i)\x01({display_match(words)})\x02", "\x03$1\x04")
    text = escape_html(F.translate(text, "\x01\x02", ""))
    return F.replace(F.replace(text, F.lit("\x03"), F.lit("<mark>")), F.lit("\x04"), F.lit("</mark>"))


def shows_match(text: Column, words: list[str]) -> Column:
    """Whether highlight() would mark anything."""
    return F.exists(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({DISPLAY_WORD})")), lambda w: w.rlike(f"(?i)^{display_match(words)}$"))


def matching_values(values: Column, terms: list[str]) -> Column:
    """The values in which any term matches."""
    hit = lambda v: _any([has_term(fold(F.lower(v)), t) for t in terms])
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), hit)


def hidden_matches(visible: list[Column], hidden: list[Column], words: list[str], terms: list[str], most: int = 4) -> Column:
    """Values of the hidden lists that explain a hit of which nothing visible tells; the first `most`, ignoring case."""
    found = F.concat(*[matching_values(h, terms) for h in hidden])
    nothing = F.array().cast("array<string>")
    return F.when(_any([shows_match(v, words) for v in visible]), nothing).otherwise(F.slice(distinct_ignoring_case(found), 1, most))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def distinct_ignoring_case(values: Column) -> Column:
    """The first of values that differ in case only; order is kept."""
    def add(seen: Column, v: Column) -> Column:
        known = F.exists(seen, lambda s: F.lower(s) == F.lower(v))
        return F.when(known, seen).otherwise(F.concat(seen, F.array(v)))

    return F.aggregate(values, F.array().cast("array<string>"), add)


def split_list(text: Column, separator: str = ";") -> Column:
    """Trimmed parts that aren't empty."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def topics_in_order(topics: Column, words: list[str], cap: int = 4) -> Column:
    """Matched topics first, both parts in their own order."""
    topics = F.coalesce(topics, F.array().cast("array<string>"))
    return F.slice(F.concat(F.filter(topics, lambda t: shows_match(t, words)), F.filter(topics, lambda t: ~shows_match(t, words))), 1, cap)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")


# Elements without readable content.
HIDDEN_TAGS = ["script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg"]
META_NAMES = ["description", "og:description", "og:title", "keywords"]


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def unescape_html(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_title(html: Column) -> Column:
    return squeeze(unescape_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_body(html: Column) -> Column:
    """Readable text of a page, white space squeezed."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in HIDDEN_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return squeeze(unescape_html(F.regexp_replace(html, "<[^>]+>", " ")))


def html_meta(html: Column) -> Column:
    """Title and the contents of known metas, `name` before `property`, either order of attributes."""
    bits = [html_title(html)]
    for name in META_NAMES:
        tries = []
        for attribute in ("name", "property"):
            tries.append(F.regexp_extract(html, rf'(?is)<meta\s[^>]*{attribute}="{name}"[^>]*content="([^"]*)"', 1))
            tries.append(F.regexp_extract(html, rf'(?is)<meta\s[^>]*content="([^"]*)"[^>]*{attribute}="{name}"', 1))
        bits.append(F.coalesce(*[F.nullif(t, F.lit("")) for t in tries]))
    return squeeze(unescape_html(F.concat_ws(" ", *bits)))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))), r"^www\.", "")


def doi_url(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), F.regexp_replace(doi, r"(?i)^https?://(dx\.)?doi\.org/", ""))


def dois(doi: Column, url: Column) -> Column:
    """Listed identifiers, else the one in the URL."""
    listed, found = split_list(doi), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)doi\.org/(.+)$", 1)
    return F.when(F.size(listed) > 0, listed).when(found != "", F.array(found)).otherwise(F.array().cast("array<string>"))


def cited_papers(doi: Column, citations: Column) -> Column:
    """Pairs of identifier and citation if there are two or more of either and as many of both; else null."""
    ids, texts = F.array_distinct(split_list(doi)), split_list(citations)
    pairs = F.zip_with(ids, texts, lambda d, c: F.struct(d.alias("doi"), c.alias("citation")))
    return F.when((F.size(ids) >= 2) & (F.size(ids) == F.size(texts)), pairs)


def citation_dump(summary: Column, papers: Column) -> Column:
    """Whether a summary is but the cited papers run together: it holds the identifier of one of them."""
    return F.coalesce(F.exists(papers, lambda p: F.coalesce(summary, F.lit("")).contains(p["doi"])), F.lit(False))


def unwrap(url: Column, host: str) -> Column:
    """The decoded `url` parameter of a mail gateway's link; other links unchanged."""
    inner = F.try_url_decode(F.regexp_extract(url, r"[?&]url=([^&#]+)", 1))
    return F.when(url.contains(host) & (F.coalesce(inner, F.lit("")) != ""), inner).otherwise(url)


def inverted_index_text(index: Column) -> Column:
    """Text of word -> positions: by position; of words at one position the later in the map."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    last = F.aggregate(entries, F.create_map().cast("map<int,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["p"]), F.create_map(e["p"], e["w"])))
    return F.array_join(F.transform(F.array_sort(F.map_entries(last)), lambda e: e["value"]), " ")


def month(date: Column) -> Column:
    return F.date_format(F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd"), "MMM yyyy")
