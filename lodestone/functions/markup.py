"""Text of web pages by one pass over their markup: a scanner of tokens and a stack of open elements, in Arrow batches.

Regular expressions alone can't tell which end tag closes an element that stands within another of its name. Each token is read
once and each element is pushed and popped once, so that the work is linear in a page's length, whatever its markup.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import HIDDEN_TAGS, META_NAMES

# Elements without an end tag; those whose text runs up to their own end tag; those whose text isn't read out.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW_TAGS = ["script", "style", "title", "textarea"]
SILENT_TAGS = ["rp", "rt", "template"]

# quantifiers are possessive: what was read isn't read again
TOKEN = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))
    |!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)
    |[!?][^>]*+(?:>|\Z)
    |/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)
    |/[^a-zA-Z>][^>]*+(?:>|\Z)
    |(?P<start>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[\s/=]|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)(?P<close>>|\Z))""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}
HIDDEN, VOID, SILENT, METAS = frozenset(HIDDEN_TAGS), frozenset(VOID_TAGS), frozenset(SILENT_TAGS), frozenset(META_NAMES)


def _attributes(text: str) -> dict[str, str]:
    """The first value of each name; values without their quotes, entities resolved."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]:
            value = value[1:-1]
        out.setdefault(name.lower(), entities.unescape(value))
    return out


def read_page(page: str) -> tuple[str, str, str]:
    """(title, meta, body) of a page, white space squeezed.

    body: all text outside HIDDEN_TAGS and SILENT_TAGS, the title's too, with a space wherever markup stands. title: the first
    title's. meta: the title and, of each of META_NAMES, the content of the first meta of that `name`, else of that `property`.
    Comments and declarations are no text. An end tag closes the innermost open element of its name and all in it, one without
    such an element nothing; elements left open end with what holds them. Markup that is cut off at the end is dropped.
    """
    open_, counts = [], Counter()
    hidden = silent = 0
    texts, title = [], None
    named: dict[tuple[str, str], str] = {}
    at, size = 0, len(page)

    def say(text: str) -> None:
        if text and not hidden and not silent:
            texts.append(text)

    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            say(entities.unescape(page[at:]))
            break
        say(entities.unescape(page[at:token.start()]))
        at = token.end()
        if token["cdata"] is not None:
            say(token["cdata"])
        elif token["end"]:
            name = token["end"].lower()
            while counts[name]:
                last = open_.pop()
                counts[last] -= 1
                hidden -= last in HIDDEN
                silent -= last in SILENT
                if last == name:
                    break
        elif token["start"] and token["close"]:
            name, attributes = token["start"].lower(), token["attributes"]
            if name == "meta" and not hidden:
                values = _attributes(attributes)
                for by in ("name", "property"):
                    if values.get(by) in METAS:
                        named.setdefault((by, values[by]), values.get("content", ""))
            if name in VOID or attributes.endswith("/") and not _unquoted_end(attributes):
                continue
            if name in RAW_END:
                stop = RAW_END[name].search(page, at)
                text, at = (page[at:stop.start()], stop.start()) if stop else (page[at:], size)
                if name not in HIDDEN:
                    text = entities.unescape(text)
                    say(text)
                    if name == "title" and title is None and not hidden:
                        title = text
                # its end tag closes nothing else: it was not pushed
                end = TOKEN.match(page, at)
                at = end.end() if end else at
                continue
            open_.append(name)
            counts[name] += 1
            hidden += name in HIDDEN
            silent += name in SILENT
    squeeze = lambda parts: " ".join(" ".join(parts).split())
    found = [named.get(("name", n), named.get(("property", n), "")) for n in META_NAMES]
    return squeeze([title or ""]), squeeze([title or "", *found]), squeeze(texts)


def _unquoted_end(attributes: str) -> bool:
    """Whether the last slash belongs to an unquoted value, as in <a href=x/>."""
    last = None
    for last in ATTRIBUTE.finditer(attributes):
        pass
    return last is not None and last.end() == len(attributes)


PAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "meta", "body", "full")])
ARROW = pa.struct([(c, pa.string()) for c in PAGE.names])


def _pages(pages: pa.Array) -> pa.Array:
    """Page after page: of a batch nothing but its own text and what was read is held, both by Arrow."""
    parts = []
    for page in pages:
        title, meta, body = read_page(page.as_py() or "")
        parts.append(pa.array([{"title": title, "meta": meta, "body": body, "full": f"{meta} {body}"}], ARROW))
    return pa.concat_arrays(parts) if parts else pa.array([], ARROW)


def page_text(html: Column) -> Column:
    """struct(title, meta, body, full) of a page: read_page(), and full: meta and body. A null page counts as an empty one."""
    return F.arrow_udf(_pages, PAGE)(html)
