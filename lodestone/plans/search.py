"""Hybrid search as one lazy plan: filters, keyword tiers, cosine ranking with a cut-off, reciprocal rank fusion."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import fold, has_term, query_terms
from lodestone.session import shared_dir

# Fusion constant and the semantic cut-off.
RRF_K = 60
RELATIVE, FLOOR, MOST = 0.85, 0.30, 30
LIST_FACETS = ("topics", "locations", "croppingSystems")


@dataclass(frozen=True)
class SearchRequest:
    """A query's state. facets: column -> wanted values; mode: keyword, semantic or hybrid; limit: ranks wanted, all if None."""

    q: str = ""
    facets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    date_from: str | None = None
    date_to: str | None = None
    show_expired: bool = False
    mode: str = "hybrid"
    limit: int | None = None

    def cleared(self) -> SearchRequest:
        """Without query, facets and dates; whether expired items show is kept."""
        return SearchRequest(show_expired=self.show_expired, mode=self.mode, limit=self.limit)

    def toggled(self, facet: str, value: str) -> SearchRequest:
        """With a facet's value added, or taken out if it was there."""
        old = self.facets.get(facet, ())
        new = tuple(v for v in old if v != value) if value in old else (*old, value)
        return SearchRequest(self.q, {**self.facets, facet: new}, self.date_from, self.date_to, self.show_expired, self.mode, self.limit)


def visible(show_expired: bool) -> Column:
    return F.lit(True) if show_expired else ~F.coalesce("expired", F.lit(False))


def in_facets(facets: dict[str, tuple[str, ...]], is_list: set[str] | tuple[str, ...] = LIST_FACETS) -> Column:
    """Any value within a facet, all facets together; no values: no constraint. Empty strings are no values."""
    out = F.lit(True)
    for column, values in facets.items():
        if not values:
            continue
        wanted = [v for v in values if v]
        hit = F.arrays_overlap(F.col(column), F.array(*map(F.lit, wanted)).cast("array<string>")) if column in is_list else F.col(column).isin(wanted)
        out = out & F.coalesce(hit, F.lit(False))
    return out


def in_dates(first: str | None, last: str | None, column: str = "publishDate") -> Column:
    """Strings compared, both bounds included; without a date a row fails as soon as there is a bound."""
    out = F.lit(True)
    if first or last:
        out = F.coalesce(F.col(column), F.lit("")) != ""
    if first:
        out = out & (F.col(column) >= first)
    if last:
        out = out & (F.col(column) <= last)
    return F.coalesce(out, F.lit(False))


def _text(*columns: Column) -> Column:
    return fold(F.lower(F.concat_ws("\n", *columns)))


def keyword_index(items: DataFrame) -> DataFrame:
    """items with folded tiers _title, _kind and _rest; write it once, query it often. Columns that items lack count as empty."""
    have = lambda *names: [F.col(n) for n in names if n in items.columns]
    return items.withColumns({
        "_title": _text(*have("title")), "_kind": _text(*have("contentType", "topics")),
        "_rest": _text(*have("summary", "locations", "croppingSystems", "people", "pageKeywords")),
    })


def tier(term: str) -> Column:
    return F.when(has_term(F.col("_title"), term), 3).when(has_term(F.col("_kind"), term), 2).when(has_term(F.col("_rest"), term), 1).otherwise(0)


def keyword_scores(index: DataFrame, terms: list[str]) -> DataFrame:
    """Rows in which every term matches, with score: the sum of the terms' tiers, repeated terms counted again.

    Each distinct term's tier is evaluated once, as a column that filter and sum both read.
    """
    distinct = list(dict.fromkeys(terms))
    scored = index.withColumn("_tiers", F.array(*[tier(t) for t in distinct]))
    scored = scored.where(F.array_min("_tiers") >= 1)
    return scored.withColumn("score", sum((F.col("_tiers")[distinct.index(t)] for t in terms[1:]), F.col("_tiers")[distinct.index(terms[0])])).drop("_tiers")


#: Ranges of the order that are ranked apart, a bound on what the driver sees of the rows; each is a task's work at a time.
RANGES = 1 << 12


def ranked(df: DataFrame, order: list, limit: int | None = None, name: str = "rank") -> DataFrame:
    """Rank from 1, for any keys. With a limit the best are found in each partition first, and only they are ranked together.

    Without one, rows are dealt out by sampled ranges of the order, counted by range, and numbered within their range from the sum
    of the ranges before. Rows that are equal in the order's keys stand by a hash of all their columns, so that a common key is split
    as well; only rows equal in every column share a range. The ranges are RANGES at most, and their counts, a number each, are
    all that is summed in one place. As ranges are of one sample, the dealt rows are written to the shared folder here, so that
    counts and numbers are of the same ranges, whatever executors are lost.
    """
    if limit is not None:
        return df.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    columns = df.columns
    spread = F.xxhash64(*[F.col(c) for c in columns if _hashable(df.schema[c].dataType)])
    keyed = df.withColumn("_spread", spread)
    dealt = keyed.repartitionByRange(_ranges(df), *order, "_spread").sortWithinPartitions(*order, "_spread")
    # the place of a row: its range in the upper bits, its number there in the lower ones
    placed = _kept(dealt.withColumn("_at", F.monotonically_increasing_id()).select(*columns, F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_n")))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("_range", "_before")), "_range").select(*columns, (F.col("_before") + F.col("_n") + 1).alias(name))


def _hashable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def _ranges(df: DataFrame) -> int:
    return min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: ranges are of one sample, and stay if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/ranked-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cosine(a: Column, b: Column) -> Column:
    """Dot product in double precision, in order; of unit vectors the cosine."""
    double = lambda v: v.cast("array<double>")
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def semantic_scores(items: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """Items that have a vector (id, vector), with their similarity to the query. The query is a literal: no join."""
    return items.join(vectors, "id").withColumn("similarity", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])))


def cut_off(scored: DataFrame) -> DataFrame:
    """At most MOST best, each at least RELATIVE of the best and FLOOR. Cut after all filters, as the best depends on them."""
    best = ranked(scored, [F.desc("similarity"), "ord"], MOST, "semantic_rank")
    top = F.max("similarity").over(Window.partitionBy(F.lit(0)))
    return best.withColumn("_top", top).where(F.col("similarity") >= F.greatest(F.col("_top") * RELATIVE, F.lit(FLOOR))).drop("_top")


def fuse(keyword: DataFrame, semantic: DataFrame, limit: int | None = None) -> DataFrame:
    """Union of two ranked lists by id: rrf, rank and semantic_only. Ties: keyword order first, then semantic order."""
    both = keyword.select("id", "keyword_rank", "score").join(semantic.select("id", "semantic_rank", "similarity"), "id", "full_outer")
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", share("keyword_rank") + share("semantic_rank")).withColumn("semantic_only", F.col("keyword_rank").isNull())
    return ranked(both, [F.desc("rrf"), F.asc_nulls_last("keyword_rank"), F.asc_nulls_last("semantic_rank")], limit)


def search(index: DataFrame, request: SearchRequest, vectors: DataFrame | None = None, query_vector: list[float] | None = None, postings: DataFrame | None = None) -> DataFrame:
    """id and rank of the hits, best first, with what explains them. Without a query: the filtered items in stored order.

    Without vectors or a query vector hybrid search is keyword search. With the postings of the index, words are looked up there
    and its texts aren't read.
    """
    from lodestone.plans.postings import posting_scores  # which builds on this module

    base = index.where(visible(request.show_expired) & in_facets(request.facets))
    if request.date_from or request.date_to:
        base = base.where(in_dates(request.date_from, request.date_to))
    terms = query_terms(request.q)
    if not terms:
        return ranked(base.select("id", "ord"), ["ord"], request.limit).select("id", "rank")
    mode = request.mode if vectors is not None and query_vector else "keyword"
    if mode != "semantic":
        if postings is None:
            scored = keyword_scores(base, terms).select("id", "ord", "score")
        else:
            scored = posting_scores(postings, terms, index).join(base.select("id", "ord"), "id").select("id", "ord", "score")
        keyword = ranked(scored, [F.desc("score"), "ord"], request.limit, "keyword_rank")
        if mode == "keyword":
            return keyword.select("id", F.col("keyword_rank").alias("rank"), "score")
    semantic = cut_off(semantic_scores(base.select("id", "ord"), vectors, query_vector).select("id", "ord", "similarity"))
    if mode == "semantic":
        return semantic.select("id", F.col("semantic_rank").alias("rank"), "similarity")
    return fuse(keyword, semantic, request.limit)


def facet_counts(items: DataFrame, facets: dict[str, bool]) -> DataFrame:
    """(facet, value, n) over all items in one pass; facets: column -> whether it is a list. Empty values don't count."""
    def named(column: str, is_list: bool) -> Column:
        values = F.coalesce(F.col(column), F.array().cast("array<string>")) if is_list else F.array(F.col(column).cast("string"))
        return F.transform(values, lambda v: F.struct(F.lit(column).alias("facet"), v.alias("value")))

    entries = F.concat(*[named(c, is_list) for c, is_list in facets.items()])
    flat = items.select(F.explode(entries).alias("e")).select("e.*").where("value is not null and value <> ''")
    return flat.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def facet_options(counts: DataFrame) -> DataFrame:
    """place: display order within a facet, frequent first, then by name in locale order. A facet's values are few beside the rows."""
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), F.collate("value", "UNICODE"))))


def facet_search(counts: DataFrame, part: str) -> DataFrame:
    return counts.where(F.lower("value").contains(part.lower()))


def result_counts(hits: DataFrame, items: DataFrame) -> DataFrame:
    """(n, total)."""
    return hits.agg(F.count(F.lit(1)).alias("n")).crossJoin(items.agg(F.count(F.lit(1)).alias("total")))
