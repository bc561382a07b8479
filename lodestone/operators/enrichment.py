"""Enriching items with terms of what they link to: identifiers first, then video titles, then the page itself.

Services are injected: functions that map an identifier or address to a payload, or None where there is none. Each route is a
stage whose results are written before the next one begins, so that no service is asked twice and only items that a route
left without terms go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.markup import page_text
from lodestone.functions.text import domain, dois, inverted_index_text, strip_tags
from lodestone.operators import mining
from lodestone.sources.catalogue import fetched

WORK = "concepts array<struct<display_name:string,score:double,level:int>>, abstract_inverted_index map<string,array<int>>"
RECORD = "message struct<subject:array<string>,`container-title`:array<string>,abstract:string>"
VIDEO = "title string, author_name string"
# Hosts of videos.
VIDEO_HOSTS = ["youtube.com", "m.youtube.com", "youtu.be"]
NOTHING = lambda: F.array().cast("array<string>")


def looked_up(keys: DataFrame, service: Callable[[str], str | None], partitions: int = 8) -> DataFrame:
    """(id, pos, key, payload) of keys (id, pos, key): what a service says of each, null where it fails or knows nothing."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            def ask(key: str) -> str | None:
                try:
                    return service(key)
                except Exception:  # noqa: BLE001  a service that fails is one that knows nothing
                    return None

            yield batch.assign(payload=[ask(k) for k in batch["key"]])

    return keys.select("id", "pos", "key").repartition(partitions).mapInPandas(run, "id string, pos int, key string, payload string")


def abstract_terms(text: Column, known: Column) -> Column:
    return F.transform(mining.top_terms(mining.mined_words(text, known), mining.TOP_ABSTRACT), lambda c: c["term"])


def work_terms(payload: Column, known: Column) -> Column:
    """Concepts of a work, then the frequent words of its abstract; null if it has neither."""
    w = F.from_json(payload, WORK)
    abstract = F.coalesce(inverted_index_text(F.coalesce(w["abstract_inverted_index"], F.create_map().cast("map<string,array<int>>"))), F.lit(""))
    names = F.coalesce(mining.concepts(w["concepts"]), NOTHING())
    return F.when((F.size(names) > 0) | (abstract != ""), F.concat(names, abstract_terms(abstract, known)))


def record_terms(payload: Column, known: Column) -> Column:
    """Subjects and the container's name of a record, then the frequent words of its abstract without markup."""
    m = F.from_json(payload, RECORD)["message"]
    container = F.filter(F.slice(F.coalesce(m["container-title"], NOTHING()), 1, 1), lambda c: F.coalesce(c, F.lit("")) != "")
    return F.concat(F.coalesce(m["subject"], NOTHING()), container, abstract_terms(strip_tags(m["abstract"]), known))


def video_terms(payload: Column, known: Column, blob: Column) -> Column:
    """Channel, capitalised phrases of the title, then words, of a video; words that a kept phrase holds go."""
    v = F.from_json(payload, VIDEO)
    title, author = F.coalesce(v["title"], F.lit("")), F.coalesce(v["author_name"], F.lit(""))
    phrases = F.filter(F.regexp_extract_all(title, F.lit(f"({mining.CAPITALISED})")), lambda p: F.length(p) >= 4)
    words = mining.mined_words(F.concat(title, F.lit(" "), author), known)
    found = F.concat(F.array(author), phrases, words)
    return F.slice(mining.without_covered_words(mining.merged(found, blob, None)), 1, mining.MOST)


def enrich(items: DataFrame, work: Callable, record: Callable, video: Callable, page: Callable, stage: Callable[[DataFrame, str], DataFrame], partitions: int = 8) -> DataFrame:
    """(id, status, via, keywords, reason, charCount) of items with an address. stage(df, name) writes df and gives it back.

    status: ok, failed, blocked or low_yield. An identifier's works are asked first, its record only where the work says nothing.
    """
    all_ = mining.with_known(items.where(F.coalesce("url", F.lit("")) != "")).select("id", "url", "blob", "known", dois(F.col("doi"), F.col("url")).alias("dois"))
    keys = all_.select("id", F.posexplode("dois").alias("pos", "key"))
    about = all_.select("id", "blob", "known")
    works = stage(looked_up(keys, work, partitions), "works").join(about, "id").withColumn("terms", work_terms(F.col("payload"), F.col("known")))
    silent = works.where("terms is null").select("id", "pos", "key")
    records = stage(looked_up(silent, record, partitions), "records").join(about, "id").withColumn("terms", record_terms(F.col("payload"), F.col("known")))
    both = works.where("terms is not null").select("id", "pos", "terms").unionAll(records.select("id", "pos", "terms").where("terms is not null"))
    by_id = both.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "terms"))), lambda s: s["terms"])).alias("terms"))
    named = by_id.join(all_.select("id", "blob", "dois"), "id").select("id", mining.merged(F.col("terms"), F.col("blob")).alias("keywords"), F.concat(F.lit("doi:"), F.array_join("dois", ",")).alias("via"))
    done = stage(named.where(F.size("keywords") > 0), "named")

    rest = all_.join(done, "id", "left_anti")
    videos = rest.where(domain(F.col("url")).isin(VIDEO_HOSTS)).select("id", F.lit(0).alias("pos"), F.col("url").alias("key"))
    told = stage(looked_up(videos, video, partitions), "videos").where("payload is not null").join(about, "id")
    told = told.select("id", video_terms(F.col("payload"), F.col("known"), F.col("blob")).alias("keywords"), F.lit("youtube-oembed").alias("via")).where(F.size("keywords") > 0)
    done = done.select("id", "keywords", "via").unionAll(told)

    left = rest.join(told, "id", "left_anti")
    pages = stage(fetched(left, page, partitions), "pages").join(about, "id")
    read = pages.select("id", "error", "blob", "known", page_text(F.col("payload")).alias("p")).select("id", "error", "blob", "known", "p.body", "p.meta", F.col("p.full").alias("text"))
    terms = F.transform(mining.best_terms(F.col("text"), F.col("known"), F.col("blob")), lambda t: t["term"])
    read = read.withColumn("keywords", terms)
    status = (
        F.when(F.col("error").isNotNull(), "failed").when(mining.blocked(F.col("text")), "blocked")
        .when(mining.thin(F.col("body"), F.col("meta")) | (F.size("keywords") == 0), "low_yield").otherwise("ok")
    )
    reason = F.when(F.col("status") == "failed", F.col("error")).when(F.col("status") == "blocked", "login wall or bot check").when((F.col("status") == "low_yield") & mining.thin(F.col("body"), F.col("meta")), "thin page").when(F.col("status") == "low_yield", "nothing new")
    good = F.col("status") == "ok"
    scraped = read.withColumn("status", status).select(
        "id", "status", F.when(good, "scraped-page").alias("via"), F.when(good, F.col("keywords")).alias("keywords"), reason.alias("reason"),
        F.when(F.col("status") == "low_yield", F.length("body")).alias("charCount"))
    ok = done.select("id", F.lit("ok").alias("status"), "via", "keywords", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("charCount"))
    return ok.unionAll(scraped)


def report(results: DataFrame, run_at: Column) -> DataFrame:
    """One row a status: runAt, n and the detail rows of that status."""
    detail = F.array_sort(F.collect_list(F.struct("id", "via", "keywords", "reason", "charCount")))
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"), detail.alias("detail")).withColumn("runAt", run_at)
