"""License scan by a positional rare-token index, in DataFrame functions only.

The index holds postings (word -> phrase, relative position) of the templates' mandatory key phrases. Document frequencies
of all licence words are counted over the whole corpus. In each file the licence words that it holds are taken in order of
their IDF, highest first, down to the last one that is needed: a phrase all of whose words the file holds needs ANCHORS of them.
Places of these words vote for starts (word place minus relative position); a start that all of a phrase's looked-up words agree
on is a candidate, and the phrase's words are then verified one after the other. Every place of a phrase holds these words at
their relative positions, so none is lost. A file that holds no phrase's words is not looked into any further.

The index is a constant of the query, bounded by TEMPLATES, never by the corpus; all work on a text happens in its own row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by contract: every place of these phrases counts, and they label alone.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: Labels of the method's own: all of a label's key phrases must be found.
TEMPLATES = {
    "mit-text": ["permission is hereby granted free of charge to any person obtaining a copy", "the software is provided as is without warranty of any kind"],
    "bsd": ["redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"],
    "gpl": ["gnu general public license"],
    "gpl-3": ["gnu general public license version 3"],
    "lgpl": ["gnu lesser general public license"],
    "agpl": ["gnu affero general public license"],
    "mpl-2": ["mozilla public license version 2"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "apache-2-text": ["licensed under the apache license version 2", "you may not use this file except in compliance with the license"],
    "cc-by": ["creative commons attribution"],
    "cc-by-sa": ["cc by sa"],
    "cc0": ["cc0 1 0 universal"],
    "all-rights-reserved": ["all rights reserved"],
}
ANCHORS = 2
#: No phrase has so many words; keeps starts in front of a text from being negative.
LONGEST = 1 << 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def phrases() -> list[tuple[str, list[str], bool]]:
    """(label, words, whether base) of each key phrase; labels with several key phrases come several times."""
    out = [(label, phrase.split(), True) for label, phrase in BASE.items()]
    return out + [(label, p.split(), False) for label, ps in TEMPLATES.items() for p in ps]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lowered. Splitting leaves an empty string at most at either end."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS)


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """Over all documents: how many hold each licence word, and how many documents there are."""
    present = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))
    # counted in one aggregate with a column per word: no row per occurrence, no shuffle of words
    row = docs.select(present.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("w", w)).alias(f"w{i}") for i, w in enumerate(vocabulary)]
    ).first()
    return {w: row[f"w{i}"] for i, w in enumerate(vocabulary)}, row["n"]


def by_rarity(frequencies: dict[str, int], n_docs: int) -> list[str]:
    """Licence words by IDF, highest first."""
    return sorted(frequencies, key=lambda w: (-math.log((n_docs + 1) / (frequencies[w] + 1)), w))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs, with its columns and _n_words, _places (array of label, base, start, end), _base_labels,
    _labels and _score.

    Null or empty texts have no words and no places; ties and repeated rows are judged each for itself; an empty table
    gives an empty result. Columns of docs named like the new ones give way. _score is the largest share of a label's key phrases
    that were verified, 1 for base labels. A text takes time in proportion to its length, but for sorting its votes.
    """
    found = phrases()
    words = by_rarity(*word_frequencies(docs, sorted({w for _, words, _ in found for w in words})))
    rank = {w: n for n, w in enumerate(words)}
    ranks = [sorted(rank[w] for w in wording) for _, wording, _ in found]
    needed = [r[min(ANCHORS, len(r)) - 1] for r in ranks]
    rare = words[: max(needed) + 1]
    postings = {w: [(p, i) for p, (_, wording, _) in enumerate(found) for i, x in enumerate(wording) if x == w] for w in rare}
    added = ["_n_words", "_places", "_base_labels", "_labels", "_score"]
    kept = [c for c in docs.columns if c not in added]

    split = words_of(F.col("text"))
    rows = docs.select(F.struct(*kept).alias("row"), split.alias("w0"))
    rows = rows.select("row", F.when(F.element_at("w0", 1) == "", F.slice("w0", F.lit(2), F.size("w0"))).otherwise(F.col("w0")).alias("w1"))
    held = F.array_intersect(F.array(*map(F.lit, words)), F.col("w1"))  # by rarity
    rows = rows.select("row", "w1", (F.size("w1") - F.when(F.try_element_at("w1", F.lit(-1)) == "", 1).otherwise(0)).cast("long").alias("n"), held.alias("held"))
    # look up: the file's rarest licence words, down to the last that a phrase with all words in the file needs
    whole = [F.forall(F.array(*map(F.lit, wording)), lambda x: F.array_contains("held", x)) for _, wording, _ in found]
    last = F.when(F.size("held") > 0, F.greatest(*[F.when(w, F.lit(r)) for w, r in zip(whole, needed)]))
    rows = rows.select("row", "w1", "n", last.alias("last"))
    place = F.create_map(*[x for w in rare for x in (F.lit(w), F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")) for p, i in postings[w]]))])
    known = F.create_map(*[x for w in rare for x in (F.lit(w), F.lit(rank[w]))])
    hits = F.filter(F.transform("w1", lambda w, i: F.when(w.isin(rare), F.struct(i.alias("at"), w.alias("word")))), lambda h: h.isNotNull() & (F.element_at(known, h["word"]) <= F.col("last")))
    # how many of each phrase's words are looked up in this file
    need = F.array(*[sum((F.when(F.col("last") >= r, 1).otherwise(0) for r in own[1:]), F.when(F.col("last") >= own[0], 1).otherwise(0)) for own in ranks])
    rows = rows.select("row", "w1", "n", F.when(F.col("last").isNotNull(), hits).alias("hits"), F.when(F.col("last").isNotNull(), need).alias("need"))
    # intersect: a phrase and a start as one number, so that equal votes stand together once sorted
    votes = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(place, h["word"]), lambda q: F.shiftleft(q["p"].cast("long"), 32) + h["at"] - q["i"] + LONGEST)))
    rows = rows.select("row", "w1", "n", "need", F.sort_array(votes).alias("votes"))
    struct = lambda v: F.struct(F.shiftright(v, 32).cast("int").alias("p"), (v.bitwiseAND(F.lit(0xFFFFFFFF)) - LONGEST).cast("int").alias("start"))
    # each looked-up word of a phrase votes once for a start: need equal votes in a row are one start
    backed = F.filter("votes", lambda v, i: F.try_element_at("votes", i + F.element_at("need", F.shiftright(v, 32).cast("int") + 1)).eqNullSafe(v))
    # verify: the phrase's words stand there, one after the other
    wording = F.array(*[F.array(*map(F.lit, own)) for _, own, _ in found])
    stands = lambda v: (v["start"] >= 0) & (F.slice("w1", F.greatest(v["start"], F.lit(0)) + 1, F.size(F.element_at(wording, v["p"] + 1))) == F.element_at(wording, v["p"] + 1))
    rows = rows.select("row", "n", "w1", F.transform(backed, struct).alias("backed"))
    rows = rows.select("row", "n", F.coalesce(F.filter("backed", stands), F.array().cast("array<struct<p:int,start:int>>")).alias("good"))

    n_base = len(BASE)
    ids = F.array_distinct(F.transform("good", lambda v: v["p"]))
    rows = rows.withColumn("ids", ids)
    labels = list(dict.fromkeys(label for label, _, _ in found))
    members = {label: [p for p, f in enumerate(found) if f[0] == label] for label in labels}
    share = {label: sum((F.array_contains("ids", p).cast("int") for p in ps[1:]), F.array_contains("ids", ps[0]).cast("int")) / F.lit(float(len(ps))) for label, ps in members.items()}
    joined = lambda names: F.concat_ws(",", F.array_sort(F.array_compact(F.array(*[F.when(share[x] == 1.0, F.lit(x)) for x in names]))))
    place = F.transform("good", lambda v: F.struct(
        F.element_at(F.array(*[F.lit(f[0]) for f in found]), v["p"] + 1).alias("label"), (v["p"] < n_base).alias("base"),
        v["start"].cast("long").alias("start"), (v["start"] + F.size(F.element_at(wording, v["p"] + 1))).cast("long").alias("end")))
    return rows.select(
        "row.*", F.col("n").alias("_n_words"), place.alias("_places"),
        joined(list(BASE)).alias("_base_labels"), joined(labels).alias("_labels"),
        F.greatest(*share.values()).alias("_score"),
    )


def op1_license_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs)
    base = F.transform(F.filter("_places", lambda p: p["base"]), lambda p: p["start"])
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        F.col("_base_labels").alias("base_labels"), F.col("_labels").alias("labels"), F.col("_score").alias("score"),
    )


def op1_sql() -> str:
    """DuckDB SQL for the same rows: phrases are sought in the words joined by single spaces."""
    found = phrases()
    labels = list(dict.fromkeys(label for label, _, _ in found))
    has = lambda p: f"contains(t, ' {' '.join(found[p][1])} ')"
    members = {label: [p for p, f in enumerate(found) if f[0] == label] for label in labels}
    share = {label: f"(({' + '.join(f'{has(p)}::INT' for p in ps)}) / {float(len(ps))}::DOUBLE)" for label, ps in members.items()}
    names = lambda which: f"array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN {share[x]} = 1.0 THEN {chr(39)}{x}{chr(39)} END' for x in which)}], lambda x: x IS NOT NULL)), ',')"
    starts = " || ".join(
        f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(f[1]) - 1}] = [{', '.join(chr(39) + x + chr(39) for x in f[1])}])" for f in found if f[2]
    )
    return f"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t, {starts} AS s FROM a)
SELECT doc_id, len(w)::BIGINT AS n_words, len(s)::BIGINT AS n_base, (list_min(s) - 1)::BIGINT AS first_word, (list_max(s) - 1)::BIGINT AS last_word,
  {names(list(BASE))} AS base_labels, {names(labels)} AS labels, greatest({', '.join(share.values())}) AS score
FROM b"""
