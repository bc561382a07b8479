"""Substring dedup by repeated-phrase automata.

1. Each document is sketched: of every window of WINDOW words the PHRASE-word phrase of least hash. Equal windows select equal
   phrases, so a window that occurs twice holds a phrase that recurs. Phrases are counted over the whole corpus; those in
   several places are confirmed.
2. Documents are dealt out in shards of a few MB. A shard's Aho-Corasick automaton holds the confirmed phrases that its
   documents have; every document of the shard streams through it, and all places of phrases come from the automaton. An
   automaton's size is bounded by its shard's, however many phrases the corpus has.
3. A window whose selected phrase stands at a located place is a candidate. Equal surroundings of a phrase are one class, of
   which the first member counts; where a phrase has several classes, their windows are grouped, and the least (document,
   start) of each is its first place. Candidate windows at other places are removed.

Whole copies are known by their hash and skip steps 1 to 3: of a copy of WINDOW words or more, every word is removed.
Skew: counting and grouping are by partial aggregates, so a passage that a third of all documents share is one row per task;
the most frequent texts and phrases are joined by a bounded broadcast (spread_join). Lists are gathered by document only.
Hashes: 64 bits for a phrase, 128 for a class and a text, 96 for a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.session import cut, prepare, spread_join, text_key
from lodestone.llm.textkit import WHITESPACE, Sketch, U, Words, chunks, mix, signed, sliding

WINDOW, PHRASE = 20, 6
#: Bytes of text of a shard.
SHARD = 1 << 21
ADDED = ["_n_words", "_n_removed", "_kept_text", "_removed"]
KEY = ["did", "rid"]


def _sketch_rows(window: int, k: int):
    """(phrase, did, rid) of the selected phrases: once per document, twice if it recurs within the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), WHITESPACE)
                sketch = Sketch(words, k, window)
                at = np.flatnonzero(sketch.chosen)
                doc, phrase = words.owner()[at], sketch.grams[at]
                order = np.lexsort((phrase, doc))
                doc, phrase = doc[order], phrase[order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (phrase[1:] != phrase[:-1])
                nth = np.arange(len(doc)) - np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))
                doc, phrase = doc[nth < 2], phrase[nth < 2]
                yield pa.RecordBatch.from_arrays([pa.array(signed(phrase)), *[pa.array(part.column(c).to_numpy()[doc]) for c in KEY]], ["phrase", *KEY])

    return run


class Shard:
    """An automaton of the confirmed phrases that some texts have, and the texts' candidate windows by the places it finds."""

    def __init__(self, words: Words, sketch: Sketch, confirmed: np.ndarray):
        self.words, self.sketch, self.k = words, sketch, sketch.k
        text, self.spaces = words.joined()
        self.machine = self.compiled(text, confirmed)
        self.located = np.zeros(len(sketch.grams), bool)
        self.located[self.places(text)] = True
        # a window is a candidate if the phrase it selects stands at a located place
        masked = np.where(self.located, sketch.grams, U(2**64 - 1))
        self.candidate = sketch.whole & (sliding(masked, sketch.width) == sketch.low) if len(sketch.whole) else np.zeros(0, bool)

    def compiled(self, text: bytes, confirmed: np.ndarray):
        """The automaton of the confirmed phrases' texts, a byte for a character; None without phrases."""
        grams, at = np.unique(self.sketch.grams[self.sketch.chosen], return_index=True)
        at = np.flatnonzero(self.sketch.chosen)[at[np.isin(grams, confirmed)]]
        if not len(at):
            return None
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        sizes = self.words.ends - self.words.starts
        begins, ends = (self.spaces[at] - sizes[at] - 1).tolist(), (self.spaces[at + self.k - 1] + 1).tolist()
        for a, b in zip(begins, ends):
            machine.add_word(text[a:b].decode("latin-1"))
        machine.make_automaton()
        return machine

    def places(self, text: bytes) -> np.ndarray:
        """The words at which the automaton finds a phrase: a match ends at the space behind the phrase's last word."""
        if self.machine is None:
            return np.zeros(0, np.int64)
        ends = np.fromiter((end for end, _ in self.machine.iter(text.decode("latin-1"))), np.int64)
        return np.searchsorted(self.spaces, ends) - self.k + 1


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray(pa.compute.list_value_length(column).fill_null(0))
    ends = np.cumsum(sizes)
    return [None if not n else values[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist())]


def _classes(window: int, k: int):
    """Runs of n candidate windows from `start` on that select one place of a phrase; around: its surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=SHARD):
                words = Words(part.column("text"), WHITESPACE)
                sketch = Sketch(words, k, window)
                confirmed = np.unique(np.ascontiguousarray(part.column("phrases").flatten().to_numpy(zero_copy_only=False)).astype(np.int64))
                at = np.flatnonzero(Shard(words, sketch, confirmed.view(U)).candidate)
                if not len(at):
                    continue
                # the leftmost phrase of least hash in each candidate window
                places = np.flatnonzero(sketch.chosen)
                pick = np.searchsorted(places, at)
                home = places[np.minimum(pick, len(places) - 1)]
                wrong = sketch.grams[home] != sketch.low[at]
                while wrong.any():
                    pick[wrong] += 1
                    home[wrong] = places[pick[wrong]]
                    wrong[wrong] = sketch.grams[home[wrong]] != sketch.low[at[wrong]]
                heads = np.concatenate([[0], np.flatnonzero((np.diff(home) != 0) | (np.diff(at) != 1)) + 1])
                n = np.diff(np.append(heads, len(at)))
                start, home = at[heads], home[heads]
                doc = words.owner()[home]
                # all words of the run's windows, and where the phrase stands in them
                around = mix(words.spans(start, n + window - 1) ^ ((home - start).astype(U) << U(32)))
                columns = [
                    pa.array(signed(sketch.grams[home])), pa.array(signed(around)), *[pa.array(part.column(c).to_numpy()[doc]) for c in KEY],
                    pa.array((start - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["phrase", "around", *KEY, "start", "n"])

    return run


def _runs(starts: list, sizes: list, words: Words) -> np.ndarray:
    """The words at which the windows of these runs start."""
    out = [words.first[d] + np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) for d, (s, n) in enumerate(zip(starts, sizes)) if s is not None]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _windows(window: int):
    """Hashes and places of the windows of the runs that stand for their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), WHITESPACE)
                at = _runs(_lists(part.column("starts")), _lists(part.column("sizes")), words)
                doc = words.owner()[at]
                half = window // 2
                second = mix(words.spans(at, half) ^ (words.spans(at + half, window - half) * U(0x9E3779B97F4A7C15)))
                columns = [
                    pa.array(signed(words.spans(at, window))), pa.array((second >> U(32)).astype(np.uint32).view(np.int32)),
                    *[pa.array(part.column(c).to_numpy()[doc]) for c in KEY], pa.array((at - words.first[doc]).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["w1", "w2", *KEY, "start"])

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
REMOVED = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
CUT = [T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_kept_text", T.StringType()), T.StructField("_removed", REMOVED)]


def kept(words: Words, drop: np.ndarray, removed: np.ndarray) -> tuple[list[str], list[list[dict]]]:
    """Each text's words without the dropped ones, and the spans of words dropped."""
    texts, spans = [], []
    for d in range(words.n):
        raw = words.data[words.places[d] : words.places[d + 1]].tobytes().split()
        if not removed[d]:
            texts.append(b" ".join(raw).decode("utf-8", "replace"))
            spans.append([])
            continue
        flags = drop[words.first[d] : words.first[d + 1]]
        texts.append(b" ".join(w for w, f in zip(raw, flags.tolist()) if not f).decode("utf-8", "replace"))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
    return texts, spans


def cut_words(part: pa.RecordBatch, words: Words, covered: np.ndarray, least: int) -> pa.RecordBatch:
    """Rows without the words at which the running sum of `covered` is above 0, and whole copies of `least` words or more."""
    drop = np.cumsum(covered)[: len(words)] > 0
    copy = part.column("copy").to_numpy(zero_copy_only=False)
    drop |= (copy & (words.counts >= least))[words.owner()]
    removed = np.bincount(words.owner(), drop, minlength=words.n).astype(np.int64)
    texts, spans = kept(words, drop, removed)
    columns = [part.column("text"), part.column("other"), pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array(texts, pa.string()), pa.array(spans, SPANS)]
    return pa.RecordBatch.from_arrays(columns, ["text", "other", *ADDED])


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), WHITESPACE)
                gone = np.zeros(len(words) + 1, bool)
                gone[_runs(_lists(part.column("starts")), _lists(part.column("sizes")), words)] = True
                for d, firsts in enumerate(_lists(part.column("firsts"))):
                    if firsts is not None:
                        gone[words.first[d] + firsts] = False
                at = np.flatnonzero(gone)
                covered = np.zeros(len(words) + 1, np.int64)
                covered[at] += 1
                covered[np.minimum(at + window, len(words))] -= 1
                yield cut_words(part, words, covered, window)

    return run


def with_copies(docs: DataFrame) -> DataFrame:
    """(did, rid, text, other, copy): rid tells rows of one id apart by their texts; `copy` if the same text has a smaller id
    elsewhere; `other` holds what restored() needs."""
    text = F.coalesce("text", F.lit(""))
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text" and c not in ADDED]
    keyed = docs.select(text_key(text).alias("did"), F.hash(text).alias("rid"), text.alias("text"), F.struct(F.col("text").isNull().alias("none"), *others).alias("other"))
    hashes = [F.xxhash64(F.lit(seed), text).alias(f"t{seed}") for seed in (1, 2)]
    ids = docs.select(text_key(text).alias("did"), F.hash(text).alias("rid"), *hashes)
    least = ids.groupBy("t1", "t2").agg(F.min("did").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = spread_join(ids, least, ["t1", "t2"], ["least"], F.col("did")).where("did > least").select(*KEY, F.lit(True).alias("copied")).distinct()
    return keyed.join(copies, KEY, "left").select(*KEY, "text", "other", F.coalesce("copied", F.lit(False)).alias("copy"))


def restored(out: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that with_copies() was given, and the added ones, which take the place of older ones of their names."""
    place = {c: F.col("other").getField(f"c{i}").alias(c) for i, c in enumerate(columns) if c not in ADDED}
    place["text"] = F.when(~F.col("other.none"), F.col("text")).alias("text")
    return out.select(*[place[c] for c in columns if c not in ADDED], *ADDED)


def confirmed(originals: DataFrame, window: int, k: int) -> DataFrame:
    """(did, rid, phrases): each document's selected phrases that recur in the corpus."""
    rows = originals.mapInArrow(_sketch_rows(window, k), "phrase long, did long, rid int")
    recurring = rows.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = spread_join(rows, recurring, ["phrase"], [], F.col("did"))
    return held.groupBy(*KEY).agg(F.collect_set("phrase").alias("phrases"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = PHRASE) -> DataFrame:
    """docs with _n_words, _n_removed, _kept_text (kept words joined by one space) and _removed (spans of words).

    A word is removed if a window of `window` words covers it whose words also start earlier: in a document of smaller id, or
    in the same document. Null and empty texts have no words. Every row is a document: those of equal id come in the order of
    a hash of their texts, those without an id likewise after all others; equal rows are one document, as neither is earlier.
    An empty table gives an empty result; other columns pass through.
    """
    prepare(docs.sparkSession)
    base = with_copies(docs)
    originals = base.where(~F.col("copy"))
    # all branches read all columns of base, so that one exchange of texts serves them all
    held = originals.join(confirmed(originals, window, k), KEY, "left")
    runs = cut(held.mapInArrow(_classes(window, k), "phrase long, around long, did long, rid int, start int, n int"), "runs", free=True)
    by_doc = lambda df: df.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("r")).select(*KEY, F.col("r.start").alias("starts"), F.col("r.n").alias("sizes"))
    first = F.min(F.struct("did", "start", "rid", F.col("n").alias("n"))).alias("m")
    # a window selects its phrase by its words alone: where a phrase has one class, the first member is first in all its windows
    by_phrase = runs.groupBy("phrase").agg(F.min("around").alias("lo"), F.max("around").alias("hi"), F.count(F.lit(1)).alias("n"), first)
    sole = by_phrase.where("lo = hi").select("m.did", "m.rid", F.sequence("m.start", F.expr("m.start + m.n - 1")).alias("f"))
    several = spread_join(runs, by_phrase.where("lo < hi").select("phrase", "n"), ["phrase"], [], F.col("did"))
    members = several.groupBy("phrase", "around").agg(first).select("m.*")
    listed = originals.join(by_doc(members), KEY)
    places = listed.mapInArrow(_windows(window), "w1 long, w2 int, did long, rid int, start int")
    firsts = places.groupBy("w1", "w2").agg(F.min(F.struct("did", "start", "rid")).alias("m")).select("m.*")
    spared = firsts.select(*KEY, F.array("start").alias("f")).unionAll(sole).groupBy(*KEY).agg(F.flatten(F.collect_list("f")).alias("firsts"))
    joined = base.join(by_doc(runs), KEY, "left").join(spared, KEY, "left")
    out = joined.mapInArrow(_remove(window), T.StructType([joined.schema["text"], joined.schema["other"], *CUT]))
    return restored(out, docs.columns)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_sql() -> str:
    """DuckDB SQL for the same rows: windows as texts, numbered among their equals by document and place."""
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j,
  unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + {WINDOW - 1} <= len(w) THEN array_to_string(w[i:i + {WINDOW - 1}], ' ') END)) AS g FROM t),
f AS (SELECT doc_id, word, j, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, j) > 1 AS again FROM p),
c AS (SELECT doc_id, word, j, bool_or(again) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)"""
