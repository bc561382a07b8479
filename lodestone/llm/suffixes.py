"""Suffix-array dedup with sparse suffixes.

Suffixes are retained only at content-selected places: of every SELECT words, the PHRASE-word phrase of least hash. Two equal
passages of PASSAGE words select equal places, the first within SELECT words, so that their suffixes there have the first
RUN words in common: these are the key by which suffixes are dealt out and sorted. In the sorted order each suffix is compared
with its neighbour, and with the earliest suffix of its run; matches are extended to the left and to the right, as far as
PASSAGE words need, and a match of PASSAGE words or more marks the later place. Longer passages are marked piece by piece.

Suffixes whose run recurs and that agree in all words around them, as far as PASSAGE words need, are a class, known by hashes of
128 bits: all but its first are marked that far, and nothing more could be found by comparing them. Where a run has several
classes, their firsts are shipped with the words around them. Whole copies are known by their hash. A run is never
gathered: its earliest suffix comes by a partial aggregate and a join that broadcasts the most frequent runs (spread_join).
What has other words around it than the earliest is then sorted by ranges, so that a hot run goes on in the next partition;
the last suffix of a partition and the first of the next are compared as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.phrases import CUT, KEY, _lists, cut_words, restored, with_copies
from lodestone.llm.session import cut, prepare, spread_join
from lodestone.llm.textkit import WHITESPACE, Sketch, U, Words, chunks, mix, signed

PASSAGE, SELECT, PHRASE = 50, 30, 10
RUN = PASSAGE - (SELECT - PHRASE)


def _retained(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected places that a whole run follows, their texts and the runs' hashes."""
    at = np.flatnonzero(Sketch(words, PHRASE, SELECT).chosen)
    doc = words.owner()[at]
    fits = at + RUN <= words.first[doc + 1]
    at, doc = at[fits], doc[fits]
    return at, doc, signed(words.spans(at, RUN))


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, did, rid) of the retained suffixes' runs: once per document, twice if the run recurs within the document."""
    for batch in batches:
        for part in chunks(batch):
            _, doc, key = _retained(Words(part.column("text"), WHITESPACE))
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            again = np.zeros(len(doc), bool)
            again[2:] = (doc[2:] == doc[:-2]) & (key[2:] == key[:-2])
            doc, key = doc[~again], key[~again]
            yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(part.column(c).to_numpy()[doc]) for c in KEY]], ["key", *KEY])


def _reach(words: Words, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where to where the words around each place are compared: as far as PASSAGE words need, within its text."""
    return np.maximum(words.first[doc], at - (PASSAGE - RUN)), np.minimum(words.first[doc + 1], at + PASSAGE)


def _recurring(words: Words, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the retained places those whose run recurs: a run that recurs in any text of the chunk recurs in the corpus."""
    runs = part.column("runs").flatten().to_numpy(zero_copy_only=False)
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, doc, key = _retained(words)
    keep = np.isin(key, runs)
    return at[keep], doc[keep], key[keep]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Retained suffixes whose run recurs, each with a hash of all words around it and of where it stands in them."""
    for batch in batches:
        for part in chunks(batch):
            words = Words(part.column("text"), WHITESPACE)
            at, doc, key = _recurring(words, part)
            if not len(at):
                continue
            lo, hi = _reach(words, at, doc)
            around = mix(words.spans(lo, hi - lo) ^ ((at - lo).astype(U) << U(32)))
            places = pa.array((at - words.first[doc]).astype(np.int32))
            columns = [pa.array(key), pa.array(signed(around)), *[pa.array(part.column(c).to_numpy()[doc]) for c in KEY], places]
            yield pa.RecordBatch.from_arrays(columns, ["key", "around", *KEY, "at"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The named suffixes with the words before the place and after the run."""
    for batch in batches:
        for part in chunks(batch):
            words = Words(part.column("text"), WHITESPACE)
            raw, starts, ends = words.data.tobytes(), words.starts, words.ends
            said = lambda a, b: b" ".join(raw[starts[a] : ends[b - 1]].split()) if b > a else b""
            rows = []
            for d, named in enumerate(part.column("named").to_pylist()):
                did, rid = (part.column(c)[d].as_py() for c in KEY)
                begin = int(words.first[d])
                at = np.array([begin + one["at"] for one in named], np.int64)
                lo, hi = _reach(words, at, np.full(len(at), d))
                for one, p, a, b in zip(named, at.tolist(), lo.tolist(), hi.tolist()):
                    rows.append((one["key"], did, one["at"], rid, said(a, p), said(p + RUN, b), one["n"], one["head"]))
            yield _table(rows, {"key": pa.int64(), **PLACE, **AROUND, "n": pa.int64(), "head": pa.bool_()})


def common(a: list, b: list) -> int:
    """How many leading elements agree."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def match(one: tuple[bytes, bytes], two: tuple[bytes, bytes]) -> tuple[int, int]:
    """Words that two places of a run (words before, words after the run) have in common to the left and to the right."""
    right = RUN + (len(one[1].split()) if one[1] == two[1] else common(one[1].split(), two[1].split()))
    left = len(one[0].split()) if one[0] == two[0] else common(one[0].split()[::-1], two[0].split()[::-1])
    return left, right


PLACE = {"did": pa.int64(), "at": pa.int32(), "rid": pa.int32()}
AROUND = {"before": pa.binary(), "after": pa.binary()}
MARK = {"did": pa.int64(), "rid": pa.int32(), "start": pa.int32(), "end": pa.int32()}
SUFFIX = {"key": pa.int64(), "at": pa.int32(), **AROUND}
#: Partition, and 0 for its first suffix, 1 for its last.
BORDER = {"part": pa.int32(), "side": pa.int32()}
ORDER = ["key", "after", "before", "did", "at", "rid"]


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))


def _compare_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from the comparison with the run's earliest suffix; and suffixes (no start) with other words around them.

    Left out are those that match the earliest in all words around them: they are marked as far as any comparison could, and
    whatever matches them matches the earliest as far. So are those alone with it, and those with too few words around them.
    """
    names = ("key", *PLACE, *AROUND, "places", "head_did", "head_at", "head_rid", "head_before", "head_after")
    for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
        marks: set[tuple] = set()
        others: list[tuple] = []
        for key, did, at, rid, before, after, n_rows, head_did, head_at, head_rid, head_before, head_after in zip(*(batch.column(c).to_pylist() for c in names)):
            if (did, at, rid) != (head_did, head_at, head_rid):
                left, right = match((before, after), (head_before, head_after))
                if left + right >= PASSAGE:
                    marks.add((did, rid, at - left, at + right))
                most = len(before.split()) + RUN + len(after.split())
                if n_rows > 2 and most >= PASSAGE and left + right < most:
                    others.append((did, rid, None, None, key, at, before, after))
        yield _table([(*m, None, None, None, None) for m in marks] + others, MARK | SUFFIX)


def later_of(one: tuple, two: tuple) -> tuple[int, int, int, int] | None:
    """Of two suffixes (in ORDER) the later one's mark, if they are of a run and match far enough."""
    if one[0] != two[0] or one[3:] == two[3:]:
        return None
    left, right = match((one[2], one[1]), (two[2], two[1]))
    did, at, rid = max(one[3:], two[3:])
    return (did, rid, at - left, at + right) if left + right >= PASSAGE else None


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from sorted suffixes, each compared with the one before it; and the first and the last suffix (no start)."""
    first = last = None
    for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
        marks: set[tuple] = set()
        for row in zip(*(batch.column(c).to_pylist() for c in ORDER)):
            if last is None:
                first = row
            elif mark := later_of(last, row):
                marks.add(mark)
            last = row
        yield _table([(*m, *[None] * 6) for m in marks], MARK | SUFFIX | BORDER)
    if last is not None:
        part = TaskContext.get().partitionId()
        ends = [(did, rid, None, None, key, at, before, after, part, side) for side, (key, after, before, did, at, rid) in enumerate((first, last))]
        yield _table(ends, MARK | SUFFIX | BORDER)


MARKED = "did long, rid int, start int, end int"
CONTEXT = "key long, did long, at int, rid int, before binary, after binary, n long, head boolean"
HELD = f"{MARKED}, key long, at int, before binary, after binary"


def neighbour_marks(suffixes: DataFrame) -> DataFrame:
    """(did, rid, start, end) from each suffix and its neighbour in the order of all."""
    ranges = suffixes.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(*ORDER)
    out = cut(ranges.mapInArrow(_compare_neighbours, f"{HELD}, part int, side int"), "neighbours", free=True)
    # two rows a partition
    ends = [tuple(r) for r in out.where("start is null").orderBy("part", "side").select(*ORDER).collect()]
    marks = [m for one, two in zip(ends[1::2], ends[2::2]) if (m := later_of(one, two))]
    found = out.where("start is not null").select(*MARK)
    return found.unionAll(found.sparkSession.createDataFrame(marks, MARKED)) if marks else found


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = Words(part.column("text"), WHITESPACE)
            covered = np.zeros(len(words) + 1, np.int64)
            at, doc, _ = _recurring(words, part)
            firsts = [words.first[d] + f for d, f in enumerate(_lists(part.column("firsts"))) if f is not None]
            later = ~np.isin(at, np.concatenate(firsts)) if firsts else np.ones(len(at), bool)
            lo, hi = _reach(words, at[later], doc[later])
            enough = hi - lo >= PASSAGE
            np.add.at(covered, lo[enough], 1)
            np.add.at(covered, hi[enough], -1)
            for d, (starts, ends) in enumerate(zip(_lists(part.column("starts")), _lists(part.column("ends")))):
                if starts is not None:
                    np.add.at(covered, words.first[d] + np.minimum(starts, words.counts[d]), 1)
                    np.add.at(covered, words.first[d] + np.minimum(ends, words.counts[d]), -1)
            yield cut_words(part, words, covered, PASSAGE)


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs with _n_words, _n_removed, _kept_text and _removed (spans of words), as remove_repeats() gives them.

    Removed are passages of PASSAGE words or more that also stand earlier, found as the module says; every removed word is in
    such a passage. Null and empty texts have no words. Every row is a document, in the order that remove_repeats() names. An
    empty table gives an empty result; other columns pass through.
    """
    prepare(docs.sparkSession)
    base = with_copies(docs)
    originals = base.where(~F.col("copy"))
    rows = originals.mapInArrow(_run_rows, "key long, did long, rid int")
    recurring = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    runs = spread_join(rows, recurring, ["key"], [], F.col("did")).groupBy(*KEY).agg(F.collect_set("key").alias("runs"))
    # read by several later steps, for each of which Spark would find the runs anew
    runs = cut(runs, "recurring", free=True)
    places = originals.join(runs, KEY).mapInArrow(_places, "key long, around long, did long, rid int, at int")
    # suffixes that agree in all words around them are a class; its first stands for all
    first = F.min(F.struct("did", "at", "rid")).alias("m")
    classes = places.groupBy("key", "around").agg(first)
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m")).where("n > 1").select("key", "n", F.col("n").alias("places"), F.col("m").alias("least"))
    named = spread_join(classes.select("key", "m"), several, ["key"], ["places", "least"], F.col("m"))
    named = named.select("m.did", "m.rid", F.struct("key", "m.at", F.col("places").alias("n"), (F.col("m") == F.col("least")).alias("head")).alias("s"))
    named = named.groupBy(*KEY).agg(F.collect_list("s").alias("named"))
    contexts = originals.join(named, KEY).mapInArrow(_contexts, CONTEXT)
    # what later steps need is written by one job, so that texts and places are shuffled once for all of it
    found = cut(contexts.unionByName(classes.select("m.*"), True), "suffixes", free=True)
    contexts = found.where("key is not null")
    firsts = found.where("key is null").groupBy(*KEY).agg(F.collect_list("at").alias("firsts"))
    heads = contexts.where("head").dropDuplicates(["key"])
    heads = heads.select("key", "n", F.col("n").alias("places"), *[F.col(c).alias(f"head_{c}") for c in ("did", "at", "rid", "before", "after")])
    headed = spread_join(contexts.drop("n", "head"), heads, ["key"], ["places", "head_did", "head_at", "head_rid", "head_before", "head_after"], F.col("did"))
    compared = cut(headed.mapInArrow(_compare_heads, HELD), "heads", free=True)
    marks = compared.where("start is not null").select(*MARK).unionAll(neighbour_marks(compared.where("start is null")))
    by_doc = marks.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("m")).select(*KEY, F.col("m.start").alias("starts"), F.col("m.end").alias("ends"))
    joined = base.join(runs, KEY, "left").join(firsts, KEY, "left").join(by_doc, KEY, "left")
    return restored(joined.mapInArrow(_cut_out, T.StructType([joined.schema["text"], joined.schema["other"], *CUT])), docs.columns)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_passages(docs)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.size("_removed").cast("long").alias("n_spans"), F.sha2(F.col("_kept_text").cast("binary"), 256).alias("kept_sha256"))
