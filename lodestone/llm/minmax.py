"""Near-duplicate groups by min-max hashing.

Both the minimum and the maximum of a document's shingles under each of PERMUTATIONS permutations are kept: twice as many
signature values as hash evaluations. Bands of these values propose links; every link is confirmed on full sets. The
similarity asked for is a parameter, in hundredths; how long bands are and what the bounds let through follows from it.

Skew. Documents with equal sets are one node from the start. In a band's bucket all members propose a link to one hub only;
only if the confirmed links leave a bucket in several components, pairs across components are proposed as well, and only
those that size, a 128-bit sketch and a parity map of the sets don't rule out. So no bucket is expanded into all of its
pairs, and no link that joins two components is lost.

Parity map: each shingle flips one of 1,024 bits. Two sets' maps differ in as many bits as their difference has elements at
most, so that a pair whose maps differ in more bits than a linked pair's sets may differ in is no link, for certain.

A pair at the threshold misses all bands with probability below MISSED: bands have as many values as allow this (at 85 it is
28 bands of 5, at 80 35 bands of 4). The sketch drops a pair at the threshold with probability below DROPPED; size and parity
are exact bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.graph import components
from lodestone.llm.session import UNNAMED, cut, doc_key, prepare, spread_join, text_key
from lodestone.llm.textkit import U, WHITESPACE, Words, chunks, mix, signed

SHINGLE, THRESHOLD = 5, 85
PERMUTATIONS = 70
#: Probabilities that a pair at the threshold shares no band, and that its sketches rule it out.
MISSED, DROPPED = 1e-7, 1e-8
#: Longs of a parity map.
PARITY = 16
#: Buckets of more members choose their hub by unique shingles.
BIG_BUCKET = 32
#: Bytes of text that a worker holds shingles of at a time.
CHUNK = 1 << 18

_rng = np.random.Generator(np.random.PCG64(85))
_FLIP = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * U(2)
_TIMES = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
_BAND = _rng.integers(0, 2**63, 2 * PERMUTATIONS, dtype=np.uint64)


def band_rows(threshold: int) -> int:
    """Values of a band: the most for which a pair at the threshold misses all bands with probability below MISSED."""
    for rows in range(2 * PERMUTATIONS, 0, -1):
        if (1 - (threshold / 100) ** rows) ** (2 * PERMUTATIONS // rows) < MISSED:
            return rows
    raise ValueError(f"no bands find pairs at {threshold} of 100")


def sketch_bits(threshold: int) -> int:
    """Sketch bits (of 128) in which a linked pair may differ: each differs with probability (1 - similarity) / 2."""
    p, within = (100 - threshold) / 200, 0.0
    for bits in range(129):
        within += comb(128, bits) * p**bits * (1 - p) ** (128 - bits)
        if 1 - within < DROPPED:
            break
    return bits


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in one array, and where each text's begin (and the last end)."""
    words = Words(texts, WHITESPACE, lower=True)
    counts = words.counts
    grams, fits = words.windows(k), words.fits(k)
    owner = words.owner()
    short = np.flatnonzero((counts > 0) & (counts < k))
    hashes = np.concatenate([grams[fits], words.spans(words.first[:-1][short], counts[short])])
    docs = np.concatenate([owner[: len(grams)][fits], short])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[fresh], docs[fresh]
    return hashes, np.searchsorted(docs, np.arange(words.n + 1))


def signatures(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """One row of 2 x PERMUTATIONS values for each run that starts at heads."""
    out = np.empty((len(heads), 2 * PERMUTATIONS), U)
    for i in range(PERMUTATIONS):
        h = (hashes ^ _FLIP[i]) * _TIMES[i]
        out[:, 2 * i] = np.minimum.reduceat(h, heads)
        out[:, 2 * i + 1] = np.maximum.reduceat(h, heads)
    return out


def _sign(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of bands of `rows` values, sketches and parity maps of texts."""
    n_bands = 2 * PERMUTATIONS // rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["did", "n", "h1", "h2", "bands", "s1", "s2", "parity"]
        for batch in batches:
            for part in chunks(batch, size=CHUNK):
                hashes, first = shingles(part.column("text"))
                counts = np.diff(first)
                some = np.flatnonzero(counts)
                bands = np.zeros((part.num_rows, n_bands), U)
                parity = np.zeros((part.num_rows, PARITY), U)
                sums, sketch = np.zeros((2, part.num_rows), U), np.zeros((2, part.num_rows), U)
                if len(some):
                    heads = first[:-1][some]
                    values = signatures(hashes, heads)
                    key = np.broadcast_to(_BAND[:n_bands], (len(some), n_bands)).copy()
                    for r in range(rows):
                        key = mix(key ^ values[:, r * n_bands : (r + 1) * n_bands])
                    bands[some] = key
                    bits = mix(values[:, :128]) >> U(63)
                    place = mix(hashes ^ U(0x27BB2EE687B0B0FD))
                    flip, at = U(1) << (place & U(63)), (place >> U(6)) & U(PARITY - 1)
                    for i in range(PARITY):
                        parity[some, i] = np.bitwise_xor.reduceat(np.where(at == i, flip, U(0)), heads)
                    for half in range(2):
                        sketch[half, some] = (bits[:, 64 * half : 64 * half + 64] << np.arange(64, dtype=U)).sum(axis=1, dtype=U)
                        sums[half, some] = np.add.reduceat(mix(hashes ^ U(0x5851F42D4C957F2D + half)), heads)
                lists, maps = (pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * x.shape[1]), pa.array(signed(x.ravel()))) for x in (bands, parity))
                columns = [part.column("did"), pa.array(counts.astype(np.int64)), pa.array(signed(sums[0])), pa.array(signed(sums[1])), lists, pa.array(signed(sketch[0])), pa.array(signed(sketch[1])), maps]
                yield pa.RecordBatch.from_arrays(columns, names)

    return sign


def _possible(a: str, b: str, threshold: int) -> Column:
    """Whether sizes, sketches and parity maps leave room for a link between rows with prefixes a and b."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    bits = lambda c: F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c)))
    apart = sum((F.bit_count(F.col(f"{a}parity")[i].bitwiseXOR(F.col(f"{b}parity")[i])) for i in range(1, PARITY)), F.bit_count(F.col(f"{a}parity")[0].bitwiseXOR(F.col(f"{b}parity")[0])))
    # linked sets of s elements together differ in at most s * (100 - threshold) / (100 + threshold)
    return (
        (F.least(na, nb) * 100 >= F.greatest(na, nb) * threshold)
        & (bits("s1") + bits("s2") <= sketch_bits(threshold))
        & (apart * (100 + threshold) <= (na + nb) * (100 - threshold))
    )


def _confirm(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of texts whose sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text_a", CHUNK):
                hashes, first = shingles(part.column("text_a"))
                bs = part.column("b").to_pylist()
                fresh = [i for i, b in enumerate(bs) if b not in held and (i == 0 or bs[i - 1] != b)]
                if fresh:
                    if len(held) > 64:
                        wanted = set(bs)
                        held = {k: v for k, v in held.items() if k in wanted}
                    other, at = shingles(part.column("text_b").take(pa.array(fresh)))
                    held.update((bs[i], other[at[j] : at[j + 1]]) for j, i in enumerate(fresh))
                keep = []
                for i, b in enumerate(bs):
                    x, y = hashes[first[i] : first[i + 1]], held[b]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= threshold * (len(x) + len(y) - common) and len(x) > 0)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))

    return check


def confirm(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are links on full sets."""
    a = texts.select(F.col("did").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("did").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").sortWithinPartitions("b")
    return both.mapInArrow(_confirm(threshold), "a long, b long").distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, size=CHUNK):
            hashes, first = shingles(part.column("text"))
            dids = np.repeat(part.column("did").to_numpy(), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(dids), pa.array(signed(hashes))], ["did", "shingle"])


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: did, n_shingles, component (both keys as in text_key), kept. Linked are sets of a Jaccard
    similarity of `threshold` hundredths or more.

    Null and empty texts have no shingles and are linked with nothing. Rows that share an id are one document for linking;
    rows without an id are one if they share a text, and come after all others. Equal rows get equal results; an empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text_key(text).alias("did"), text.alias("text"))
    sets = cut(texts.mapInArrow(_sign(band_rows(threshold)), "did long, n long, h1 long, h2 long, bands array<long>, s1 long, s2 long, parity array<long>"), "sets")
    first = [F.first(c).alias(c) for c in ("n", "bands", "s1", "s2", "parity")]
    classes = cut(sets.where("n > 0").groupBy("h1", "h2").agg(F.min("did").alias("rep"), *first), "classes")
    entries = classes.select(F.explode("bands").alias("bucket"), "rep")
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("hub")).where("size > 1").withColumn("n", F.col("size"))
    members = cut(spread_join(entries, buckets, ["bucket"], ["size", "hub"], F.col("rep")), "members")
    about = classes.select("rep", "n", "s1", "s2", "parity")

    def sided(side: str) -> DataFrame:
        return about.select(F.col("rep").alias(side), *[F.col(c).alias(side + c) for c in ("n", "s1", "s2", "parity")])

    def stars(hubs: DataFrame) -> DataFrame:
        pairs = hubs.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
        return pairs.join(sided("a"), "a").join(sided("b"), "b").where(_possible("a", "b", threshold)).select("a", "b")

    # texts of the documents that any later step may compare
    pairs = stars(members)
    live = pairs.select("a").unionAll(pairs.select("b")).unionAll(members.where("size > 2").select("rep")).toDF("did").distinct()
    texts = cut(texts.join(live, "did", "left_semi"), "texts")
    # shingles that only one member of the big buckets has: a lower bound on what a member lacks in any partner there
    big = members.where(F.col("size") > BIG_BUCKET)
    crowd = big.select(F.col("rep").alias("did")).distinct()
    single = texts.join(crowd, "did", "left_semi").distinct().mapInArrow(_shingle_rows, "did long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("rep"))
    unique = cut(single.where("n = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("u")), "unique")
    central = big.join(unique, "rep", "left").fillna(0, ["u"]).groupBy("bucket").agg(F.min(F.struct("u", "rep")).alias("best")).select("bucket", F.col("best.rep").alias("hub"))
    hubs = members.where(F.col("size") <= BIG_BUCKET).select("rep", "hub").unionAll(big.drop("hub").join(central, "bucket").select("rep", "hub"))
    proposed = cut(stars(hubs), "stars")
    links = cut(confirm(proposed, texts, threshold), "confirmed")
    joined = components(links)
    # buckets that the links leave in several components
    placed = members.where("size > 2").join(joined.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("bucket", "rep", "size", F.coalesce("comp", "rep").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    attributes = about.join(unique, "rep", "left").fillna(0, ["u"])
    # a unique shingle is so among members of big buckets only: elsewhere it rules nothing out
    inner = placed.join(mixed, "bucket").join(attributes, "rep").withColumn("u", F.when(F.col("size") > BIG_BUCKET, F.col("u")).otherwise(0))
    inner = inner.where(F.col("u") * 100 <= F.col("n") * (100 - threshold))
    side = lambda s: inner.select("bucket", F.col("rep").alias(s), F.col("comp").alias(f"{s}_comp"), *[F.col(c).alias(s + c) for c in ("n", "s1", "s2", "parity")])
    across = side("a").join(side("b"), "bucket").where((F.col("a_comp") < F.col("b_comp")) & _possible("a", "b", threshold))
    further = across.select("a", "b").distinct()
    for a, b in (("a", "b"), ("b", "a")):
        further = further.join(proposed.select(F.col(a).alias("a"), F.col(b).alias("b")), ["a", "b"], "left_anti")
    more = cut(confirm(further, texts, threshold), "confirmed")
    if not more.isEmpty():
        joined = components(links.unionAll(more))
    reps = sets.join(classes.select("h1", "h2", "rep"), ["h1", "h2"], "left").select("did", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    out = reps.join(joined.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    out = out.select("did", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "did").alias("component"))
    return out.withColumn("kept", F.col("did") == F.col("component"))


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one document of each group: the one of least id, and of equal rows with this id one.

    Each id with its text is a document here: rows without an id, or of a repeated id, stay or go by their own text. Texts
    without words are in no group and stay.
    """
    did, node = doc_key(), F.xxhash64(doc_key(), F.xxhash64("text"))
    linked = near_duplicates(docs.select(node.alias("doc_id"), "text"), threshold).where("n_shingles > 0").select(F.col("did").alias("node"), "component").distinct()
    placed = docs.select(node.alias("node"), did.alias("did")).distinct().join(linked, "node")
    first = placed.groupBy("component").agg(F.min(F.struct("did", "node")).alias("first")).select("first.node")
    gone = placed.select("node").join(first, "node", "left_anti")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), node.alias("node"))
    kept = keyed.join(gone, "node", "left_anti")
    return kept.withColumn("copy", F.row_number().over(Window.partitionBy("node").orderBy("node"))).where("copy = 1").select("row.*")


def op10_minmax_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs, THRESHOLD)
    named = lambda key: F.when(F.col(key) < F.lit(UNNAMED), F.col(key))
    return out.select(named("did").alias("doc_id"), "n_shingles", named("component").alias("component_id"), "kept")


def op10_sql() -> str:
    """DuckDB SQL for the same rows: all pairs that share a shingle, and what is reachable by links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS g FROM t),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b
  FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= {THRESHOLD} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {THRESHOLD} * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS node, doc_id AS comp FROM s UNION SELECT l.b, r.comp FROM r JOIN links l ON l.a = r.node AND l.b > r.comp)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(comp) AS component_id, s.doc_id = min(comp) AS kept
FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, g"""
