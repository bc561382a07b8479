"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet at shared seeds: windows of SEED words, found by their hashes. For each pair that shares
seeds, the longest match of unmarked words is marked again and again, down to SEED words: running Karp-Rabin hashes of all
unmarked windows of one length tell whether there is a match that long, and the greatest such length is found by halving. The
share of an item's words that tiles cover tells contamination, in whatever order its passages stand in the document.

The benchmark is taken in blocks of at most BLOCK_BYTES of text, one pass over the documents for each; a pass ends in the
shared folder, so that one block is in memory at a time. Documents are never shuffled, so no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.session import cut, prepare
from lodestone.llm.textkit import NON_ALNUM, Words, chunks

SEED = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6
BLOCK_BYTES = 4 << 20
HIT = pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64())])
HITS = pa.list_(HIT)


def _runs(free: np.ndarray) -> np.ndarray:
    """For each place, how many unmarked words begin there in a row."""
    places = np.arange(len(free))
    stops = np.where(free, len(free), places)
    return np.minimum.accumulate(stops[::-1])[::-1] - places


class Sides:
    """Unmarked windows of words lo..hi-1 of `one` and of `two`, there at `places` only."""

    def __init__(self, one: Words, lo: int, hi: int, two: Words, places: np.ndarray, end: int):
        self.one, self.lo, self.two, self.places = one, lo, two, places
        self.base = int(places[0]) if len(places) else 0
        self.free = [np.ones(hi - lo, bool), np.ones(max(0, end - self.base), bool)]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        return _runs(self.free[0]), _runs(self.free[1])[self.places - self.base]

    def windows(self, runs: tuple[np.ndarray, np.ndarray], length: int) -> list[np.ndarray]:
        """Places and hashes of unmarked windows of one length: of `one`, then of `two`."""
        p, q = np.flatnonzero(runs[0] >= length), self.places[runs[1] >= length]
        return [p, self.one.spans(self.lo + p, length), q, self.two.spans(q, length)]

    def longest(self, runs: tuple[np.ndarray, np.ndarray], least: int, most: int) -> int:
        """The greatest length up to `most` of which unmarked windows agree; below `least` if there is none."""
        most = min(most, *(int(r.max(initial=0)) for r in runs))
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            _, a, _, b = self.windows(runs, middle)
            low, high = (middle, high) if np.isin(a, b).any() else (low, middle - 1)
        return low

    def mark(self, length: int, runs: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
        """Tiles of this length: the least place in `one` first, with the least place in `two` that is still unmarked."""
        p, a, q, b = self.windows(runs, length)
        order = np.argsort(b, kind="stable")
        q, b = q[order], b[order]
        first, last = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
        # where in a hash's places to go on: a window that is marked stays so
        onward: dict[int, int] = {}
        tiles = []
        for i in np.flatnonzero(first < last).tolist():
            at, h = int(p[i]), int(a[i])
            if not self.free[0][at : at + length].all():
                continue
            j = onward.get(h, int(first[i]))
            while j < last[i] and not self.free[1][q[j] - self.base : q[j] - self.base + length].all():
                j += 1
            onward[h] = j
            if j < last[i]:
                there = int(q[j])
                self.free[0][at : at + length] = self.free[1][there - self.base : there - self.base + length] = False
                tiles.append((at, there, length))
        return tiles


def tile(one: Words, lo: int, hi: int, two: Words, places: np.ndarray, end: int, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in one, place in two, length) between words lo..hi-1 of `one` and `two` at sorted places (up to `end`).

    The longest match of unmarked words comes first, of equally long ones that with the least place in one, then in two.
    """
    sides, tiles, length = Sides(one, lo, hi, two, places, end), [], hi - lo
    while length >= least:
        runs = sides.runs()
        length = sides.longest(runs, least, length)
        if length >= least:
            tiles += sides.mark(length, runs)
        length -= 1
    return tiles


class Block:
    """Words and seeds of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.words = Words(pa.array(texts, pa.string()), NON_ALNUM, lower=True)
        grams, fits = self.words.windows(SEED), self.words.fits(SEED)
        owner = self.words.owner()[: len(grams)]
        grams, owner = grams[fits], owner[fits]
        order = np.lexsort((owner, grams))
        grams, owner = grams[order], owner[order]
        # a seed that an item repeats counts once
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        self.seeds, self.items = grams[fresh], owner[fresh]

    def hits(self, texts: pa.Array) -> list[list[dict]]:
        """For each text, the items with shared seeds: coverage and number of tiles."""
        words = Words(texts, NON_ALNUM, lower=True)
        out: list[list[dict]] = [[] for _ in range(words.n)]
        grams = words.windows(SEED)
        if not len(grams) or not len(self.seeds):
            return out
        low = np.searchsorted(self.seeds, grams)
        shared = np.flatnonzero((self.seeds[np.minimum(low, len(self.seeds) - 1)] == grams) & words.fits(SEED))
        low, high = low[shared], np.searchsorted(self.seeds, grams[shared], "right")
        times = high - low
        # a row for each place and item that share a seed, by document, item and place
        place = np.repeat(shared, times)
        item = self.items[np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))]
        doc = words.owner()[place]
        order = np.lexsort((place, item, doc))
        doc, item, place = doc[order], item[order], place[order]
        heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])) if len(doc) else np.zeros(0, np.int64)
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(doc)]):
            lo, hi = int(self.words.first[item[a]]), int(self.words.first[item[a] + 1])
            # a tile's every window is a seed: only places of seeds can begin one
            tiles = tile(self.words, lo, hi, words, place[a:b], int(place[b - 1]) + SEED)
            if tiles:
                out[doc[a]].append({"item_id": self.ids[item[a]], "coverage": sum(t[2] for t in tiles) / (hi - lo), "tiles": len(tiles)})
        return out


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of bounded size. Items with fewer than SEED words can't be found; items without an id can."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy(F.asc_nulls_last("item_id"), "text").collect()
        yield Block([r["item_id"] for r in rows], [r["text"] for r in rows])


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs with _hits (items that share tiles with the text: item_id, coverage, tiles) and _contaminated.

    A document is contaminated if tiles cover at least `coverage` of an item's words. Null and empty texts have no hits; equal
    rows are judged alike; an empty benchmark contaminates nothing; no documents give no rows; older _hits and _contaminated
    give way, other columns pass through.
    """
    spark = prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("_hits", "_contaminated")]
    table = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<struct<item_id:long,coverage:double,tiles:long>>").alias("hits"))
    schema = T.StructType([table.schema["row"], table.schema["text"], T.StructField("hits", table.schema["hits"].dataType)])

    def add(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    found = shared.value.hits(part.column("text"))
                    before = part.column("hits").to_pylist()
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array([x + y for x, y in zip(before, found)], HITS)], ["row", "text", "hits"])

        return run

    for n, block in enumerate(blocks(benchmark)):
        if n:
            table = cut(table, "hits")
        table = table.mapInArrow(add(spark.sparkContext.broadcast(block)), schema)
    back = [F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(kept)]
    return table.select(*back, F.col("hits").alias("_hits"), F.exists("hits", lambda h: h["coverage"] >= coverage).alias("_contaminated"))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = F.array_max(F.transform("_hits", lambda h: F.struct(h["coverage"].alias("coverage"), (-h["item_id"]).alias("item"), h["tiles"].alias("tiles"))))
    leaked = F.transform(F.filter("_hits", lambda h: h["coverage"] >= COVERAGE), lambda h: h["item_id"])
    return out.select(
        "doc_id", F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), F.coalesce(best["tiles"], F.lit(0)).cast("long").alias("n_tiles"),
        F.array_sort(F.array_compact(leaked)).alias("item_ids"), F.col("_contaminated").alias("contaminated"), (~F.col("_contaminated")).alias("kept"),
    )
