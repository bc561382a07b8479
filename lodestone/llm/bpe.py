"""Byte-level BPE by a segment tree over byte positions.

Leaf i of a piece's tree holds the rank of the pair that starts at byte position i (none: a large number); inner nodes hold
the least rank below them, the left one on ties. The root names the leftmost pair of least rank; a merge updates the two
leaves of the merged pair and the leaf of the live neighbour to its left, each in as many steps as the tree is high.
Pieces of up to WIDE bytes are merged many at a time, a forest of equal trees as one array; longer ones singly.
Each distinct piece of a chunk is merged once; what a task keeps between chunks is bounded.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.session import prepare
from lodestone.llm.textkit import chunks

NONE = np.int32(2**30)
WIDE = 64
#: Bytes of text that a worker splits at a time.
CHUNK = 1 << 19
#: Pieces that a task remembers; beyond that it starts anew.
REMEMBERED = 1 << 17


class Vocabulary:
    """Ranks of byte strings; the rank of a pair of tokens is that of their joined bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.token = [b""] * (max(ranks.values()) + 1)
        keys, values = array("q"), array("i")
        for whole, rank in ranks.items():
            self.token[rank] = whole
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(values, np.int32)[order], NONE)
        self.forget()

    def forget(self) -> None:
        """Known pieces: their number, and where in `flat` their ids begin and how many they are."""
        self.memory: dict[str, int] = {}
        self.flat, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where one side is missing (-1) or the pair is no token."""
        keys = (a << 32) | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((self.pair_keys[at] == keys) & (a >= 0) & (b >= 0), self.pair_ranks[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """One piece, by its own segment tree."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        ids = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        base = 1
        while base < n:
            base *= 2
        none, ranks, token = int(NONE), self.ranks, self.token
        rank_of = lambda a, b: ranks.get(token[a] + token[b], none)
        tree = [none] * (2 * base)
        for i in range(n - 1):
            tree[base + i] = rank_of(ids[i], ids[i + 1])
        for node in range(base - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, rank: int) -> None:
            node = base + i
            tree[node] = rank
            node //= 2
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least
                node //= 2

        while tree[1] != none:
            node, least = 1, tree[1]
            while node < base:
                node *= 2
                if tree[node] != least:
                    node += 1
            i = node - base
            j = after[i]
            ids[i] = least
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
            put(j, none)
            put(i, rank_of(ids[i], ids[k]) if k < n else none)
            if before[i] >= 0:
                put(before[i], rank_of(ids[before[i]], ids[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_forest(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Pieces of at most width bytes (a power of two), one tree each, a merge in each unfinished tree at a time."""
        m = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[raw], -1)
        after = np.tile(np.arange(1, width + 1), (m, 1))
        before = np.tile(np.arange(-1, width - 1), (m, 1))
        tree = np.full((m, 2 * width), NONE, np.int32)
        tree[:, width : 2 * width - 1] = self.pair_rank(ids[:, :-1], ids[:, 1:])
        size = width
        while size > 1:
            tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size //= 2

        def put(rows: np.ndarray, i: np.ndarray, ranks: np.ndarray) -> None:
            node = i + width
            tree[rows, node] = ranks
            node >>= 1
            while node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node >>= 1

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            least = tree[rows, 1]
            node = np.ones(len(rows), np.int64)
            while node[0] < width:
                node *= 2
                node += tree[rows, node] != least
            i = node - width
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = least
            ids[rows, j] = -1
            after[rows, i] = k
            inside = k < width
            before[rows[inside], k[inside]] = i[inside]
            following = np.where(inside, ids[rows, np.minimum(k, width - 1)], -1)
            put(rows, j, np.full(len(rows), NONE, np.int32))
            put(rows, i, self.pair_rank(least.astype(np.int64), following))
            h = before[rows, i]
            left = np.flatnonzero(h >= 0)
            if len(left):
                put(rows[left], h[left], self.pair_rank(ids[rows[left], h[left]], least[left].astype(np.int64)))
            rows = rows[tree[rows, 1] != NONE]
        keep = ids >= 0
        flat = ids[keep].astype(np.int32)
        return np.split(flat, np.cumsum(keep.sum(axis=1))[:-1])

    def merge(self, pieces: list[str]) -> list[np.ndarray]:
        """Token ids of each distinct piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        for n, piece in enumerate(raw):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[n] = np.array([rank], np.int32)
            elif len(piece) > WIDE:
                out[n] = np.array(self.merge_one(piece), np.int32)
            else:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(n)
        for width, which in by_width.items():
            for lo in range(0, len(which), 4096):
                part = which[lo : lo + 4096]
                for n, ids in zip(part, self.merge_forest([raw[n] for n in part], width)):
                    out[n] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's ids begin (and the last end)."""
        found = [self.pattern.findall(t) for t in texts]
        pieces = list(chain.from_iterable(found))
        if len(self.memory) > REMEMBERED:
            self.forget()
        places = list(map(self.memory.get, pieces))
        if None in places:
            fresh = list({p for p, place in zip(pieces, places) if place is None})
            merged = self.merge(fresh)
            sizes = np.fromiter(map(len, merged), np.int64, len(merged))
            self.memory.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh))))
            self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, *merged])
            places = list(map(self.memory.__getitem__, pieces))
        at = np.array(places, dtype=np.int64)
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        # all pieces' ids one after the other: each id is its piece's begin and its place in the piece
        ids = self.flat[np.repeat(self.begins[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.cumsum([0, *map(len, found)])]


class Tokens:
    """The bytes of each id, which is all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        bytes_of = {i: b for b, i in ranks.items()}
        self.table = pa.array([bytes_of.get(i, b"") for i in range(max(bytes_of, default=-1) + 1)], pa.large_binary())

    def decode(self, ids: pa.Array) -> pa.Array:
        """Bytes of each list of ids; null for a null list."""
        ids = ids.cast(pa.large_list(pa.int32())) if not pa.types.is_large_list(ids.type) else ids
        flat = ids.flatten()
        tokens = self.table.take(flat)
        ends = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
        lengths = np.where(np.array(ids.is_null()), 0, np.array(pa.compute.list_value_length(ids).fill_null(0)))
        bounds = ends[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
        data = tokens.buffers()[2].to_pybytes() if len(tokens) and tokens.buffers()[2] is not None else b""
        return pa.array([None if null else data[a:b] for null, a, b in zip(ids.is_null().to_pylist(), bounds[:-1], bounds[1:])], pa.binary())


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(read_ranks(path))


def _bounds(n: np.ndarray) -> pa.Array:
    return pa.array(n.astype(np.int32))


def _encoded(docs: DataFrame, path: str, pattern: str, column: str, back: str | None) -> DataFrame:
    """Rows of docs without `column` as `row`, `_ids`, and with `back` the decoded ids' bytes or whether they are the text's.

    One pass in one worker: the text goes in once, and comes back only if its decoded bytes are asked for.
    """
    prepare(docs.sparkSession)
    # a struct needs a field, even where no other column is kept
    packed = docs.select(F.struct(F.lit(True).alias("some"), *[c for c in docs.columns if c != column]).alias("row"), F.col(column).cast("string").alias("value"))
    kinds = {"bytes": T.StructField("_bytes", T.BinaryType()), "exact": T.StructField("_exact", T.BooleanType())}
    schema = T.StructType([packed.schema["row"], T.StructField("_ids", T.ArrayType(T.IntegerType(), False), False), *([kinds[back]] if back else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        table = tokens(path) if back else None
        for batch in batches:
            for part in chunks(batch, "value", CHUNK):
                texts = part.column("value").fill_null("")
                flat, bounds = vocab.encode(texts.to_pylist())
                ids = pa.ListArray.from_arrays(_bounds(bounds), pa.array(flat))
                columns = [part.column("row"), ids]
                if back:
                    decoded = table.decode(ids)
                    columns.append(decoded if back == "bytes" else pa.compute.equal(decoded, texts.cast(pa.binary())))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        vocab.forget()  # the worker lives on, for other operators

    return packed.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """docs with `_ids`, the token ids of the whole text; the rank file must be at `path` on every executor.

    Null texts count as empty: no ids. Other columns pass through whatever their names, an old `_ids` gives way; rows stay
    rows, equal rows get equal ids; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c != "_ids"]
    twin = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(column).alias("value"))
    out = _encoded(twin, path, pattern, "value", None)
    return out.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(kept)], "_ids")


def round_trip(docs: DataFrame, path: str, pattern: str, column: str = "text", back: str = "exact") -> DataFrame:
    """docs without `column`, with `_ids` as encode() gives them, and what they decode to: `_bytes` (back="bytes"), or `_exact`,
    whether these are the text's bytes (back="exact"). Nulls and columns as for encode()."""
    added = {"exact": "_exact", "bytes": "_bytes"}[back]
    kept = [c for c in docs.columns if c not in (column, "_ids", added)]
    twin = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(column).alias("value"))
    out = _encoded(twin, path, pattern, "value", back)
    return out.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(kept)], "_ids", added)


def decode(ids: DataFrame, path: str, column: str = "_ids") -> DataFrame:
    """ids with `_bytes`, the joined bytes of the tokens; null where the list is null. An empty table gives an empty result."""
    prepare(ids.sparkSession)
    kept = [c for c in ids.columns if c != "_bytes"]
    packed = ids.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.col(column).cast("array<int>").alias("value"))
    schema = T.StructType([packed.schema["row"], T.StructField("_bytes", T.BinaryType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column("row"), table.decode(part.column("value"))], ["row", "_bytes"])

    return packed.mapInArrow(run, schema).select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(kept)], "_bytes")


def op5_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = round_trip(docs, path, pattern, back="bytes")
    return out.select(
        "doc_id", F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"),
    )
