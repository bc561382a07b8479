"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda.

The agenda holds the adjacent symbol pairs whose joined piece is in the vocabulary. The pair of best score is merged, the left
one on ties; its neighbours enter the agenda anew. The agendas of parts of up to SHORT symbols stand one after the other in an
array, and each is searched for its best entry at the same time; beyond that an agenda is a heap with stale entries left in it.
Symbols that are no piece become their bytes' pieces.

Text is cut first where no piece can reach across: before runs of spaces and at line feeds, as far as the vocabulary's pieces
really don't. Parts that occurred lately are remembered, in two generations of bounded size: a full one becomes the old one, and
parts of that which occur again move on.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.session import prepare
from lodestone.llm.textkit import chunks

#: How the vocabulary writes a space.
SPACE = "▁"
SHORT = 48
#: Bytes of text that a worker encodes at a time.
CHUNK = 1 << 19
#: Parts, and ids in them, that a generation of a worker's memory holds.
REMEMBERED, REMEMBERED_IDS = 1 << 18, 1 << 21
NONE = np.int32(2**30)
#: What stands for a byte that is no UTF-8.
REPLACEMENT = "�".encode()


class Memory:
    """Known parts: where in `flat` their ids begin, how many they are, and whether the library has the same."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.begins, self.sizes, self.agreed = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def full(self) -> bool:
        return len(self.places) > REMEMBERED or len(self.flat) > REMEMBERED_IDS

    def add(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray, agreed: np.ndarray) -> None:
        self.places.update(zip(parts, range(len(self.sizes), len(self.sizes) + len(parts))))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])
        self.agreed = np.concatenate([self.agreed, agreed])

    def find(self, parts: list[str]) -> np.ndarray:
        """Each part's number, -1 where it is not known."""
        return np.fromiter(map(self.places.get, parts, repeat(-1)), np.int64, len(parts))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts one after the other, and where each part's begin (and the last end)."""
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return self.flat[np.repeat(self.begins[at] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Pieces:
    """A merge-type vocabulary with byte pieces that adds a space in front and normalises nothing else."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.vocab_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        if len(self.byte_ids) != 256 or any(lib.is_unused(i) for i in range(n)) or lib.encode(" ") != lib.encode(SPACE) or lib.decode(lib.encode("ﬁ  x ")) != "ﬁ  x ":
            raise ValueError("the vocabulary must have all byte pieces, no unused ones, and leave text as it is")
        # here a space is a space
        self.ids = {names[i].replace(SPACE, " "): i for i in plain}
        scores = {p: lib.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        if not all(c in self.ids for p in scores for c in p):
            raise ValueError("pieces must consist of characters that are pieces")
        best = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        #: the place by score of a merge to this piece, best first, equal scores at one place
        self.order = {p: best[score] for p, score in scores.items()}
        self._pairs()
        inner = any(" " in p.lstrip(" ") for p in scores)
        self.lines = any("\n" in p for p in self.ids)
        stop = "" if self.lines else "\\n"
        self.parts = re.compile(".+" if inner else f" +[^ {stop}]*|[^ {stop}]+" + ("" if self.lines else "|\\n"), re.S)
        # what an id says: bytes, and whether they are a single byte's
        says = [b""] * n
        for i in plain:
            says[i] = names[i].replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            says[i] = bytes([byte])
        says[self.unknown] = " ⁇ ".encode()
        self.says = pa.array(says, pa.large_binary())
        self.single = np.zeros(n, bool)
        self.single[list(self.byte_ids.values())] = True
        self.spaced = np.array([bool(s) and s[0] == 32 for s in says]) & ~self.single
        self.spaced[self.unknown] = False
        self.silent = np.array([lib.is_control(i) for i in range(n)])
        self.forget()

    def _pairs(self) -> None:
        """As arrays: ids of characters; pairs of pieces that join to one, with the place by score and the id of what they join to."""
        self.of_char = -1 - np.arange(0x110000, dtype=np.int64)  # none: told from the character
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        cuts = ((p, p[:k], p[k:]) for p in self.order for k in range(1, len(p)))
        found = sorted((self.ids[a] << 32 | self.ids[b], self.order[p], self.ids[p]) for p, a, b in cuts if a in self.ids and b in self.ids)
        table = np.array([*found, (np.iinfo(np.int64).max, NONE, -1)], np.int64)
        self.pair_keys, self.pair_order, self.pair_joined = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].copy()

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place by score, joined id) of pairs; NONE if they don't join."""
        keys = a << 32 | b
        keys[(a < 0) | (b < 0)] = -1
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_order[at], NONE), self.pair_joined[at]

    def forget(self) -> None:
        self.memory, self.old = Memory(), Memory()

    def _side_by_side(self, parts: list[str]) -> list[list[int]]:
        """The symbols of short parts (ids, or -1 - a character) after all merges, the best of each part at a time."""
        out: list[list[int]] = [[]] * len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        symbols = self.of_char[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        who = np.arange(len(parts))
        last = np.cumsum(sizes) - 1
        order, joined = np.full(len(symbols), NONE, np.int32), np.full(len(symbols), -1, np.int64)
        order[:-1], joined[:-1] = self._pair(symbols[:-1], symbols[1:])
        order[last] = NONE
        while len(who):
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            best = np.minimum.reduceat(order, first)
            live = best != NONE
            if not live.all():
                keep = np.repeat(live, sizes)
                done, begin = symbols[~keep].tolist(), 0
                for n, size in zip(who[~live].tolist(), sizes[~live].tolist()):
                    out[n] = done[begin : begin + size]
                    begin += size
                symbols, order, joined = symbols[keep], order[keep], joined[keep]
                who, sizes, best = who[live], sizes[live], best[live]
                if not len(who):
                    break
            owner = np.repeat(np.arange(len(who)), sizes)
            at = np.flatnonzero(order == best[owner])
            of = owner[at]
            at = at[np.concatenate([[True], of[1:] != of[:-1]])]  # the left one on ties: one in each part
            symbols[at] = joined[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, order, joined = symbols[keep], order[keep], joined[keep]
            at -= np.arange(len(at))
            sizes = sizes - 1
            ends = np.cumsum(sizes)
            for left, valid in ((at, at + 1 < ends), (at - 1, at > ends - sizes)):
                order[left[valid]], joined[left[valid]] = self._pair(symbols[left[valid]], symbols[left[valid] + 1])
            order[at[at + 1 == ends]] = NONE
        return out

    def _heap(self, part: str) -> list[str]:
        symbols, order, n = list(part), self.order.get, len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, 2) for i in range(n - 1) if (c := order(part[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, length = heapq.heappop(agenda)
            j = after[i]
            if j >= n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != length:
                continue  # one side was merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (c := order(symbols[left] + symbols[right])) is not None:
                    heapq.heappush(agenda, (c, left, len(symbols[left]) + len(symbols[right])))
        return [s for s in symbols if s]

    def merge(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part."""
        out: list[list[int]] = [[]] * len(parts)
        short = [n for n, p in enumerate(parts) if len(p) <= SHORT]
        for lo in range(0, len(short), 4096):
            some = short[lo : lo + 4096]
            for n, symbols in zip(some, self._side_by_side([parts[n] for n in some])):
                out[n] = symbols
                if min(symbols) < 0:
                    out[n] = [i for s in symbols for i in ([s] if s >= 0 else [self.byte_ids[b] for b in chr(-1 - s).encode()])]
        for n, p in enumerate(parts):
            if len(p) > SHORT:
                out[n] = [i for s in self._heap(p) for i in ([self.ids[s]] if s in self.ids else [self.byte_ids[b] for b in s.encode()])]
        return out

    def theirs(self, parts: list[str]) -> list[list[int]]:
        """The library's ids of each part. Behind a line feed that no piece holds, a part stands as it does within a text."""
        if self.lines:
            return self.library.encode([p[1:] for p in parts], num_threads=1)
        return [ids[2:] for ids in self.library.encode(["\n" + p for p in parts], num_threads=1)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' ids in one array, where each text's ids begin (and the last end), and whether the library has the same
        ids for all parts of a text."""
        found = [self.parts.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        parts = list(chain.from_iterable(found))
        if self.memory.full():
            self.memory, self.old = Memory(), self.memory
        at = self.memory.find(parts)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lacking = [parts[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(lacking)))
            at[missing] = self.memory.find(lacking)
        ids, ends = self.memory.ids(at)
        firsts = np.cumsum([0, *map(len, found)])
        doubts = np.concatenate([[0], np.cumsum(~self.memory.agreed[at])])
        return ids, ends[firsts], doubts[firsts[1:]] == doubts[firsts[:-1]]

    def _learn(self, parts: list[str]) -> None:
        """Parts move on from the old generation, or are merged and compared with the library's."""
        at = self.old.find(parts)
        again = at[at >= 0]
        if len(again):
            self.memory.add([p for p, n in zip(parts, at.tolist()) if n >= 0], self.old.ids(again)[0], self.old.sizes[again], self.old.agreed[again])
        fresh = [p for p, n in zip(parts, at.tolist()) if n < 0]
        if fresh:
            merged = self.merge(fresh)
            sizes = np.fromiter(map(len, merged), np.int64, len(merged))
            same = np.fromiter(map(list.__eq__, merged, self.theirs(fresh)), bool, len(merged))
            self.memory.add(fresh, np.fromiter(chain.from_iterable(merged), np.int32, int(sizes.sum())), sizes, same)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts of the ids between the bounds. Bytes that are no UTF-8 become U+FFFD, one each; other ids are refused."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.single)):
            raise ValueError("an id is not in the vocabulary")
        taken = self.says.take(pa.array(ids, pa.int64()))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        data = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] is not None else b""
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = ids[lo:hi]
            spoken = np.flatnonzero(~self.silent[own])
            strip = int(len(spoken) > 0 and self.spaced[own[spoken[0]]])
            whole = data[int(ends[lo]) + strip : int(ends[hi])]
            split = len(spoken) > 0 and spoken[-1] - spoken[0] >= len(spoken)  # a silent id parts bytes
            out.append(self._mended(own, strip) if split or not _is_text(whole) else whole)
        return out

    def _mended(self, ids: np.ndarray, strip: int) -> bytes:
        """Joined bytes in which each run of byte pieces is made valid."""
        out, run = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.single[i]:
                run += self.says[i].as_py()
                continue
            at = 0
            while at < len(run):
                size = next((n for n in (1, 2, 3, 4) if _is_text(run[at : at + n])), 0)
                out.append(run[at : at + size] if size else REPLACEMENT)
                at += size or 1
            run = b""
            if i >= 0:
                out.append(self.says[i].as_py())
        return b"".join(out)[strip:]


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """An end id after each text's ids."""
    out = np.insert(ids, bounds[1:], end).astype(np.int32)
    return out, bounds + np.arange(len(bounds))


def _renamed(docs: DataFrame, column: str, kept: list[str]) -> DataFrame:
    """The kept columns as a struct of plain names, so that no name can clash, and the column as `value`."""
    return docs.select(F.struct(F.lit(True).alias("some"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.col(column).alias("value"))


def _named(out: DataFrame, kept: list[str], added: list[str]) -> DataFrame:
    return out.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(kept)], *added)


def round_trip(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs without `column`, with `_ids` (an end id last), `_text` (what they decode to) and `_agrees`: whether the sentencepiece
    library has the same ids for each part of the text. It is asked in each Arrow batch, about the parts that are new there.

    The model file must be at `path` on every executor. Null texts count as empty: the end id alone, empty text. Other columns
    pass through whatever their names, but old ones of the three added names give way; rows stay rows, equal rows get equal
    ids; an empty table gives an empty result. A text is encoded as a whole; one without spaces takes n log n steps.
    """
    return _encoded(docs, path, column, True)


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs with `_ids`, an end id last. All else as for round_trip(), but `column` stays and nothing is decoded or compared."""
    kept = [c for c in docs.columns if c != "_ids"]
    twin = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(column).alias("value"))
    out = _encoded(twin, path, "value", False)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "_ids")


def _encoded(docs: DataFrame, path: str, column: str, back: bool) -> DataFrame:
    prepare(docs.sparkSession)
    added = ["_ids", "_text", "_agrees"] if back else ["_ids"]
    kept = [c for c in docs.columns if c != column and c not in added]
    packed = _renamed(docs, column, kept).withColumn("value", F.col("value").cast("string"))
    fields = {"_ids": T.ArrayType(T.IntegerType(), False), "_text": T.StringType(), "_agrees": T.BooleanType()}
    schema = T.StructType([packed.schema["row"], *[T.StructField(name, fields[name]) for name in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(path)
        for batch in batches:
            for part in chunks(batch, "value", CHUNK):
                texts = part.column("value").fill_null("").to_pylist()
                ids, bounds, agree = vocab.encode(texts)
                ids, bounds = _with_end(ids, bounds, vocab.end)
                columns = [part.column("row"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                if back:
                    columns += [pa.array([d.decode() for d in vocab.decode(ids, bounds)], pa.string()), pa.array(agree)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
    return _named(packed.mapInArrow(run, schema), kept, added)


def decode(ids: DataFrame, path: str, column: str = "_ids") -> DataFrame:
    """ids with `_text`, what the list of ids says; null where the list is null. Null ids within a list count as not there. Any
    other id than the vocabulary's is an error. An empty table gives an empty result."""
    prepare(ids.sparkSession)
    kept = [c for c in ids.columns if c != "_text"]
    packed = _renamed(ids, column, kept).withColumn("value", F.filter(F.col("value").cast("array<int>"), lambda x: x.isNotNull()))
    schema = T.StructType([packed.schema["row"], T.StructField("_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column("value")
                lengths = np.array(pa.compute.list_value_length(lists).fill_null(0), dtype=np.int64)
                flat = np.array(lists.flatten(), dtype=np.int64)
                texts = vocab.decode(flat, np.concatenate([[0], np.cumsum(lengths)]))
                said = [None if null else t.decode() for null, t in zip(lists.is_null().to_pylist(), texts)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(said, pa.string())], schema.names)

    return _named(packed.mapInArrow(run, schema), kept, ["_text"])


def op11_pieces(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = round_trip(docs, path or public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("_text").cast("binary"), 256).alias("decoded_sha256"), F.col("_agrees").alias("agrees"),
    )
