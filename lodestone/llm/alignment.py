"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

A state is the side that leads, its last token, and the bytes of that token which the other side hasn't matched yet. The other
side's next token is read against these bytes: they get shorter, or run out and leave that token's own rest dangling on the
other side, or both end together and a group closes. The step also links the two tokens, whose bytes overlap. Steps are memoised
by state and next token, so that bytes are compared once for each step that texts bring; a text costs a look-up a token.

Links are counted over the corpus in Spark: each document holds its distinct links and how often it has them; counts are summed
by pair. Pairs that occur often are a table of checked size, which is broadcast; rarer pairs, however many, are joined.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.session import cut, prepare
from lodestone.llm.textkit import chunks

LEFT, RIGHT, CLOSED = 0, 1, 2
#: Bytes of text that a worker aligns at a time.
CHUNK = 1 << 19
#: So much white space in a row is beyond the matcher of the library that merges bytes.
LONG_RUN = 1000
#: Steps that a task remembers; beyond that it starts anew.
REMEMBERED = 1 << 20
#: Pairs of ids that are broadcast at most, the most frequent ones.
FREQUENT = 1 << 19


def byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters as themselves, all others from U+0100 on, in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Left:
    """Byte-level BPE from a tokenizers file, without special tokens: text is split by the pattern, merged by rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        of = byte_of_char()
        special = {t["content"] for t in said.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw
        # merges stand in the order of the ids of what they make, so that these are the ranks
        places = [ranks[bytes(of[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in said["model"]["merges"]]
        if places != sorted(places):
            raise ValueError("the vocabulary's merges must stand in the order of their ids")
        self.merger = tiktoken.Encoding("left", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        self.pattern, self.long_run = regex.compile(pattern), regex.compile(rf"\s{{{LONG_RUN}}}")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._in_steps(t) if len(t) > LONG_RUN and self.long_run.search(t) else self.merger.encode_ordinary(t) for t in texts]

    def _in_steps(self, text: str) -> list[int]:
        """The same, split here and merged piece by piece."""
        return [i for piece in self.pattern.findall(text) for i in self.merger._encode_single_piece(piece)]


class Right:
    """Merge-type pieces from a sentencepiece file, which puts a space in front of the text."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        names = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class State(dict):
    """What dangles: the steps from here by the other side's next token, each (number of the step, next state, who leads there).

    leads: LEFT or RIGHT, the side whose token dangles."""

    __slots__ = ("leads", "token", "rest", "owner")

    def __init__(self, owner: Transducer, leads: int, token: int, rest: bytes):
        self.owner, self.leads, self.token, self.rest = owner, leads, token, rest

    def __missing__(self, token: int) -> tuple[int, State | None, int]:
        self[token] = out = self.owner.step(self, token)
        return out


class Begin(dict):
    """No side leads: the state that each left token leads to."""

    def __init__(self, owner: Transducer):
        self.owner = owner

    def __missing__(self, token: int) -> State:
        self[token] = out = self.owner.state(LEFT, token, self.owner.sides[LEFT][token])
        return out


class Transducer:
    def __init__(self, left: list[bytes], right: list[bytes]):
        self.sides = left, right
        self.forget()

    def forget(self) -> None:
        self.begin = Begin(self)
        self.states: dict[tuple[int, int, int], State] = {}
        # of each step: the pair that it links, which side it reads, whether it closes a group
        self.pairs, self.reads, self.closes = array("q"), array("b"), array("b")

    def state(self, leads: int, token: int, rest: bytes) -> State:
        key = leads, token, len(rest)
        out = self.states.get(key)
        if out is None:
            out = self.states[key] = State(self, leads, token, rest)
        return out

    def step(self, state: State, token: int) -> tuple[int, State | None, int]:
        """Reads a token of the side that lags. Bytes that differ are an error."""
        own, rest, lags = self.sides[1 - state.leads][token], state.rest, 1 - state.leads
        if not own or not (rest.startswith(own) or own.startswith(rest)):
            raise ValueError("the two sides' bytes differ")
        if len(own) < len(rest):
            after = self.state(state.leads, state.token, rest[len(own) :])
        else:
            after = self.state(lags, token, own[len(rest) :]) if len(own) > len(rest) else None
        a, b = (state.token, token) if lags == RIGHT else (token, state.token)
        self.pairs.append(a * len(self.sides[RIGHT]) + b)
        self.reads.append(lags)
        self.closes.append(after is None)
        return len(self.pairs) - 1, after, CLOSED if after is None else after.leads

    def align(self, left: list[int], right: list[int]) -> list[int] | None:
        """The numbers of the steps; None if bytes differ or a side ends early."""
        lefts, rights, out = iter(left), iter(right), []
        begin, read_left, read_right, add = self.begin, lefts.__next__, rights.__next__, out.append
        try:
            for token in lefts:
                state, leads = begin[token], LEFT
                while leads != CLOSED:
                    step, state, leads = state[read_left() if leads else read_right()]
                    add(step)
        except (ValueError, StopIteration):
            return None
        return out if next(rights, None) is None else None


def _numbers(size: int) -> pa.Array:
    """Decimal ids with what follows them: a comma, the bar between the sides, or the semicolon between groups."""
    return pa.array([f"{i}{end}".encode() for i in range(size) for end in ",|;"], pa.large_binary())


class Aligner:
    def __init__(self, left: Left, right: Right):
        self.left, self.right = left, right
        self.transducer = Transducer(left.bytes, right.bytes)
        self.numbers = _numbers(max(len(left.bytes), len(right.bytes)))

    def batch(self, texts: list[str]) -> list[tuple]:
        """For each text (tokens left, tokens right, groups, the groups' line, distinct pairs, how often each)."""
        if len(self.transducer.pairs) > REMEMBERED:
            self.transducer.forget()
        lefts, rights = self.left.encode([" " + t if t else "" for t in texts]), self.right.encode(texts)
        done = []
        for text, a, b in zip(texts, lefts, rights):
            whole = bool(text) and b"".join(map(self.left.bytes.__getitem__, a)) == b" " + text.encode()
            done.append(self.transducer.align(a, b) if whole else None)
        # as copies: arrays that are looked into can't grow
        known = np.array(self.transducer.pairs), np.array(self.transducer.reads), np.array(self.transducer.closes, bool)
        return [self._row(a, b, steps, *known) for a, b, steps in zip(lefts, rights, done)]

    def _row(self, a: list[int], b: list[int], steps: list[int] | None, pairs: np.ndarray, reads: np.ndarray, closes: np.ndarray) -> tuple:
        if not steps:
            return 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int32)
        taken = np.fromiter(steps, np.int32, len(steps))
        ends = np.flatnonzero(closes[taken])
        right_ends = np.cumsum(reads[taken], dtype=np.int64)[ends]
        left_ends = ends + 1 - right_ends + np.arange(1, len(ends) + 1)  # each group begins with a left token without a step
        links, counts = np.unique(pairs[taken], return_counts=True)
        return len(a), len(b), len(ends), self.line(a, b, left_ends, right_ends), links, counts.astype(np.int32)

    def line(self, a: list[int], b: list[int], ends: np.ndarray, others: np.ndarray) -> bytes:
        """Groups as `a1,a2|b1;a3|b2,b3`: each id moves behind what the other side has in earlier groups."""
        x, y = np.fromiter(a, np.int64, len(a)), np.fromiter(b, np.int64, len(b))
        n, m = np.diff(ends, prepend=0), np.diff(others, prepend=0)
        out = np.zeros(len(x) + len(y), np.int64)
        follow = np.zeros(len(x), np.int64)
        follow[ends - 1] = 1
        out[np.arange(len(x)) + np.repeat(others - m, n)] = 3 * x + follow
        follow = np.zeros(len(y), np.int64)
        follow[others - 1] = 2
        out[np.arange(len(y)) + np.repeat(ends, m)] = 3 * y + follow
        return self.numbers.take(pa.array(out)).buffers()[2].to_pybytes()[:-1]


@lru_cache(maxsize=1)
def aligner(left: str, pattern: str, right: str) -> Aligner:
    return Aligner(Left(left, pattern), Right(right))


@lru_cache(maxsize=1)
def _right_size(path: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()


def _aligned(docs: DataFrame, left: str, pattern: str, right: str, column: str, kept: list[str], lines: bool) -> DataFrame:
    prepare(docs.sparkSession)
    packed = docs.select(F.struct(F.lit(True).alias("some"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.col(column).cast("string").alias("value"))
    long, text = T.LongType(), T.StringType()
    schema = T.StructType([packed.schema["row"], *[T.StructField(c, kind) for c, kind in (("n_a", long), ("n_b", long), ("n_groups", long), ("groups", text), ("pairs", T.ArrayType(long)), ("counts", T.ArrayType(T.IntegerType())))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(left, pattern, right)
        for batch in batches:
            for part in chunks(batch, "value", CHUNK):
                rows = own.batch(part.column("value").fill_null("").to_pylist())
                n_a, n_b, n_groups, said, pairs, counts = zip(*rows)
                groups = [s.decode() if lines else hashlib.sha256(s).hexdigest() if s else "" for s in said]
                at = pa.array(np.cumsum([0, *map(len, pairs)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (pairs, counts)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(groups, pa.string()), *lists], schema.names)
        own.transducer.forget()  # the worker lives on, for other operators

    return packed.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, size: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus are of a pair, and whether no pair with the same right id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("e")).select("e.pairs", "e.counts")
    counts = cut(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")), "pair-counts")
    most = counts.groupBy((F.col("pair") % size).alias("b")).agg(F.max("n").alias("most"))
    # as many rows as right ids at most: a vocabulary's size
    return cut(counts.join(F.broadcast(most), F.col("pair") % size == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def link_sums(aligned: DataFrame, pairs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(_key, n_best, count_sum) of aligned (_key, pairs, counts) with links. Pairs with at least `least` links, chosen so that they
    are no more than `frequent`, are broadcast; the links of all others are joined with theirs by a shuffle."""
    sizes = {r["b"]: r["c"] for r in pairs.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}  # 64 rows at most
    least, held = max(sizes, default=0) + 1, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= frequent:
        least -= 1
        held += sizes.get(least, 0)
    often = F.floor(F.log2("n")) >= least
    each = aligned.select("_key", F.explode(F.arrays_zip("pairs", "counts")).alias("e")).select("_key", F.col("e.pairs").alias("pair"), F.col("e.counts").alias("k"))
    sums = lambda df: df.groupBy("_key").agg(F.sum(F.when(F.col("best"), F.col("k").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    hot = F.broadcast(pairs.where(often))
    out = sums(each.join(hot, "pair"))
    if least > 0:  # some pairs are too rare to be broadcast
        rest = sums(each.join(F.broadcast(pairs.where(often).select("pair")), "pair", "left_anti").join(pairs.where(~often), "pair"))
        out = out.unionByName(rest).groupBy("_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def align(docs: DataFrame, left: str, pattern: str, right: str, column: str = "text", frequent: int = FREQUENT, lines: bool = True) -> DataFrame:
    """docs without `column`, with n_a, n_b (tokens of each side), n_groups, n_links, n_best, count_sum and groups: the groups as
    `a1,a2|b1;a3|b2,b3`, or with lines=False the SHA-256 of that.

    left is a tokenizers file of byte-level BPE, split by `pattern`; right a sentencepiece file; both at their path on every
    executor. The left side reads a space and the text, the right side the text. Texts that are null or empty, or whose tokens'
    bytes aren't the space and the text on both sides, have no tokens: zeros, empty groups. Counts are over all rows, repeated
    ones included. Columns of docs named like the new ones give way, others pass whatever their names; an empty table gives an
    empty result. A row holds its distinct pairs, as many as its text has links at most.
    """
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    kept = [c for c in docs.columns if c != column and c not in added]
    size = _right_size(right)
    # written once: the ids stay, whatever executors are lost
    table = cut(_aligned(docs, left, pattern, right, column, kept, lines).withColumn("_key", F.monotonically_increasing_id()), "aligned")
    sums = link_sums(table, pair_counts(table, size), frequent)
    out = table.drop("pairs", "counts").join(sums, "_key", "left")
    links = F.col("n_a") + F.col("n_b") - F.col("n_groups")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(kept)], "n_a", "n_b", "n_groups", links.alias("n_links"), zero("n_best"), zero("count_sum"), "groups")


def op13_alignment(spark, sf_dir: str, left: str | None = None, right: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left, right = left or public_tokenizers.path("byte_bpe_50k.json"), right or public_tokenizers.path("piece_bpe_32k.model")
    return align(docs, left, public_tokenizers.PATTERN, right, lines=False).withColumnRenamed("groups", "groups_sha256")
