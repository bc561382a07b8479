"""Static embeddings: tokens, word pieces, pooled vectors, int8 rows."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import FOLD_FROM, FOLD_TO, SPACE

#: Punctuation: ASCII signs and symbols, and Unicode's category.
PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"


#: Rows of a token table that are broadcast at most.
MOST_TOKENS = 1 << 18
#: Words that piece_counts() expands into pieces at a time.
AT_ONCE = 1 << 15


@dataclass(frozen=True)
class Model:
    dim: int
    unknown: int
    prefix: str = "##"
    longest: int = 100


def _clean_table() -> tuple[str, str]:
    """What fold() replaces and removes, and every white space as a blank."""
    blank = re.compile(SPACE)
    spaces = [chr(c) for c in range(0xFFFF) if not 0x1C <= c <= 0x1F and c != 0x85 and blank.fullmatch(chr(c))]
    kept = len(FOLD_TO)
    folded = [(a, " " if blank.fullmatch(b) else b) for a, b in zip(FOLD_FROM[:kept], FOLD_TO) if a not in spaces]
    return "".join(spaces) + "".join(a for a, _ in folded) + FOLD_FROM[kept:], " " * len(spaces) + "".join(b for _, b in folded)


CLEAN_FROM, CLEAN_TO = _clean_table()


def clean(text: Column) -> Column:
    """Folded lower-case text whose white space is blanks."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), CLEAN_FROM, CLEAN_TO)


def basic_tokens(text: Column) -> Column:
    """Words and single punctuation characters of folded lower-case text."""
    return F.regexp_extract_all(clean(text), F.lit(rf"([{PUNCTUATION}]|[^\s{PUNCTUATION}]+)"))


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) of the basic tokens of texts (text). What stands between blanks is counted first, so that only distinct strings
    are cut up."""
    chunks = texts.select(F.explode(F.split(clean(F.col("text")), " ")).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    return chunks.select("n", F.explode(basic_tokens(F.col("chunk"))).alias("token")).groupBy("token").agg(F.sum("n").alias("n"))


@cache
def _token() -> re.Pattern:
    """The pattern of basic_tokens() for strings without white space."""
    marks = re.escape("".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == "P" or "!" <= c <= "~" and not c.isalnum()))
    return re.compile(f"[{marks}]|[^{marks}]+")


def _longest_first(model: Model, vocabulary: dict[str, int]) -> Callable[[str], list[int]]:
    """Ids of a word, the longest piece first; a word that can't be cut up or is too long is one unknown."""
    later = {t.removeprefix(model.prefix): i for t, i in vocabulary.items() if t.startswith(model.prefix)}
    sizes_first, sizes_later = (sorted({len(t) for t in known} - {0}, reverse=True) for known in (vocabulary, later))

    def ids_of(word: str) -> list[int]:
        if len(word) > model.longest:
            return [model.unknown]
        out, at, known, sizes = [], 0, vocabulary, sizes_first
        while at < len(word):
            for size in sizes:
                # near the end it is all that is left, the longest that can be
                piece = known.get(word[at:at + size])
                if piece is not None:
                    break
            else:
                return [model.unknown]
            out.append(piece)
            at, known, sizes = at + size, later, sizes_later
        return out

    return ids_of


def _flat(words: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(where each word's ids begin and the last ones end, ids), without a list for each word."""
    ids, ends = array("q"), array("q", [0])
    for w in words:
        ids.extend(w)
        ends.append(len(ids))
    return np.frombuffer(ends, np.int64), np.frombuffer(ids, np.int64) if ids else np.zeros(0, np.int64)


def _expanded(words: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many) of words, one after the other."""
    many = (ends[1:] - ends[:-1])[words]
    return ids[np.repeat(ends[words] - np.cumsum(many) + many, many) + np.arange(many.sum())], many


def word_pieces(model: Model, vocabulary: dict[str, int]):
    """UDF: ids of words, as piece_counts() counts them. The vocabulary is a model's file, of fixed size, and goes along with the
    function."""
    ids_of = _longest_first(model, vocabulary)

    @F.arrow_udf("array<int>")
    def pieces(tokens: pa.Array) -> pa.Array:
        words = tokens.flatten().dictionary_encode()
        ids, many = _expanded(words.indices.to_numpy(), *_flat(map(ids_of, words.dictionary.to_pylist())))
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)])[ends], pa.int32()), pa.array(ids, pa.int32()))

    return pieces


def piece_counts(model: Model, vocabulary: dict[str, int]):
    """UDF: from text as clean() makes it to its pieces' ids, each with its count, in the order of ids.

    Each distinct string of an Arrow batch is cut up once, and no batch is taken apart into Python's strings word by word: a
    worker's memory is a small multiple of a batch, however many words or pieces that has.
    """
    ids_of = _longest_first(model, vocabulary)

    @F.arrow_udf("array<struct<token_id:int,n:bigint>>")
    def counts(texts: pa.Array) -> pa.Array:
        chunks = pc.split_pattern(pc.fill_null(texts, ""), " ")
        words = chunks.flatten().dictionary_encode()
        owners = np.repeat(np.arange(len(texts)), pc.list_value_length(chunks).to_numpy())
        each, n = np.unique(owners * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
        del owners, chunks
        ends, ids = _flat([i for t in ([w] if w.isalnum() else _token().findall(w)) for i in ids_of(t)] for w in words.dictionary.to_pylist())
        most = int(ids.max(initial=0)) + 1
        # few words at a time, as each may have as many pieces as letters
        parts = []
        for k in range(0, len(each), AT_ONCE):
            owner, word = np.divmod(each[k:k + AT_ONCE], max(1, len(ends) - 1))
            some, many = _expanded(word, ends, ids)
            found, at = np.unique(np.repeat(owner, many) * most + some, return_inverse=True)
            parts.append((found, np.bincount(at, weights=np.repeat(n[k:k + AT_ONCE], many), minlength=len(found))))
        found, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(f for f, _ in parts)]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([np.zeros(0), *(c for _, c in parts)]), minlength=len(found)).astype(np.int64)
        owner, ids = np.divmod(found, most)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
        fields = pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(total, pa.int64())], ["token_id", "n"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)

    return counts


def encode(items: DataFrame, token_table: DataFrame) -> DataFrame:
    """pooled() vectors of items (id, tokens). Tokens are counted by partial aggregates, so that an item of any length is a row for
    each distinct token at most."""
    return pooled(items.select("id", F.explode("tokens").alias("token_id")).groupBy("id", "token_id").agg(F.count(F.lit(1)).alias("n")), token_table)


def encode_texts(texts: DataFrame, model: Model, vocabulary: dict[str, int], token_table: DataFrame) -> DataFrame:
    """pooled() vectors of texts (id, text)."""
    counts = piece_counts(model, vocabulary)
    found = texts.select("id", counts(clean(F.col("text"))).alias("c"))
    return pooled(found.select("id", F.inline("c")), token_table)


def pooled(counted: DataFrame, token_table: DataFrame) -> DataFrame:
    """(id, vector) of counts (id, token_id, n): the mean of dequantised rows, unit length; no tokens, no vector.

    The table (token_id, q, scale) is a model's file of fixed size. Counts cross once, to their id's task, and counts of one id
    and token add up; sums run in the order of token ids and are the same on any number of executors.
    """
    counted = counted.repartition("id").groupBy("id", "token_id").agg(F.sum("n").alias("n"))
    # a table that grew beyond what a model's file holds is joined as any other
    small = token_table.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS
    rows = counted.join(F.broadcast(token_table) if small else token_table, "token_id")
    scaled = rows.select("id", "token_id", "n", F.transform("q", lambda x: x.cast("double") * F.col("scale").cast("double") * F.col("n")).alias("v"))
    listed = scaled.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token_id", "v"))).alias("l"), F.sum("n").alias("n"))
    total = F.aggregate(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), F.element_at("l", 1)["v"], lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b))
    mean = listed.select("id", F.transform(total, lambda x: x / F.col("n")).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x)) + F.lit(1e-32)
    return mean.withColumn("norm", norm).select("id", F.transform("m", lambda x: x / F.col("norm")).alias("vector"))


def item_text(title: Column, summary: Column) -> Column:
    """What is encoded of an item: title and summary, without blanks and full stops at either end."""
    return F.btrim(F.concat(F.trim(F.coalesce(title, F.lit(""))), F.lit(". "), F.trim(F.coalesce(summary, F.lit("")))), F.lit(". "))


def quantise(vector: Column) -> Column:
    """(q, scale): rows of int8 with the largest magnitude at 127; halves go to the even number; a zero row has scale 1."""
    scale = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))) / F.lit(127.0)
    scale = F.when(scale == 0, F.lit(1.0)).otherwise(scale)
    q = F.transform(vector, lambda x: F.greatest(F.least(F.rint(x.cast("double") / scale), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))
    return F.struct(q.alias("q"), scale.alias("scale"))


def missing_ids(tokens: DataFrame, size: int) -> DataFrame:
    """Ids of 0..size-1 that a vocabulary (token_id) lacks; it is complete if there are none."""
    return tokens.sparkSession.range(size).select(F.col("id").cast("int").alias("token_id")).join(tokens.select("token_id"), "token_id", "left_anti")
