"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of its neighbours; forward-backward marginals, weighted
by line length, aggregate into the document's quality. Lines inherit their document's label for training, as labels exist
for documents only; the sample is at most MAX_EACH documents of either label, taken by a hash of the id.

Features come from byte classes of whole texts in a vectorised pass; a document's lines are one sequence, however many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.session import prepare
from lodestone.llm.textkit import WHITESPACE, Words, chunks
from lodestone.llm.toxicity import labelled_sample

#: Bound of the labelled sample: documents of either label.
MAX_EACH = 2000
HELD_OUT_OF, HELD_OUT = 3, 1
STEPS = 250
#: Weight of label pairs against labels when learning.
PAIRS = 0.2


def _classes() -> np.ndarray:
    """256 x 8 indicators: upper, lower, digit, space, end mark, comma-like, symbol, beyond ASCII."""
    table = np.zeros((8, 256), np.int32)
    table[0, 65:91] = table[1, 97:123] = table[2, 48:58] = 1
    table[3, [9, 11, 12, 13, 32]] = 1
    table[4, [ord(c) for c in ".!?"]] = 1
    table[5, [ord(c) for c in ",;:'\"()-"]] = 1
    table[6, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 1
    table[7, 128:] = 1
    return table


CLASSES = _classes()
OWN = 16


class Lines:
    """Features of all lines of some texts. first[d]..first[d+1]: the lines of text d; length: bytes of each line."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, WHITESPACE, lower=False)
        data, n = words.data, words.n
        self.n = n
        newline = np.flatnonzero(data == 10)
        begins = np.unique(np.concatenate([words.places[:-1], newline + 1]))
        begins = begins[begins < len(data)]
        ends = np.append(begins[1:], len(data))[: len(begins)]
        sizes = np.maximum(ends - begins - (data[ends - 1] == 10), 0)
        keep = sizes > 0
        begins, ends, self.length = begins[keep], ends[keep], sizes[keep].astype(float)
        self.first = np.searchsorted(begins, words.places)
        m = len(begins)
        self.owner = np.repeat(np.arange(n), np.diff(self.first))
        if not m:
            self.x = np.zeros((0, OWN * 3 + 1))
            return
        counts = [np.diff(np.append(s := np.concatenate([[0], np.cumsum(row[data])]), s[-1])[np.append(begins, ends[-1])]) for row in CLASSES]
        upper, lower, digit, space, end, comma, symbol, beyond = (c.astype(float) for c in counts)
        size = self.length
        letters = upper + lower + beyond
        first_word = np.searchsorted(words.starts, begins)
        n_words = np.diff(np.append(first_word, np.searchsorted(words.starts, ends[-1]))).astype(float)
        # words that occurred in the document before, lines that the document repeats
        line_of_word = np.repeat(np.arange(m), n_words.astype(int))
        fresh = np.zeros(len(words.hashes), bool)
        doc_word = words.hashes ^ (words.owner().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        fresh[np.unique(doc_word, return_index=True)[1]] = True
        n_fresh = np.bincount(line_of_word, fresh[: len(line_of_word)], minlength=m)
        line_hash = words.spans(first_word, n_words.astype(int)) if len(words.hashes) else np.zeros(m, np.uint64)
        doc_line = line_hash ^ (self.owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        _, inverse, times = np.unique(doc_line, return_inverse=True, return_counts=True)
        repeated = (times[inverse] > 1).astype(float)
        last = data[np.maximum(begins, ends - 1 - (data[ends - 1] == 10))]
        ended = np.isin(last, [ord(c) for c in ".!?\"')"]).astype(float)
        doc_words = np.maximum(words.counts[self.owner], 1)
        own = np.stack([
            upper / np.maximum(letters, 1), digit / size, symbol / size, end / size, comma / size, beyond / size,
            space / size, np.log1p(size) / 8, np.log1p(n_words) / 6, np.minimum(size / np.maximum(n_words, 1), 30) / 15, n_fresh / np.maximum(n_words, 1),
            repeated, ended, (upper > 0.6 * np.maximum(letters, 1)).astype(float), symbol / np.maximum(n_words, 1), np.log1p(doc_words) / 10,
        ], axis=1)
        before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
        inner = self.first[:-1][np.diff(self.first) > 0]
        before[inner] = own[inner]
        outer = self.first[1:][np.diff(self.first) > 0] - 1
        after[outer] = own[outer]
        self.x = np.concatenate([own, before, after, np.ones((m, 1))], axis=1)


def joined_lines(texts: list[str]) -> Lines:
    """Lines of many texts, made chunk by chunk."""
    parts = [Lines(part.column("text")) for part in chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]))]
    out = Lines(pa.array([], pa.string()))
    if parts:
        lines_before = np.cumsum([0, *(len(p.x) for p in parts)])
        texts_before = np.cumsum([0, *(p.n for p in parts)])
        out.n = int(texts_before[-1])
        out.x = np.concatenate([p.x for p in parts])
        out.length = np.concatenate([p.length for p in parts])
        out.owner = np.concatenate([p.owner + t for p, t in zip(parts, texts_before)])
        out.first = np.concatenate([*(p.first[:-1] + m for p, m in zip(parts, lines_before)), lines_before[-1:]])
    return out


class Field:
    """The chain: emission weights of `good` against `bad`, and transition scores [from, to]; `edge` maps the document's
    log-odds of its mean marginal to a score."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, slope: float = 1.0, shift: float = 0.0, empty: float = 0.5):
        self.weights, self.transitions, self.slope, self.shift, self.empty = weights, transitions, slope, shift, empty

    def marginals(self, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, and of each line after the first P(pair) summed to 2 x 2, by forward-backward over all
        sequences at once: step t works on the documents that have a line t."""
        m = len(lines.x)
        emit = np.zeros((m, 2))
        if not m:
            return emit[:, 1], np.zeros((2, 2)), emit
        emit[:, 1] = lines.x @ self.weights
        counts = np.diff(lines.first)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        heads, lengths = lines.first[:-1][order], counts[order]
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # documents with more than t lines
        alpha, beta = np.empty((m, 2)), np.zeros((m, 2))
        tr = self.transitions
        alpha[heads] = emit[heads]
        for t in range(1, lengths[0]):
            at = heads[: alive[t]] + t
            a = alpha[at - 1]
            alpha[at] = np.logaddexp(a[:, :1] + tr[0], a[:, 1:] + tr[1]) + emit[at]
        for t in range(lengths[0] - 1, 0, -1):
            at = heads[: alive[t]] + t
            b = beta[at] + emit[at]
            beta[at - 1] = np.logaddexp(tr[:, 0] + b[:, :1], tr[:, 1] + b[:, 1:])
        joint = alpha + beta
        good = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -500, 500)))
        later = np.ones(m, bool)
        later[heads] = False
        at = np.flatnonzero(later)
        norm = np.logaddexp(joint[at, 0], joint[at, 1])
        pairs = np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                pairs[i, j] = np.exp(alpha[at - 1, i] + tr[i, j] + emit[at, j] + beta[at, j] - norm).sum()
        return good, pairs, emit

    def mean_odds(self, lines: Lines) -> np.ndarray:
        """Log-odds of each document's length-weighted mean marginal; nan without lines."""
        good, _, _ = self.marginals(lines)
        weight = np.bincount(lines.owner, lines.length, minlength=lines.n)
        total = np.bincount(lines.owner, lines.length * good, minlength=lines.n)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.clip(total / weight, 1e-4, 1 - 1e-4)
            return np.log(mean / (1 - mean))

    def score(self, texts: pa.Array) -> np.ndarray:
        odds = self.mean_odds(Lines(texts))
        return np.where(np.isnan(odds), self.empty, 1 / (1 + np.exp(-np.clip(self.slope * np.nan_to_num(odds) + self.shift, -30, 30))))


def learn(texts: list[str], good: list[int], prior: float) -> Field:
    """Weights by gradient ascent (Adam) with ridge, then slope and shift of the document score. `prior`: the share of good
    documents among all labels, to which the sample's share is corrected.

    What is climbed is a weighted likelihood's gradient, in two parts: line labels against their marginals, each document
    weighing the same, and label pairs against theirs, each line weighing the same and the whole part PAIRS as much. Training
    documents have one label for all their lines, so the pairs seen are good-good and bad-bad only; the ridge keeps
    transitions finite."""
    lines = joined_lines(texts)
    y = np.array(good, dtype=float)
    if len(set(good)) < 2 or not len(lines.x):
        return Field(np.zeros(OWN * 3 + 1), np.zeros((2, 2)), 0.0, float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))), prior)
    line_y = y[lines.owner]
    # each document weighs the same: long ones don't own the emissions
    weight = (1.0 / np.maximum(np.diff(lines.first), 1))[lines.owner]
    m = weight.sum()
    counts = np.diff(lines.first)
    seen = np.zeros((2, 2))
    for value in (0, 1):
        seen[value, value] = np.maximum(counts[y == value] - 1, 0).sum()
    field = Field(np.zeros(lines.x.shape[1]), np.zeros((2, 2)))
    params = np.zeros(lines.x.shape[1] + 4)
    mean, var = np.zeros_like(params), np.zeros_like(params)
    n_pairs = max(1.0, seen.sum())
    for step in range(1, STEPS + 1):
        field.weights, field.transitions = params[:-4], params[-4:].reshape(2, 2)
        p, pairs, _ = field.marginals(lines)
        grad = np.concatenate([lines.x.T @ ((line_y - p) * weight) / m - 1e-4 * params[:-4], PAIRS * (seen - pairs).ravel() / n_pairs - 0.02 * params[-4:]])
        mean = 0.9 * mean + 0.1 * grad
        var = 0.99 * var + 0.01 * grad**2
        params = params + 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    field.weights, field.transitions = params[:-4], params[-4:].reshape(2, 2)
    odds = np.nan_to_num(field.mean_odds(lines))
    slope, shift = 1.0, 0.0
    for _ in range(3000):
        g = 1 / (1 + np.exp(-np.clip(slope * odds + shift, -30, 30))) - y
        slope = max(0.05, slope - 0.05 * float((g * odds).mean()))
        shift -= 0.3 * float(g.mean())
    share = float(y.mean())
    if 0 < prior < 1:
        shift += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return Field(field.weights.copy(), field.transitions.copy(), slope, shift, prior)


def held_out(doc_id: Column) -> Column:
    """By the contract: crc32 of the id as text."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT_OF)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> Field:
    """A field from labelled training rows, at most MAX_EACH documents of either label. With labels of one kind only, or none,
    every text gets the share of good documents among the labels (one half without any). Rows without id or label are left
    out; of rows that share an id the least text counts."""
    train = ~held_out(F.col("doc_id")) if train is None else train
    n, good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & train).agg(F.count(F.lit(1)), F.sum("quality")).first()
    sample = labelled_sample(docs, labels, "quality", {1: MAX_EACH, 0: MAX_EACH}, train)
    return learn([x for x, _ in sample], [y for _, y in sample], (good or 0) / n if n else 0.5)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """docs with _score, the likelihood of good quality. Null and empty texts have no lines and get the share of good
    documents among the labels. Each row is scored for itself; an older _score gives way, other columns pass through; no rows
    give no rows."""
    prepare(docs.sparkSession)
    docs = docs.drop("_score")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("_score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(field.score(part.column("text")))], ["row", "_score"])

    return packed.mapInArrow(run, schema).select("row.*", "_score")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
