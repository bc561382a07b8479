"""Toxicity by a weighted finite-state pattern grammar.

Two transducers, both tables of weighted arcs, are composed. The lexical one reads a word's characters and its end and writes
a class: insult stems with weights learned from labelled documents, and fixed function words (target, negation, reported
speech, will, threat verb). The clause transducer reads the classes of one clause and writes weighted readings: insult, insult
at a target, negated insult, reported insult, threat at a target. Whether a clause has a target may show after its insult, so
it starts in two states, one for either guess, and only the path whose guess came true ends in a final state. A path's weight
is the product of its arcs' weights. A document's readings are summed over its clauses; a logistic layer, fitted to the labels
as well, turns the sums into a score. Only clauses in which an automaton of the stems and threat verbs matches are read, each
whole and once: others have no readings.

Learning uses at most MAX_TOXIC and MAX_CLEAN labelled documents, taken by a hash of their ids; of near copies among them
one is used. Scoring reads whole texts and is alike at every size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.session import prepare, release
from lodestone.llm.textkit import WHITESPACE, Words, chunks

#: Bounds of the labelled sample.
MAX_TOXIC, MAX_CLEAN = 2500, 4000
HELD_OUT_OF, HELD_OUT = 5, 0

TARGET = set("you your yours he him his she her they them their we us our people du dich dir ihr euch sie tu toi vous te usted ustedes tú ellos ellas ils elles".split())
NEGATION = set("not never no none isn't aren't wasn't don't doesn't nicht nie kein keine jamais pas nunca jamás".split())
REPORTED = set("said says say told claimed claims wrote writes quoted quotes reported reports called calls sagte sagt schrieb behauptet dit écrit affirme dijo dice escribió afirma".split())
WILL = set("will shall gonna would should werde wird vais va voy".split())
THREAT = set("kill hurt destroy attack burn stab shoot murder beat crush die töten verletzen tuer blesser matar golpear".split())
#: Weight of a threat that is only reported.
REPORTED_THREAT = 0.3
READINGS = ["insult", "targeted", "negated", "reported", "threat"]

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_ENDS = ".!?;:\n"
_CLAUSE = re.compile(rf"[^{CLAUSE_ENDS}]+")
#: Learned stems: at least so long, at most so long, and in at least so many documents.
STEM_MIN, STEM_MAX, STEM_DOCS = 3, 10, 5
LIFT = 25.0


END, OTHER = "#", "*"


class Transducer:
    """arcs[state][symbol]: (next state, written symbol or None, weight), several for a symbol where it isn't deterministic;
    the symbol OTHER stands for all that have no arc of their own. A state without an arc for a symbol ends the path."""

    def __init__(self, arcs: dict, start: list, final: set):
        self.arcs, self.start, self.final = arcs, start, final

    def step(self, state, symbol) -> list[tuple]:
        out = self.arcs.get(state, {})
        return out[symbol] if symbol in out else out.get(OTHER, [])

    def transduce(self, symbols, weight: float = 1.0) -> list[tuple[list[tuple], float]]:
        """(written symbols with the path's weight as of then, weight) of each path from a start to a final state."""
        paths = [(state, [], weight) for state in self.start]
        for symbol in symbols:
            paths = [(to, said + [(mark, w * v)] if mark is not None else said, w * v) for state, said, w in paths for to, mark, v in self.step(state, symbol)]
        return [(said, w) for state, said, w in paths if state in self.final]


class Composition:
    """Two transducers in a row: what the first writes the second reads. States are pairs; arcs are made when first needed.

    The first one reads words of symbols that end in END and comes back to its start there; so a pair's arcs over a whole word
    are kept as one, and weights of a word don't multiply those of the next.
    """

    def __init__(self, first: Transducer, second: Transducer, remembered: int = 1 << 16):
        self.first, self.second, self.remembered = first, second, remembered
        self.words: dict[str, list[tuple]] = {}
        self.arcs: dict[tuple, list[tuple]] = {}

    def written(self, word: str) -> list[tuple]:
        """What the first transducer writes of a word: (symbol, weight)."""
        if word not in self.words:
            if len(self.words) >= self.remembered:
                self.words.clear()
            self.words[word] = [mark for said, _ in self.first.transduce([*word, END]) for mark in said]
        return self.words[word]

    def step(self, state, symbol) -> list[tuple]:
        if (state, symbol) not in self.arcs:
            self.arcs[state, symbol] = self.second.step(state, symbol)
        return self.arcs[state, symbol]

    def readings(self, words) -> dict[str, float]:
        """Sums of the weights of each reading over the accepted paths of a clause."""
        return self.read(mark for word in words for mark in self.written(word))

    def read(self, classes) -> dict[str, float]:
        paths = [(state, {}) for state in self.second.start]
        for symbol, weight in classes:
            after = []
            for state, sums in paths:
                for to, reading, v in self.step(state, symbol):
                    after.append((to, sums if reading is None else sums | {reading: sums.get(reading, 0.0) + weight * v}))
            paths = after
        out: dict[str, float] = {}
        for state, sums in paths:
            if state in self.second.final:
                for reading, value in sums.items():
                    out[reading] = out.get(reading, 0.0) + value
        return out


def lexicon(stems: dict[str, float]) -> Transducer:
    """The lexical transducer: a trie of function words and stems. A word that goes on behind a stem has the greatest weight
    among its stems; a stem that ends in "$" is a whole word; a function word is that and no insult."""
    kinds = {w: kind for kind, words in (("threat", THREAT), ("will", WILL), ("reported", REPORTED), ("negation", NEGATION), ("target", TARGET)) for w in words}
    arcs: dict = {"": {}}
    for entry in [*kinds, *(s.rstrip("$") for s in stems)]:
        for n in range(len(entry)):
            arcs.setdefault(entry[:n], {})[entry[n]] = [(entry[: n + 1], None, 1.0)]
            arcs.setdefault(entry[: n + 1], {})
    said = lambda weight: [("", "insult", weight)] if weight else [("", None, 1.0)]
    best = {node: max((stems.get(node[:n], 0.0) for n in range(STEM_MIN, len(node) + 1)), default=0.0) for node in arcs}
    for node in list(arcs):
        weight = best[node]
        # off the trie only the greatest weight so far matters
        rest = ("rest", weight)
        arcs[node][OTHER] = [(rest, None, 1.0)]
        arcs.setdefault(rest, {OTHER: [(rest, None, 1.0)], END: said(weight)})
        arcs[node][END] = [("", kinds[node], 1.0)] if node in kinds else said(max(weight, stems.get(node + "$", 0.0)))
    return Transducer(arcs, [""], {""})


def clauses() -> Transducer:
    """The clause transducer. A state: whether a target is guessed, and whether one, a negation, reported speech and `will`
    have been read; a negation or reported speech holds for what follows in the clause."""
    arcs: dict = {}
    flags = [(t, n, r, w) for t in (False, True) for n in (False, True) for r in (False, True) for w in (False, True)]
    for guess in (False, True):
        for target, negated, reported, will in flags:
            here = {
                "negation": [((guess, target, True, reported, will), None, 1.0)],
                "reported": [((guess, target, negated, True, will), None, 1.0)],
                "will": [((guess, target, negated, reported, True), None, 1.0)],
            }
            same = (guess, target, negated, reported, will)
            here["insult"] = [(same, "reported" if reported else "negated" if negated else "targeted" if guess else "insult", 1.0)]
            threat = guess and will and not negated
            here["threat"] = [(same, "threat" if threat else None, REPORTED_THREAT if threat and reported else 1.0)]
            if guess:
                here["target"] = [((guess, True, negated, reported, will), None, 1.0)]
            arcs[same] = here
    return Transducer(arcs, [(g, False, False, False, False) for g in (False, True)], {s for s in arcs if s[0] == s[1]})


CLAUSES = clauses()


def clause_readings(classes: list[tuple[str, float]]) -> dict[str, float]:
    """Readings of a clause given as classes with weights."""
    return Composition(Transducer({}, [], set()), CLAUSES).read(classes)


class Grammar:
    """Stems and weights (of the lexical transducer) and the logistic layer."""

    def __init__(self, stems: dict[str, float], weights: list[float], bias: float):
        self.stems, self.weights, self.bias = stems, np.array(weights), bias
        self.machine = ahocorasick.Automaton()
        for stem in stems:  # "$" ends a whole word; the words of a matched clause are then read in full
            self.machine.add_word(stem.rstrip("$"), stem.rstrip("$"))
        for word in THREAT:
            if word not in stems:
                self.machine.add_word(word, word)
        self.machine.make_automaton()
        self.composed = Composition(lexicon(stems), CLAUSES)

    def readings(self, text: str) -> np.ndarray:
        """Sums of the readings over all clauses of a text."""
        text = text.lower()
        sums = np.zeros(len(READINGS))
        done = 0
        # matches come by their ends and none spans a clause's end, so clauses come in order
        for end, stem in self.machine.iter(text + " "):
            begin = end - len(stem) + 1
            if begin < done or begin and (text[begin - 1].isalpha() or text[begin - 1] in "'’"):
                continue
            # the clause around a match, from its start to its end, is read once
            at = max(done, max(text.rfind(mark, done, begin) for mark in CLAUSE_ENDS) + 1)
            done = _CLAUSE.match(text, at).end()
            for reading, value in self.composed.readings(w.group() for w in _WORD.finditer(text, at, done)).items():
                sums[READINGS.index(reading)] += value
        return sums

    def score(self, text: str | None) -> float:
        z = self.bias
        if text:
            sums = self.readings(text)
            if sums.any():
                z += float(self.weights @ np.log1p(sums))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _distinct(texts: list[str]) -> list[int]:
    """Of near copies the first: no two kept texts share two of four least shingle hashes."""
    seen: set[tuple] = set()
    keep = []
    for n, text in enumerate(texts):
        words = Words(pa.array([text]), WHITESPACE, lower=True)
        grams = words.windows(5) if len(words) >= 5 else words.hashes
        if not len(grams):
            keep.append(n)
            continue
        least = [int((grams * np.uint64(m)).min()) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
        keys = {(i, v) for i, v in enumerate(least)}
        if len(keys & seen) < 2:
            keep.append(n)
        seen |= keys
    return keep


def _stems_of(text: str) -> set[str]:
    out = set()
    for word in set(_WORD.findall(text.lower())):
        if len(word) >= STEM_MIN:
            out.add(word + "$")
            out.update(word[:n] for n in range(STEM_MIN, min(len(word), STEM_MAX) + 1))
    return out


def learn(texts: list[str], toxic: list[int], prior: float) -> Grammar:
    """Stems that mark toxic documents, then the logistic layer, shifted to the share `prior` of toxic documents."""
    kept = _distinct(texts)
    texts, toxic = [texts[i] for i in kept], [toxic[i] for i in kept]
    n_toxic = sum(toxic)
    n_clean = len(toxic) - n_toxic
    with_toxic: Counter = Counter()
    for text, label in zip(texts, toxic):
        if label:
            with_toxic.update(_stems_of(text))
    candidates = {s for s, n in with_toxic.items() if n >= min(STEM_DOCS, max(2, n_toxic // 10))}
    with_clean: Counter = Counter()
    for text, label in zip(texts, toxic):
        if not label:
            with_clean.update(_stems_of(text) & candidates)
    share = n_toxic / max(1, n_toxic + n_clean)
    stems: dict[str, float] = {}
    for stem in sorted(candidates, key=len):
        t, c = with_toxic[stem], with_clean[stem]
        lift = ((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))
        # a stem that all these documents hold by chance: expected among so many candidates less than once in a hundred
        chance = len(candidates) * math.comb(t + c, c) * share**t if t + c < 300 else 0.0
        if lift < LIFT or chance > 0.01:
            continue
        if any(stem[:n] in stems for n in range(STEM_MIN, len(stem))):
            continue  # a shorter stem says it
        stems[stem] = math.log(lift)
    whole = {s for s in stems if s.endswith("$")}
    stems = {s: w for s, w in stems.items() if s not in whole or s[:-1] not in stems}
    grammar = Grammar(stems, [0.0] * len(READINGS), 0.0)
    x = np.log1p(np.array([grammar.readings(t) for t in texts])) if texts else np.zeros((0, len(READINGS)))
    y = np.array(toxic, dtype=float)
    # no reading may lower a score: weights are kept at 0 or more; ridge by projected gradient
    w, b = np.full(len(READINGS), 1.0), -1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = p - y
        w = np.maximum(0.05, w - 0.5 * (x.T @ g / max(1, len(y)) + 1e-3 * w))
        b -= 0.5 * float(g.mean()) if len(y) else 0.0
    if 0 < share < 1 and 0 < prior < 1:
        b += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    # whatever the labels' share: a text without any reading scores 1 / (1 + e**0.7), 0.33, at most, and so is never rejected
    return Grammar(stems, w.tolist(), min(b, -0.7))


def held_out(doc_id: Column) -> Column:
    """By the contract: crc32 of the id as text."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT_OF)) == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int], train: Column) -> list[tuple[str, int]]:
    """Texts and labels of at most bounds[l] training documents with label l, chosen by a hash of the id.

    Only the chosen ids, bounded by the parameter, are broadcast. Of rows that share an id the least text counts, so that the
    driver gets no more rows than the bounds say.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).alias("_y"))
    chosen = None
    for value, most in bounds.items():
        part = usable.where(F.col("_y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_y").alias("_y"))
    rows = found.toArrow().sort_by([("doc_id", "ascending")])
    return list(zip(rows["text"].fill_null("").to_pylist(), rows["_y"].to_pylist()))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> Grammar:
    """A grammar from labelled training rows. Without labels of both kinds nothing is learned and fixed words remain."""
    train = ~held_out(F.col("doc_id")) if train is None else train
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train)
    n, t = usable.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    sample = labelled_sample(docs, labels, "toxic", {1: MAX_TOXIC, 0: MAX_CLEAN}, train)
    grammar = learn([x for x, _ in sample], [y for _, y in sample], (t or 0) / n if n else 0.0)
    del sample
    release(docs.sparkSession)
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs with _score. Null and empty texts get the score of a text without readings; every row is scored for itself, so
    repeated rows get equal scores; an older _score gives way, other columns pass through; no rows give no rows."""
    prepare(docs.sparkSession)
    docs = docs.drop("_score")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("_score", T.DoubleType(), False)])
    parts = (grammar.stems, grammar.weights.tolist(), grammar.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Grammar(*parts)
        for batch in batches:
            for part in chunks(batch):
                scores = pa.array([machine.score(t) for t in part.column("text").to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("row"), scores], ["row", "_score"])

    return packed.mapInArrow(run, schema).select("row.*", "_score")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
