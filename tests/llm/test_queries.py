"""The registered queries on every column of their contracts, against brute force or recomputation."""

import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality, sharding, toxicity
from lodestone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows_of(name, folder=SF):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@tables
def test_op2(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows_of("embeddings")}
    ids = sorted(vectors)
    x = np.stack([vectors[i] for i in ids])
    found = {}
    for r in QUERIES["op2_nearest_neighbours"](spark, SF).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in ids if i % 100 == 0}
    hit = 0
    for q, got in found.items():
        got.sort()
        d = np.sqrt(((x - vectors[q]) ** 2).sum(axis=1))
        want = sorted((float(v), i) for v, i in zip(d, ids) if i != q)[:10]
        hit += len({i for _, i in want} & {i for _, i, _ in got})
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert all(math.isclose(s, math.dist(vectors[q], vectors[i]), rel_tol=1e-9) for _, i, s in got)
        assert [(s, i) for _, i, s in got] == sorted((s, i) for _, i, s in got)
    assert hit >= 9 * len(found)


def greedy(item, doc, least=5):
    """Tiles by trying all pairs of places for the longest unmarked match, again and again."""
    free = [True] * len(item), [True] * len(doc)
    tiles = []
    while True:
        best = None
        for p, q in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while p + n < len(item) and q + n < len(doc) and free[0][p + n] and free[1][q + n] and item[p + n] == doc[q + n]:
                n += 1
            if n >= least and (best is None or (-n, p, q) < best):
                best = (-n, p, q)
        if best is None:
            return tiles
        n, p, q = -best[0], best[1], best[2]
        for i in range(n):
            free[0][p + i] = free[1][q + i] = False
        tiles.append(n)


def test_op4(spark, tmp_path):
    rng = random.Random(11)
    item = lambda n, v: [rng.choice(v) for _ in range(n)]
    items = {1: item(14, "abc"), 2: item(20, "abcdefgh"), 3: ["same"] * 12, 4: item(4, "ab")}
    docs = {i: item(rng.randint(0, 40), "abcd") for i in range(12)} | {i: item(5, "xyz") + items[2][10:] + item(3, "xyz") + items[2][:10] for i in range(12, 16)}
    docs |= {20: ["same"] * 30, 21: items[1], 22: None}
    spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in docs.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in QUERIES["op4_decontamination"](spark, str(tmp_path)).collect():
        hits = {i: greedy(w, docs[r.doc_id] or []) for i, w in items.items()}
        cover = {i: sum(t) / len(items[i]) for i, t in hits.items() if t}
        best = max(cover, key=lambda i: (cover[i], -i), default=None)
        assert (r.coverage, r.n_tiles) == ((cover[best], len(hits[best])) if best else (0.0, 0))
        assert r.item_ids == sorted(i for i, c in cover.items() if c >= 0.6) and r.contaminated == bool(r.item_ids) and r.kept != r.contaminated


@tables
def test_op5(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    from lodestone.llm.bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=read_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of("documents")}
    out = QUERIES["op5_bpe"](spark, SF).collect()
    assert {r.doc_id for r in out} == set(texts) and len(out) == len(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[r.doc_id]))


@tables
def test_op6(spark):
    from tests.llm.test_documents import removed_by_windows

    texts = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    exact = removed_by_windows(texts, 50)
    out = {r.doc_id: r for r in QUERIES["op6_suffix_dedup"](spark, SF).collect()}
    assert set(out) == set(exact)
    same = 0
    for i, (n, gone, text) in exact.items():
        r = out[i]
        assert r.n_words == n and r.n_removed <= gone and (r.n_removed == 0) == (r.n_spans == 0)
        if r.n_removed == gone:
            same += 1
            assert r.kept_sha256 == sha(text)
    assert same >= 0.97 * len(exact)


def held(i, of):
    return zlib.crc32(str(i).encode()) % of


@tables
def test_op7(spark):
    labels = {r["doc_id"]: r["toxic"] for r in rows_of("labels")}
    out = QUERIES["op7_toxicity"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of("documents")}
    docs, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.fit(docs, lab)
    assert {r.doc_id for r in out} == set(texts)
    for r in out:
        assert r.held_out == (held(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.score == pytest.approx(plain_score(grammar, texts[r.doc_id]))
    test = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(p == y for p, y in test) >= 0.9 * len(test)


def plain_class(stems, word):
    for kind, words in (("target", toxicity.TARGET), ("negation", toxicity.NEGATION), ("reported", toxicity.REPORTED), ("will", toxicity.WILL), ("threat", toxicity.THREAT)):
        if word in words:
            return kind, 1.0
    weight = max([stems.get(word + "$", 0.0), *(stems.get(word[:n], 0.0) for n in range(toxicity.STEM_MIN, min(len(word), toxicity.STEM_MAX) + 1))])
    return ("insult", weight) if weight else None


def plain_score(grammar, text):
    """All clauses of a text, each read by flags instead of transducers."""
    sums = dict.fromkeys(toxicity.READINGS, 0.0)
    for clause in toxicity._CLAUSE.findall(text.lower()):
        classes = [c for w in toxicity._WORD.findall(clause) if (c := plain_class(grammar.stems, w))]
        target, flags = any(k == "target" for k, _ in classes), set()
        for kind, weight in classes:
            if kind == "insult":
                sums["reported" if "reported" in flags else "negated" if "negation" in flags else "targeted" if target else "insult"] += weight
            elif kind == "threat" and target and "will" in flags and "negation" not in flags:
                sums["threat"] += 0.3 if "reported" in flags else 1.0
            flags.add(kind)
    z = grammar.bias + sum(w * math.log1p(sums[r]) for w, r in zip(grammar.weights, toxicity.READINGS))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_composition_matches_enumerated_paths():
    stems = {"zor": 1.5, "zorkel": 3.0, "vax$": 2.0, "kille": 1.0, "youx": 0.5}
    lexicon = toxicity.lexicon(stems)
    composed = toxicity.Composition(lexicon, toxicity.CLAUSES)
    rng = random.Random(2)
    words = ["zor", "zork", "zorkelx", "vax", "vaxx", "kill", "killer", "you", "youxy", "said", "not", "will", "hello", "zo"]
    for w in words:
        assert composed.written(w) == ([c] if (c := plain_class(stems, w)) else [])
    for _ in range(300):
        clause = [rng.choice(words) for _ in range(rng.randint(0, 7))]
        marks = [m for w in clause for said, _ in lexicon.transduce([*w, toxicity.END]) for m in said]
        want = {}
        paths = toxicity.CLAUSES.transduce([k for k, _ in marks])
        assert len(paths) == 1  # one guess comes true
        # a reading's weight: the class's times the arc's; arcs weigh 1 but for reported threats
        state = next(s for s in toxicity.CLAUSES.start if s[0] == any(k == "target" for k, _ in marks))
        for kind, weight in marks:
            (state, reading, arc), = toxicity.CLAUSES.step(state, kind)
            if reading:
                want[reading] = want.get(reading, 0.0) + weight * arc
        assert composed.readings(clause) == pytest.approx(want)


def test_clauses_of_thousands_of_characters():
    grammar = toxicity.Grammar({"zorkel": 3.0}, [1.0] * len(toxicity.READINGS), -1.0)
    read = lambda t: dict(zip(toxicity.READINGS, grammar.readings(t).tolist()))
    filler = "word " * 1000
    assert read(f"not {filler} zorkel {filler} you")["negated"] == 3.0
    assert read(f"zorkel {filler} zorkel {filler} they")["targeted"] == 6.0


@tables
def test_op8(spark):
    labels = {r["doc_id"]: r["quality"] for r in rows_of("labels")}
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of("documents")}
    out = QUERIES["op8_quality"](spark, SF).collect()
    docs, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    field = quality.fit(docs, lab)
    assert {r.doc_id for r in out} == set(texts)
    checked = 0
    for r in out:
        assert r.held_out == (held(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if len([line for line in texts[r.doc_id].split("\n") if line]) <= 8:
            checked += 1
            assert r.score == pytest.approx(enumerated_quality(field, texts[r.doc_id]), abs=1e-6)
    assert checked > 20
    test = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(p == y for p, y in test) >= 0.85 * len(test)


def enumerated_quality(field, text):
    """The length-weighted mean of marginals that are sums over all labellings of the lines."""
    import pyarrow as pa

    lines = quality.Lines(pa.array([text]))
    m = len(lines.x)
    if not m:
        return field.empty
    emit = lines.x @ field.weights
    total, good = 0.0, np.zeros(m)
    top = None
    for y in itertools.product((0, 1), repeat=m):
        e = sum(emit[i] for i in range(m) if y[i]) + sum(field.transitions[a, b] for a, b in zip(y, y[1:]))
        top = e if top is None else top
        w = math.exp(e - top)
        total += w
        good += w * np.array(y)
    mean = min(max(float((lines.length * good / total).sum() / lines.length.sum()), 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(field.slope * math.log(mean / (1 - mean)) + field.shift)))


@tables
def test_op9(spark, tmp_path):
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of("documents")}
    out = QUERIES["op9_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    shards = {}
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards.get(i, [])) for i in range(40)]
    assert max(sizes) - min(sizes) <= 1
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order)


def test_buckets_are_dealt_one_after_the_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "STRIDE", 4)
    docs = spark.createDataFrame([(i, f"text {i} " * 20, i) for i in range(400)] + [(None, None, 7), (None, None, 7)], "doc_id long, text string, _slot int").repartition(3)
    out = sharding.write_shards(docs, str(tmp_path / "shards"), shards=7, bucket_bytes=2048)
    rows = out.collect()
    assert len(rows) == 402 and len({r._bucket for r in rows}) > 8
    place = sorted((r._slot * 7 + r._shard, r._bucket) for r in rows)
    assert [p for p, _ in place] == list(range(402))
    assert [b for b, _ in itertools.groupby(b for _, b in place)] == sorted({r._bucket for r in rows})


def test_names_that_operators_use_pass_through_or_give_way(spark):
    from lodestone.llm import bpe, minmax, phrases, suffixes, tiling

    text = " ".join(f"w{i}" for i in range(60))
    names = ["doc_id", "text", "_null", "none", "c0", "other", "copy", "_score", "_removed", "_hits", "_ids", "row", "value"]
    docs = spark.createDataFrame([(i, text if i < 3 else None, *([7] * 11)) for i in (1, 2, 4)] + [(None, None, *([7] * 11))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names[2:]))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    outs = {
        "_removed": phrases.remove_repeats(docs), "_hits": tiling.decontaminate(docs, bench), "_ids": None,
        "_score": toxicity.score(docs, toxicity.fit(docs, labels)),
    }
    outs["_removed_"] = suffixes.remove_passages(docs)
    outs["_score_"] = quality.score(docs, quality.fit(docs, labels))
    public = pytest.importorskip("public_tokenizers")
    outs["_ids"] = bpe.encode(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    for name, out in outs.items():
        own = name.rstrip("_")
        assert out.columns.count(own) == 1
        rows = out.select(*[c for c in names if c != own]).collect()
        assert len(rows) == 4 and all(r[c] == 7 for r in rows for c in names[2:] if c != own)
        assert {(r.doc_id, r.text) for r in rows} == {(1, text), (2, text), (4, None), (None, None)}
    assert {r.doc_id for r in minmax.drop_near_duplicates(docs).select(*names).collect()} == {1, 4, None}
    assert bpe.encode(docs.where("false"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0


def test_texts_beyond_a_chunk_and_rows_without_ids(spark):
    from lodestone.llm import phrases, suffixes, tiling

    rng = random.Random(5)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(30000)}" for _ in range(220_000))  # over 1 MB
    assert len(long) > 1 << 20
    w = long.split(" ")
    tail = " ".join(w[150_000:150_080])
    rows = [(1, long), (2, "x " + tail + " y"), (None, "p " + tail), (None, "q " + tail), (None, "q " + tail), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for f in (phrases.remove_repeats, suffixes.remove_passages):
        got = sorted((str(r.doc_id), r._n_words, r._n_removed) for r in f(docs).collect())
        assert got == sorted([("1", 220_000, 0), ("2", 82, 80), ("None", 81, 80), ("None", 81, 80), ("None", 81, 80), ("3", 220_000, 220_000)]), f
    bench = spark.createDataFrame([(1, tail)], "item_id long, text string")
    assert tiling.decontaminate(docs, bench).where("_contaminated").count() == 6


def test_no_places_without_the_automaton(spark, monkeypatch):
    import pyarrow as pa

    from lodestone.llm import phrases
    from lodestone.llm.textkit import WHITESPACE, Sketch, Words

    passage = " ".join(f"w{i}" for i in range(30))
    words = Words(pa.array(["a b " + passage, "c " + passage + " d"]), WHITESPACE)
    sketch = Sketch(words, phrases.PHRASE, phrases.WINDOW)
    confirmed = np.unique(sketch.grams[sketch.chosen])
    assert phrases.Shard(words, sketch, confirmed).candidate.any()
    monkeypatch.setattr(phrases.Shard, "compiled", lambda *_: None)
    assert not phrases.Shard(words, sketch, confirmed).candidate.any()


def test_a_cluster_needs_a_shared_folder():
    from lodestone.llm.session import shared_dir

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        conf = {}
        sparkContext = Context  # noqa: N815

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_hot_keys_come_by_broadcast(spark, monkeypatch):
    from lodestone.llm import session

    monkeypatch.setattr(session, "FREQUENT", 1)
    left = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)], "k long, i int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("most")).where("n > 1")
    got = session.spread_join(left, right, ["k"], ["most"], F.col("i"))
    assert got.columns == ["k", "i", "most"]
    assert sorted(map(tuple, got.collect())) == [(k, i, n - 1) for k, n in ((1, 50), (2, 3)) for i in range(n)]
