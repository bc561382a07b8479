"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, licenses, minmax, phrases, quality, sharding, suffixes, tiling, toxicity

SCHEMA = "doc_id long, text string, row string, did string, copy int"


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, repeated lines, nulls, an empty and a long one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = [word() for _ in range(70)]
    texts = []
    for i in range(n):
        kind = i % 6
        own = [word() for _ in range(rng.randint(3, 120))]
        if kind == 1 and texts:
            texts.append(texts[-1])
            continue
        if kind == 2:
            own = own[:20] + passage + own[20:]
        if kind == 3:
            own = (own[:9] or ["x"]) * 12
        if kind == 4 and i > 6:
            own = [w if rng.random() > 0.02 else word() for w in texts[i - 4].split(" ")] if texts[i - 4] else own
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "a b"), (n + 4, "a b"), (n + 5, " ".join(passage * 40)), (None, "null id " * 30)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "d", 5) for i, t in rows], SCHEMA).repartition(3)


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def removed_by_windows(rows, width):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    seen, out = set(), {}
    for i, text in order:
        w = words(text)
        drop = [False] * len(w)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if g in seen:
                drop[k : k + width] = [True] * width
            seen.add(g)
        out[i] = (len(w), sum(drop), " ".join(x for x, d in zip(w, drop) if not d))
    return out


def test_repeats_match_brute_force(spark, rows):
    out = phrases.remove_repeats(frame(spark, rows))
    assert {"row", "did", "copy", "lang"} & set(out.columns) == {"row", "did", "copy"}
    got = {r.doc_id: (r._n_words, r._n_removed, r._kept_text) for r in out.collect()}
    assert got == removed_by_windows(rows, phrases.WINDOW)


def test_repeats_keep_equal_rows_alike(spark):
    text = " ".join(f"w{i}" for i in range(30))
    out = phrases.remove_repeats(frame(spark, [(1, text), (1, text), (2, text)])).select("doc_id", "_n_removed").collect()
    assert sorted(map(tuple, out)) == [(1, 0), (1, 0), (2, 30)]


def test_passages_are_sound_and_find_planted_ones(spark, rows):
    out = {r.doc_id: r for r in suffixes.remove_passages(frame(spark, rows)).collect()}
    exact = removed_by_windows(rows, suffixes.PASSAGE)
    for i, (n, gone, _) in exact.items():
        assert out[i]._n_words == n
        assert out[i]._n_removed <= gone
    assert sum(r._n_removed for r in out.values()) >= 0.97 * sum(e[1] for e in exact.values())


def groups(rows):
    sets = {}
    for i, text in rows:
        w = words(text, lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i, _ in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("big", [32, 2])
def test_near_duplicates_match_brute_force(spark, rows, big, monkeypatch):
    monkeypatch.setattr(minmax, "BIG_BUCKET", big)
    known = [r for r in rows if r[0] is not None]
    got = {r.did: (r.n_shingles, r.component) for r in minmax.near_duplicates(frame(spark, known)).collect()}
    assert got == groups(known)


def test_one_of_a_group_stays(spark, rows):
    known = [r for r in rows if r[0] is not None]
    kept = {r.doc_id for r in minmax.drop_near_duplicates(frame(spark, known + known[:5])).collect()}
    assert kept == {i for i, (_, c) in groups(known).items() if c == i}


def test_tokens_match_the_library(spark, rows):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    odd = [(900, "x" * 300 + "​日本語 🎉🎉 it's 12345   \n\n y"), (901, "aaaaaaa" * 40), (902, "<|endoftext|>")]
    data = [r for r in rows if r[0] is not None] + odd
    out = bpe.decode(bpe.encode(frame(spark, data), path, public.PATTERN), path).collect()
    texts = dict(data)
    for r in out:
        assert r._ids == library.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r._bytes).decode() == (texts[r.doc_id] or "")


def test_long_pieces_merge_like_short_ones():
    public = pytest.importorskip("public_tokenizers")
    vocab = bpe.vocabulary(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    pieces = ["straightforwardness", "hellothereabc", "zzzzzzzz"]
    assert [x.tolist() for x in vocab.merge(pieces)] == [vocab.merge_one(p.encode()) for p in pieces]


def test_license_places(spark):
    rows = [(1, "Released Under the MIT License. under-the-mit license"), (2, "Apache License, Version 2.0; CC BY-NC 4.0"), (3, "GNU General Public License, version 3"), (4, None), (5, ""), (6, "mit license"), (7, "éunder the mit license")]
    out = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert [p.start for p in out[1]._places if p.base] == [1, 5] or sorted(p.start for p in out[1]._places if p.base) == [1, 5]
    assert (out[2]._base_labels, out[3]._base_labels, out[3]._labels) == ("apache-2,cc-by-nc", "", "gpl,gpl-3")
    assert (out[4]._n_words, out[5]._n_words, out[4]._labels, out[4]._score) == (0, 0, "", 0.0)
    assert out[6]._score == 0.0 and out[7]._base_labels == ""


def test_license_scan_of_long_repetitive_texts_and_clashing_names(spark):
    """192,000 words, every third of which begins a place; columns named like the new ones."""
    docs = spark.createDataFrame([(1, "cc by nc " * 64_000, "old", 2.0), (2, "under the mit the under mit license under the mit license", "old", 2.0)], "doc_id long, text string, _labels string, _score double")
    frame = licenses.scan(docs)
    assert frame.columns == ["doc_id", "text", "_n_words", "_places", "_base_labels", "_labels", "_score"]
    began = time.time()
    out = {r.doc_id: r for r in frame.selectExpr("doc_id", "_n_words", "size(_places) as n", "_places[0].start as start", "_labels").collect()}
    assert time.time() - began < 30
    assert (out[1]._n_words, out[1].n, out[1]._labels) == (192_000, 64_000, "cc-by-nc")
    assert (out[2].n, out[2].start, out[2]._labels) == (1, 7, "mit")


def test_license_words_by_each_file_s_rarest(spark):
    """The words looked up depend on which phrases a file can hold: every phrase is found beside all others."""
    found = [" ".join(words) for _, words, _ in licenses.phrases()]
    rows = [(i, f"so {a} and {b} or") for i, (a, b) in enumerate(itertools.product(found, found))]
    out = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).select("doc_id", "_places").collect()}
    for i, text in rows:
        want = sorted(m.start() for f in set(found) for m in re.finditer(f"(?<![^ ]){f}(?![^ ])", text))
        assert len(out[i]._places) == len(want), text


def test_license_scan_runs_no_python(spark, rows):
    plan = licenses.scan(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_shards(spark, rows):
    out = sharding.shuffle_into_shards(frame(spark, rows + rows[:3]), shards=7, bucket_bytes=4096).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted((str(i), str(t)) for i, t in rows + rows[:3])
    slots = {}
    for r in out:
        slots.setdefault(r._shard, []).append(r._slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_fisher_yates_is_a_permutation():
    import numpy as np

    assert sorted(sharding.fisher_yates(50, np.random.default_rng(1)).tolist()) == list(range(50))
    assert len(sharding.fisher_yates(0, np.random.default_rng(1))) == 0


def test_tiles_find_reordered_passages(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    w = item.split()
    docs = [(1, f"x y {' '.join(w[6:])} z {' '.join(w[:6])} q"), (2, "one two three four x five six seven"), (3, None), (4, ""), (5, item.upper() + "!"), (6, " ".join(w[:5]))]
    bench = spark.createDataFrame([(7, item), (8, None), (None, item), (9, "tiny")], "item_id long, text string")
    out = {r.doc_id: r for r in tiling.decontaminate(frame(spark, docs), bench).collect()}
    assert {i for i, r in out.items() if r._contaminated} == {1, 5}
    assert out[1]._hits[0].tiles == 2 and out[1]._hits[0].coverage == 1.0
    assert out[6]._hits[0].coverage == pytest.approx(5 / 12)
    none = tiling.decontaminate(frame(spark, docs), bench.where("false")).collect()
    assert len(none) == 6 and not any(r._contaminated for r in none)


def labelled(n=400, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("bcdfglmnprstaeiou") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    out = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(30, 120))]
        toxic, good = int(i % 5 == 0), int(i % 4 != 0)
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["zorkel", "zorkelest", "vaxxit"]))
        lines = [" ".join(w[k : k + 8]) + "." for k in range(0, len(w), 8)]
        if not good:
            lines = [line.upper().replace(" ", "!! ") for line in lines]
        out.append((i, "\n".join(lines), toxic, good))
    return out


def test_toxicity_held_out(spark):
    data = labelled()
    docs = frame(spark, [(i, t) for i, t, _, _ in data] + [(9000, None), (9001, "")])
    labels = spark.createDataFrame([(i, x, g) for i, _, x, g in data] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r._score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(got[i], x) for i, _, x, _ in data if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(x) for s, x in held) >= 0.95 * len(held)
    assert 0 <= got[9000] == got[9001] < 0.5


def test_clause_readings():
    read = toxicity.clause_readings
    assert read([("target", 1), ("insult", 2.0)]) == {"targeted": 2.0}
    assert read([("negation", 1), ("insult", 2.0)]) == {"negated": 2.0}
    assert read([("reported", 1), ("negation", 1), ("insult", 2.0)]) == {"reported": 2.0}
    assert read([("will", 1), ("threat", 1), ("target", 1)]) == {"threat": 1.0}
    assert read([("threat", 1), ("target", 1)]) == {}


def test_quality_held_out(spark):
    data = labelled()
    docs = frame(spark, [(i, t) for i, t, _, _ in data] + [(9000, None), (9001, "\n\n")])
    labels = spark.createDataFrame([(i, x, g) for i, _, x, g in data], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r._score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    held = [(got[i], g) for i, _, _, g in data if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.5) == bool(g) for s, g in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001]


def test_marginals_match_enumeration():
    import itertools

    import numpy as np
    import pyarrow as pa

    lines = quality.Lines(pa.array(["Ab c.\nDEF!! G\nx", "one", "", None]))
    rng = np.random.default_rng(2)
    field = quality.Field(rng.normal(size=lines.x.shape[1]), rng.normal(size=(2, 2)))
    good, _, emit = field.marginals(lines)
    weights = {}
    for y in itertools.product((0, 1), repeat=3):
        weights[y] = np.exp(sum(emit[i, v] for i, v in enumerate(y)) + sum(field.transitions[a, b] for a, b in zip(y, y[1:])))
    for i in range(3):
        assert good[i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / sum(weights.values()))


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("false")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for out in (
        phrases.remove_repeats(none), suffixes.remove_passages(none), minmax.near_duplicates(none), minmax.drop_near_duplicates(none),
        licenses.scan(none), sharding.shuffle_into_shards(none), tiling.decontaminate(none, bench),
        toxicity.score(none, toxicity.fit(none, labels)), quality.score(none, quality.fit(none, labels)),
    ):
        assert out.count() == 0
    assert toxicity.score(frame(spark, [(1, "x")]), toxicity.fit(none, labels)).select(F.col("_score") < 0.5).first()[0]
    assert hashlib.sha256(b"").hexdigest()
