"""op13: groups, links and counts against byte offsets of the libraries' tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment
from lodestone.llm.queries import QUERIES

LEFT, RIGHT, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
ZEROS = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_best": 0, "count_sum": 0, "groups": ""}


@pytest.fixture(scope="module")
def libraries():
    left = Tokenizer.from_file(LEFT)
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=RIGHT)


def brute(texts, libraries):
    """Rows by comparing all byte ranges."""
    left, right = libraries
    names = left.get_vocab()
    of = alignment.byte_of_char()
    raw = {i: bytes(of[c] for c in t) for t, i in names.items() if i != 50256}
    rows, links = [], []
    for t in texts:
        a = left.encode(" " + t, add_special_tokens=False).ids if t else []
        b = right.encode(t or "")
        a_bytes = [raw[i] for i in a]
        b_bytes = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(a_bytes) != b" " + t.encode() or b"".join(b_bytes) != b" " + t.encode():
            rows.append(dict(ZEROS))
            links.append([])
            continue
        ranges = []
        for parts in (a_bytes, b_bytes):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            ranges.append(out)
        own = [(a[i], b[j]) for i, (p, q) in enumerate(ranges[0]) for j, (r, s) in enumerate(ranges[1]) if p < s and r < q]
        ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, begin = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(ids[k]) for k, (p, q) in enumerate(side) if begin <= p and q <= e) for ids, side in zip((a, b), ranges)))
            begin = e
        rows.append({"n_a": len(a), "n_b": len(b), "n_groups": len(groups), "n_links": len(own), "groups": ";".join(groups)})
        links.append(own)
    counts = Counter(x for own in links for x in own)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for row, own in zip(rows, links):
        row["n_best"] = sum(counts[x] == most[x[1]] for x in own)
        row["count_sum"] = sum(counts[x] for x in own)
    return rows


def texts(seed, n=120):
    rng = random.Random(seed)
    letters = "ab \n▁\tthe  é日本😀　ing<|endoftext|>ed()'s"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", None, "<|endoftext|>", "a <s> b", "the cat's", "the cat's", " " * 2500 + "x"]


@pytest.mark.parametrize("frequent", [1 << 19, 40, 0])
def test_against_all_byte_ranges(spark, libraries, frequent):
    some = texts(1)
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r.asDict() for r in alignment.align(docs, LEFT, PATTERN, RIGHT, frequent=frequent).collect()}
    assert [{k: found[i][k] for k in ZEROS} for i in range(len(some))] == brute(some, libraries)
    assert sum(r["n_links"] > 0 for r in found.values()) > 60


def test_left_is_the_library_s(libraries):
    left = alignment.Left(LEFT, PATTERN)
    some = [t for t in texts(5, 3000) if t] + ["a" * 4000, "\n" * 5000 + " x", " " * 5000]
    assert left.encode(some) == [e.ids for e in libraries[0].encode_batch(some, add_special_tokens=False)]


def test_steps_are_remembered_and_forgotten(monkeypatch):
    own = alignment.Aligner(alignment.Left(LEFT, PATTERN), alignment.Right(RIGHT))
    some = [t for t in texts(3) if t]
    first = own.batch(some)
    steps = len(own.transducer.pairs)
    assert [r[:4] for r in own.batch(some)] == [r[:4] for r in first]
    assert len(own.transducer.pairs) == steps  # nothing is compared twice
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    again = own.batch(some)
    assert [(r[3], r[4].tolist(), r[5].tolist()) for r in again] == [(r[3], r[4].tolist(), r[5].tolist()) for r in first]


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "old", "v", 3)], "doc_id long, text string, groups string, pairs string, _key int")
    out = alignment.align(docs, LEFT, PATTERN, RIGHT)
    assert out.columns == ["doc_id", "pairs", "_key", *ZEROS]
    assert out.first()["pairs"] == "v" and out.first()["_key"] == 3 and out.first()["n_links"] == 2
    assert alignment.align(docs.limit(0), LEFT, PATTERN, RIGHT).count() == 0


def test_query(spark, tmp_path, libraries):
    some = texts(2, 60)
    spark.createDataFrame([*enumerate(some), (None, "the cat")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([*some, "the cat"], libraries)
    for r in QUERIES["op13_alignment"](spark, str(tmp_path)).collect():
        row = want[-1 if r["doc_id"] is None else r["doc_id"]]
        assert all(r[k] == row[k] for k in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
        assert r["groups_sha256"] == (hashlib.sha256(row["groups"].encode()).hexdigest() if row["groups"] else "")
