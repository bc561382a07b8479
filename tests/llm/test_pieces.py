"""op11: ids and texts against the sentencepiece library."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lodestone.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(seed, n=3000):
    rng = random.Random(seed)
    letters = "ab \n▁\r\tthe  é日本😀\x00　ing<0x0A></s>ed()"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(120 if k % 20 == 0 else 24))) for k in range(n)]


def test_ids_are_the_library_s(library):
    vocab = pieces.Pieces(PATH)
    some = [*texts(1), "", " ", "▁", "a" * 3000, " " * 3000, "x \n y", "the cat " * 500, "日本" * 400]
    ids, bounds, agreed = vocab.encode(some)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == library.encode(some)
    assert agreed.all()
    for part in (" internationalisation", " ", "  x", "été\x00日本"):
        known = [vocab.ids.get(s, -1 - ord(s[0])) for s in vocab._heap(part)]
        assert vocab._side_by_side([part, part])[1] == known


def test_decoding_is_the_library_s(library):
    vocab, rng = pieces.Pieces(PATH), random.Random(2)
    lists = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), 28705, 259, 2, 1, 0]) for _ in range(rng.randrange(9))] for _ in range(3000)]
    flat = np.array([i for x in lists for i in x])
    out = vocab.decode(flat, np.cumsum([0, *map(len, lists)]))
    assert [x.decode() for x in out] == [library.decode(x) for x in lists]


def test_a_wrong_agenda_is_told(library):
    vocab = pieces.Pieces(PATH)
    vocab.pair_order[:-1] = 0  # always the leftmost pair
    _, _, agreed = vocab.encode(["the internationalisation of trade", "q"])
    assert not agreed[0]


def test_generations(monkeypatch, library):
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    vocab, some = pieces.Pieces(PATH), texts(4, 800)
    for lo in range(0, len(some), 20):
        ids, bounds, agreed = vocab.encode(some[lo : lo + 20])
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == library.encode(some[lo : lo + 20]) and agreed.all()


def test_operator(spark, library):
    rows = [(1, "the cat\nsat ", "x"), (2, None, "y"), (3, "", None), (1, "the cat\nsat ", "x"), (None, "é😀" * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ids string").withColumnRenamed("_ids", "some")
    out = pieces.round_trip(docs, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["_text"]) for r in out) == sorted((d or 0, t or "") for d, t, _ in rows)
    want = {t or "": [*library.encode(t or ""), 2] for _, t, _ in rows}
    assert all(r["_ids"] == want[r["_text"]] and r["_agrees"] for r in out)
    back = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert back.columns == ["doc_id", "text", "some", "_ids", "_text"]
    assert all(r["_text"] == (r["text"] or "") for r in back.collect())


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "old", [9], True, "v")], "doc_id long, text string, _text string, _ids array<int>, _agrees boolean, value string")
    out = pieces.round_trip(docs, PATH)
    assert out.columns == ["doc_id", "value", "_ids", "_text", "_agrees"]
    assert out.first()["_text"] == "a b"
    assert pieces.round_trip(docs.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([([264, None, 287],), (None,)], "_ids array<int>")
    assert {r["_text"] for r in pieces.decode(nulls, PATH).collect()} == {"a b", None}
    with pytest.raises(Exception, match="not in the vocabulary"):
        pieces.decode(spark.createDataFrame([([32_000],)], "_ids array<int>"), PATH).collect()


def test_query(spark, tmp_path, library):
    from lodestone.llm.queries import QUERIES

    some = [t.replace("\x00", "") for t in texts(3, 60)]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in QUERIES["op11_pieces"](spark, str(tmp_path)).collect():
        ids = library.encode(some[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["agrees"]) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)), True)
