"""What a review found to be less than the whole job, in the catalogue's queries."""

import math
import re

import pytest


def test_whole_texts_are_encoded(spark, tmp_path):
    from lodestone import queries as Q

    texts = {1: "The cat. That thing sat on a mat, zzz.", 2: "No stop here", 3: "x. " + "that thing the hat. " * 300}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    letters = "abcdefghijklmnopqrstuvwxyz"
    tokens = ["[UNK]", *letters, *(f"##{c}" for c in letters), "the", "that", "th", "##ing", "."]
    got = {r.id: r.vector for r in Q.QUERIES["s_encode"](spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        text = (t.split(".")[0].strip() + ". " + t.strip()).strip(". ").lower()
        ids = []
        for word in re.findall(r"[a-z]+|[^\sa-z]", text):
            at = 0
            piece = lambda a, b: ("##" if a else "") + word[a:b]
            known = []
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if piece(at, e) in tokens), None)
                if end is None:
                    known = [0]
                    break
                known.append(tokens.index(piece(at, end)))
                at = end
            ids += known
        mean = [sum(((n * k) % 11 - 5) * 0.5 for n in ids) / len(ids) for k in range(1, 9)]
        assert got[i] == pytest.approx([x / math.hypot(*mean) for x in mean], abs=2e-6)


def test_counting_pieces_takes_little_memory(spark):
    """A batch of many words isn't made into Python's strings word by word; batches have a bound in bytes."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import functions as F

    from lodestone.operators import encoding as E
    from lodestone.session import ship

    vocabulary = {t: n for n, t in enumerate(["[UNK]", "a", "##a", "##b", ".", "aab"])}
    ship(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
    words = spark.createDataFrame([(1, "AAB aa\u2003b. abb\u00e4 aaba"), (2, None), (3, "\n"), (3, "a a"), (3, "a")], "id long, text string")
    counts = E.piece_counts(E.Model(8, 0), vocabulary)
    got = [(r.id, [tuple(x) for x in r.c]) for r in words.select("id", counts(E.clean(F.col("text"))).alias("c")).collect()]
    # aab; a ##a; unknown, .; a ##b ##b ##a; aab ##a
    assert got[0] == (1, [(0, 1), (1, 2), (2, 3), (3, 2), (4, 1), (5, 2)]) and got[1:] == [(2, []), (3, []), (3, [(1, 2)]), (3, [(1, 1)])]
    table = spark.createDataFrame([(n, [n + 1, 3 - n], 0.5) for n in range(6)], "token_id int, q array<tinyint>, scale float")
    plain = E.encode(words.select("id", E.word_pieces(E.Model(8, 0), vocabulary)(E.basic_tokens(F.col("text"))).alias("tokens")), table)
    vectors = {r.id: r.vector for r in E.encode_texts(words, E.Model(8, 0), vocabulary, table).collect()}
    assert vectors == {r.id: r.vector for r in plain.collect()} and sorted(vectors) == [1, 3]
    assert {r.token: r.n for r in E.token_counts(words).collect()} == {"aab": 1, "aa": 1, "b": 1, ".": 1, "abba": 1, "aaba": 1, "a": 3}
    batch = pa.array(["aab aa a " * 100] * 1000)
    tracemalloc.start()
    counts.func(batch)
    assert tracemalloc.get_traced_memory()[1] < 40_000_000  # 300,000 words
    tracemalloc.stop()


def test_builds_read_documents_alone(spark, tmp_path):
    """Titles and texts need no labels: documents aren't shuffled to join what isn't used."""
    from lodestone import derived

    rows = [(i, f"title {i}. the text, the end", "en", "s", 9) for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.id: r.encoded for r in derived.s_build(spark, str(tmp_path)).collect()} == {i: i % 3 == 0 or i == 1 for i in range(9)}
