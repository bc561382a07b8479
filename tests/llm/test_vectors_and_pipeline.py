import math
import random

from pyspark.sql import functions as F

from lodestone.llm import ann
from lodestone.llm.graph import components


def vectors(n=900, dim=8, seed=4):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(30)]  # ties with row 0
    bad = [(n + 50, None), (n + 51, [0.0] * dim), (n + 52, [float("nan")] * dim), (n + 53, [None] * dim), (n + 54, [1.0]), (None, rows[1][1]), (n + 55, [float("inf")] * dim)]
    return rows, bad


def nearest(rows, q, k=10):
    x = dict(rows)[q]
    return sorted((math.dist(x, v), i) for i, v in rows if i != q)[:k]


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rows, bad = vectors()
    table = spark.createDataFrame([(i, v, "p") for i, v in rows + bad], "vec_id long, embedding array<float>, part string")
    stored = [(r.vec_id, r.embedding) for r in table.collect() if r.vec_id is not None and r.vec_id < 940]
    out = ann.search(table, F.col("vec_id") % 100 == 0).collect()
    hit = total = 0
    for q in range(0, 900, 100):
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        want = nearest(stored, q)
        hit += len({m[1] for m in mine} & {i for _, i in want})
        total += 10
        assert all(abs(m[2] - math.dist(dict(stored)[q], dict(stored)[m[1]])) < 1e-9 for m in mine)
    assert hit >= 0.9 * total
    assert [r.vec_id for r in sorted((r for r in out if r.query_id == 0), key=lambda r: r.rank)] == list(range(900, 910))


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)
    assert [(r.query_id, r.vec_id) for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 2), (0, 1)]
    assert ann.search(few.where("false"), F.lit(True)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), (3, 1), (2, 1)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(40)]
    item, passage = " ".join(word() for _ in range(20)), " ".join(word() for _ in range(60))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, texts[3]), (101, texts[4] + " tail"), (102, "x " + item + " y"), (103, passage + " p " + texts[0][:40]), (104, "q " + passage), (105, None), (106, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "byte_bpe"]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 103 and 104 share 56 of 68 shingles, 0.82: near duplicates from 0.8 on, of which the first stays
    assert set(out) == set(range(40)) | {103, 105, 106}
    assert all(r.decodes for r in out.values())
    stage = dict(corpus_pipeline.STAGES)["substring_dedup"]
    cut = {r.doc_id: r for r in stage(spark, docs, str(tmp_path)).collect()}
    assert cut[104].text == "q" and cut[104].n_chars == 1 and cut[103].text == dict(rows)[103] and cut[105].text is None
