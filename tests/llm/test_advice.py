"""What a review found to be less than the whole job."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, minmax, session, suffixes, toxicity

SCHEMA = "doc_id long, text string"


def text(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_stage_drops_near_copies_from_80(spark, tmp_path):
    import corpus_pipeline

    rows = []
    for i in range(20):  # 100 shingles each, 89 in common: 89 / 111 = 0.802; then 88 / 112 = 0.786
        base = text(f"a{i}x", 104).split(" ")
        rows += [(i, " ".join(base)), (100 + i, " ".join(base[:93]) + " " + text(f"b{i}x", 11)), (200 + i, text(f"c{i}x", 104))]
        rows.append((300 + i, text(f"c{i}x", 92) + " " + text(f"d{i}x", 12)))
    docs = spark.createDataFrame(rows, SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()} == {i for i, _ in rows if not 100 <= i < 200}
    assert minmax.drop_near_duplicates(docs, 85).count() == len(rows)


def test_bands_and_bounds_follow_the_threshold():
    assert [minmax.band_rows(t) for t in (80, 85)] == [4, 5]
    assert [minmax.sketch_bits(t) for t in (80, 85)] == [35, 30]


def test_rows_without_or_with_repeated_ids_go_by_their_own_text(spark):
    rows = [(1, text("a", 60)), (None, text("a", 60)), (None, text("a", 59)), (2, text("b", 60)), (2, text("a", 60) + " tail")]
    rows += [(None, text(f"own{i}x", 40)) for i in range(10)] + [(2, text("e", 40)), (None, None), (None, ""), (3, ""), (7, text("f", 50)), (5, text("f", 50) + " z")]
    kept = [tuple(r) for r in minmax.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    gone = {(None, text("a", 60)), (None, text("a", 59)), (2, text("a", 60) + " tail"), (7, text("f", 50))}
    assert sorted(kept, key=repr) == sorted(set(rows) - gone, key=repr)


def test_long_clauses_are_read_whole():
    grammar = toxicity.Grammar({"zorkel": 3.0}, [1.0] * len(toxicity.READINGS), -1.0)
    read = lambda t: dict(zip(toxicity.READINGS, grammar.readings(t).tolist()))
    none = dict.fromkeys(toxicity.READINGS, 0.0)
    filler = "word " * 450
    assert read(f"Fine. You {filler}zorkel") == none | {"targeted": 3.0}
    assert read(f"zorkel {filler}zorkel! zorkel") == none | {"insult": 9.0}
    assert read(f"zorkel {'word ' * 410}zorkel you") == none | {"targeted": 6.0}
    assert read(f"they said {filler}zorkel; not {filler}zorkel") == none | {"reported": 3.0, "negated": 3.0}
    assert read(f"will {filler}kill {filler}you") == none | {"threat": 1.0}
    assert read("a" * 3000 + "zorkel") == none


def test_neighbours_meet_wherever_their_suffixes_lie(spark):
    # runs of 49 words, one less than a passage, that five and more documents share; pairs of these share one word more
    rows = []
    for r in range(0, 10000, 1000):
        run = text(f"run{r}x", 49)
        rows.append((r, text(f"h{r}x", 9) + " " + run + " " + text(f"i{r}x", 60)))
        for i in range(r + 1, r + 5):
            rows += [(n, text(f"p{n}x", 7) + " " + run + " " + text(f"s{i}x", 1) + " " + text(f"e{n}x", 9)) for n in (i, 100 + i)]
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    kept = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    out = {r.doc_id: r._n_removed for r in suffixes.remove_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, v in kept.items():
        spark.conf.set(k, v)
    assert {i for i, n in out.items() if n >= 50} == {i for i, _ in rows if i % 1000 > 100}
    assert all(n in (0, 50) for n in out.values())


@pytest.mark.parametrize("times", [1, 2, 12])
def test_repeated_ids_take_no_places(spark, times):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    q = rows[0][1]
    rows += [(90 + j, [x + 0.01 * (j + 1) for x in q]) for j in range(2) for _ in range(times)]  # rows repeated
    rows += [(92, [x + 0.001 * (j + 1) for x in q]) for j in range(times)]  # an id with many vectors near the query
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    least = {}
    for i, v in rows:
        least[i] = min(least.get(i, math.inf), math.dist(q, v))
    want = sorted((d, i) for i, d in least.items() if i)[:10]
    got = ann.search(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(n + 1, i) for n, (_, i) in enumerate(want)]
    assert all(abs(r.score - d) < 1e-9 for r, (d, _) in zip(got, want))


def test_written_tables_release_what_the_driver_freed(spark, monkeypatch):
    session.cut(spark.range(3), "first")  # what a first job loads isn't measured
    jvm = spark.sparkContext._jvm
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, pid, block = field.get(None), jvm.java.lang.ProcessHandle.current().pid(), 1 << 16
    held = lambda: next(int(x.split()[1]) for x in open(f"/proc/{pid}/status") if x.startswith("RssAnon")) / 1024
    blocks = [unsafe.allocateMemory(block) for _ in range(2400)]
    for at in blocks:
        unsafe.setMemory(at, block, 1)
    some = blocks[::100] + blocks[-1:]  # so few blocks in use keep all of the freed ones with the allocator
    for at in blocks:
        if at not in some:
            unsafe.freeMemory(at)
    monkeypatch.setattr(session, "_release_from", 0.0)
    before = held()
    assert session.cut(spark.range(3), "released").count() == 3
    after = held()
    for at in some:
        unsafe.freeMemory(at)
    assert before - after > 100
    again = session._release_from
    session.release(spark)  # too soon after the last time
    assert session._release_from == again
