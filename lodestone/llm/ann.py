"""Approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced parts; a small classifier learns, from a vector, how its neighbours
spread over the parts. The index assigns every row to the classifier's most probable part. A query goes to its several most
probable parts, as many as found RECALL of the sample's neighbours, and is reranked there exactly.

There are parts at every size, as many as the square root of the rows asks for, and the index is written once, by part number.
Parts are dealt out in blocks of bounded size (candidates x queries), so a part that holds a third of all rows is many
tasks; each block gives a query's nearest K, and the blocks' answers are merged by an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.session import cut, prepare

K = 10
#: Rows of the sample that the index is fitted on: for each part, at least and at most; and neighbours in its graph.
PART_SAMPLE, SAMPLE, MAX_SAMPLE, DEGREE = 32, 4096, 32768, 10
#: Share of the sample's neighbours that the probed parts must hold.
RECALL = 0.95
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Queries whose distances to a block are in memory at a time.
SLICE = 256
HIDDEN, EPOCHS = 128, 250


def part_count(rows: int) -> int:
    """Parts of so many rows: they grow with the square root of the rows, as do rows in a part, up to what the sample can show.
    So a table of 64 rows has 2 parts and one of a hundred million 1,024."""
    return max(1, min(MAX_SAMPLE // PART_SAMPLE, isqrt(rows) // 4, rows // PART_SAMPLE))


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Each row's nearest rows, by blocks."""
    degree = min(degree, len(x) - 1)
    out = np.empty((len(x), degree), np.int64)
    norms = (x**2).sum(axis=1)
    for lo in range(0, len(x), 512):
        d = norms[lo : lo + 512, None] + norms[None] - 2 * x[lo : lo + 512] @ x.T
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo : lo + 512] = np.argpartition(d, degree - 1, axis=1)[:, :degree] if degree else out[lo : lo + 512]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.1) -> np.ndarray:
    """Balanced partition of the graph: halves along principal directions to start with, then sweeps that move a row to the
    part most of its neighbours (both ways) are in, while that part has room."""
    label = np.zeros(len(x), np.int64)
    stack, used = [(np.arange(len(x)), parts)], 0
    while stack:
        rows, p = stack.pop()
        if p == 1:
            label[rows] = used
            used += 1
            continue
        y = x[rows] - x[rows].mean(axis=0)
        direction = rng.normal(size=y.shape[1])
        for _ in range(8):
            direction = y.T @ (y @ direction)
            direction /= np.linalg.norm(direction) or 1.0
        order = np.argsort(y @ direction, kind="stable")
        at = len(rows) * (p // 2) // p
        stack += [(rows[order[:at]], p // 2), (rows[order[at:]], p - p // 2)]
    room = int(np.ceil(slack * len(x) / parts))
    size = np.bincount(label, minlength=parts)
    degree = graph.shape[1]
    heads = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), degree)])
    tails = np.concatenate([np.repeat(np.arange(len(x)), degree), graph.ravel()])
    order = np.argsort(heads, kind="stable")
    tails, first = tails[order], np.searchsorted(heads[order], np.arange(len(x) + 1))
    for _ in range(10):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(label[tails[first[i] : first[i + 1]]], minlength=parts)
            best = int(np.argmax(np.where((size < room) | (np.arange(parts) == label[i]), votes, -1)))
            if best != label[i] and votes[best] > votes[label[i]]:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return label


class Router:
    """A classifier with one hidden layer: probabilities of the parts that hold a vector's neighbours."""

    def __init__(self, arrays: list[np.ndarray], probes: int):
        self.arrays, self.probes = arrays, probes

    def scores(self, x: np.ndarray) -> np.ndarray:
        m, s, a, b, c, d = self.arrays
        return np.maximum((x - m) / s @ a + b, 0) @ c + d

    @staticmethod
    def learn(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Router:
        m, s = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = (x - m) / s
        params = [rng.normal(size=(x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, target.shape[1])) * np.sqrt(1 / HIDDEN), np.zeros(target.shape[1])]
        mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(EPOCHS // 10):
            order = rng.permutation(len(z))
            for rows in np.array_split(order, max(1, len(order) // 512)):
                step += 1
                h = np.maximum(z[rows] @ params[0] + params[1], 0)
                o = h @ params[2] + params[3]
                o = np.exp(o - o.max(axis=1, keepdims=True))
                g = (o / o.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                gh = (g @ params[2].T) * (h > 0)
                grads = [z[rows].T @ gh + 1e-4 * params[0], gh.sum(axis=0), h.T @ g + 1e-4 * params[2], g.sum(axis=0)]
                for i, grad in enumerate(grads):
                    mean[i] = 0.9 * mean[i] + 0.1 * grad
                    var[i] = 0.999 * var[i] + 0.001 * grad**2
                    params[i] = params[i] - 3e-3 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.999**step)) + 1e-8)
        return Router([m, s, *params], target.shape[1])


def fit(sample: np.ndarray, parts: int, seed: int = 7) -> Router:
    """Router of the sample's parts. A quarter of the sample is kept from training; its neighbours set the probes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    graph = neighbour_graph(sample, DEGREE)
    if parts == 1 or graph.shape[1] == 0:
        return Router([np.zeros(sample.shape[1]), np.ones(sample.shape[1]), np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    label = balanced_parts(sample, graph, parts, rng)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(sample)), label] += 2.0
    target /= target.sum(axis=1, keepdims=True)
    train, test = np.arange(len(sample)) % 4 != 0, np.flatnonzero(np.arange(len(sample)) % 4 == 0)
    router = Router.learn(sample[train], target[train], rng)
    scores = router.scores(sample)
    assigned = scores.argmax(axis=1)
    rank = np.argsort(np.argsort(-scores[test], axis=1), axis=1)
    needed = np.take_along_axis(rank, assigned[graph[test]], axis=1).ravel() + 1
    router.probes = int(np.quantile(needed, RECALL, method="higher"))
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows that take part: not null, not zero, all components finite, of the most frequent length
    (the smaller length on ties). Rows without an id take no part."""
    e = F.col("embedding").cast("array<double>")
    sound = table.select("vec_id", e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
    )
    common = sound.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.where(F.size("embedding") == (common["n"] if common else 0))


def search(table: DataFrame, is_query, k: int = K) -> DataFrame:
    """For each row that `is_query` holds for: rank, vec_id and score (Euclidean distance) of the nearest others found.

    Rows that share an id count as one candidate at its smallest distance, never as a neighbour of themselves; distances tie
    by vec_id. An empty table gives an empty result; fewer than k candidates are all returned; other columns are not read.
    """
    spark = prepare(table.sparkSession)
    # repeated rows would take the places of others in the sample, in blocks and in sizes
    vectors = cut(valid_vectors(table.select("vec_id", "embedding")).distinct(), "vectors")
    total = vectors.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    parts = part_count(total)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(max(SAMPLE, parts * PART_SAMPLE)).toArrow()
    router = fit(_matrix(sample.column("embedding").combine_chunks()), parts)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            part = router.scores(x).argmax(axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], ["vec_id", "embedding", "part"])

    indexed = cut(vectors.mapInArrow(assign, "vec_id long, embedding array<double>, part int"), "index")
    # rows of a part, and ids of which all rows are in it: those of several parts are not counted on
    sizes, own = np.zeros((2, parts), np.int64)
    spread = indexed.groupBy("vec_id", "part").count().withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy("vec_id")))
    for r in spread.groupBy("part").agg(F.sum("count").alias("rows"), F.count_if(F.col("parts") == 1).alias("ids")).collect():  # two numbers a part
        sizes[r["part"]], own[r["part"]] = r["rows"], r["ids"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            order = np.argsort(-router.scores(x), axis=1, kind="stable") if len(x) else np.zeros((0, parts), np.int64)
            # as many parts as the router probes, and further ones until they hold enough candidates
            full = np.cumsum(own[order], axis=1) - own[order] <= k
            take = (np.arange(parts)[None] < router.probes) | full
            rows, cols = np.nonzero(take)
            picked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([picked.column("vec_id"), picked.column("embedding"), pa.array(order[rows, cols].astype(np.int32))], ["query_id", "embedding", "part"])

    queries = indexed.where(is_query).select("vec_id", "embedding")
    routed = queries.mapInArrow(route, "query_id long, embedding array<double>, part int")
    asked = np.zeros(parts, np.int64)
    for r in routed.groupBy("part").count().collect():
        asked[r["part"]] = r["count"]
    blocks = F.array(*[F.lit(int(-(-n // BLOCK_ROWS) or 1)) for n in sizes])
    askers = F.array(*[F.lit(int(-(-n // BLOCK_QUERIES) or 1)) for n in asked])
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    at = F.col("part") + 1
    left = (
        routed.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.element_at(askers, at)).cast("int"))
        .withColumn("block", every(F.element_at(blocks, at)))
    )
    right = (
        indexed.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.element_at(blocks, at)).cast("int"))
        .withColumn("q_block", every(F.element_at(askers, at)))
    )

    def rerank(queries: pa.Table, rows: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not rows.num_rows:
            return none
        q, x = _matrix(queries.column("embedding").combine_chunks()), _matrix(rows.column("embedding").combine_chunks())
        q_ids, ids = queries.column("query_id").to_numpy(), rows.column("vec_id").to_numpy()
        norms = (x**2).sum(axis=1)
        by_id = np.argsort(ids, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(ids[by_id]) != 0])
        out = []
        for i in range(len(q)):
            if i % SLICE == 0:
                near = (q[i : i + SLICE] ** 2).sum(axis=1)[:, None] + norms[None] - 2 * q[i : i + SLICE] @ x.T
                near[q_ids[i : i + SLICE, None] == ids[None]] = np.inf
            row = near[i % SLICE]
            if len(heads) > k:
                # all that may be of the k nearest ids, whatever was rounded; distances are then taken anew
                nearest = np.minimum.reduceat(row[by_id], heads) if len(heads) < len(row) else row
                least = np.partition(nearest, k - 1)[k - 1]
                pick = np.flatnonzero(row <= least + 1e-9 * (1 + abs(least)) if np.isfinite(least) else np.isfinite(row))
            else:
                pick = np.flatnonzero(np.isfinite(row))
            exact = np.sqrt(((x[pick] - q[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[pick], exact))
            distinct = order[np.sort(np.unique(ids[pick][order], return_index=True)[1])][:k]
            out.append((np.full(len(distinct), q_ids[i]), ids[pick][distinct], exact[distinct]))
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    keys = ["part", "block", "q_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table, F.col("vec_id") % 100 == 0)
