"""Repair of conversations' structure by a weighted automaton, made deterministic as far as conversations need it.

The edits of a row (keep, give another role, delete, insert before it) are weighted arcs between the four places in
`(s?(ua)+)?`. What a conversation's rest costs from each of these places is a vector; with its least cost taken out it is a state
of a deterministic automaton read from the last row to the first. Such states and their steps are made when first met and kept in
a table, so that a row costs a look-up. From the first row on, the arcs whose cost is exactly the difference of two vectors
(tight arcs) are followed, the least letter first: the cheapest edits that come first in ASCII order.

Equal rows of a turn are one row with a number; faults are found by Spark, and what Python reads of a row is one letter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.session import cut, prepare, spread_join

#: White space at a text's ends.
BLANKS = " \t\n\x0b\x0c\r"
#: What a sentence ends with.
STOPS = ".!?"
ADJACENT = {"su", "ua", "au"}
# Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Places in (s?(ua)+)?: before anything, behind s, behind u, behind a. Where an initial leads, and the one that is put in.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
PUT = (USER, USER, ASSISTANT, USER)
#: Letters of edits within this module: inserted user and assistant, roles changed to them; K and D.
INSERTED, REROLED = {USER: "i", ASSISTANT: "j"}, {USER: "r", ASSISTANT: "t"}
AUDIT = str.maketrans("ijrt", "IIRR")
#: What is added at the end from each place.
ENDING, ENDING_COST = ("", "ij", "j", ""), (0, 2 * INSERT, INSERT, 0)
#: Rows of a partition (a power of two) whose letters are put together.
BLOCK_BITS = 10


class Automaton:
    """States are normalised vectors of costs. A row is a letter: d must go; s, u, a, x (any other initial), in capitals if truncated."""

    def __init__(self) -> None:
        self.number = {ENDING_COST: 0}
        self.vectors = [ENDING_COST]
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.arcs: dict[tuple[int, str, int], tuple[str, int]] = {}

    def step(self, state: int, row: str) -> tuple[int, int]:
        """(cost, state) in front of a row, by the state behind it."""
        found = self.steps[state].get(row)
        if found is None:
            ahead = self.vectors[state]
            costs = [min(cost + ahead[to] for _, cost, to in self.edits(row, place)) for place in range(4)]
            for _ in range(4):  # inserts, one after the other
                costs = [min(c, INSERT + costs[PUT[place]]) for place, c in enumerate(costs)]
            least = min(costs)
            vector = tuple(c - least for c in costs)
            if vector not in self.number:
                self.number[vector] = len(self.vectors)
                self.vectors.append(vector)
                self.steps.append({})
            found = self.steps[state][row] = least, self.number[vector]
        return found

    @staticmethod
    def edits(row: str, place: int) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, next place) of the edits that use up the row, in the letters' order."""
        yield "D", DELETE, place
        if row != "d":
            extra = TRUNCATED if row.isupper() else 0
            if row.lower() in LEADS[place]:
                yield "K", extra, LEADS[place][row.lower()]
            yield REROLED[PUT[place]], REROLE + extra, PUT[place]

    def tight(self, state: int, row: str, place: int) -> tuple[str, int]:
        """The edits before and of a row, and the next place; `state` is that behind the row."""
        key = state, row, place
        found = self.arcs.get(key)
        if found is None:
            weight, before = self.step(state, row)
            here, ahead, at, said = self.vectors[before], self.vectors[state], place, ""
            while True:
                arcs = {letter.translate(AUDIT): (letter, to) for letter, cost, to in self.edits(row, at) if cost + ahead[to] == weight + here[at]}
                if "D" not in arcs and INSERT + here[PUT[at]] == here[at]:
                    at = PUT[at]
                    said += INSERTED[at]
                    continue
                letter, to = arcs[min(arcs)]
                found = self.arcs[key] = said + letter, to
                break
        return found

    def repair(self, rows: str) -> tuple[int, list[str], str]:
        """(cost, edits of each row, edits behind the last)."""
        if not rows:
            return 0, [], ""
        cost, state, behind = 0, 0, []
        for row in reversed(rows):
            behind.append(state)
            weight, state = self.step(state, row)
            cost += weight
        cost += self.vectors[state][START]
        edits, place = [], START
        for row, state in zip(rows, reversed(behind)):
            said, place = self.tight(state, row, place)
            edits.append(said)
        return cost, edits, ENDING[place]


def faults(turns: DataFrame) -> DataFrame:
    """One row for each (conv_id, turn, role, text) with `copies`, how many rows are like it, `initial`, `blank`, `repeated` (role and
    text stand earlier in the conversation) and `truncated`; of copies all but the first are repeated as well."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    tie = F.md5(F.concat_ws("\0", "role", "text").cast("binary"))
    rows = cut(rows.withColumns({"tie": tie, "key": F.xxhash64(F.col("conv_id").isNull(), "conv_id", tie)}), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    firsts = rows.groupBy("key", "tie").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    rows = spread_join(rows, firsts, ["key", "tie"], ["first"], F.xxhash64("turn"))
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    blank, repeated = bare == "", place != F.col("first")
    return rows.select(
        "conv_id", "turn", "tie", "role", "text", "copies", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), blank.alias("blank"),
        (~blank & repeated).alias("repeated"), (~blank & ~repeated & ~F.substring(bare, -1, 1).isin(*STOPS)).alias("truncated"),
    )


def _letter():
    return F.when(F.col("blank") | F.col("repeated"), "d").when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))


def _illegal(initials: str, copies: list[int]) -> int:
    return sum(a + b not in ADJACENT for a, b in zip(initials, initials[1:])) + sum(copies) - len(copies)


def _repaired(blocks: DataFrame) -> DataFrame:
    """Of blocks of letters sorted by conversation and place: each block's edits, and in a conversation's first block what is told of it."""
    told = [T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("audit", T.StringType())]
    schema = T.StructType([blocks.schema["conv_id"], T.StructField("at", T.LongType()), T.StructField("edits", T.ArrayType(T.StringType())), *told])

    def finish(automaton: Automaton, conv, parts: list[dict]) -> list[dict]:
        rows = "".join(p["letters"] for p in parts)
        copies = [n for p in parts for n in p["copies"]]
        cost, edits, ending = automaton.repair(rows)
        audit = "".join(e + "D" * (n - 1) for e, n in zip(edits, copies)) + ending
        told = {"cost": cost + DELETE * (sum(copies) - len(copies)), "illegal": _illegal("".join(p["initials"] for p in parts), copies), "audit": audit.translate(AUDIT)}
        edits[-1] += ending
        out, done = [], 0
        for p in parts:
            out.append({"conv_id": conv, "at": p["at"], "edits": edits[done : done + len(p["letters"])], **(told if not done else {})})
            done += len(p["letters"])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, parts, kind = Automaton(), [], None
        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type
            for p in batch.to_pylist():
                if parts and parts[0]["conv_id"] != p["conv_id"]:
                    out += finish(automaton, parts[0]["conv_id"], parts)
                    parts = []
                parts.append(p)
            yield packed(out, kind)
        if parts:
            yield packed(finish(automaton, parts[0]["conv_id"], parts), kind)

    def packed(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        kinds = {"conv_id": kind, "at": pa.int64(), "edits": pa.list_(pa.string()), "cost": pa.int64(), "illegal": pa.int64(), "audit": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()], list(kinds))

    return blocks.mapInArrow(run, schema)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of turns (conv_id, turn, role, text).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation that has rows. repaired: the turns
    after the cheapest edits (conv_id, place, role, text), `place` a struct that sorts within a conversation.

    Rows stand by turn, those without one first; rows of one turn by a hash of role and text, so that equal rows stand together.
    Null roles and texts count as one space; a null conv_id is a conversation like others. Other columns are not read. An empty
    table gives empty results. Conversations are split over tasks by turn; of a conversation one task reads a letter and a
    number for each distinct row, as its audit is one string.
    """
    prepare(turns.sparkSession)
    placed = cut(faults(turns), "faults")
    placed = placed.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "tie").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "tie")
    placed = cut(placed.withColumn("at", F.monotonically_increasing_id()), "placed")
    each = placed.select("conv_id", F.shiftright("at", BLOCK_BITS).alias("block"), F.struct("at", _letter().alias("letter"), "initial", "copies").alias("row"))
    joined = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "").alias(f"{c}s")
    blocks = each.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    blocks = blocks.select("conv_id", "block", F.col("rows")[0]["at"].alias("at"), joined("letter"), joined("initial"), F.transform("rows", lambda r: r["copies"]).alias("copies"))
    found = cut(_repaired(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")), "edits")
    total = lambda c, n: F.sum(F.when(c, n).otherwise(0))
    more = F.col("copies") - 1
    counts = placed.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), total(F.col("blank"), F.col("copies")).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("repeated"), F.col("copies")).otherwise(more)).alias("duplicate"), total(F.col("truncated"), F.lit(1)).alias("truncated"),
    )
    report = counts.unionByName(found.where("audit is not null").select("conv_id", "cost", "illegal", "audit"), True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    report = report.groupBy("conv_id").agg(*[F.max(c).cast("long").alias(c) for c in numbers], F.max("audit").alias("audit"))
    return report, _turns(placed, found)


def _turns(placed: DataFrame, found: DataFrame) -> DataFrame:
    edits = found.select(F.posexplode("edits").alias("i", "said"), "at").select((F.col("at") + F.col("i")).alias("at"), "said").where("said <> 'D'")
    both = placed.select("conv_id", "at", "role", "text").join(edits, "at")
    made = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    user, assistant, nothing = F.lit("user"), F.lit("assistant"), F.lit("")

    def turn(c):
        text = F.when(c.isin("i", "j"), nothing).otherwise(F.col("text"))
        return F.when(c.isin("i", "r"), made(user, text)).when(c.isin("j", "t"), made(assistant, text)).when(c == "K", made(F.col("role"), text))

    rows = both.select("conv_id", "at", F.posexplode(F.transform(F.split("said", ""), turn)).alias("k", "turn")).where("turn is not null")
    return rows.select("conv_id", F.struct("at", "k").alias("place"), "turn.role", "turn.text")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each conversation's `role:text`, joined by line feeds. A conversation's rows stream through one task in
    order, as one hash can't be split; nothing of them is kept."""
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nobody = object()
        now, state, kind = nobody, None, None
        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for conv, said in zip(batch.column("conv_id").to_pylist(), batch.column("said").to_pylist()):
                if conv != now:
                    if now is not nobody:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(said.encode())
                else:
                    state.update(b"\n" + said.encode())
            yield packed(done, kind)
        if now is not nobody:
            yield packed([(now, state.hexdigest())], kind)

    def packed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], schema.names)

    said = repaired.select("conv_id", F.concat("role", F.lit(":"), "text").alias("said"), "place").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return said.select("conv_id", "said").mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of `conv_id:turn` modulo 20 deals out; nulls become a space, but for ids and turns."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", given("role").alias("role"), given("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("twice", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("twice", "kind")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report, repaired = repair(damaged(turns))
    parts = turns.select("conv_id").distinct().unionByName(report, True).unionByName(digests(repaired), True)
    numbers = [c for c, kind in report.dtypes if kind == "bigint" and c != "conv_id"]
    nothing = hashlib.sha256(b"").hexdigest()
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.lit(nothing)).alias("repaired_sha256"),
    )
