"""op12: structure repair against enumeration of all edits."""

import hashlib
import itertools
import os
import random
import re
import zlib
from functools import lru_cache

import pyarrow.parquet as pq
import pytest

from lodestone.llm import repair
from lodestone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
INITIAL = {"u": "user", "a": "assistant"}


def is_blank(text):
    return not re.search(r"[^\x20\x09-\x0D]", text)


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit at every place; rows: (role, text, fault)."""

    @lru_cache(None)
    def best(i, place):
        options = [(0, "", ())] if i == len(rows) and place in ("", "a") else []
        if i < len(rows):
            role, text, fault = rows[i]
            extra = int(fault == "truncated")
            options.append(add(3, "D", (), best(i + 1, place)))
            if fault not in ("blank", "duplicate"):
                if role[:1] and after(place, role[0]):
                    options.append(add(extra, "K", ((role, text),), best(i + 1, role[0])))
                for initial, name in INITIAL.items():
                    if after(place, initial):
                        options.append(add(2 + extra, "R", ((name, text),), best(i + 1, initial)))
        return min(o for o in options if o) if any(options) else None

    def after(place, initial):
        return initial in {"": "su", "s": "u", "u": "a", "a": "u"}[place]

    def add(cost, letter, out, rest):
        return rest and (cost + rest[0], letter + rest[1], out + rest[2])

    # inserts cost 2 each, and three in a row lead nowhere that one doesn't: places are opened up to twice at each row
    plain = best

    @lru_cache(None)
    def best(i, place, left=2):  # noqa: F811
        options = [o for o in [plain.__wrapped__(i, place)] if o]
        if left:
            options += [add(2, "I", ((INITIAL[x], ""),), o) for x in "ua" if after(place, x) for o in [best(i, x, left - 1)] if o]
        return min(options, key=lambda o: o[:2]) if options else None

    return best(0, "")


def brute(rows):
    """The contract's columns of one conversation; rows (turn, role, text) in order."""
    seen, faulty, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        fault = ""
        if is_blank(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        faulty.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(tuple(faulty))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


def in_order(rows):
    tie = lambda r: hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why? ", " \n", "", "a b.\t", "x", "é!"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "u2"]
    return {c: [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, 8))] for c in range(n)}


def test_enumerated_edits():
    """The reference of these tests itself, against all choices of edits and up to two inserts in each gap."""
    rng, form = random.Random(7), re.compile("(s?(ua)+)?")
    for _ in range(12):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randrange(3))]
        edits = []
        for role, _, fault in rows:
            extra = int(fault == "truncated")
            keep = [] if fault == "blank" else [("K", extra, role[0]), ("R", 2 + extra, "u"), ("R", 2 + extra, "a")]
            edits.append([("D", 3, ""), *keep])
        gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
        found = []
        for chosen in itertools.product(*edits):
            for filled in itertools.product(gaps, repeat=len(rows) + 1):
                roles = "".join(g + e[2] for g, e in zip(filled, (*chosen, ("", 0, ""))))
                if form.fullmatch(roles):
                    cost = sum(e[1] for e in chosen) + 2 * sum(map(len, filled))
                    found.append((cost, "".join("I" * len(g) + e[0] for g, e in zip(filled, (*chosen, ("", 0, ""))))))
        assert min(found) == cheapest(tuple(rows))[:2]


def test_automaton_is_cheapest_and_small():
    rng, automaton = random.Random(3), repair.Automaton()
    for _ in range(3000):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.choice(["", "", "", "blank", "truncated"])) for _ in range(rng.randrange(12))]
        letters = "".join("d" if f == "blank" else x.upper() if f else x for x, f in ((r[0] if r[0] in "sua" else "x", f) for r, _, f in rows))
        cost, edits, ending = automaton.repair(letters)
        assert (cost, ("".join(edits) + ending).translate(repair.AUDIT)) == cheapest(tuple(rows))[:2]
    assert len(automaton.vectors) < 60


def columns(r):
    return {k: r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}


def test_operator_with_ties_nulls_and_copies(spark):
    convs = conversations(1, 80)
    rows = [(c, *r, "x") for c, own in convs.items() for r in own] + [(None, 1, None, None, "y"), (None, None, "user", "Hm", "z")]
    convs[None] = [(1, " ", " "), (None, "user", "Hm")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string").repartition(5)
    report, repaired = repair.repair(turns)
    shas = {r["conv_id"]: r["sha256"] for r in repair.digests(repaired).collect()}
    found = {r["conv_id"]: r for r in report.collect()}
    assert set(found) == set(convs)
    nothing = hashlib.sha256(b"").hexdigest()
    for c, own in convs.items():
        want = brute(in_order(own))
        assert columns(found[c]) | {"repaired_sha256": shas.get(c, nothing)} == want, c


def test_a_conversation_over_many_partitions(spark, monkeypatch):
    """One conversation holds most rows, a text of it very often, some turns are very long."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    rng = random.Random(5)
    long = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"said {t}.", "the same.", f"cut {t}"])) for t in range(300)]
    copies = [(7, 40, "user", "again.")] * 50
    rows = [*long, *copies, (1, 0, "user", "x" * 300_000), (1, 1, "assistant", "y.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    report, repaired = repair.repair(turns)
    found = {r["conv_id"]: r for r in report.collect()}
    shas = {r["conv_id"]: r["sha256"] for r in repair.digests(repaired).collect()}
    for c in (1, 7):
        assert columns(found[c]) | {"repaired_sha256": shas[c]} == brute(in_order([r[1:] for r in rows if r[0] == c]))


def test_empty_tables(spark):
    report, repaired = repair.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert report.count() == repaired.count() == repair.digests(repaired).count() == 0


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def check_query(spark, folder, rows):
    convs = {}
    for r in damage(rows):
        convs.setdefault(r[0], []).append(r[1:])
    nothing = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    found = {r["conv_id"]: r for r in QUERIES["op12_conversation_repair"](spark, folder).collect()}
    assert set(found) == {r[0] for r in rows}
    for c, r in found.items():
        assert columns(r) | {"repaired_sha256": r["repaired_sha256"]} == (brute(in_order(convs[c])) if c in convs else nothing), c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_on_the_smallest_tables(spark):
    check_query(spark, SF, [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()])


def test_query_with_nulls(spark, tmp_path):
    rng = random.Random(11)
    rows = [(c, t, role, text) for c, own in conversations(2, 60).items() for t, role, text in own]
    rows += [(None, rng.choice([None, 1, 2]), rng.choice([None, "user"]), rng.choice([None, "Yes.", "No"])) for _ in range(12)]
    rows += [(900 + i, i, "user", "Gone.") for i in range(60)]  # some of these are dropped whole
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    check_query(spark, str(tmp_path), rows)
