"""Conversation structure repair against a shortest-path search over audit strings."""

import collections
import hashlib
import heapq
import random
import re
import zlib

from fleetlens.llm import catalog, structure

SPACE = " \t\n\x0b\x0c\r"
FOLLOWS = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}


def cheapest(rows):
    """(cost, audit, repaired [(role, row or None)]) of rows (role, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in seen:
            continue
        seen.add((i, state))
        written = [r for r in ("user", "assistant") if (state, r[0]) in FOLLOWS]
        for r in written:
            heapq.heappush(heap, (cost + 2, audit + "I", i, r[0], (*out, (r, None))))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in FOLLOWS:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, i))))
                for r in written:
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, r[0], (*out, (r, i))))


def slow(rows, damage=True):
    convs, ids = collections.defaultdict(list), set()
    for c, t, role, text, *_ in rows:
        ids.add(c)
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[c] += [(t is not None, t or 0, "user" if kind == 4 else role, text, t)] * (2 if kind == 3 else 1)
    out = []
    for c in ids:
        # equal turns: by role, the start of the text, then a hash, which this test avoids
        rows_, seen, faults = sorted(convs[c], key=lambda x: x[:4]), set(), []
        for _, _, role, text, _ in rows_:
            ink = text.strip(SPACE)
            faults.append((role, "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [x[4] for x in rows_ if x[4] is not None]
        cost, audit, repaired = cheapest(faults)
        text = "\n".join(f"{role}:{'' if i is None else rows_[i][3]}" for role, i in repaired)
        n = collections.Counter(f for _, f in faults)
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:])), cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


def whole(spark, path):
    return sorted(map(str, (tuple(r) for r in catalog.QUERIES["op13_structure_repair"](spark, path).collect())))


def saved(spark, rows, scratch):
    schema = "conv_id long, turn long, role string, text string, row long, start string, key long"
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema).repartition(3).write.parquet(f"{scratch}/conversations.parquet")
    return scratch


def made(rng, ids, n):
    texts = ["Yes.", "No", "Why?", "", " \n", None, "é!", "Go on. ", "x" * 70 + ".", "y" * 70]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]
    return [(rng.choice(ids), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_equals_search_with_dirty_rows_and_a_hot_conversation(spark, scratch):
    rng = random.Random(2)
    rows = made(rng, [*range(60), None], 500)
    rows += [(7, t, ("user", "assistant")[t % 2 if t % 11 else 1], f"Text {t}." if t % 5 else "Same.") for t in range(300)]
    rows += [(900, 3, "user", "one"), (901, None, None, None), (7, 70, "user", "long " * 30000 + ".")]
    assert whole(spark, saved(spark, rows, scratch)) == slow(rows)


def test_long_runs_of_one_symbol(spark, scratch):
    rows = [(1, t, "user", f"Ask {t}.") for t in range(700)] + [(2, t, "tool", f"cut {t}") for t in range(90)]
    rows += [(3, t, "assistant", "") for t in range(500)] + [(4, 1, "user", "Same.")] * 400
    assert whole(spark, saved(spark, rows, scratch)) == slow(rows)


def test_runs_equal_search_over_random_symbols():
    rng = random.Random(4)
    for _ in range(400):
        rows = []
        for _ in range(rng.randint(0, 5)):
            rows += [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "", "truncated", "blank"]))] * rng.choice([1, 1, 2, 9])
        runs = []
        for r in rows:
            structure._grown(runs, structure.symbol(*r))
        cost, audit, _ = cheapest(rows)
        letters, state = "", structure.NOTHING
        pieces = structure.unroll(runs, state, structure.END)
        while True:
            try:
                letters += next(pieces)
            except StopIteration as end:
                state = end.value
                break
        assert letters + structure.closing(state)[0] == audit
        assert structure.to_go(runs, structure.END)[structure.NOTHING] == cost
        assert structure._times(structure.matrix(runs), structure.END) == structure.to_go(runs, structure.END)


def test_repair_gives_the_rows(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "cut")], "conv_id long, turn long, role string, text string")
    rows = [tuple(r) for r in structure.repair(frame).collect()]
    assert rows == [(1, "K", "", 0, 0, "user", "Hi."), (1, "D", "duplicate", 1, 3, None, None), (1, "R", "truncated", 1, 3, "assistant", "cut")]


def test_empty_table_and_a_conversation_that_loses_all_rows(spark, scratch):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone.")]
    got = whole(spark, saved(spark, rows, scratch + "/a"))
    assert got == slow(rows) and "''" in got[0]
    assert whole(spark, saved(spark, [], scratch + "/b")) == []


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert whole(spark, path) == slow(rows)
