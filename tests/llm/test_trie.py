"""Conversation prefix trie against a version that rebuilds every text."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from fleetlens.llm import catalog, trie

SCHEMA = "conv_id long, turn long, role string, text string, base long, depth long, f1 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c in seqs:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = seqs.get(c - c % 20, [])[:h] + seqs[c][h:]
    members = collections.defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(m) - 1) * len(WORD.findall(n[-1][1])) if n else 0
    ends = {n: ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(n)) for n, m in members.items()}
    return sorted(map(str, ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
                             hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items())))


def got(spark, rows, n=None):
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    if n:
        frame = frame.repartition(n)
    found = trie.prefix_trie(frame, lambda c: c - c % 20, lambda c: trie.crc32_text(c) % 4)
    return sorted(map(str, (tuple(r) for r in found.collect())))


def made(rng, ids, long=0):
    texts = ["a b", "a b c", "", None, " \t ", "é ü", "x" * 70 + " 1", "x" * 70 + " 2", "yes. no? " * 3]
    rows = []
    for c in ids:
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(ids[0], t, "user", f"turn {t % 7}") for t in range(long)]
    return rows + rows[:5]


def test_equals_brute_force_with_a_hot_conversation_and_dirty_rows(spark):
    rng = random.Random(5)
    rows = made(rng, list(range(100, 160)) + [5, 7, 2**40], long=400)      # no conversation 0: its block has no head
    rows += [(None, 1, "user", "no id"), (141, 0, "user", "word " * 30000)]
    rng.shuffle(rows)
    assert got(spark, rows, 3) == slow(rows)


def test_one_conversation_alone_and_copies_of_one(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(40) for t in range(4)]
    assert got(spark, rows) == slow(rows)
    rows = [(20, t, "user", "same") for t in range(50)]
    assert got(spark, rows) == slow(rows)


def test_many_ends_of_one_node_are_hashed_block_by_block(spark, monkeypatch):
    from fleetlens.llm import stretches

    monkeypatch.setattr(stretches, "BLOCK", 64)
    rows = [(c, t, "user", f"t{t}") for c in range(20, 300) for t in range(3)]
    assert got(spark, rows) == slow(rows)


def test_a_colliding_hash_is_found_and_computed_anew(spark, monkeypatch):
    seen = []
    real = trie._turns

    def colliding(convs, seed, names):
        seen.append(seed)
        out = real(convs, seed, names)
        return out if seed else out.withColumn("t1", out.t1 % 2).withColumn("t2", out.t2 % 1)

    monkeypatch.setattr(trie, "_turns", colliding)
    rows = made(random.Random(8), list(range(40, 60)))
    assert got(spark, rows) == slow(rows) and seen == [0, 1]


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = [tuple(r) for r in catalog.QUERIES["op11_conversation_trie"](spark, f"/root/testdata/{sf}").collect()]
    assert sorted(map(str, found)) == slow(rows)
