"""Conversation prefix trie (11): composable fingerprints of turn sequences, conversations rebuilt symbolically.

A conversation is rebuilt from the first ``head`` turns of a base conversation and its own turns after
its first ``head``.  Nothing is rebuilt as text.  The fingerprint of a sequence is the composition of
its turns' maps x -> a x + t modulo 2^61 - 1 (an associative product with an identity, taken with two
multipliers at once), so with Q_c[i] the product of c's first i turns, the rebuilt prefix that ends at
c's own turn i is Q_c[i] + (Q_b[k] - Q_c[h]) a^(i - h): one number a conversation joins the base's head
to the own suffix.  Prefix products come from one scan over the turns in order, in which a long
conversation is cut into stretches (``stretches``) whose products compose.

A row (conversation, depth, fingerprint, turn reference) stands for a rebuilt prefix.  Equal
(depth, fingerprint) make a node.  Equality is verified, not assumed: a turn reference (128 bits of a
turn's role and text) must name one role and text in the whole table, and all rows of a node must have
one turn reference and one parent; then equal nodes are equal sequences, by induction over the depth.
Should any differ, everything is computed again with other hashes.

Sums over subtrees need no walk by levels: the conversation with the smallest id in a node has it in
every node below it on its own path, so the nodes a conversation stands for are the deepest ones of its
path.  What a conversation's own nodes add up to counts for every node that it is a member of, less
what lies above that node.

Null role or text is empty.  Equal turn numbers are ordered by role, the first 64 characters of the
text, then a hash of the text; repeated rows stay as repeated turns.  Rows with a null conversation
id take no part.  A base that is absent gives no head; a conversation may be left without a turn and is
then a member of the root alone.  Very long texts are hashed and counted by the JVM, one row at a time.
An empty table gives no node, not even a root.  Only the four named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import checkpointed, lean
from fleetlens.llm.stretches import Out, digests, in_order, rows, summaries

PRIME = (1 << 61) - 1
MULTIPLIERS = (0x1C9E6A5B3D2F4871 % PRIME, 0x0B7D51E8C3A6F293 % PRIME)
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "f1", "f2"]
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def crc32_text(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def _turns(convs: DataFrame, seed: int, names: dict[str, str]) -> DataFrame:
    """Every turn in order, with its reference (t1, t2) and its number of words."""
    role, text = (F.coalesce(F.col(names[c]), F.lit("")) for c in ("role", "text"))
    turns = convs.where(F.col(names["conv_id"]).isNotNull()).select(
        F.col(names["conv_id"]).cast("long").alias("conv_id"), F.col(names["turn"]).alias("turn"), role.alias("role"), text.alias("text"))
    turns = turns.select("*", F.substring("text", 1, 64).alias("start"), F.xxhash64("text").alias("rest"), F.monotonically_increasing_id().alias("row"))
    turns = in_order(turns, ["conv_id"], ["turn", "role", "start", "rest", "row"])
    return turns.select("conv_id", "role", "text", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
                        F.xxhash64(F.lit(2 * seed), "role", "text").alias("t1"),
                        F.xxhash64(F.lit(2 * seed + 1), "text", "role").alias("t2"))


def compose(left: tuple[int, int], right: tuple[int, int], power: tuple[int, int]) -> tuple[int, int]:
    """The product of two sequences, given a^(length of the right one)."""
    return tuple((x * a + y) % PRIME for x, y, a in zip(left, right, power, strict=True))


def _product(batches: Iterator[pa.RecordBatch]) -> tuple | None:
    """(first group, last group, only one group): a group is (conv_id, turns, product) of its stretch here."""
    a1, a2 = MULTIPLIERS
    first = now = None
    n = x = y = 0
    for conv, t1, t2 in rows(batches):
        if conv != now:
            if now is not None and first is None:
                first = (now, n, (x, y))
            now, n, x, y = conv, 0, 0, 0
        n, x, y = n + 1, (x * a1 + t1) % PRIME, (y * a2 + t2) % PRIME
    return None if now is None else (first or (now, n, (x, y)), (now, n, (x, y)), first is None)


def _before(found: dict[int, tuple]) -> dict[int, tuple]:
    """For each partition what its first group has in the partitions before: (conv_id, turns, product)."""
    out, carry = {}, None
    for p in sorted(found):
        first, last, single = found[p]
        if carry is not None and carry[0] == first[0]:
            out[p] = carry
            if single:
                power = tuple(pow(a, first[1], PRIME) for a in MULTIPLIERS)
                last = (first[0], carry[1] + first[1], compose(carry[2], first[2], power))
        carry = last
    return out


def _products(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, words, t1, t2, product to here, product to the turn before)."""
    keyed = turns.select("conv_id", "t1", "t2")
    before = _before(summaries(keyed, _product))
    schema = pa.schema([(c, pa.int64()) for c in ("conv_id", "pos", "words", "t1", "t2", "v1", "v2", "u1", "u2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a1, a2 = MULTIPLIERS
        out, now = Out(schema), None
        for conv, words, t1, t2 in rows(batches):
            if conv != now:
                carry = before.get(TaskContext.get().partitionId()) if now is None else None
                now, (n, (x, y)) = conv, carry[1:] if carry else (0, (0, 0))
            u, v = x, y
            n, x, y = n + 1, (x * a1 + t1) % PRIME, (y * a2 + t2) % PRIME
            yield from out.add((conv, n, words, t1, t2, x, y, u, v))
        yield from out.flush()

    return turns.select("conv_id", "words", "t1", "t2").mapInArrow(lean(run), ", ".join(f"{f.name} long" for f in schema))


def _prefixes(products: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column]) -> DataFrame:
    """(conv_id, depth, f1, f2, p1, p2 of the parent, turn reference, words, ends): one row a rebuilt prefix, the root included."""
    c = F.col("conv_id")
    convs = products.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = checkpointed(convs.select(c, "n", base(c).alias("base"), head(c).cast("long").alias("head")))
    bases = convs.select(c.alias("base"), F.col("n").alias("base_n"))
    at = lambda conv, pos, a, b: products.select(c.alias(conv), F.col("pos").alias(pos), F.col("v1").alias(a), F.col("v2").alias(b))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("head", F.coalesce("base_n", F.lit(0))))
    convs = convs.join(at("base", "k", "b1", "b2"), ["base", "k"], "left").join(at("conv_id", "head", "c1", "c2"), ["conv_id", "head"], "left")
    zero = {x: F.coalesce(x, F.lit(0).cast("long")) for x in ("b1", "b2", "c1", "c2")}
    convs = checkpointed(convs.select("conv_id", "base", "k", "head", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("head"))).alias("total"),
                                      *(v.alias(k) for k, v in zero.items())))

    heads = convs.where("k > 0").select(c, F.col("base").alias("of"), "total", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("depth"))
    of = products.select(c.alias("of"), F.col("pos").alias("depth"), "words", "t1", "t2", "v1", "v2", "u1", "u2")
    heads = heads.join(of, ["of", "depth"]).select(
        "conv_id", "depth", "words", "t1", "t2", F.col("v1").alias("f1"), F.col("v2").alias("f2"),
        F.col("u1").alias("p1"), F.col("u2").alias("p2"), (F.col("depth") == F.col("total")).alias("ends"))

    own = products.join(convs, "conv_id").where("pos > head").select(
        "conv_id", (F.col("k") + F.col("pos") - F.col("head")).alias("depth"), "words", "t1", "t2", "v1", "v2", "u1", "u2",
        (F.col("pos") - F.col("head")).alias("after"), "b1", "b2", "c1", "c2", (F.col("k") + F.col("pos") - F.col("head") == F.col("total")).alias("ends"))
    schema = pa.schema([*((x, pa.int64()) for x in ("conv_id", "depth", "words", "t1", "t2", "f1", "f2", "p1", "p2")), ("ends", pa.bool_())])

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for conv, depth, words, t1, t2, v1, v2, u1, u2, after, b1, b2, c1, c2, ends in rows(batches):
            moved = []
            for a, b, x, v, u in zip(MULTIPLIERS, (b1, b2), (c1, c2), (v1, v2), (u1, u2), strict=True):
                less = (b - x) * pow(a, after - 1, PRIME)      # the base's head in place of the own one
                moved.append(((v + less * a) % PRIME, (u + less) % PRIME))
            (f1, p1), (f2, p2) = moved
            yield from out.add((conv, depth, words, t1, t2, f1, f2, p1, p2, ends))
        yield from out.flush()

    own = own.mapInArrow(lean(shifted), ", ".join(f"{f.name} {'boolean' if f.name == 'ends' else 'long'}" for f in schema))
    none, nil = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = convs.select("conv_id", nil.alias("depth"), nil.alias("words"), none.alias("t1"), none.alias("t2"), nil.alias("f1"), nil.alias("f2"),
                        none.alias("p1"), none.alias("p2"), (F.col("total") == 0).alias("ends"))
    return checkpointed(root.unionByName(heads).unionByName(own))


def _nodes(turns: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, bool]:
    """The nodes, and whether every node is one sequence of turns and every turn reference one turn."""
    proof = ("p1", "p2", "t1", "t2")
    found = prefixes.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        *(F.min(x).alias(x) for x in proof), *(F.max(x).alias(f"high_{x}") for x in proof))
    found = checkpointed(found)
    mixed = found.where(" OR ".join(f"{x} <> high_{x}" for x in proof))
    named = turns.groupBy("t1", "t2").agg(F.min("role").alias("a"), F.max("role").alias("b"), F.min("text").alias("c"), F.max("text").alias("d"))
    sound = mixed.isEmpty() and named.where("a <> b OR c <> d").isEmpty()
    return found.select(*NODE, "n_convs", "conv_id", "words", "p1", "p2"), sound


def _sums_above(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``above``: what the conversation's own nodes above this one add up to."""
    ordered = in_order(nodes, ["conv_id"], ["depth"])

    def summed(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        first = now = None
        for conv, value in rows(batches):
            if conv != now:
                if now is not None and first is None:
                    first = (now, total)
                now, total = conv, 0
            total += value
        return None if now is None else (first or (now, total), (now, total), first is None)

    before, carry = {}, None
    found = summaries(ordered.select("conv_id", "value"), summed)
    for p in sorted(found):
        first, last, single = found[p]
        if carry is not None and carry[0] == first[0]:
            before[p] = carry[1]
            if single:
                last = (first[0], carry[1] + first[1])
        carry = last
    schema = pa.schema([(x, pa.int64()) for x in (*NODE, "above")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = Out(schema), None
        for conv, value, *node in rows(batches):
            if conv != now:
                total = before.get(TaskContext.get().partitionId(), 0) if now is None else 0
                now = conv
            yield from out.add((*node, total))
            total += value
        yield from out.flush()

    return ordered.select("conv_id", "value", *NODE).mapInArrow(lean(run), ", ".join(f"{f.name} long" for f in schema))


def prefix_trie(convs: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column],
                conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``base`` and ``head`` give, from a conversation's id, the conversation its head is taken from and the
    number of turns taken.
    """
    names = {"conv_id": conv_id, "turn": turn, "role": role, "text": text}
    seed = 0
    while True:
        turns = _turns(convs, seed, names)
        prefixes = _prefixes(checkpointed(_products(turns)), base, head)
        nodes, sound = _nodes(turns, prefixes)
        if sound:
            break
        seed += 1

    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")]
    children = nodes.where("depth > 0").select(*up).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    value = (F.col("n_convs") - 1) * F.col("words")
    nodes = checkpointed(nodes.join(children, NODE, "left").select(
        *NODE, "conv_id", "n_convs", "p1", "p2", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), value.alias("value")))
    own = nodes.groupBy("conv_id").agg(F.sum("value").alias("all"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    sums = prefixes.select("conv_id", *NODE).join(own, "conv_id").groupBy(*NODE).agg(
        F.sum("all").alias("all"), F.sum("leaves").alias("n_leaves"))
    ends = prefixes.where("ends").select(*NODE, "conv_id")
    ends = in_order(ends, NODE, ["conv_id"]).select(*NODE, F.col("conv_id").cast("string").alias("id"), F.lit("").alias("mark"))
    ends = digests(ends, NODE, "id", "mark", ",").select(*NODE, "sha256")
    parents = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.where("depth > 0").select(F.col("depth").alias("of_depth"), F.col("f1").alias("of_f1"), F.col("f2").alias("of_f2"), *up)
    linked = linked.join(parents, NODE).select(F.col("of_depth").alias("depth"), F.col("of_f1").alias("f1"), F.col("of_f2").alias("f2"), "parent_conv_id")
    return (nodes.join(sums, NODE).join(_sums_above(nodes), NODE).join(ends, NODE, "left").join(linked, NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    (F.col("all") - F.col("above")).alias("saved_tokens"), F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")))
