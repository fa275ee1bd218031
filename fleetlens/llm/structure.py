"""Conversation structure repair (13): the cheapest edits that make roles alternate, by run-length DP.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``.  Edits: K keep (0), R rerole to user
or assistant (2), D delete (3; a blank or duplicate row must go), I insert an empty user or assistant
row (2); a truncated row that stays adds 1.  Of the cheapest edits the ASCII-least audit string wins.

Each row is one of seven symbols (its role's class and fault; rows that must go are one).  Equal
consecutive symbols collapse to a run.  A symbol is a 4 x 4 min-plus matrix over the states "nothing
yet", "after s", "after u", "after a", and a run is a power of it, taken from cached binary powers, so
costs to go are known at every run's end without visiting its rows.  Choices are unrolled from there,
block by block of 2^k rows (a block's choices depend on the symbol, the state and the differences of
the costs to go alone, so they are cached too).

A conversation may lie over many tasks: rows are dealt in order by range, each stretch is one matrix,
the driver multiplies the matrices of cut conversations (two a partition), and each task unrolls its
own stretch.  The faults need no order but that of equal rows: a duplicate is found by an aggregate
over (conversation, role, text) hashes.

Null role or text is one space (so such a text is blank and such a role must be changed).  A null
conversation id is a conversation of its own, a null turn comes first.  Equal turns are ordered by role,
the first 64 characters of the text, then a hash of the text; of equal rows all but one are
duplicates.  A conversation of which no row is left has no audit and no repaired rows.  An empty table
gives no rows.  Texts of any length are whole cells and are never joined but block by block, to be
hashed.  Only the four named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import checkpointed, lean
from fleetlens.llm.stretches import Out, digests, in_order, rows, summaries

# Fixed values of the task: costs, and the white space that words are split at.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INK = r"[^\x20\x09-\x0D]"

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 4
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: The state that each role leads to from each state, where it may follow.
AFTER = {(NOTHING, SYSTEM): SYSTEM, (NOTHING, USER): USER, (SYSTEM, USER): USER, (ASSISTANT, USER): USER, (USER, ASSISTANT): ASSISTANT}
ACCEPTED = (NOTHING, ASSISTANT)
MUST_GO = -1
INF = 1 << 60
#: Rows of the longest block whose choices are cached: 2^BLOCK.
BLOCK = 10

Vector = tuple[int, int, int, int]


def symbol(role: str, fault: str) -> int:
    """One number for what the cost of a row depends on."""
    return MUST_GO if fault in ("blank", "duplicate") else INITIALS.get(role[:1], OTHER) * 2 + (fault == "truncated")


def _written(state: int) -> int:
    """The state after the one role (user or assistant) that may be inserted or reroled to in ``state``."""
    return ASSISTANT if state == USER else USER


def _kept(sym: int, state: int) -> int | None:
    return None if sym == MUST_GO else AFTER.get((state, sym // 2))


def _product(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(min(x + b[k][j] for k, x in enumerate(row)), INF) for j in range(4)) for row in a)


def _times(a: tuple[Vector, ...], v: Vector) -> Vector:
    return tuple(min(min(x + y for x, y in zip(row, v, strict=True)), INF) for row in a)


UNIT = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))


def _inserts() -> tuple[Vector, ...]:
    step = tuple(tuple(0 if i == j else INSERT if j == _written(i) else INF for j in range(4)) for i in range(4))
    return _product(_product(step, step), step)


INSERTS = _inserts()
#: Costs to go when no row is left.
END: Vector = tuple(min(INSERTS[i][j] for j in ACCEPTED) for i in range(4))


@lru_cache(maxsize=None)
def power(sym: int, k: int) -> tuple[Vector, ...]:
    """The transition of 2^k rows of one symbol, inserts before each row included."""
    if k:
        return _product(power(sym, k - 1), power(sym, k - 1))
    extra = 0 if sym == MUST_GO else TRUNCATED * (sym % 2)
    edit = [[INF] * 4 for _ in range(4)]
    for state in range(4):
        edit[state][state] = DELETE
        if sym != MUST_GO:
            to = _written(state)
            edit[state][to] = min(edit[state][to], REROLE + extra)
            if (to := _kept(sym, state)) is not None:
                edit[state][to] = min(edit[state][to], extra)
    return _product(INSERTS, tuple(map(tuple, edit)))


def _run_blocks(length: int) -> list[int]:
    """A run's length as powers of two that a block may have, the largest first."""
    head, rest = divmod(length, 1 << BLOCK)
    return [BLOCK] * head + [k for k in reversed(range(BLOCK)) if rest >> k & 1]


def to_go(runs: list[tuple[int, int]], v: Vector) -> Vector:
    """Costs to go before ``runs`` of (symbol, length), given those after."""
    for sym, length in reversed(runs):
        for k in range(length.bit_length()):
            if length >> k & 1:
                v = _times(power(sym, k), v)
    return v


def matrix(runs: list[tuple[int, int]]) -> tuple[Vector, ...]:
    """The transition of all ``runs``."""
    out = UNIT
    for sym, length in runs:
        for k in range(length.bit_length()):
            if length >> k & 1:
                out = _product(out, power(sym, k))
    return out


def _level(v: Vector) -> Vector:
    low = min(v)
    return tuple(min(x - low, INF) for x in v)


@lru_cache(maxsize=8192)
def _choices(sym: int, k: int, state: int, after: Vector) -> tuple[str, int]:
    """The ASCII-least cheapest letters for 2^k rows of ``sym`` from ``state``, and the state they end in."""
    if k:
        first, state = _choices(sym, k - 1, state, _level(_times(power(sym, k - 1), after)))
        rest, state = _choices(sym, k - 1, state, after)
        return first + rest, state
    before, letters = _times(power(sym, 0), after), ""
    while True:
        left, kept, to = before[state], _kept(sym, state), _written(state)
        extra = 0 if sym == MUST_GO else TRUNCATED * (sym % 2)
        if DELETE + after[state] == left:
            return letters + "D", state
        if INSERT + before[to] == left:
            letters, state = letters + "I", to
        elif kept is not None and extra + after[kept] == left:
            return letters + "K", kept
        else:
            return letters + "R", to


def unroll(runs: list[tuple[int, int]], state: int, after: Vector) -> Iterator[str]:
    """The letters of ``runs`` from ``state``, piece by piece; returns the state they end in."""
    ends, v = [], after
    for sym, length in reversed(runs):
        ends.append(v)
        v = to_go([(sym, length)], v)
    for (sym, length), v in zip(runs, reversed(ends), strict=True):
        blocks, befores = _run_blocks(length), []
        for k in reversed(blocks):
            befores.append(_level(v))
            v = _times(power(sym, k), v)
        for k, v in zip(blocks, reversed(befores), strict=True):
            letters, state = _choices(sym, k, state, v)
            yield letters
    return state


def closing(state: int) -> tuple[str, int]:
    """The letters after the last row, and the final state."""
    letters = ""
    while END[state]:
        letters, state = letters + "I", _written(state)
    return letters, state


def _grown(runs: list[list[int]], sym: int) -> None:
    """``runs`` with one more row of ``sym``."""
    if runs and runs[-1][0] == sym:
        runs[-1][1] += 1
    else:
        runs.append([sym, 1])


def faults(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every row in order: conv_id, turn, role, key (of conversation, role and text), fault, text.

    The fault is blank, duplicate (an equal row has a smaller turn), truncated or empty.  Rows of equal
    key and turn lie side by side and are told apart by the scan.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role, text))
    t = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                     F.monotonically_increasing_id().alias("row"))
    t = t.withColumn("key", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")),
                                                       F.length("role").cast("string"), "role", "text"), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    repeated = t.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("key", "first")
    last = F.regexp_extract("text", f"({INK})[\\x20\\x09-\\x0D]*\\z", 1)
    fault = (F.when(last == "", "blank").when(F.col("first").isNotNull() & (place > F.col("first")), "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated").otherwise(""))
    t = t.join(repeated, "key", "left").select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("start"), "key", "row", fault.alias("fault"), "text")
    return in_order(t, ["conv_id"], ["turn", "role", "start", "key", "row"]).select("conv_id", "turn", "role", "key", "fault", "text")


def _scan(batches: Iterator[pa.RecordBatch], before: tuple | None = None) -> Iterator[tuple]:
    """(conv_id, role, fault, whether the pair with the row before is illegal, place, new group, rest of the row).

    ``before``: conv_id, turn, key and role of the row before the partition's first.
    """
    started = before is not None
    last = before
    for conv, turn, role, key, fault, *rest in rows(batches):
        goes_on = started and last[0] == conv
        if goes_on and fault != "blank" and last[1:3] == (turn, bytes(key)):
            fault = "duplicate"
        illegal = goes_on and last[3][:1] + role[:1] not in LEGAL
        last = (conv, turn, bytes(key), role)
        started = True
        yield conv, role, fault, illegal, last, goes_on, rest


def _summed(batches: Iterator[pa.RecordBatch]) -> tuple | None:
    """What a partition tells: its first row and that row's fault, the matrix of the first group's other
    rows, that of the last group, whether the two are one, and its last row."""
    head = rest = None
    runs: list = []
    out, last = UNIT, None
    for _, role, fault, _, place, goes_on, _ in _scan(batches):
        last = place
        if head is None:
            head = (place, fault)
            continue
        if not goes_on:
            if rest is None:
                rest = _product(out, matrix(runs))
            out, runs = UNIT, []
        _grown(runs, symbol(role, fault))
        if len(runs) > 4096:
            out, runs = _product(out, matrix(runs)), []
    if head is None:
        return None
    end = _product(out, matrix(runs))
    return head, end if rest is None else rest, end, rest is None, last


class _Cut:
    """What each partition must know of the others: the row before it, costs to go after it, the state before it."""

    def __init__(self, ordered: DataFrame):
        self.found = found = summaries(ordered, _summed)
        order = sorted(found)
        self.before = {p: found[q][4] for q, p in zip(order, order[1:], strict=False)}
        self.goes_on = {p for p in order if p in self.before and self.before[p][0] == found[p][0][0][0]}
        self.after, ahead = {}, None
        for p in reversed(order):
            (place, fault), rest, _, single, last = found[p]
            self.after[p] = ahead[1] if ahead and ahead[0] == last[0] and ahead[2] else END
            if p in self.goes_on and fault != "blank" and self.before[p][1:3] == place[1:3]:
                fault = "duplicate"
            costs = _times(_product(power(symbol(place[3], fault), 0), rest), self.after[p] if single else END)
            ahead = (place[0], costs, p in self.goes_on)
        self.start = self._states(ordered, order)

    def _states(self, ordered: DataFrame, order: list[int]) -> dict[int, int]:
        """The state that the first group of a partition starts in, where it goes on from the one before."""
        if not self.goes_on:
            return {}
        before, after = self.before, self.after
        wanted = {q for q, p in zip(order, order[1:], strict=False) if p in self.goes_on}

        def run(batches: Iterator[pa.RecordBatch]) -> tuple | None:
            p = TaskContext.get().partitionId()
            if p not in wanted:
                return None
            runs: list = []
            for _, role, fault, _, _, goes_on, _ in _scan(batches, before.get(p)):
                if not goes_on:
                    runs = []
                _grown(runs, symbol(role, fault))
            return tuple(_drained(unroll(runs, state, after[p])) for state in range(4))

        ends, start = summaries(ordered, run), {}
        for q, p in zip(order, order[1:], strict=False):
            if p in self.goes_on:
                alone = self.found[q][3]
                start[p] = ends[q][start.get(q, NOTHING) if alone else NOTHING]
        return start


def _drained(letters: Iterator[str]) -> int:
    """The state that ``unroll`` ends in."""
    while True:
        try:
            next(letters)
        except StopIteration as end:
            return end.value


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The audit as rows, in order: conv_id, edit (initial), fault, illegal (the pair with the row before), cost,
    written_role and written_text of the repaired row (null if deleted).  Inserted rows have no fault."""
    ordered = faults(turns, conv_id, turn, role, text)
    cut = _Cut(ordered.select("conv_id", "turn", "role", "key", "fault"))
    before, after, start, goes_on = cut.before, cut.after, cut.start, cut.goes_on
    later = {q for q, p in zip(sorted(cut.found), sorted(cut.found)[1:], strict=False) if p in goes_on}
    schema = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("fault", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()),
                        ("written_role", pa.string()), ("written_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, out = TaskContext.get().partitionId(), Out(schema)
        held: list = []
        runs: list = []

        def written(conv, state: int, costs: Vector, ends: bool) -> Iterator[pa.RecordBatch]:
            at = iter(held)
            for letters in (*unroll(runs, state, costs), ""):
                for edit in letters:
                    if edit == "I":
                        state = _written(state)
                        yield from out.add((conv, edit, "", 0, INSERT, NAMES[state], ""))
                        continue
                    role, fault, illegal, text = next(at)
                    extra = TRUNCATED * (fault == "truncated")
                    if edit == "D":
                        yield from out.add((conv, edit, fault, illegal, DELETE, None, None))
                    elif edit == "K":
                        state = _kept(symbol(role, fault), state)
                        yield from out.add((conv, edit, fault, illegal, extra, role, text), len(text))
                    else:
                        state = _written(state)
                        yield from out.add((conv, edit, fault, illegal, REROLE + extra, NAMES[state], text), len(text))
            if ends:
                for edit in closing(state)[0]:
                    state = _written(state)
                    yield from out.add((conv, edit, "", 0, INSERT, NAMES[state], ""))

        now, state, any_row = None, start.get(p, NOTHING), False
        for conv, role, fault, illegal, _, along, (text,) in _scan(batches, before.get(p)):
            if any_row and not along:
                yield from written(now, state, END, True)
                held, runs, state = [], [], NOTHING
            now, any_row = conv, True
            held.append((role, fault, int(illegal), text))
            _grown(runs, symbol(role, fault))
        if any_row:
            yield from written(now, state, after[p], p not in later)
        yield from out.flush()

    kinds = "conv_id long, edit string, fault string, illegal long, cost long, written_role string, written_text string"
    return ordered.mapInArrow(lean(run), kinds)


def repaired(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    edits = checkpointed(repair(turns, conv_id, turn, role, text))
    count = lambda fault: F.sum((F.col("fault") == fault).cast("long")).alias(fault)
    sums = edits.groupBy("conv_id").agg(count("blank"), count("duplicate"), count("truncated"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    lines = edits.select("conv_id", "edit", F.concat_ws(":", "written_role", "written_text").alias("line"), "written_role")
    lines = lines.select("conv_id", "edit", F.when(F.col("written_role").isNotNull(), F.col("line")).alias("line"))
    hashed = digests(lines, ["conv_id"], "line", "edit", "\n")
    same = sums["conv_id"].eqNullSafe(hashed["conv_id"])
    return sums.join(hashed, same).select(sums["*"], hashed["marks"].alias("audit"), hashed["sha256"].alias("repaired_sha256"))


def damaged(convs: DataFrame) -> DataFrame:
    """The rows of ``conversations`` damaged by crc32(conv_id:turn) mod 20: 0 drops a row, 1 empties its text,
    2 removes its sentence ends, 3 repeats it, 4 makes it the user's.  Nulls are written as one space."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    at = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    kind = F.crc32(at.cast("binary")) % 20
    t = convs.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    t = t.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                 F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                 F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return t.drop("copy")


def gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers that are missing between a conversation's first and last."""
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0).cast("long")).alias("gaps"))
