"""Conversation structure repair: the cheapest edits that give alternating turns, by a Viterbi search that emits while it reads.

Rows of a conversation are read in order. For each of four states (nothing yet, after system, after user, after assistant) the
cheapest edits so far survive, as a node of a backpointer tree that counts its children; a state that another one beats by
more than the rest can make good has no survivor. When the survivors share their first unresolved ancestor, its edit is emitted;
a branch that no survivor descends from is dropped. So only edits on which survivors still differ are held. Insertions belong to
the row after them, so the edits up to a row end in that row's own letter, none begins another, and their alphabetic order never
changes by what follows: ties are decided by the order of the whole unresolved edits, which is carried as a rank of the survivors.

Repeated rows are one row with a count. A conversation of more than `block_rows` rows is cut into ranges. Each range is
searched from all four states on its own; costs and ranks of its 16 ways are folded along the conversation, and each range then emits
the edits between the two states that the fold has given it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: States: nothing yet, after system, after user, after assistant. Of each the state and role that an insertion leads to.
NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
#: Where a row that is kept leads, by the initial of its role.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Insertions that complete a conversation that ends in a state.
TAIL = {0: (), 1: ("user", "assistant"), 2: ("assistant",), 3: ()}
INSERT, REROLE, DELETE, UNFINISHED = 2, 2, 3, 1
#: What the rest of a conversation costs more at most from one state than from another: whatever is done from the other can be done
#: with insertions first, and with the other's system row deleted. [state][other]
MORE = {0: {1: 0, 2: 2, 3: 0}, 1: {0: 4, 2: 2, 3: 4}, 2: {0: 5, 1: 2, 3: 2}, 3: {0: 3, 1: 0, 2: 2}}

EDITS = "conv_id {kind}, block int, seq long, edit string, turn long, fault string, given_role string, role string, text string, times long"


class Node:
    """One row's edits, and the edits of later rows that build on them."""

    __slots__ = ("parent", "kids", "step")

    def __init__(self, parent: Node | None, step: tuple | None):
        self.parent, self.step, self.kids = parent, step, set()
        if parent is not None:
            parent.kids.add(self)


class Search:
    """The survivors of a conversation, or of a range of it that begins in `state`: {state: (cost, rank, node)}."""

    def __init__(self, state: int = 0):
        self.root = Node(None, None)
        self.live = {state: (0, 0, self.root)}

    def take(self, row: object, initial: str, unfinished: bool, doomed: bool, times: int = 1) -> list[tuple]:
        """Reads a row, which must be deleted `times` times if `doomed`; returns the steps that are settled by it.

        A step: (row, roles inserted before it, letter, role given to it).
        """
        best, more = {}, UNFINISHED if unfinished else 0
        for state, (cost, rank, node) in self.live.items():
            ways = [(state, cost + DELETE * times, "D", (), None)]
            at, spent, before, letters = state, cost, (), ""
            for _ in range(0 if doomed else 3):
                after, role = NEXT[at]
                if (kept := KEPT.get((at, initial))) is not None:
                    ways.append((kept, spent + more, letters + "K", before, None))
                ways.append((after, spent + REROLE + more, letters + "R", before, role))
                at, spent, before, letters = after, spent + INSERT, (*before, role), letters + "I"
            for target, total, suffix, inserted, role in ways:
                if target not in best or (total, rank, suffix) < best[target][:3]:
                    best[target] = (total, rank, suffix, node, (row, inserted, suffix[-1], role))
        # what another survivor beats whatever follows is no survivor
        best = {t: way for t, way in best.items() if not any(best[x][0] + MORE[x][t] < way[0] for x in best if x != t)}
        old, order = [node for *_, node in self.live.values()], sorted(best, key=lambda t: best[t][1:3])
        self.live = {t: (best[t][0], order.index(t), Node(*best[t][3:])) for t in best}
        for node in old:  # a branch without survivors goes, up to where it left another one
            while not node.kids and node.parent is not None:
                node.parent.kids.discard(node)
                node = node.parent
        return self._settled()

    def _settled(self) -> list[tuple]:
        out = []
        while len(self.root.kids) == 1:
            self.root = self.root.kids.pop()
            self.root.parent = None
            out.append(self.root.step)
        return out

    def end(self, state: int | None = None) -> tuple[int, list[tuple]]:
        """The final state, the best one or the one given, and the steps up to it that weren't settled yet."""
        if state is None:
            state = min(self.live, key=lambda s: (self.live[s][0] + INSERT * len(TAIL[s]), self.live[s][1]))
        node, out = self.live[state][2], []
        while node is not self.root:
            out.append(node.step)
            node = node.parent
        return state, out[::-1]


def fold(blocks: list[dict[int, dict[int, tuple[int, int]]]]) -> list[tuple[int, int]]:
    """The states in which each range of a conversation begins and ends on the best way; a range: {from: {to: (cost, rank)}}."""
    live, back = {0: (0, 0)}, []
    for ways in blocks:
        best = {}
        for state, (cost, rank) in live.items():
            for target, (more, own) in ways[state].items():
                if target not in best or (cost + more, rank, own) < best[target][:3]:
                    best[target] = (cost + more, rank, own, state)
        order = sorted(best, key=lambda t: best[t][1:3])
        live = {t: (best[t][0], order.index(t)) for t in best}
        back.append({t: best[t][3] for t in best})
    state, out = min(live, key=lambda s: (live[s][0] + INSERT * len(TAIL[s]), live[s][1])), []
    for origin in reversed(back):
        out.append((origin[state], state))
        state = origin[state]
    return out[::-1]


def _kind(rows: DataFrame) -> tuple[str, pa.DataType]:
    """The type of conv_id, for Spark and for Arrow."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return kind, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _summaries(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(conv_id, block, state, target, cost, rank) of each range; rows come in order."""
    now, found = None, {}

    def batch_of(found: dict) -> pa.RecordBatch:
        rows = [(*key, s, t, cost, rank) for key, searches in found.items() for s, search in searches.items() for t, (cost, rank, _) in search.live.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["conv_id", "block", "state", "target", "cost", "rank"])

    for batch in batches:
        for conv, block, _, role, _, times, fault, _, _, _ in _rows(batch):
            if now != (conv, block):
                if len(found) >= 1000:
                    yield batch_of(found)
                    found = {}
                now = (conv, block)
                found[now] = {s: Search(s) for s in NEXT}
            for search in found[now].values():
                if fault in ("blank", "duplicate"):
                    search.take(None, "", False, True, times)
                else:
                    search.take(None, role[:1], fault == "truncated", False)
                    if times > 1:
                        search.take(None, "", False, True, times - 1)
    yield batch_of(found)


class _Out:
    """Edits as columns, handed over when there are many."""

    def __init__(self, kind: pa.DataType):
        self.kinds = [kind, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        self.rows, self.size, self.seq = [], 0, 0

    def insert(self, conv: object, block: int, role: str) -> None:
        self.rows.append((conv, block, self.seq, "I", None, None, None, role, "", 1))
        self.seq += 1

    def add(self, conv: object, block: int, step: tuple) -> None:
        (turn, role, text, fault, times), inserted, letter, given = step
        for x in inserted:
            self.insert(conv, block, x)
        gone = letter == "D"
        self.rows.append((conv, block, self.seq, letter, turn, fault, role, None if gone else given or role, None if gone else text, times))
        self.size += 0 if gone else len(text)
        self.seq += 1

    def full(self) -> bool:
        return len(self.rows) >= 10_000 or self.size > 4_000_000

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 10
        self.rows, self.size = [], 0
        names = [x.split()[0] for x in EDITS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, self.kinds, strict=True)], names)


def _edits(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Edits of conversations or ranges of them; rows come in order."""
    out, now, search, ends = _Out(kind), None, None, (None, True)

    def close() -> None:
        if now is not None:
            state, steps = search.end(ends[0])
            for step in steps:
                out.add(*now, step)
            for role in TAIL[state] if ends[1] else ():
                out.insert(*now, role)

    for batch in batches:
        for conv, block, turn, role, text, times, fault, entry, target, last in _rows(batch):
            if now != (conv, block):
                close()
                now, search, ends, out.seq = (conv, block), Search(entry), (target, last), 0
            doomed = fault in ("blank", "duplicate")
            settled = search.take((turn, role, text, fault, times if doomed else 1), role[:1], fault == "truncated", doomed, times if doomed else 1)
            if not doomed and times > 1:
                settled = settled + search.take((turn, role, None, "duplicate", times - 1), "", False, True, times - 1)
            for step in settled:
                out.add(*now, step)
            if out.full():
                yield out.batch()
    close()
    yield out.batch()


def repair(turns: DataFrame, block_rows: int = 65_536) -> DataFrame:
    """(conv_id, block, seq, edit, turn, fault, given_role, role, text, times): the cheapest edits of each conversation, in the order of
    block and seq. edit is K (kept), R (role changed), D (deleted, `times` times in a row) or I (inserted, with an empty text).

    turns: conv_id, turn, role, text and maybe times (how often the row stands there, 1 if the column is missing; rows of 0 don't
    count). A conversation's rows go by turn, nulls first, then role and text. Faults, the first that holds: blank, duplicate (role and
    text stand earlier), truncated (the last character isn't one of .!?). Keep costs 0, a new role 2, an insertion 2, a deletion 3, a truncated
    row that stays 1 more; blank rows and duplicates go. Role initials then are nothing, or an s or not and ua once or more. Of equally cheap
    edits the alphabetically first are taken. Null roles and texts are one space; a role without an initial can't be kept. Rows
    without a conv_id are one conversation. Other columns aren't read.
    """
    times = F.col("times").cast("long") if "times" in turns.columns else F.lit(1).cast("long")
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), times.alias("times")).where("times > 0")
    rows = common.saved(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times")), "turns")

    # duplicates: rows whose role and text stand at an earlier turn, too
    place = F.struct(F.col("turn").isNotNull(), "turn")
    again = rows.groupBy("conv_id", "role", F.md5(F.col("text").cast("binary")).alias("md5")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = common.saved(again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), "md5", "first"), "again")
    seen = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.md5(F.col("text").cast("binary")) == F.col("md5"))
    rows = rows.join(common.small_side(again, again.count(), 200_000), seen, "left")
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.lit(1))
    later = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)
    fault = F.when(last == "", "blank").when(later, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    rows = rows.select("conv_id", "turn", "role", "text", "times", fault.alias("fault"))

    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select(F.col("conv_id").alias("_conv"), "n")
    sizes = common.saved(sizes, "long")
    many, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    kind, arrow = _kind(rows)
    shown = EDITS.format(kind=kind)
    order = ["conv_id", "block", "turn", "role", "text"]
    whole = rows if not many else rows.join(common.small_side(sizes, many), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_anti")
    whole = whole.select("conv_id", F.lit(0).alias("block"), "turn", "role", "text", "times", "fault", F.lit(0).alias("entry"), F.lit(None).cast("int").alias("target"), F.lit(True).alias("last"))
    if many:
        cut = rows.join(common.small_side(sizes, many), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
        cut = common.saved(cut.repartitionByRange(-(-total // block_rows), "conv_id", "turn", "role", "text").withColumn("block", F.spark_partition_id()), "ranges")
        ends = _range_ends(cut, order, kind, arrow)
        placed = cut.join(common.small_side(ends, ends.count()), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
        whole = whole.unionByName(placed.select(whole.columns))
    return whole.repartition("conv_id", "block").sortWithinPartitions(*order).mapInArrow(lambda batches: _edits(batches, arrow), shown)


def _range_ends(cut: DataFrame, order: list[str], kind: str, arrow: pa.DataType) -> DataFrame:
    """(_conv, _block, entry, target, last): the states between which each range is repaired. A fold holds 16 numbers a range."""
    nothing = [F.lit(None).cast("int").alias(n) for n in ("entry", "target", "last")]
    rows = cut.select("conv_id", "block", "turn", "role", "text", "times", "fault", *nothing)
    ways = rows.repartition("conv_id", "block").sortWithinPartitions(*order).mapInArrow(lambda batches: _summaries(batches, arrow), f"conv_id {kind}, block long, state long, target long, cost long, rank long")

    def each(key: tuple, table: pa.Table) -> pa.Table:
        blocks = {}
        for block, state, target, cost, rank in zip(*[table[c].to_pylist() for c in ("block", "state", "target", "cost", "rank")], strict=True):
            blocks.setdefault(block, {}).setdefault(state, {})[target] = (cost, rank)
        names = sorted(blocks)
        ends = fold([blocks[b] for b in names])
        n = len(names)
        return pa.table({"_conv": pa.array([key[0].as_py()] * n, arrow), "_block": pa.array(names, pa.int32()), "entry": pa.array([e for e, _ in ends], pa.int32()), "target": pa.array([t for _, t in ends], pa.int32()), "last": pa.array([i == n - 1 for i in range(n)])})

    return common.saved(ways.groupBy("conv_id").applyInArrow(each, f"_conv {kind}, _block int, entry int, target int, last boolean"), "ends")


def digests(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of `conversations`.

    Hash and audit of a conversation are one sequence, so a task reads its edits in order, batch by batch, and holds the audit only.
    """
    kind, arrow = _kind(edits)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in EDITS.split(", ")[3:])]
    there = conversations.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("block"), F.lit(-1).cast("long").alias("seq"), *empty)
    rows = edits.unionByName(there).repartition("conv_id").sortWithinPartitions("conv_id", "block", "seq")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, c = None, [], None

        def close() -> None:
            if c is not None:
                gaps = c["high"] - c["low"] + 1 - c["turns"] if c["turns"] else 0
                done.append((now[0], gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"], "".join(c["audit"]), c["sha"].hexdigest()))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *[pa.array(x, pa.int64()) for x in columns[1:7]], *[pa.array(x, pa.string()) for x in columns[7:]]], names)

        for batch in batches:
            for conv, _, _, edit, turn, fault, given, role, text, times in _rows(batch):
                if now != (conv,):
                    close()
                    now, c = (conv,), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0, "low": 0, "high": 0, "audit": [], "sha": hashlib.sha256(), "before": None, "any": False}
                if edit is None:
                    continue
                c["audit"].append(edit * times)
                if edit != "I":
                    if fault:
                        c[fault] += times
                    pairs = [(c["before"], given[:1])] if c["before"] is not None else []
                    c["illegal"] += sum(a + b not in ("su", "ua", "au") for a, b in pairs) + times - 1
                    c["before"] = given[:1]
                    if turn is not None and (not c["turns"] or turn != c["high"]):
                        c["low"] = c["low"] if c["turns"] else turn
                        c["high"], c["turns"] = turn, c["turns"] + 1
                c["cost"] += {"K": 0, "R": REROLE, "I": INSERT, "D": DELETE * times}[edit] + (UNFINISHED if fault == "truncated" and edit in "KR" else 0)
                if edit != "D":
                    c["sha"].update(("\n" if c["any"] else "").encode() + role.encode() + b":" + text.encode())
                    c["any"] = True
            if len(done) >= 10_000:
                yield batch_of()
                done = []
        close()
        yield batch_of()

    return rows.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
