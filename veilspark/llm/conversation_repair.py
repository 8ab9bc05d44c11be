"""Conversation structure repair by shortest paths with a bucket queue (operator 13).

The rows of a conversation, by turn, are to become (s?(ua)+)?, by initials of roles: nothing, or an
optional system row and then user and assistant in turns. A row may be kept (0), given the role user
or assistant (1) or deleted (2, which blank and duplicate rows must be); an empty row of user or
assistant may be put in anywhere (5); a truncated row that is not deleted costs 5 more. Nodes of the
graph are (rows behind, state), states being the start and the last role; its costs are small
integers, so Dial's bucket queue, from the end backwards, records every node's distance without a
heap. The walk from the start takes, of the arcs that are tight, the one with the least letter
(D, I, K, R): that is the ASCII-least audit of all cheapest ones.

No conversation is handled whole but for what is one value by definition. Rows are dealt out and
sorted by ranges of (conversation, turn, role, text) and cut into blocks of at most ``BLOCK`` rows of
one conversation, and a block's graph is a letter a row. Where a conversation has several blocks,
each gives the distances between its first and last states (4 x 4, by Dial), a backward pass over
these numbers gives the distances from each block's end to the goal, and each block is then walked
from each state that it may be entered in. A last pass over the sorted rows, which holds one row and
a running hash, picks the walks that fit and writes the result.

Defined results: null role or text is one space; a null turn comes first; rows of one turn go by
role, then text, and equal ones are duplicates; a null ``conv_id`` is a conversation of its own; an
empty text is blank; a text of any length is one row; a role of another initial can only be changed
or deleted; no rows give no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, spread_join, write_table

BLOCK = 2048
# What edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 40
START, S, U, A = range(4)
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
WANTED = {START: "u", S: "u", U: "a", A: "u"}  # the role that is put in or given
ROLES = {"u": "user", "a": "assistant"}
END = [0, 2 * INSERT, INSERT, 0]  # what is missing when no row is left
BLANK, DUPLICATE = "B", "D"  # codes of rows that must go; others are their initial or ?, upper case or ! if truncated
CODES = "sua?SUA!"


def _row_arcs(code: str) -> list[list[tuple[str, int, int]]]:
    """By state: (letter, cost, next state) of what can be done with a row, letters ascending."""
    arcs = [[("D", DELETE, st)] for st in range(4)]
    if code in CODES:
        more = TRUNCATED if code in "SUA!" else 0
        for st in range(4):
            if (to := NEXT.get((st, code.lower()))) is not None:
                arcs[st].append(("K", KEEP + more, to))
            arcs[st].append(("R", REROLE + more, NEXT[st, WANTED[st]]))
    return arcs


ROW_ARCS = {c: _row_arcs(c) for c in (*CODES, BLANK, DUPLICATE)}
INTO_BY_ROW = {c: [[(st, w) for st in range(4) for _, w, to in arcs[st] if to == v] for v in range(4)] for c, arcs in ROW_ARCS.items()}
INTO_BY_INSERT = [[st for st in range(4) if NEXT[st, WANTED[st]] == v] for v in range(4)]


def distances(codes: str, ends: list[int]) -> list[int]:
    """The distance of each node (4 * rows behind + state) to the goal, ends being those of the last rows' states: Dial's algorithm.

    Buckets are a ring: all distances in the queue lie within the greatest cost, or within ends at first.
    Rows are put in before a row only; what is put in at the end of the block belongs to the next one.
    """
    n = len(codes)
    dist = [NEVER] * (4 * n + 4)
    at = min(ends)
    ring = max(INSERT, REROLE + TRUNCATED, max(e for e in ends if e < NEVER) - at) + 1
    buckets: list[list[int]] = [[] for _ in range(ring)]
    waiting = 0
    for st, e in enumerate(ends):
        if e < NEVER:
            buckets[e % ring].append(4 * n + st)
            waiting += 1
    while waiting:
        bucket = buckets[at % ring]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] < NEVER:
                continue
            dist[node] = at
            i, st = divmod(node, 4)
            if i < n:
                for before in INTO_BY_INSERT[st]:
                    if dist[4 * i + before] == NEVER:
                        buckets[(at + INSERT) % ring].append(4 * i + before)
                        waiting += 1
            if i:
                for before, w in INTO_BY_ROW[codes[i - 1]][st]:
                    if dist[4 * i - 4 + before] == NEVER:
                        buckets[(at + w) % ring].append(4 * i - 4 + before)
                        waiting += 1
        at += 1
    return dist


def walk(codes: str, dist: list[int], st: int) -> str:
    """The least letters along tight arcs from a state before the first row to behind the last one."""
    letters = []
    for i, code in enumerate(codes):
        while True:
            here = dist[4 * i + st]
            arcs = [(letter, to) for letter, w, to in ROW_ARCS[code][st] if here == w + dist[4 * i + 4 + to]]
            put = NEXT[st, WANTED[st]]
            if here == INSERT + dist[4 * i + put] and not (arcs and arcs[0][0] < "I"):
                letters.append("I")
                st = put
                continue
            letter, st = arcs[0]
            letters.append(letter)
            break
    return "".join(letters)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the distances from each first to each last state, where there are other blocks."""
    for b in batches:
        found = []
        for codes, n in zip(b.column("codes").to_pylist(), b.column("n_blocks").to_pylist(), strict=True):
            by_end = [distances(codes, [0 if x == st else NEVER for x in range(4)])[:4] for st in range(4)] if n > 1 else []
            found.append([min(by_end[to][st], NEVER) for st in range(4) for to in range(4)] if n > 1 else [])
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("block"), b.column("codes"), pa.array(found, pa.list_(pa.int64()))], names=["k", "block", "codes", "across"])


def _to_goal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, last ones first, with the distances of their last states to the goal."""
    key, ends = None, END
    for b in batches:
        out = []
        for k, across in zip(b.column("k").to_pylist(), b.column("across").to_pylist(), strict=True):
            if k != key:
                key, ends = k, END
            out.append(ends)
            if across:
                ends = [min(across[4 * st + to] + ends[to] for to in range(4)) for st in range(4)]
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("block"), b.column("codes"), pa.array(out, pa.list_(pa.int64()))], names=["k", "block", "codes", "ends"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        audits = []
        for codes, ends in zip(b.column("codes").to_pylist(), b.column("ends").to_pylist(), strict=True):
            dist = distances(codes, ends)
            audits.append([walk(codes, dist, st) for st in range(4)])
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("block"), b.column("codes"), pa.array(audits, pa.list_(pa.string()))], names=["k", "block", "codes", "audits"])


TURNS = "k string, block long, j int, turn long, role string, text string, again boolean"


def _numbered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their block and place in it, and whether they equal the row before."""
    from pyspark import TaskContext

    blocks = count(TaskContext.get().partitionId() << 40)
    last, block, j = (None,), 0, 0
    for b in batches:
        at, places, again = [], [], []
        for row in zip(*(b.column(c).to_pylist() for c in ("k", "turn", "role", "text")), strict=True):
            again.append(row == last)
            if row[0] != last[0] or j == size:
                block, j = next(blocks), 0
            at.append(block)
            places.append(j)
            last, j = row, j + 1
        cols = [b.column("k"), pa.array(at, pa.int64()), pa.array(places, pa.int32()), b.column("turn"), b.column("role"), b.column("text"), pa.array(again, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["k", "block", "j", "turn", "role", "text", "again"])


def _key(conv_id: str) -> Column:
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(" "))


def _planned(rows: DataFrame, size: int) -> DataFrame:
    """Rows and the plans of their blocks, a conversation in one partition: by block, the plan (j = -1) first."""
    space = F.lit(" ")
    clean = rows.select(_key("conv_id").alias("k"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    order = ["k", "turn", "role", "text"]
    turns = write_table(clean.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_numbered, size=size), TURNS), "turns")

    trimmed = F.rtrim("text", F.lit(SPACES))
    told = turns.select(
        "k", "block", "j", "turn", "again", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("mark"),
        F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut_off"),
    )
    firsts = told.groupBy("k", "mark").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"))
    told = spread_join(told, firsts.select("k", "mark", "first", "n"), ["k", "mark"], counts=firsts)
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("?")
    code = (
        F.when(F.col("blank"), BLANK).when(F.col("again") | ~F.col("turn").eqNullSafe(F.col("first.turn")), DUPLICATE)
        .when(F.col("cut_off"), F.translate(known, "sua?", "SUA!")).otherwise(known)
    )
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", code.alias("code")))), lambda x: x["code"]), "")
    blocks = write_table(told.groupBy("k", "block").agg(letters.alias("codes")), "blocks")

    n_blocks = blocks.groupBy("k").agg(F.count("*").alias("n_blocks"))
    across = spread_join(blocks, n_blocks, ["k"], counts=n_blocks.withColumnRenamed("n_blocks", "n"))
    across = across.select("k", "block", "codes", "n_blocks").mapInArrow(_across, "k string, block long, codes string, across array<long>")
    ends = across.repartition("k").sortWithinPartitions("k", F.desc("block")).mapInArrow(_to_goal, "k string, block long, codes string, ends array<long>")
    plans = ends.repartition("k", "block").mapInArrow(_walked, "k string, block long, codes string, audits array<string>")
    both = turns.drop("again").unionByName(plans.withColumn("j", F.lit(-1)), allowMissingColumns=True)
    return both.repartition("k").sortWithinPartitions("k", "block", "j")


Edit = tuple[str, str, "str | None", "tuple | None"]  # conversation, letter, role afterwards, the row (turn, role, text, code)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Edit]]:
    """Every edit in its order, a list for each batch and one for what is put in at the very end."""
    key, st, letters, codes = None, START, iter(""), ""

    def closed(out: list[Edit]) -> list[Edit]:
        for want in {S: "ua", U: "a"}.get(st, "") if key is not None else "":
            out.append((key, "I", ROLES[want], None))
        return out

    for b in batches:
        out: list[Edit] = []
        cols = zip(*(b.column(c).to_pylist() for c in ("k", "j", "turn", "role", "text", "codes")), b.column("audits"), strict=True)
        for k, j, turn, role, text, plan, audits in cols:
            if j < 0:
                if k != key:
                    closed(out)
                    key, st = k, START
                letters, codes = iter(audits[st].as_py()), plan
                continue
            for letter in letters:
                if letter == "D":
                    out.append((key, "D", None, (turn, role, text, codes[j])))
                    break
                if letter == "K":
                    st = NEXT[st, role[:1]]
                    out.append((key, "K", role, (turn, role, text, codes[j])))
                    break
                want = WANTED[st]
                st = NEXT[st, want]
                out.append((key, letter, ROLES[want], (turn, role, text, codes[j]) if letter == "R" else None))
                if letter == "R":
                    break
        yield out
    yield closed([])


REPORT = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Report:
    """What is told of one conversation, edit by edit."""

    def __init__(self) -> None:
        self.turns: list[int] = []  # first and last
        self.distinct = self.illegal = self.cost = 0
        self.faults = {BLANK: 0, DUPLICATE: 0, "truncated": 0}
        self.initial, self.letters, self.hash, self.empty = None, [], hashlib.sha256(), True

    def add(self, letter: str, role: str | None, row: tuple | None) -> None:
        self.letters.append(letter)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[letter]
        text = ""
        if row:
            turn, was, text, code = row
            if turn is not None and turn not in self.turns[1:]:
                self.turns = [*self.turns[:1], turn] if self.turns else [turn, turn]
                self.distinct += 1
            if (fault := code if code in self.faults else "truncated" if code in "SUA!" else None) is not None:
                self.faults[fault] += 1
            if fault == "truncated" and letter != "D":
                self.cost += TRUNCATED
            if self.initial is not None and (self.initial, was[:1]) not in LEGAL:
                self.illegal += 1
            self.initial = was[:1]
        if letter != "D":
            self.hash.update(("" if self.empty else "\n").encode() + f"{role}:".encode() + text.encode())
            self.empty = False

    def row(self, key: str) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return (key, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest())


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, now = None, _Report()
    names = [c.split()[0] for c in REPORT.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in REPORT.split(", ")]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for edits in _edits(batches):
        rows = []
        for k, letter, role, row in edits:
            if k != key:
                if key is not None:
                    rows.append(now.row(key))
                key, now = k, _Report()
            now.add(letter, role, row)
        if rows:
            yield batch(rows)
    if key is not None:
        yield batch([now.row(key)])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, n = None, 0
    for edits in _edits(batches):
        out = []
        for k, letter, role, row in edits:
            if k != key:
                key, n = k, 0
            if letter != "D":
                out.append((k, n, letter, row and row[0], role, row[2] if row else ""))
                n += 1
        if out:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["k", "position", "edit", "turn", "role", "text"])


def _back(rows: DataFrame, result: DataFrame, how: str) -> DataFrame:
    """The result with conv_id as it was, in place of its key."""
    ids = rows.select("conv_id").distinct().withColumn("k", _key("conv_id"))
    return ids.join(result, "k", how).drop("k")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, position, edit (K, R or I), turn (null if put in), role, text of the repaired conversations."""
    done = _planned(rows, block).mapInArrow(_repaired, "k string, position long, edit string, turn long, role string, text string")
    return done.withColumn("conv_id", F.when(F.col("k") != " ", F.col("k")).cast(rows.schema["conv_id"].dataType)).select("conv_id", *(c for c in done.columns if c != "k"))


def report(rows: DataFrame, all_rows: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row for every conv_id of all_rows (rows if not given): its faults, the cost and audit of its repair, and the digest of what it becomes."""
    told = _back(rows if all_rows is None else all_rows, _planned(rows, block).mapInArrow(_reported, REPORT), "left")
    zero = {c.split()[0]: 0 for c in REPORT.split(", ") if c.endswith("long")}
    return told.na.fill(zero | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}, [*zero, "audit", "repaired_sha256"])


def damage(rows: DataFrame) -> DataFrame:
    """The rows, some of them damaged by the checksum of ``conv_id:turn``: dropped, emptied, without their ends of sentences, repeated, or said by the user. Nulls are one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", _key("conv_id"), _key("turn"))) % 20
    text = F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", space))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")
