"""Repair of conversations whose turns are damaged, by the cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_folder, stage

#: Rows and characters of a conversation that a task holds at most; what is beyond goes on in a written table.
HELD_ROWS = 5_000
HELD_CHARS = 1 << 22
#: Backpointers of a row of that table, a byte each.
BLOCK = 1 << 16

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What a repaired conversation has come to: nothing yet, its system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = "DIKR"  # in ASCII order, so that the first of several cheapest edits gives the least audit
_GIVEN = (USER, USER, ASSISTANT, USER)  # the only role that an inserted turn, or one with a new role, may have then
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_DONE, _TOTALS, _MOVES, _ROW = range(4)

REPORT = T.StructType(
    [T.StructField("conv_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
)
_STREAM = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("left", T.LongType()), *REPORT.fields[1:]]
    + [T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("moves", T.BinaryType())]
)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv_id, turn, role, text, lost; a dropped row stays as `lost`, with nothing but its conversation."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    code = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    lost = F.col("code") == 0
    damaged = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), code.alias("code"))
    return damaged.select(
        "conv_id",
        F.when(~lost, F.col("turn")).alias("turn"),
        F.when(lost, "").when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(lost | (F.col("code") == 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        lost.alias("lost"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Adds each row's first fault, and its number among equal rows of its conversation."""
    end = F.expr(r"trim(TRAILING '\t\n\u000B\f\r ' FROM text)")
    blank = end == ""
    # blank rows need no number; the others of a conversation meet only their equals
    apart = F.when(blank | F.col("lost"), F.pmod(F.xxhash64("turn"), F.lit(256))).otherwise(-1)
    equals = Window.partitionBy("conv_id", "role", "text", "apart").orderBy(F.col("turn").asc_nulls_first())
    fault = (
        F.when(F.col("blank"), BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.col("mark").isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    )
    numbered = rows.select("*", blank.alias("blank"), F.right(end, F.lit(1)).alias("mark"), apart.alias("apart")).withColumn("nth", F.row_number().over(equals))
    return numbered.select("conv_id", "turn", "role", "text", "lost", fault.alias("fault"), "nth")


class Costs:
    """The cheapest cost from every state to the end, row by row from the last, and the edit to take there.

    Costs differ from the smallest of the four by little, so steps repeat and are looked up.
    """

    def __init__(self) -> None:
        self.seen: dict[tuple, tuple[tuple[int, ...], int, int]] = {}

    def step(self, after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int, int]:
        """(costs before the row, less the smallest; the smallest; two bits of edit for each state)."""
        key = (after, initial, fault)
        if key not in self.seen:
            self.seen[key] = self._step(after, initial, fault)
        return self.seen[key]

    @staticmethod
    def _step(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int, int]:
        edits = [{"D": DELETE + after[q]} for q in range(4)]
        if fault not in (BLANK, DUPLICATE):
            more = UNFINISHED if fault == TRUNCATED else 0
            for q in range(4):
                if (q, initial) in _KEPT:
                    edits[q]["K"] = KEEP + more + after[_KEPT[q, initial]]
                edits[q]["R"] = REROLE + more + after[_GIVEN[q]]
        taken = [min(e.values()) for e in edits]
        # an inserted turn leads to one state; a second insertion in a row to the other of user and assistant
        for q in (USER, ASSISTANT):
            edits[q]["I"] = INSERT + min(taken[_GIVEN[q]], INSERT + taken[q])
        for q in (START, SYSTEM):
            edits[q]["I"] = INSERT + min(edits[USER].values())
        best = [min(e.values()) for e in edits]
        bits = sum(min(LETTERS.index(c) for c, v in e.items() if v == best[q]) << (2 * q) for q, e in enumerate(edits))
        least = min(best)
        return tuple(b - least for b in best), least, bits


END_COSTS = (0, 2 * INSERT, INSERT, 0)


class Walk:
    """Applies the edits from the first row on: the audit and the hash of the repaired turns."""

    def __init__(self) -> None:
        self.state, self.audit, self.digest, self.some = START, bytearray(), hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.digest.update((f"\n{role}:{text}" if self.some else f"{role}:{text}").encode())
        self.some = True

    def _insert(self) -> None:
        self.audit += b"I"
        self.state = _GIVEN[self.state]
        self._put(_NAMES[self.state], "")

    def row(self, bits: int, role: str, text: str) -> None:
        while (letter := LETTERS[bits >> (2 * self.state) & 3]) == "I":
            self._insert()
        self.audit += letter.encode()
        if letter == "K":
            self.state = _KEPT[self.state, role[:1]]
            self._put(role, text)
        elif letter == "R":
            self.state = _GIVEN[self.state]
            self._put(_NAMES[self.state], text)

    def end(self) -> tuple[str, str]:
        while self.state in (SYSTEM, USER):
            self._insert()
        return self.audit.decode(), self.digest.hexdigest()


class _Conversation:
    """What is carried from row to row of one conversation, from its last row to its first."""

    def __init__(self, key: str):
        self.key, self.rows, self.chars, self.spilt, self.n = key, [], 0, False, 0
        self.after, self.cost, self.moves = END_COSTS, 0, bytearray()
        self.counts = dict.fromkeys(COUNTS, 0)
        self.next_initial, self.turn, self.last_turn, self.turns = None, None, None, 0

    def add(self, turn: int | None, role: str, text: str, fault: int, costs: Costs, out: list[tuple]) -> None:
        initial = role[:1]
        if self.next_initial is not None and initial + self.next_initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.next_initial = initial
        if fault:
            self.counts[COUNTS[fault]] += 1
        if turn is not None and turn != self.turn:
            self.turn, self.turns = turn, self.turns + 1
            self.last_turn = turn if self.last_turn is None else self.last_turn
        self.after, more, bits = costs.step(self.after, initial if initial in ("s", "u", "a") else "", fault)
        self.cost += more
        self.moves.append(bits)
        self.rows.append((role, text))
        self.chars += len(text)
        self.n += 1
        if len(self.rows) >= HELD_ROWS or self.chars >= HELD_CHARS:
            self.spilt = True
            self.spill(out)
        if self.spilt and len(self.moves) >= BLOCK:
            self.spill_moves(out)

    def spill(self, out: list[tuple]) -> None:
        at = self.n - len(self.rows)
        out.extend((self.key, _ROW, at + k, *[None] * 8, role, text, None) for k, (role, text) in enumerate(self.rows))
        self.rows, self.chars = [], 0

    def spill_moves(self, out: list[tuple]) -> None:
        """The moves of the rows down from the latest, in the order of reading."""
        if self.moves:
            out.append((self.key, _MOVES, self.n - 1, *[None] * 10, bytes(reversed(self.moves))))
        self.moves = bytearray()

    def finish(self, out: list[tuple]) -> None:
        self.counts["cost"] = self.cost + self.after[START]
        self.counts["gaps"] = self.last_turn - self.turn + 1 - self.turns if self.turns else 0
        totals = [self.counts[c] for c in COUNTS]
        if self.spilt:
            self.spill(out)
            self.spill_moves(out)
            out.append((self.key, _TOTALS, self.n, *totals, *[None] * 5))
            return
        walk = Walk()
        for bits, (role, text) in zip(reversed(self.moves), reversed(self.rows), strict=True):
            walk.row(bits, role, text)
        out.append((self.key, _DONE, 0, *totals, *walk.end(), None, None, None))


def _backward(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations from their last row to their first; state goes from batch to batch."""
    costs, now, out = Costs(), None, []
    for batch in batches:
        for key, timed, turn, role, text, lost, fault in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    now.finish(out)
                now = _Conversation(key)
            if not lost:
                now.add(turn if timed else None, role, text, fault, costs, out)
            if len(out) >= HELD_ROWS:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)
            out = []
    if now is not None:
        now.finish(out)
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_STREAM.names)
    return frame.astype({c: "Int64" for c in COUNTS})


def _forward(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations that were spilt, from their first row on: totals, then blocks of moves and the rows that they cover."""
    key, totals, walk, moves, top, done = None, None, None, b"", 0, []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.kind == _TOTALS:
                if key is not None:
                    done.append((key, *totals, *walk.end()))
                key, totals, walk = row.key, [int(getattr(row, c)) for c in COUNTS], Walk()
            elif row.kind == _MOVES:
                moves, top = row.moves, row.left
            else:
                walk.row(moves[top - row.left], row.role, row.text)
        if done:
            yield pd.DataFrame(done, columns=["key", *REPORT.names[1:]])
            done = []
    if key is not None:
        yield pd.DataFrame([(key, *totals, *walk.end())], columns=["key", *REPORT.names[1:]])


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of the table, null included: the counts of what is wrong after damage() and the cheapest repair.

    Rows are dealt by conversation and sorted from the last turn to the first; a task carries four costs from row to row
    and from batch to batch, and keeps a byte of backpointers a row. At a conversation's first row the edits are followed
    forward. One that is longer than HELD_ROWS or HELD_CHARS spills its rows and backpointers to a table in the shared
    folder as it goes by, and a second pass, sorted from its first row, follows them; so a task holds a bounded part of any
    conversation but for its audit, a character a row.

    Null role or text is one space. Rows of equal turn come in the order of role and text, null turns first; an empty or
    other role has an initial that fits nowhere. A conversation that lost all rows has zeros, an empty audit and the hash
    of nothing. Repeated rows are duplicates. An empty table gives no row. Other columns are not looked at.
    """
    spark = conversations.sparkSession
    rows = faults(damage(conversations)).select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), F.col("turn").isNotNull().alias("timed"),
        F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "role", "text", "lost", "fault", "nth",
    )
    down = [F.col(c).desc() for c in ("timed", "turn", "role", "text", "nth")]
    back = rows.repartition("key").sortWithinPartitions("key", *down).drop("nth").mapInPandas(_backward, _STREAM)
    back = stage(back, new_folder(spark))
    known = T.StructType([_STREAM["key"], *REPORT.fields[1:]])
    spilt = back.where(F.col("kind") != _DONE).repartition("key").sortWithinPartitions("key", F.col("left").desc(), F.col("kind"))
    found = back.where(F.col("kind") == _DONE).select(known.names).unionByName(spilt.mapInPandas(_forward, known))
    return found.select(F.when(F.col("key") != " ", F.col("key").cast("long")).alias("conv_id"), *REPORT.names[1:])
