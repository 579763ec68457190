"""Conversation structure repair: generalised LR parsing with weighted edits.

The roles of a conversation, by their initials, should read ``(s?(ua)+)?``, as the grammar

    conversation = | turns | s turns        turns = u a | turns u a

Its LR automaton is driven over the rows of a conversation, sorted by turn. Instead of failing,
a row may be kept (K, cost 0), given the role user or assistant (R, 2) or deleted (D, 3), and an
empty text of either role may be inserted before it or at the end (I, 2). Blank rows and those
whose role and text were there before must be deleted; a truncated row that is not costs 1
more. All stacks that this gives live in one graph-structured stack. Stacks of equal top state
are merged: the one of the least (cost, audit) stays, the audit being the edits' letters in
order. So there are at most as many as states, whatever the edits.

Rows are shuffled by conv_id, and sorted and marked by Spark; both sorts spill. A task streams
through its rows and holds, for the conversation at hand, a byte per row and state to find the
audit at the end, and for each stack a digest of the text repaired so far, to which rows are
added as they come. So a conversation of any length needs a few bytes per row, and its texts are
never gathered. Its audit and digest are single values, which is why one task streams it.

NULL roles, texts and turns count as one space (a NULL conv_id, too, where rows are damaged);
NULL turns come first; rows of equal turn are in the order of role, then text. Rows without
conv_id are one conversation. Repeated rows are duplicates. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import Batches, batch

KEPT, REROLED, DELETED, INSERTED = "K", "R", "D", "I"
COST = {KEPT: 0, REROLED: 2, DELETED: 3, INSERTED: 2}
TRUNCATED_COST = 1
GIVEN = {"u": "user", "a": "assistant"}  # roles that edits can give
SOUND, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
ADJACENT = ("su", "ua", "au")
INK, ENDINGS, SPACE = r"[^\x20\x09-\x0D]", "[.!?]", r"[\x20\x09-\x0D]"

# The LR automaton: what follows a symbol, and what a state reduces to: (symbols, result).
SHIFT = {(0, "s"): 1, (0, "u"): 4, (1, "u"): 4, (4, "a"): 5, (2, "u"): 6, (3, "u"): 6, (6, "a"): 7}
GOTO = {(0, "turns"): 2, (1, "turns"): 3}
REDUCE = {5: (2, "turns"), 7: (3, "turns")}
ACCEPTING = (0, 2, 3)
STATES = 8
SYMBOLS = ("s", *GIVEN)
LETTERS = (DELETED, KEPT, REROLED)


@dataclass(frozen=True, slots=True)
class Node:
    """A state on the graph-structured stack and the node below it."""

    state: int
    below: Node | None = None


def advance(top: Node, symbol: str) -> Node | None:
    """The stack after a symbol and the reductions that follow, None if the symbol cannot come."""
    state = SHIFT.get((top.state, symbol))
    if state is None:
        return None
    top = Node(state, top)
    while top.state in REDUCE:
        size, result = REDUCE[top.state]
        for _ in range(size):
            top = top.below
        top = Node(GOTO[top.state, result], top)
    return top


class Stack:
    """One of the stacks at a place between two rows."""

    __slots__ = ("node", "cost", "place", "text")

    def __init__(self, node: Node, cost: int, place: int, text):
        self.node, self.cost, self.place, self.text = node, cost, place, text


class Option:
    """A way on from a stack: what was inserted, and the edit of the next row if any.

    ``place`` orders the stacks of one place by audit. None of their audits begins with
    another, since each ends with the edit of the same row; so (cost, place, edits) orders
    the longer ones.
    """

    __slots__ = ("node", "order", "origin", "inserted", "role")

    def __init__(self, node, order, origin, inserted, role=None):
        self.node, self.order, self.origin, self.inserted, self.role = node, order, origin, inserted, role


def merge(found: dict[int, Option], option: Option) -> bool:
    """Stacks of equal top: the least (cost, audit) stays."""
    state = option.node.state
    if state in found and found[state].order <= option.order:
        return False
    found[state] = option
    return True


class Repair:
    """Parses one conversation, row by row."""

    def __init__(self):
        self.stacks = {0: Stack(Node(0), 0, 0, hashlib.sha256())}
        self.trail = bytearray()  # per row and state: state before, insertions, edit

    def _with_insertions(self) -> dict[int, Option]:
        found = {s: Option(x.node, (x.cost, x.place, ""), x, "") for s, x in self.stacks.items()}
        ahead = list(found.values())
        while ahead:
            option = ahead.pop()
            if found[option.node.state] is not option:
                continue  # a cheaper stack took its place
            cost, place, edits = option.order
            for symbol in GIVEN:
                node = advance(option.node, symbol)
                if node:
                    order = (cost + COST[INSERTED], place, edits + INSERTED)
                    longer = Option(node, order, option.origin, option.inserted + symbol)
                    if merge(found, longer):
                        ahead.append(longer)
        return found

    @staticmethod
    def _add(text, started: bool, role: str, said: bytes) -> None:
        text.update(b"\n" * started + role.encode() + b":" + said)

    def _written(self, option: Option):
        """The digest of the stack's text and its insertions, and whether it has begun."""
        text, started = option.origin.text.copy(), option.origin.node.state != 0
        for symbol in option.inserted:
            self._add(text, started, GIVEN[symbol], b"")
            started = True
        return text, started

    def row(self, role: str, text: bytes, fault: int) -> None:
        found: dict[int, Option] = {}
        extra = TRUNCATED_COST * (fault == TRUNCATED)
        for option in self._with_insertions().values():
            cost, place, edits = option.order

            def edit(node, letter, new_role, more=0):
                order = (cost + COST[letter] + more, place, edits + letter)
                merge(found, Option(node, order, option.origin, option.inserted, new_role))

            edit(option.node, DELETED, None)
            if fault in (BLANK, DUPLICATE):
                continue
            for symbol in SYMBOLS:
                node = advance(option.node, symbol)
                if node and symbol == role[:1]:
                    edit(node, KEPT, role, extra)
                elif node and symbol in GIVEN:
                    edit(node, REROLED, GIVEN[symbol], extra)
        steps = bytearray(STATES)
        by_audit = sorted(found.values(), key=lambda o: o.order[1:])
        stacks = {}
        for place, option in enumerate(by_audit):
            digest, started = self._written(option)
            if option.role is not None:
                self._add(digest, started, option.role, text)
            state = option.node.state
            stacks[state] = Stack(option.node, option.order[0], place, digest)
            letter = LETTERS.index(option.order[2][-1])
            steps[state] = option.origin.node.state << 4 | len(option.inserted) << 2 | letter
        self.stacks = stacks
        self.trail += steps

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair."""
        options = [o for s, o in self._with_insertions().items() if s in ACCEPTING]
        best = min(options, key=lambda o: o.order)
        parts = [best.order[2]]
        state = best.origin.node.state
        for at in range(len(self.trail) - STATES, -1, -STATES):
            step = self.trail[at + state]
            parts.append(INSERTED * (step >> 2 & 3) + LETTERS[step & 3])
            state = step >> 4
        return best.order[0], "".join(reversed(parts)), self._written(best)[0].hexdigest()


class Conversation:
    """What is counted of one conversation while its rows pass."""

    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.faults = [0, 0, 0, 0]
        self.least = self.most = self.last_initial = None
        self.turns = self.illegal = 0

    def row(self, turn, role: str, text: bytes, fault: int) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        initial = role[:1]
        self.illegal += self.last_initial is not None and self.last_initial + initial not in ADJACENT
        self.last_initial = initial
        self.faults[fault] += 1
        self.repair.row(role, text, fault)

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        found = (gaps, *self.faults[1:], self.illegal)
        return (self.conv_id, *found, *self.repair.end())


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped: rows damaged by a hash of conversation and turn."""
    space = F.lit(" ")
    said = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    name = F.concat_ws(
        ":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    )
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.regexp_replace("text", ENDINGS, "")
    )
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return said.withColumn("kind", kind).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order, with the first fault of each.

    ``rows`` may have ``dropped``: such rows only stand for their conversation.
    """
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", "role", "text", dropped.alias("dropped"))
    together = rows.repartition("conv_id")
    order = [F.asc_nulls_first("turn")]
    # within the partitions by conv_id: sorted, not shuffled again
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(*order)
    fault = (
        F.when(F.col("dropped"), SOUND)
        .when(~F.col("text").rlike(INK), BLANK)
        .when(F.col("copy") > 1, DUPLICATE)
        .when(~F.col("text").rlike(rf"{ENDINGS}{SPACE}*\z"), TRUNCATED)
        .otherwise(SOUND)
    )
    counted = together.withColumn("copy", F.row_number().over(same)).withColumn("fault", fault)
    return counted.sortWithinPartitions("conv_id", *order, "role", "text", "copy")


RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint,"
    " illegal bigint, cost bigint, audit string, repaired_sha256 string"
)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_id``, ``turn``, ``role``, ``text`` (and ``dropped``)."""

    def parsed(batches: Batches) -> Iterator[tuple]:
        now = None
        for b in batches:
            columns = [b[c].to_pylist() for c in ("conv_id", "dropped", "turn", "role", "text", "fault")]
            for conv_id, dropped, turn, role, text, fault in zip(*columns):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield now.result()
                    now = Conversation(conv_id)
                if not dropped:
                    now.row(turn, role, text, fault)
        if now is not None:
            yield now.result()

    def run(batches: Batches) -> Batches:
        held = []
        for found in parsed(batches):
            held.append(found)
            if len(held) == 1024:
                yield as_batch(held)
                held = []
        yield as_batch(held)

    ordered = marked(rows).withColumn("text", F.col("text").cast("binary")).drop("copy")
    return ordered.mapInArrow(run, RESULT)


def as_batch(found: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in RESULT.split(", ")]
    kinds = [pa.string() if part.endswith("string") else pa.int64() for part in RESULT.split(", ")]
    columns = list(zip(*found)) or [[]] * len(names)
    return batch(**{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})
