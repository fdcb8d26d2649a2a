"""Repair of conversation structure by Viterbi with coalescing survivors.

A sound conversation is empty or one optional system row and then user and assistant rows in turn,
beginning with a user and ending with an assistant; a role counts by its initial. A row may be kept (K),
given the role user or assistant (R), or deleted (D); an empty row of either role may be inserted
anywhere (I). The cheapest edits are taken, among equally cheap ones the edit string that comes first in
ASCII order.

The search runs over four states (nothing written yet, or the last role written). Each state has one
*survivor*, a path in a tree of backpointers whose nodes know how many paths use them. Where a survivor
is replaced, nodes that nobody uses any more are freed; as soon as all survivors share an ancestor, the
edits up to it are final: they are emitted, and the tree shrinks to what is unresolved. A state whose path
costs so much more than another's that no cheapest path can go through it has no survivor. Equally cheap
survivors are compared over their complete unresolved suffixes: two paths first differ below their
lowest common node, which skip pointers find in logarithmic time.

Rows come sorted by conversation; a task reads row after row and holds one conversation's unresolved
rows, however long the conversation is.

Nulls in ``conv_id``, ``turn``, ``role`` and ``text`` are read as one space where they are part of a
text; null turns come first, and rows without a ``conv_id`` are one conversation. Rows of one turn are ordered by
role and text. Repeated rows are rows of their own, all but the first of them duplicates. A conversation
without rows is sound. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SPACE = " \t\n\x0b\x0c\r"
RELABEL, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
# For each state the roles that may follow, by initial, and the state they lead to.
_NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_GIVEN = {"u": "user", "a": "assistant"}
# (state, other, cost): whatever follows ``state`` can follow ``other`` for at most ``cost`` more, by inserting
# the missing row or deleting a system row that ``state`` alone may keep.
_INSTEAD = ((NOTHING, ASSISTANT, DELETE), (NOTHING, USER, INSERT + DELETE), (SYSTEM, NOTHING, 0), (SYSTEM, ASSISTANT, 0),
            (SYSTEM, USER, INSERT), (USER, NOTHING, INSERT), (USER, SYSTEM, INSERT), (USER, ASSISTANT, INSERT),
            (ASSISTANT, NOTHING, 0), (ASSISTANT, USER, INSERT))
_ROWS = "conv_id bigint, turn bigint, role string, text string, gone boolean, copy int"
Edit = tuple[str, str | None, str | None]


class Node:
    """One edit of a path. ``jump`` is an ancestor further up; ``uses`` counts children and survivors."""

    __slots__ = ("up", "jump", "depth", "edit", "uses", "children")

    def __init__(self, up: Node | None, edit: Edit | None):
        self.up, self.edit, self.uses, self.children = up, edit, 0, ()
        if up is None:
            self.depth, self.jump = 0, None
        else:
            self.depth = up.depth + 1
            far = up.jump
            even = far is not None and far.jump is not None and up.depth - far.depth == far.depth - far.jump.depth
            self.jump = far.jump if even else up


def _ancestor(node: Node, depth: int) -> Node:
    while node.depth > depth:
        far = node.jump
        node = far if far is not None and far.depth >= depth else node.up
    return node


def earlier(a: Node, b: Node) -> bool:
    """Does the edit string of ``a`` come before that of ``b``? Both hang below one root."""
    x, y = _ancestor(a, min(a.depth, b.depth)), _ancestor(b, min(a.depth, b.depth))
    if x is y:
        return a.depth < b.depth
    while x.up is not y.up:
        # The deepest pair of ancestors at one depth that still differs.
        if x.jump is not None and y.jump is not None and x.jump is not y.jump and x.jump.depth == y.jump.depth:
            x, y = x.jump, y.jump
        else:
            x, y = x.up, y.up
    return x.edit[0] < y.edit[0]


class Survivors:
    """The best path to each state after the rows read so far."""

    def __init__(self, emit: Callable[[Edit], None]):
        self._emit = emit
        self._root = Node(None, None)
        self._paths: list[tuple[int, Node] | None] = [(0, self._root), None, None, None]
        self._root.uses = 1
        self._close()

    def _better(self, found: list, state: int, cost: int, up: Node, edit: Edit) -> None:
        known = found[state]
        if known is not None and known[0] < cost:
            return
        node = Node(up, edit)
        if known is None or cost < known[0] or earlier(node, known[1]):
            found[state] = (cost, node)

    def _insert(self, found: list) -> None:
        """Inserted rows behind what is found; two rounds reach every state there is to reach."""
        for _ in range(2):
            for state, path in enumerate(list(found)):
                if path is not None:
                    for initial, role in _GIVEN.items():
                        if initial in _NEXT[state]:
                            self._better(found, _NEXT[state][initial], path[0] + INSERT, path[1], ("I", role, ""))

    def _close(self) -> None:
        found = list(self._paths)
        self._insert(found)
        self._replace(found)

    def _replace(self, found: list) -> None:
        """Take the new survivors, free what only the old ones used, emit what all new ones share."""
        for path in found:
            if path is not None:
                node = path[1]
                node.uses += 1
                # Nodes of this step hang themselves into the tree when a survivor first uses them.
                while node.uses == 1 and node.up is not None:
                    node.up.uses += 1
                    node.up.children += (node,)
                    node = node.up
        for path in self._paths:
            if path is not None:
                node = path[1]
                node.uses -= 1
                while node.uses == 0 and node is not self._root:
                    up = node.up
                    node.up = node.jump = None
                    up.uses -= 1
                    up.children = tuple(c for c in up.children if c is not node)
                    node = up
        self._paths = found
        while self._root.uses == 1 and self._root.children:
            node, = self._root.children
            self._emit(node.edit)
            self._root.children = ()
            self._root, node.up, node.jump = node, None, None

    @staticmethod
    def _drop_beaten(found: list) -> None:
        """Forget states that no cheapest path can go through: another state could follow the same way for
        ``_INSTEAD`` at most and still cost less. Without this the path that deletes everything would live on."""
        costs = [path and path[0] for path in found]
        for state, other, more in _INSTEAD:
            if costs[state] is not None and costs[other] is not None and costs[state] > costs[other] + more:
                found[state] = None

    def row(self, role: str, text: str, must_go: bool, cut_short: bool) -> None:
        found: list[tuple[int, Node] | None] = [None] * 4
        extra = CUT_SHORT if cut_short else 0
        for state, path in enumerate(self._paths):
            if path is None:
                continue
            cost, node = path
            self._better(found, state, cost + DELETE, node, ("D", None, None))
            if must_go:
                continue
            for initial, following in _NEXT[state].items():
                if role[:1] == initial:
                    self._better(found, following, cost + extra, node, ("K", role, text))
                elif initial in _GIVEN:
                    self._better(found, following, cost + RELABEL + extra, node, ("R", _GIVEN[initial], text))
        self._insert(found)
        self._drop_beaten(found)
        self._replace(found)

    def end(self) -> int:
        """Emit the rest of the best sound path; its cost."""
        cost, node = min((p for p in (self._paths[NOTHING], self._paths[ASSISTANT]) if p is not None),
                         key=lambda p: p[0])
        other = self._paths[NOTHING]
        if other is not None and other[0] == cost and other[1] is not node and earlier(other[1], node):
            node = other[1]
        other = self._paths[ASSISTANT]
        if other is not None and other[0] == cost and other[1] is not node and earlier(other[1], node):
            node = other[1]
        rest = []
        while node is not self._root:
            rest.append(node.edit)
            node = node.up
        for edit in reversed(rest):
            self._emit(edit)
        return cost


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults of known kinds, chosen by a checksum of conversation and turn; a dropped row stays as
    a row with ``gone``, so that its conversation is still known."""
    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("_"),
    ).drop("_")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text, gone) by conversation, then turn; ``copy`` numbers equal roles and
    texts of a conversation in that order, from 1. Both shuffles go by hash; what is hot in the first
    is a repeated text, in the second a conversation."""
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    numbered = rows.select("conv_id", "turn", "role", "text", "gone", F.row_number().over(same).alias("copy"))
    return numbered.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"))


class Conversation:
    """Counts of faults and the edits of one conversation, row by row."""

    def __init__(self, emit: Callable[[Edit], None]):
        self._survivors = Survivors(emit)
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self._first = self._turn = self._initial = None
        self._turns = 0

    def row(self, turn: int | None, role: str, text: str, copy: int) -> None:
        if turn is not None and turn != self._turn:
            self._first = turn if self._first is None else self._first
            self._turn, self._turns = turn, self._turns + 1
        said = text.strip(_SPACE)
        blank, repeated = not said, bool(said) and copy > 1
        cut_short = bool(said) and not repeated and said[-1] not in ".!?"
        self.blank += blank
        self.duplicate += repeated
        self.truncated += cut_short
        if self._initial is not None and self._initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self._initial = role[:1]
        self._survivors.row(role, text, blank or repeated, cut_short)

    @property
    def gaps(self) -> int:
        return self._turn - self._first + 1 - self._turns if self._turns else 0

    def end(self) -> int:
        return self._survivors.end()


def _conversations(batches: Iterator[pa.RecordBatch], start: Callable, done: Callable) -> Iterator[tuple]:
    """Feed sorted rows to one conversation after the other: ``start`` makes its state, ``done`` closes it."""
    now, state, begun = None, None, False
    for batch in batches:
        for conv, turn, role, text, gone, copy in zip(*[batch.column(i).to_pylist() for i in range(6)]):
            if not begun or conv != now:
                if begun:
                    yield from done(now, state)
                now, state, begun = conv, start(conv), True
            if not gone:
                yield from state.feed(turn, role, text, copy)
    if begun:
        yield from done(now, state)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


class _Edits:
    """Edits of a conversation as rows, handed out as soon as they are final."""

    def __init__(self, conv: int | None):
        self._conv, self._step, self._final = conv, 0, []
        self._rows = Conversation(self._final.append)

    def take(self) -> Iterator[tuple]:
        for edit, role, text in self._final:
            yield self._conv, self._step, edit, role, text
            self._step += 1
        self._final.clear()

    def feed(self, turn, role, text, copy) -> Iterator[tuple]:
        self._rows.row(turn, role, text, copy)
        yield from self.take()

    def end(self) -> Iterator[tuple]:
        self._rows.end()
        yield from self.take()


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, step, edit, role, text): the edits of every conversation in order; deletions have neither role
    nor text. The rows without the deletions are the repaired conversation. ``rows`` has (conv_id, turn, role,
    text) and may have ``gone``."""
    schema = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                        ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_conversations(batches, _Edits, lambda _, state: state.end()), schema, 1024)

    return in_order(_readable(rows)).mapInArrow(run, "conv_id bigint, step bigint, edit string, role string, text string")


def _readable(rows: DataFrame) -> DataFrame:
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    return rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       gone.alias("gone"))


class _Digest:
    def __init__(self, conv: int | None):
        self.audit: list[str] = []
        self.repaired = hashlib.sha256()
        self._any = False
        self.rows = Conversation(self._take)

    def _take(self, edit: Edit) -> None:
        kind, role, text = edit
        self.audit.append(kind)
        if kind != "D":
            self.repaired.update((("\n" if self._any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self._any = True

    def feed(self, turn, role, text, copy) -> Iterator[tuple]:
        self.rows.row(turn, role, text, copy)
        return iter(())


_DIGEST = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
           "cost bigint, audit string, repaired_sha256 string")


def digests(rows: DataFrame) -> DataFrame:
    """Faults, cost, edit string and a digest of the repaired rows, one row per conversation."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in counts], ("audit", pa.string()),
                        ("repaired_sha256", pa.string())])

    def done(conv: int | None, state: _Digest) -> Iterator[tuple]:
        cost, r = state.rows.end(), state.rows
        yield (conv, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, cost, "".join(state.audit),
               state.repaired.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_conversations(batches, _Digest, done), schema, 1024)

    return in_order(_readable(rows)).mapInArrow(run, _DIGEST)
