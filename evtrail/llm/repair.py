"""Structure repair of conversations: the cheapest edits that make roles alternate, by a survivor Viterbi.

The rows of a conversation pass once, in order.  Four survivors (nothing kept yet, or last role s, u, a) share a tree of
backpointers with reference counts; as soon as all of them descend from one node, the edits up to it are
final and are given out, so that memory holds the unresolved part only.  Paths of equal cost are told apart by
their complete unresolved edits: at the node where they part, which jump pointers find.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, claim, slices

#: Which last role a role may follow; "" is nothing kept yet.
_AFTER = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}
_ROLES = {"u": "user", "a": "assistant"}
_FINAL = ("", "a")
_LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class Costs:
    """Costs of the edits; an insertion must cost something. `truncated` is added to a truncated row that stays."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class _Node:
    """One edit of a path. `refs` counts the survivors and the nodes that follow, which `kids` holds by their edit: two
    ways on from a node never have the same edit."""

    __slots__ = ("depth", "edit", "jump", "kids", "parent", "payload", "refs")

    def __init__(self, parent: _Node | None, edit: str, payload: tuple | None):
        self.parent, self.edit, self.payload, self.refs, self.kids = parent, edit, payload, 0, {}
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, j = parent.depth + 1, parent.jump
            self.jump = j.jump if parent.depth - j.depth == j.depth - j.jump.depth else parent


def _before(a: _Node, b: _Node) -> bool:
    """Whether a's edits come before b's: decided where the paths part, in a logarithm of the unresolved edits."""
    if a.depth > b.depth:
        return not _before(b, a)
    last_b = b
    while b.depth > a.depth:
        last_b = b
        b = b.jump if b.jump.depth > a.depth else b.parent
    if a is b:
        return last_b is not b  # a is where b goes on from
    while a.parent is not b.parent:
        a, b = (a.parent, b.parent) if a.jump is b.jump else (a.jump, b.jump)
    return a.edit < b.edit


class Viterbi:
    """Takes the rows of one conversation by push() and hands (edit, payload) to `emit` in order: payload is the (role, text)
    of a row that stays, None of one that goes.  finish() hands over the rest and returns the cost."""

    def __init__(self, emit: Callable[[str, tuple | None], None], costs: Costs = Costs()):  # noqa: B008
        if costs.insert <= 0:
            raise ValueError("an insertion must cost something")
        self.emit, self.costs, self.live = emit, costs, 0
        # from any survivor two insertions and a deletion do what any other can do, so one that is dearer by more is lost
        self.slack = 2 * costs.insert + costs.delete
        self.root = _Node(None, "", None)
        self.best: dict[str, tuple[int, _Node]] = {}
        self._survive(self._insertions({"": (0, self.root, "", None)}))

    def _offer(self, to: dict, state: str, cost: int, parent: _Node, edit: str, payload: tuple | None) -> None:
        """Candidates are (cost, parent, edit, payload): a node is made for those that survive only."""
        old = to.get(state)
        if old is None or cost < old[0]:
            to[state] = (cost, parent, edit, payload)
        elif cost == old[0] and (edit < old[2] if parent is old[1] else _before(_Node(parent, edit, None), _Node(old[1], old[2], None))):
            to[state] = (cost, parent, edit, payload)

    def _insertions(self, now: dict) -> dict[str, tuple[int, _Node]]:
        done: dict[str, tuple[int, _Node]] = {}
        while now:  # the cheapest state first: an insertion leads to dearer ones only
            state = min(now, key=lambda s: now[s][0])
            cost, parent, edit, payload = now.pop(state)
            node = _Node(parent, edit, payload) if edit else parent
            done[state] = (cost, node)
            for role in ("u", "a"):
                if state in _AFTER[role] and role not in done:
                    self._offer(now, role, cost + self.costs.insert, node, "I", (_ROLES[role], ""))
        least = min(c for c, _ in done.values())
        return {s: x for s, x in done.items() if x[0] <= least + self.slack}

    def push(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        now: dict[str, tuple] = {}
        c, extra, initial = self.costs, self.costs.truncated if truncated else 0, role[:1]
        for last, (cost, node) in self.best.items():
            self._offer(now, last, cost + c.delete, node, "D", None)
            if not must_go:
                if last in _AFTER.get(initial, ()):
                    self._offer(now, initial, cost + c.keep + extra, node, "K", (role, text))
                for to, name in _ROLES.items():
                    if last in _AFTER[to]:
                        self._offer(now, to, cost + c.rerole + extra, node, "R", (name, text))
        self._survive(self._insertions(now))

    def _survive(self, best: dict[str, tuple[int, _Node]]) -> None:
        for _, node in best.values():
            node.refs += 1
            while node.parent is not None and node.edit not in node.parent.kids:  # a new branch joins the tree
                node.parent.kids[node.edit] = node
                node.parent.refs += 1
                self.live += 1
                node = node.parent
        old, self.best = self.best, best
        for _, node in old.values():
            node.refs -= 1
            while node.refs == 0 and node is not self.root:
                up = node.parent
                del up.kids[node.edit]
                up.refs -= 1
                self.live -= 1
                node = up
        while self.root.refs == 1 and self.root.kids:  # all survivors come from here on
            (node,) = self.root.kids.values()
            self.root.kids, self.root.jump, node.parent = {}, self.root, None
            self.emit(node.edit, node.payload)
            self.live -= 1
            self.root, node.payload = node, None

    def finish(self) -> int:
        ends = [self.best[s] for s in _FINAL if s in self.best]
        cost, node = ends[0]
        for other, at in ends[1:]:
            if other < cost or (other == cost and _before(at, node)):
                cost, node = other, at
        edits = []
        while node is not self.root:
            edits.append(node)
            node = node.parent
        for at in reversed(edits):
            self.emit(at.edit, at.payload)
        return cost


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults by crc32("conv_id:turn") % 20: 0 drops the row (it stays as
    `gone`, so that its conversation is not lost), 1 empties its text, 2 takes out [.!?], 3 repeats the row, 4 makes
    the role user.  Nulls count as one blank, but for conv_id and turn themselves, which stay null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    at = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return at.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows with their faults, those of a conversation side by side in one partition, by turn (null first), role and text."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    seen = Window.partitionBy("conv_id", "gone", "role", F.sha2("text", 256)).orderBy("turn")
    at = rows.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1)  # no second shuffle: its key is finer
    fault = F.when(end == "", 1).when(F.col("again"), 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return at.withColumn("fault", fault).sortWithinPartitions("conv_id", "turn", "role", "text", "again").select("conv_id", "turn", "role", "text", "gone", "fault")


class _Conversation:
    """One conversation on its way through."""

    def __init__(self, conv_id, emit: Callable[[str, tuple | None], None] | None, costs: Costs):
        self.conv_id, self.counts, self.illegal, self.last = conv_id, [0, 0, 0, 0], 0, None
        self.turns, self.first, self.now = 0, None, None
        self.audit, self.hash, self.begun = [], hashlib.sha256(), False
        self.path = Viterbi(emit or self.note, costs)

    def note(self, edit: str, payload: tuple | None) -> None:
        self.audit.append(edit)
        if payload is not None:
            self.hash.update((("\n" if self.begun else "") + f"{payload[0]}:{payload[1]}").encode())
            self.begun = True

    def push(self, turn, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        if self.last is not None and self.last + role[:1] not in _LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None and turn != self.now:
            self.first, self.now, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.path.push(role, text, fault in (1, 2), fault == 3)

    def gaps(self) -> int:
        return 0 if self.first is None else self.now - self.first + 1 - self.turns


def _stream(batches: Iterator[pa.RecordBatch], make: Callable[[object], _Conversation]) -> Iterator[_Conversation | None]:
    """Passes the rows to their conversations; yields each when its rows are over, and None from time to time."""
    at = None
    for batch in slices(batches, 2000):
        for conv_id, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is None or conv_id != at.conv_id:
                if at is not None:
                    yield at
                at = make(conv_id)
            if not gone:
                at.push(turn, role, text, fault)
        yield None
    if at is not None:
        yield at


def repair(rows: DataFrame, *, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """rows are (conv_id, turn, role, text); one row an edit, in order: conv_id, at (from 0), edit (K keep, R rerole, D delete, I
    insert) and the role and text that stand there now (null where the row goes).  See report() for faults and ties."""
    ready = _ordered(_plain(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repair")
        out: list[tuple] = []

        def make(conv_id) -> _Conversation:
            n = 0

            def emit(edit: str, payload: tuple | None) -> None:
                nonlocal n
                out.append((conv_id, n, edit, *(payload or (None, None))))
                n += 1

            return _Conversation(conv_id, emit, costs)

        for done in _stream(batches, make):
            if done is not None:
                done.path.finish()
            if len(out) >= 2000 or done is None:
                yield _batch(out, names, types)
                out.clear()
        yield _batch(out, names, types)

    names, types = ["conv_id", "at", "edit", "role", "text"], [_arrow(ready), pa.int64(), pa.string(), pa.string(), pa.string()]
    return ready.mapInArrow(run, f"conv_id {ready.schema['conv_id'].dataType.simpleString()}, at long, edit string, role string, text string")


def report(rows: DataFrame, *, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """One row a conversation: conv_id, gaps (missing turns between the smallest and the largest), rows by their first fault (blank,
    duplicate of an earlier role and text, truncated: the last character that is not white space is none of .!?), illegal (neighbours
    whose role initials are not su, ua, au), cost and audit (the edits' initials) of the cheapest edits that leave the
    role initials as (s?(ua)+)? , of equally cheap ones the first in ASCII order, and the SHA-256 of the
    repaired "role:text" lines.

    Rows go by turn, null first, then role and text; repeated rows are rows.  A null role or text counts as one blank, a null
    conv_id is a conversation like others.  Rows marked `gone` count for nothing but that their conversation is there; a
    conversation without rows has zeros, an empty audit and the hash of the empty text; an empty table gives
    none; other columns are left out; long texts pass whole.
    One shuffle by conv_id; a conversation, however long, is a stream in one task that holds its unresolved edits and a
    letter of audit a row: a digest of all its lines in order has no other form."""
    ready = _ordered(_plain(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repair")
        out: list[tuple] = []
        for done in _stream(batches, lambda conv_id: _Conversation(conv_id, None, costs)):
            if done is not None:
                cost = done.path.finish()
                out.append((done.conv_id, done.gaps(), *done.counts[1:], done.illegal, cost, "".join(done.audit), done.hash.hexdigest()))
            elif out:
                yield _batch(out, names, types)
                out.clear()
        yield _batch(out, names, types)

    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names, types = ["conv_id", *longs, "audit", "repaired_sha256"], [_arrow(ready), *[pa.int64()] * len(longs), pa.string(), pa.string()]
    return ready.mapInArrow(run, f"conv_id {ready.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in longs) + ", audit string, repaired_sha256 string")


def _plain(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False).alias("gone")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), gone)


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
