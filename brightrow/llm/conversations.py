"""Conversation structure repair by a Viterbi decoder whose survivors coalesce.

A conversation is in shape if its role initials read ``(s?(ua)+)?``. Rows are kept, given
the role user or assistant, or deleted, and rows without text are inserted, at the least
cost. The decoder walks the rows of a conversation in order with one survivor for each of
four states: nothing yet, after the system row, after a user row, after an assistant row.

Edits lie in a tree of runs with back references, one leaf per survivor. A run that lost its
last branch goes, and one that has a single branch left joins it; as soon as all survivors
share a first run, its edits are final and leave the tree. So memory follows the edits that
are still open. Each survivor carries its own digest of the repaired rows, so no text waits
for a decision.

Ties go to the edits that read least. Survivors are always different edits of the same rows,
and none can begin another, so their complete open suffixes stand in a fixed order; it is
carried as a place per survivor, and what is appended decides between children of one
survivor only. A survivor goes as soon as another one can follow whatever it may still do for
strictly less in all; else deleting everything would stay possible to the end, and no edit
would ever be final. An insertion before a deletion reads later than one after it and costs the
same, so insertions are tried before kept rows and at the end only.

Rows of a conversation go to one task, since its digest is one chain over its rows; they
stream through it in sorted order, and sorting spills. Order: turn (nulls first), role, text;
rows that repeat follow one another. A null role or text reads as one space, in the key of
the damage a null id or turn as well. A null ``conv_id`` is one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from brightrow.llm.common import batches, pick

WHITE = "\t\n\x0b\x0c\r "
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
IN_SHAPE = {"su", "ua", "au"}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


class Run:
    """Edits in a row without a branch."""

    __slots__ = ("edits", "children", "parent")

    def __init__(self, parent: Run | None):
        self.edits = bytearray()
        self.children: set[Run] = set()
        self.parent = parent
        if parent is not None:
            parent.children.add(self)


class Survivor:
    __slots__ = ("cost", "place", "run", "digest", "rows")

    def __init__(self, cost: int, place: int, run: Run, digest, rows: int):
        self.cost, self.place, self.run, self.digest, self.rows = cost, place, run, digest, rows


# Where a row that is written as state `to` may come from: directly, or after an inserted row.
DIRECT = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
FILLED = {USER: (USER,), ASSISTANT: (START, SYSTEM, ASSISTANT)}

# What it costs at most to follow any continuation of the first state from the second: a row
# inserted between (INSERT), and the system row that only a start can keep deleted (DELETE).
DETOUR = {
    (START, ASSISTANT): DELETE,
    (START, USER): INSERT + DELETE,
    (SYSTEM, ASSISTANT): 0,
    (SYSTEM, USER): INSERT,
    (USER, ASSISTANT): INSERT,
    (ASSISTANT, USER): INSERT,
}


class Decoder:
    """The cheapest edits of one conversation, fed row by row."""

    def __init__(self):
        self.root = Run(None)
        self.final = bytearray()
        self.survivors: dict[int, Survivor] = {START: Survivor(0, 0, self.root, hashlib.sha256(), 0)}

    def delete(self) -> None:
        """A row that has to go: every survivor deletes it."""
        for s in self.survivors.values():
            s.cost += DELETE
            s.run.edits += b"D"
        if len(self.survivors) == 1:
            self._emit()

    def feed(self, role: str, text: str, truncated: bool) -> None:
        """A row that may stay."""
        old = self.survivors
        surcharge = CUT if truncated else 0
        # Per new state: cost, place of the source, edits, source, roles of the written rows.
        best: dict[int, tuple] = {}

        def offer(to: int, source: int, cost: int, edits: bytes, written: tuple) -> None:
            s = old.get(source)
            if s is None:
                return
            mine = (s.cost + cost, s.place, edits)
            if to not in best or mine < best[to][0]:
                best[to] = (mine, source, written)

        for state in old:
            offer(state, state, DELETE, b"D", ())
        first = role[:1]
        if first == "s":
            offer(SYSTEM, START, surcharge, b"K", (role,))
        for to, letter in ((USER, "u"), (ASSISTANT, "a")):
            if first == letter:
                cost, edit, name = surcharge, b"K", role
            else:
                cost, edit, name = surcharge + REROLE, b"R", ROLES[to]
            for source in DIRECT[to]:
                offer(to, source, cost, edit, (name,))
            filler = ROLES[ASSISTANT if to == USER else USER]
            for source in FILLED[to]:
                offer(to, source, cost + INSERT, b"I" + edit, (filler, name))
        beaten = [
            state
            for (state, other), more in DETOUR.items()
            if state in best and other in best and best[other][0][0] + more < best[state][0][0]
        ]
        for state in beaten:
            best.pop(state, None)
        self._advance(best, text)

    def finish(self) -> tuple[int, str, str]:
        """Cost, edits and digest of the cheapest conversation in shape."""
        ends = ((START, b"", ()), (ASSISTANT, b"", ()), (USER, b"I", ("assistant",)), (SYSTEM, b"II", ("user", "assistant")))
        found = [
            ((s.cost + INSERT * len(edits), s.place, edits), state, written)
            for state, edits, written in ends
            if (s := self.survivors.get(state)) is not None
        ]
        mine, state, written = min(found)
        self._advance({state: (mine, state, written)}, "")
        last = self.survivors[state]
        return last.cost, self.final.decode("ascii"), last.digest.hexdigest()

    def _advance(self, best: dict[int, tuple], text: str) -> None:
        old = self.survivors
        users: dict[int, int] = {}
        for _, source, _ in best.values():
            users[source] = users.get(source, 0) + 1
        # Edits of different survivors are told apart already; of one, by what is appended.
        order = sorted(best, key=lambda to: best[to][0][1:])
        made = {}
        for place, to in enumerate(order):
            (cost, _, edits), source, written = best[to]
            s = old[source]
            users[source] -= 1
            alone = not users[source] and not s.run.children
            run = s.run if alone else Run(s.run)
            run.edits += edits
            digest = s.digest if not users[source] else s.digest.copy()
            rows = s.rows
            for k, name in enumerate(written):
                said = text if k == len(written) - 1 else ""
                digest.update(f"{chr(10) if rows else ''}{name}:{said}".encode())
                rows += 1
            made[to] = Survivor(cost, place, run, digest, rows)
        self.survivors = made
        dropped = [s.run for state, s in old.items() if state not in users]
        for run in dropped:
            self._release(run)
        self._emit()

    def _release(self, run: Run) -> None:
        """Drop a run without branches, and upwards; a run with one branch left joins it."""
        while run.parent is not None and not run.children:
            parent = run.parent
            parent.children.discard(run)
            run = parent
        if len(run.children) == 1 and run.parent is not None:
            (child,) = run.children
            run.edits += child.edits
            run.children = child.children
            for c in run.children:
                c.parent = run
            for s in self.survivors.values():
                if s.run is child:
                    s.run = run

    def _emit(self) -> None:
        """Edits before the first branch are final."""
        while True:
            self.final += self.root.edits
            self.root.edits.clear()
            if len(self.root.children) != 1:
                return
            (self.root,) = self.root.children
            self.root.parent = None


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped: rows damaged by the hash of their id and turn.

    A row that is to be dropped stays as a mark of its conversation, without a role or text.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    space = F.lit(" ")
    key = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    )
    rows = rows.withColumn("_kind", F.crc32(key) % 20)
    kind = F.col("_kind")
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 0, None).when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 0, None)
        .when(kind == 1, "")
        .when(kind == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_time"),
    ).drop("_time")


def _faulty_rows(rows: DataFrame) -> DataFrame:
    """Rows of each conversation together and in order, with the first fault of each.

    One shuffle: both sorts and the window keep to the partitions by conversation. The text
    of a row that must go is left behind.
    """
    tail = F.rtrim(F.col("text"), F.lit(WHITE))
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")) > 1
    # Without the mark an open end would be taken for one of the listed signs.
    whole = F.substring(tail, -1, 1).isin(".", "!", "?")
    fault = (
        F.when(F.col("dropped"), SOUND)
        .when(tail == "", BLANK)
        .when(again, DUPLICATE)
        .when(~whole, TRUNCATED)
        .otherwise(SOUND)
    )
    marked = rows.repartition("conv_id").withColumn("_fault", fault)
    ordered = marked.sortWithinPartitions("conv_id", "turn", "role", "text")
    needed: Column = F.when(F.col("_fault").isin(SOUND, TRUNCATED), F.col("text"))
    return ordered.select("conv_id", "turn", "role", needed.alias("text"), "dropped", "_fault")


class _Report:
    """Counts and edits of the conversation at hand."""

    def __init__(self, name):
        self.name = name
        self.decoder: Decoder | None = None
        self.low = self.high = self.last = None
        self.turns = 0
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.initial: str | None = None

    def add(self, turn, role: str, text: str | None, fault: int) -> None:
        if self.decoder is None:
            self.decoder = Decoder()
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.last:
                self.turns += 1
                self.last = self.high = turn
        self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in IN_SHAPE:
            self.illegal += 1
        self.initial = role[:1]
        if fault in (BLANK, DUPLICATE):
            self.decoder.delete()
        else:
            self.decoder.feed(role, text or "", fault == TRUNCATED)

    def row(self) -> tuple:
        cost, audit, digest = self.decoder.finish() if self.decoder else (0, "", hashlib.sha256().hexdigest())
        gaps = 0 if self.low is None else int(self.high - self.low + 1 - self.turns)
        _, blank, duplicate, truncated = self.faults
        return self.name, gaps, blank, duplicate, truncated, self.illegal, cost, audit, digest


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id``: gaps, faults, cost, edits (K, R, D, I) and digest of the repaired rows.

    ``rows`` has conv_id, turn, role, text and optionally ``dropped``; conversations of
    dropped rows only have zeros, no edits and the digest of nothing.
    """
    if "dropped" not in rows.columns:
        rows = pick(rows, "conv_id", "turn", "role", "text").select(
            "conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(False).alias("dropped")
        )
    schema = T.StructType(
        [
            rows.schema["conv_id"],
            *T.StructType.fromDDL(
                "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
                "repaired_sha256 string"
            ),
        ]
    )

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, kind, names = None, None, schema.names

        def table(found: list[tuple]) -> pa.RecordBatch:
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found), types)], names=names)

        for chunk in chunks:
            kind, found = chunk.schema.field(0).type, []
            for name, turn, role, text, dropped, fault in zip(*[c.to_pylist() for c in chunk.columns]):
                if report is None or report.name != name:
                    if report is not None:
                        found.append(report.row())
                    report = _Report(name)
                if not dropped:
                    report.add(turn, role, text, fault)
            if found:
                yield table(found)
        if report is not None:
            yield table([report.row()])

    return batches(_faulty_rows(rows), run, schema)
