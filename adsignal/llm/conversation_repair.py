"""Conversation repair: the cheapest edits that give turns a proper order of roles, by survivor-coalescence Viterbi.

A repaired conversation is empty or has role initials ``s?(ua)+``.  A row is kept (K), gets the role user or assistant (R),
or is deleted (D); an empty turn of user or assistant can be inserted anywhere (I).  The rows of a conversation pass by in
order.  For each of four states (nothing yet, after a system, user or assistant turn) the cheapest edits that lead there
survive, as the tip of a tree whose steps point back.  A step is freed when no survivor descends from it, and once all
survivors share an ancestor, the edits up to it are given out, texts included: only steps behind the last common ancestor
are held.  Equal costs are compared by the whole unresolved edits, up to where the two part, and the ASCII-least stay.
Survivors that no ending can make cheapest are dropped, so that survivors meet soon.

Defined cases: null role and text are one space, as is a null id or turn in the text of the damage hash; turns are in
order of turn (nulls first), then role and text; equal rows stay rows of their own, all but the first duplicates; rows
without a conversation id are one conversation; a conversation whose rows are all gone has one row of nulls among the
edits; empty tables give empty results; extra columns are not carried; very long texts pass through one at a time.

A digest over the whole conversation is sequential, so a conversation is one task's work, read from a spillable sort: a
very long one takes time, not memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOTHING, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
#: The initials that a kept turn may have after each state, and the one that a new or renamed turn has.
KEPT = {NOTHING: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NEW = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
INSERT, DELETE, RENAME, TRUNCATED = 2, 3, 2, 1
#: By how much going on from the second state can at most be dearer than from the first.
DEARER = {
    (NOTHING, SYSTEM): 2 * INSERT, (NOTHING, USER): DELETE + INSERT, (NOTHING, ASSISTANT): DELETE,
    (SYSTEM, NOTHING): 0, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 0,
    (USER, NOTHING): INSERT, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT,
    (ASSISTANT, NOTHING): 0, (ASSISTANT, SYSTEM): 2 * INSERT, (ASSISTANT, USER): INSERT,
}
#: What each state lacks at the end.
ENDING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

#: How many rows and signs a task gives out at once.
ROWS, SIGNS = 4096, 1 << 22


def ways(initial: str, must_go: bool, truncated: bool) -> dict[str, list[tuple[str, int, str]]]:
    """By the state after a row: (state before it, cost, edits), with inserts in front of the row as useful."""
    best: dict[tuple[str, str], tuple[int, str]] = {}
    for before in KEPT:
        state, inserts = before, ""
        while len(inserts) <= 2:
            cost = INSERT * len(inserts)
            found = [(state, cost + DELETE, inserts + "D")]
            if not must_go:
                late = TRUNCATED if truncated else 0
                found.append((NEW[state], cost + RENAME + late, inserts + "R"))
                if initial and initial in KEPT[state]:
                    found.append((initial, cost + late, inserts + "K"))
            for after, *rest in found:
                best[before, after] = min(best.get((before, after), (1 << 30, "")), tuple(rest))
            state, inserts = NEW[state], inserts + "I"
    out: dict[str, list[tuple[str, int, str]]] = {}
    for (before, after), (cost, letters) in best.items():
        out.setdefault(after, []).append((before, cost, letters))
    return out


WAYS = {(i, must, late): ways(i, must, late) for i in ("", SYSTEM, USER, ASSISTANT) for must in (False, True) for late in (False, True)}


class Step:
    """The edits around one row: references are the steps that follow it and, at a tip, its survivor."""

    __slots__ = ("kids", "letters", "parent", "row", "survives")

    def __init__(self, letters: str, row: Any, parent: Step | None) -> None:
        self.letters, self.row, self.parent, self.kids, self.survives = letters, row, parent, [], True
        if parent is not None:
            parent.kids.append(self)


class Survivors:
    """The cheapest edits to each state so far.  ``feed`` and ``finish`` give out (edits, row) as soon as they are certain."""

    def __init__(self) -> None:
        self.root = Step("", None, None)
        self.tips = {NOTHING: (0, self.root)}

    def _less(self, a: str, with_a: str, b: str, with_b: str) -> bool:
        one, other, left, right = self.tips[a][1], self.tips[b][1], [with_a], [with_b]
        while one is not other:
            left.append(one.letters)
            right.append(other.letters)
            one, other = one.parent, other.parent
        return "".join(reversed(left)) < "".join(reversed(right))

    def _resolved(self) -> Iterator[tuple[str, Any]]:
        while len(self.root.kids) == 1 and not self.root.survives:
            self.root = self.root.kids[0]
            self.root.parent = None
            yield self.root.letters, self.root.row

    def feed(self, initial: str, must_go: bool, truncated: bool, row: Any) -> Iterator[tuple[str, Any]]:
        best: dict[str, tuple[int, str, str]] = {}
        for after, found in WAYS[initial if initial in ROLES or initial == SYSTEM else "", must_go, truncated].items():
            for before, cost, letters in found:
                if before not in self.tips:
                    continue
                cost += self.tips[before][0]
                known = best.get(after)
                if known is None or cost < known[0] or (cost == known[0] and self._less(before, letters, known[1], known[2])):
                    best[after] = (cost, before, letters)
        alive = {x: b for x, b in best.items() if not any(y != x and c[0] + DEARER[x, y] < b[0] for y, c in best.items())}
        tips = {after: (cost, Step(letters, row, self.tips[before][1])) for after, (cost, before, letters) in alive.items()}
        for _, step in self.tips.values():
            step.survives = False
            while not step.kids and not step.survives and step.parent is not None:
                step.parent.kids.remove(step)
                step = step.parent
        self.tips = tips
        yield from self._resolved()

    def finish(self) -> Iterator[tuple[str, Any]]:
        best: tuple[int, str] | None = None
        for state, (cost, _) in self.tips.items():
            cost += INSERT * len(ENDING[state])
            if best is None or cost < best[0] or (cost == best[0] and self._less(state, ENDING[state], best[1], ENDING[best[1]])):
                best = cost, state
        step, path = self.tips[best[1]][1], []
        while step is not self.root:
            path.append((step.letters, step.row))
            step = step.parent
        yield from reversed(path)
        yield ENDING[best[1]], None


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by crc32 of ``conv_id:turn`` modulo 20, nulls replaced by a space.

    0: the row is gone; 1: no text; 2: no sentence ends; 3: the row twice; 4: the role is user.
    """
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text, kind = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col("kind")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(named.cast("binary")) % 20).alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).when(kind > 0, F.col("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).when(kind > 0, F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"))


def marked(rows: DataFrame) -> DataFrame:
    """Rows with their first ``fault`` (blank, duplicate, truncated or null), each conversation in order in one task."""
    rows = rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    blank, ended = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = rows.withColumn("fault", F.when(F.col("gone"), None).when(blank, "blank").when(again, "duplicate").when(~ended, "truncated"))
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", F.coalesce(F.col("fault") == "duplicate", F.lit(False)))


EDITS = "place long, edit string, turn long, was string, role string, text string, fault string"


def repaired(rows: DataFrame) -> DataFrame:
    """The edits of every conversation, in order: conv_id, place, edit (K, R, D, I), turn, was (the role before), role, text, fault.

    Rows that are ``gone`` only name their conversation.  The rows of a conversation follow each other in one partition.
    """
    rows = marked(rows)
    kind = rows.schema["conv_id"].dataType

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, held, names, started = None, [], 0, ["conv_id", *(x.split()[0] for x in EDITS.split(", "))], False
        conv, place, state, survivors = None, 0, NOTHING, Survivors()

        def laid(resolved: Iterator[tuple[str, Any]]) -> None:
            nonlocal place, state, held
            for letters, row in resolved:
                for letter in letters:
                    turn, was, text, fault = (None, None, "", None) if letter == "I" else row
                    role = was
                    if letter in "IR":
                        state = NEW[state]
                        role = ROLES[state]
                    elif letter == "K":
                        state = was[0]
                    out.append((conv, place, letter, turn, was, role, text, fault))
                    place, held = place + 1, held + len(text)

        def given() -> pa.RecordBatch:
            nonlocal out, held
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            kinds = [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        def closed() -> None:
            laid(survivors.finish())
            if not place:
                out.append((conv, 0, *[None] * 6))

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for this, turn, role, text, gone, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not started or this != conv:
                    if started:
                        closed()
                    started, conv, place, state, survivors = True, this, 0, NOTHING, Survivors()
                if not gone:
                    laid(survivors.feed(role[:1], fault in ("blank", "duplicate"), fault == "truncated", (turn, role, text, fault)))
                if len(out) >= ROWS or held >= SIGNS:
                    yield given()
        if started:
            closed()
            yield given()

    return rows.mapInArrow(edit, f"conv_id {kind.simpleString()}, {EDITS}")


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summarised(edits: DataFrame) -> DataFrame:
    """One row per conversation from the rows of ``repaired``, read in their order in the same tasks.

    gaps, counts of faults, illegal neighbours before the repair, cost, audit (the letters of all edits) and the digest of
    the repaired ``role:text`` rows.
    """
    kind = edits.schema["conv_id"].dataType
    legal = {before + after for before, nexts in KEPT.items() for after in nexts if before}

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, done, conv, found = None, ["conv_id", *(x.split()[0] for x in SUMMARY.split(", "))], [], None, None

        def fresh() -> dict[str, Any]:
            return {"first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "before": None, "cost": 0, "audit": [], "digest": hashlib.sha256(), "any": False}

        def closed() -> None:
            gaps = found["last"] - found["first"] + 1 - found["turns"] if found["turns"] else 0
            done.append((conv, gaps, *[found[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")], "".join(found["audit"]), found["digest"].hexdigest()))

        def given() -> pa.RecordBatch:
            nonlocal done
            columns, done = list(zip(*done, strict=True)), []
            kinds = [ids, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for this, place, edit, turn, was, role, text, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if place == 0:  # every conversation begins with it
                    if found is not None:
                        closed()
                    conv, found = this, fresh()
                if edit is None:
                    continue
                found["audit"].append(edit)
                if edit != "I":
                    if turn is not None and turn != found["last"]:
                        found["first"] = turn if found["first"] is None else found["first"]
                        found["last"], found["turns"] = turn, found["turns"] + 1
                    if found["before"] is not None and found["before"] + was[:1] not in legal:
                        found["illegal"] += 1
                    found["before"] = was[:1]
                    if fault:
                        found[fault] += 1
                found["cost"] += {"I": INSERT, "D": DELETE, "R": RENAME, "K": 0}[edit] + (TRUNCATED if fault == "truncated" and edit in "KR" else 0)
                if edit != "D":
                    found["digest"].update((("\n" if found["any"] else "") + f"{role}:{text}").encode())
                    found["any"] = True
            if len(done) >= ROWS:
                yield given()
        if found is not None:
            closed()
            yield given()

    columns = ["conv_id", *(x.split()[0] for x in EDITS.split(", "))]
    return edits.select(*columns).mapInArrow(summarise, f"conv_id {kind.simpleString()}, {SUMMARY}")
