"""Repair of conversation structure at the least cost, with an audit of every edit.

A repaired conversation has the role initials (s?(ua)+)?. Each row is kept, reroled or deleted, and empty turns may be
inserted anywhere. What is best from a row and a state of this pattern on is one integer: its high digits are the cost, its
low digits, three bits each and as many as an audit can have letters, are the audit's letters from the first one on, padded
with zeros at the end. Letters stand in ASCII order, so the smallest integer is the cheapest repair and, of equal ones, that
with the least audit; an edit adds to the high digits and moves the low ones one place down. The minimum of integers over a
graph of rows and states decides everything, and the winning integer spells out the audit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch

#: Costs of the edits, and of leaving a truncated text.
DELETE, INSERT, REROLE, LEFT_TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
LETTERS = " DIKR"
BITS = 3
#: States of the pattern: nothing yet, after a system, after a user, after an assistant turn; the first and the last may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
#: By state, the state and the role that may be put next, and by initial what a row may be kept as.
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LEGAL = {"su", "ua", "au"}
#: What is known of a row: its role's initial, whether it has to go, whether its text breaks off.
Row = tuple[str, bool, bool]


def cheapest(rows: Sequence[Row]) -> tuple[int, str]:
    """The least cost of a repair of rows and the least audit of that cost: the initials of its edits (Delete, Insert, Keep, Rerole) in order.

    Takes time in proportion to the square of the number of rows (integers are as long as audits), memory to the number.
    """
    # all deleted and a pair inserted is a way from any state, so no best way has more insertions than that costs
    places = len(rows) + (DELETE * len(rows) + 2 * INSERT) // INSERT + 2
    low = BITS * places
    letters, top = (1 << low) - 1, low - BITS
    codes = {x: k << top for k, x in enumerate(LETTERS)}
    never = (DELETE * (len(rows) + places) + 1 << low) << BITS

    def edit(letter: str, cost: int, rest: int) -> int:
        return never if rest >= never else ((rest >> low) + cost << low) | codes[letter] | ((rest & letters) >> BITS)

    def inserted(best: list[int]) -> list[int]:
        """best, when a turn or two may be put before what comes next; more than two come back to the same state."""
        once = [min(x, edit("I", INSERT, best[NEXT[s][0]])) for s, x in enumerate(best)]
        return [min(x, edit("I", INSERT, once[NEXT[s][0]])) for s, x in enumerate(once)]

    best = inserted([0, never, never, 0])
    for initial, gone, truncated in reversed(rows):
        now = []
        for s in range(4):
            ways = [edit("D", DELETE, best[s])]
            if not gone:
                left = LEFT_TRUNCATED * truncated
                ways.append(edit("R", REROLE + left, best[NEXT[s][0]]))
                if initial in KEEP[s]:
                    ways.append(edit("K", left, best[KEEP[s][initial]]))
            now.append(min(ways))
        best = inserted(now)
    cost, spelt, audit = best[START] >> low, best[START] & letters, []
    # in chunks, so that a long audit is not shifted letter by letter
    text = f"{spelt:0{places}o}" if spelt else ""
    for digit in text:
        if digit == "0":
            break
        audit.append(LETTERS[int(digit)])
    return cost, "".join(audit)


class Replay:
    """Goes along an audit and says what each edit leaves."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _placed(self, role: str | None, text: str) -> tuple[str, str, str]:
        letter = self.audit[self.at]
        self.at += 1
        if role is None:
            self.state, role = NEXT[self.state]
        else:
            self.state = KEEP[self.state][role[:1]]
        return role, text, letter

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(role, text, edit) of the turns inserted at this point."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._placed(None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What comes out up to and with the next row: insertions before it, then the row unless it is deleted."""
        yield from self.inserted()
        if self.audit[self.at] == "D":
            self.at += 1
        else:
            yield self._placed(None if self.audit[self.at] == "R" else role, text)


def _ordered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) without nulls in role and text, and their digest, which orders rows of equal turn."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PLANNED = pa.struct([("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


class _Faults:
    """Counts the faults of one conversation, row by row."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low: int | None = None
        self.high: int | None = None

    def add(self, turn: int | None, initial: str, digest: bytes, blank: bool, open_end: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.rows and self.rows[-1][0] + initial not in LEGAL:
            self.illegal += 1
        again = digest in self.seen
        self.seen.add(digest)
        truncated = open_end and not blank and not again
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += truncated
        self.rows.append((initial, blank or again, truncated))

    def plan(self) -> dict:
        cost, audit = cheapest(self.rows)
        gaps = self.high - self.low + 1 - self.turns if self.high is not None else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


def plan_repairs(rows: DataFrame) -> DataFrame:
    """A row per conv_id of rows (conv_id, turn, role, text): conv_id and plan, a struct of gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows go by turn, null first, equal ones by a digest of role and text. A row's first fault counts: blank (nothing but
    blanks), duplicate (role and text stood earlier in the conversation), truncated (its last character that is no blank is
    none of . ! ?). gaps are the turn numbers missing between the least and the greatest. illegal are neighbours whose
    initials are none of su, ua, au. Null roles and texts are one space; an empty role has a space as its initial, so it is
    never kept; a null conv_id is one conversation. Repeated rows are duplicates. Texts aren't shuffled here: a task goes through
    sorted rows of some 50 bytes each, and holds of one conversation a digest and a few flags a row.
    An empty table gives an empty result; further columns aren't read.
    """
    slim = _ordered(rows)
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    initial = F.when(F.col("role") == "", F.lit(" ")).otherwise(F.substring("role", 1, 1))
    slim = slim.select("conv_id", "turn", "digest", initial.alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("open_end"))
    slim = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest")

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, faults, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("plan", PLANNED)])
            done: list[dict] = []
            for conv, *row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 2, 4, 5)), strict=True):
                if faults is None or conv != name:
                    if faults:
                        done.append({"conv_id": name, "plan": faults.plan()})
                    name, faults = conv, _Faults()
                faults.add(*row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if faults:
            yield pa.RecordBatch.from_pylist([{"conv_id": name, "plan": faults.plan()}], schema)

    return slim.mapInArrow(planned, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, plan struct<{PLAN.replace(' ', ':').replace(',:', ',')}>")


def _streamed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, in the partition that it hashes to."""
    rows = _ordered(rows).select("conv_id", F.lit(1).alias("_kind"), "turn", "digest", "role", "text", F.lit(None).cast(plans.schema["plan"].dataType).alias("plan"))
    none = F.lit(None)
    heads = plans.select("conv_id", F.lit(0).alias("_kind"), none.cast("long").alias("turn"), none.cast("binary").alias("digest"), none.cast("string").alias("role"), none.cast("string").alias("text"), "plan")
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "_kind", "turn", "digest").select("conv_id", "plan", "role", "text")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The repaired conversations, a row per turn: conv_id, place (from 0), role, text, edit (I, K or R).

    rows as for plan_repairs(); the plans are written to the shared folder. Inserted turns have empty texts; what is deleted has
    no row. Texts are streamed: a task holds one at a time.
    """
    plans = Scratch(rows.sparkSession, "repair").write(plan_repairs(rows), "plans")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, replay, place, schema = None, None, 0, None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
            out: list[dict] = []
            for conv, plan, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                turns = (replay.inserted() if replay else ()) if plan else replay.row(role, text)
                for r, t, edit in turns:
                    out.append({"conv_id": name, "place": place, "role": r, "text": t, "edit": edit})
                    place += 1
                if plan:
                    name, replay, place = conv, Replay(plan["audit"]), 0
            yield pa.RecordBatch.from_pylist(out, schema)
        if replay:
            out = [{"conv_id": name, "place": place + k, "role": r, "text": t, "edit": e} for k, (r, t, e) in enumerate(replay.inserted())]
            yield pa.RecordBatch.from_pylist(out, schema)

    return _streamed(rows, plans).mapInArrow(repaired, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, role string, text string, edit string")


def audit_conversations(rows: DataFrame) -> DataFrame:
    """A row per conv_id of rows: what plan_repairs() finds, and repaired_sha256 of the repaired conversation, role:text by newlines, in lowercase hex.

    As repair_conversations(), whose rows it digests as they come instead of returning them.
    """
    plans = Scratch(rows.sparkSession, "repair").write(plan_repairs(rows), "plans")

    class Digest:
        def __init__(self, conv: object, plan: dict):
            self.head, self.replay = {"conv_id": conv, **plan}, Replay(plan["audit"])
            self.sha, self.any = sha256(), False

        def add(self, turns: Iterator[tuple[str, str, str]]) -> None:
            for role, text, _ in turns:
                self.sha.update(f"{chr(10) * self.any}{role}:{text}".encode("utf-8", "surrogatepass"))
                self.any = True

        def row(self) -> dict:
            self.add(self.replay.inserted())
            return {**self.head, "repaired_sha256": self.sha.hexdigest()}

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = None, None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *PLANNED, ("repaired_sha256", pa.string())])
            out: list[dict] = []
            for conv, plan, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if plan:
                    if now:
                        out.append(now.row())
                    now = Digest(conv, plan)
                else:
                    now.add(now.replay.row(role, text))
            yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    return _streamed(rows, plans).mapInArrow(digested, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {PLAN}, repaired_sha256 string")
