"""Repair of conversation structure at least cost, by one suffix-shared automaton over all conversations.

A row counts by the initial of its role (``s``, ``u``, ``a``, others ``o``) and by its first fault: *blank* (only white
space), *duplicate* (role and text seen earlier in the conversation) or *truncated* (the last visible character is none
of ``.!?``). One letter a row makes the signature of a conversation: ``x`` for a row that must go, else the role, in upper
case if truncated. Edits make the role initials fit ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (2), Delete (3)
and Insert of an empty user or assistant turn (2); a truncated row that stays costs 1 more.

Signatures are read from their ends and share every common suffix: a node of the automaton is one distinct suffix. For
each node and each state of the grammar the cost still to go and the next edit of the best audit are worked out once; the
rest of that audit is the one of the node and state that follow, so audits share suffixes too. Of equally cheap audits
the least in ASCII counts. Two edits of one letter never compete, so the next letters decide. Conversations come sorted by
reversed signature: only the path of the signature at hand is held, and a node is met again only while it is on the path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of ``[\\x20\\x09-\\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: nothing written, then after a system, user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}

Node = tuple[tuple[int, ...], str]


def answer(state: int) -> int:
    """State after the turn that the grammar takes next: user or assistant."""
    return ASSISTANT if state == USER else USER


def kept(role: str, state: int) -> int | None:
    """State after a kept row of this role initial, if the grammar takes it."""
    if role == "s" and state == START:
        return SYSTEM
    if (role == "u" and state != USER) or (role == "a" and state == USER):
        return answer(state)
    return None


#: After the last row: costs to go and next edit in each state, blank where nothing is missing.
END: Node = ((0, 2 * INSERT, INSERT, 0), " II ")


def node(letter: str, following: tuple[int, ...]) -> Node:
    """Costs to go and next edits before a row of this letter, from the costs to go after it."""
    role, stays = letter.lower(), TRUNCATED if letter.isupper() else 0
    best = []
    for state in range(4):
        options = [(DELETE + following[state], "D")]
        if role != "x":
            options.append((REROLE + stays + following[answer(state)], "R"))
            if (after := kept(role, state)) is not None:
                options.append((stays + following[after], "K"))
        best.append(min(options))
    for _ in range(2):  # inserts chain at most twice: system, user, assistant
        best = [min(best[s], (INSERT + best[answer(s)][0], "I")) for s in range(4)]
    return tuple(b[0] for b in best), "".join(b[1] for b in best)


class Automaton:
    """The path of one signature from its end on, which the next signature shares as far as their suffixes agree."""

    def __init__(self) -> None:
        self.reversed = ""
        self.path: list[Node] = [END]
        self.base = [0]
        self.made = 0
        self.steps: dict[tuple[str, tuple[int, ...]], tuple[int, Node]] = {}

    def step(self, letter: str, following: tuple[int, ...]) -> tuple[int, Node]:
        """A node with costs from 0 on, and what they lie above those of the node that follows. Few differ."""
        if (letter, following) not in self.steps:
            costs, edits = node(letter, following)
            least = min(costs)
            self.steps[letter, following] = least, (tuple(c - least for c in costs), edits)
        return self.steps[letter, following]

    def audit(self, backward: str) -> tuple[int, str]:
        """Cost and audit of the signature that reads ``backward`` from its end."""
        if backward != self.reversed:
            shared = 0
            for a, b in zip(backward, self.reversed, strict=False):
                if a != b:
                    break
                shared += 1
            del self.path[shared + 1 :], self.base[shared + 1 :]
            for letter in backward[shared:]:
                more, new = self.step(letter, self.path[-1][0])
                self.path.append(new)
                self.base.append(self.base[-1] + more)
                self.made += 1
            self.reversed = backward
        edits, state = [], START
        for at in range(len(backward), -1, -1):
            while (edit := self.path[at][1][state]) == "I":
                edits.append("I")
                state = answer(state)
            if at:
                edits.append(edit)
                if edit == "K":
                    state = kept(backward[at - 1].lower(), state)
                elif edit == "R":
                    state = answer(state)
        return self.base[-1] + self.path[-1][0][START], "".join(edits)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` (conv_id, turn, role, text) with planted faults, by the CRC of ``conv_id:turn`` mod 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 sets role user. A null role, text or
    part of the key counts as one space."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.crc32(F.concat_ws(":", *parts).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.where(code != 0).select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies)
    )
    return rows.drop("col")


def prepared(turns: DataFrame) -> DataFrame:
    """The four columns that count, without nulls in role and text, with the digest that orders equal turns."""
    space = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )
    return rows.withColumn("digest", F.unhex(F.md5("text")))


def letters(rows: DataFrame) -> DataFrame:
    """``prepared`` rows without their text: whether blank or truncated, and whether role and text stand at an earlier
    turn. Only digests that stand at several turns of a conversation are joined back."""
    visible = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    small = rows.select(
        "conv_id",
        "turn",
        "role",
        "digest",
        initial.alias("initial"),
        (visible == "").alias("blank"),
        (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    content = ["conv_id", "role", "digest"]
    spread = small.groupBy(*content).agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.max(F.col("turn").isNull()).alias("without")
    )
    spread = spread.where((F.col("low") < F.col("high")) | (F.col("without") & F.col("low").isNotNull()))
    spread = spread.select(*[F.col(c).alias(f"_{c}") for c in content], "low", "without")
    same: Column = F.lit(True)
    for c in content:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    again = F.col("turn").isNotNull() & (F.col("without") | (F.col("turn") > F.col("low")))
    return small.join(spread, same, "left").select(*small.columns, F.coalesce(again, F.lit(False)).alias("again"))


SUMMARY = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]
    + [("backward", pa.string())]
)
COUNTS_SQL = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


class Reading:
    """Counts and signature of one conversation, row by row in order; a byte a row is all it keeps."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.signature = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.turn = self.initial = self.row = None

    def add(self, turn: int | None, role: str, digest: bytes, initial: str, blank: bool, truncated: bool, again: bool) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turns += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        again = again or (turn, role, digest) == self.row
        self.turn, self.initial, self.row = turn, initial, (turn, role, digest)
        letter = initial if initial in ("s", "u", "a") else "o"
        if blank or again:
            self.blank += blank
            self.duplicate += not blank
            letter = "x"
        elif truncated:
            self.truncated += 1
            letter = letter.upper()
        self.signature += letter.encode()

    def summary(self) -> dict:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        out = {"conv_id": self.conv_id, "gaps": gaps, "backward": self.signature[::-1].decode()}
        return out | {c: getattr(self, c) for c in ("blank", "duplicate", "truncated", "illegal")}


def summaries(rows: DataFrame) -> DataFrame:
    """Counts and reversed signature of each conversation of ``prepared`` rows. Sorted rows stream through the tasks."""
    order = ["conv_id", "turn", "role", "digest"]
    columns = [*order, "initial", "blank", "truncated", "again"]
    dealt = letters(rows).repartition("conv_id").sortWithinPartitions(*order).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Reading | None = None
        for batch in batches:
            out = []
            for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if own is None or own.conv_id != conv_id:
                    if own is not None:
                        out.append(own.summary())
                    own = Reading(conv_id)
                own.add(*row)
            yield pa.RecordBatch.from_pylist(out, SUMMARY)
        if own is not None:
            yield pa.RecordBatch.from_pylist([own.summary()], SUMMARY)

    return dealt.mapInArrow(run, f"{COUNTS_SQL}, backward string")


def audited(turns: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of each conversation of ``turns`` (conv_id, turn, role, text; further columns are
    ignored): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Turns are taken by number, null first, equal numbers by role and digest of the text. A null role or text counts as one
    space; rows of a null conv_id are one conversation; equal rows are duplicates of the first of them. gaps counts turn
    numbers missing between the least and the largest, illegal the neighbouring role initials other than su, ua and au. No
    rows give no rows. Equal signatures may lie in several tasks, so a common one makes none of them large; a conversation
    takes some 20 bytes a row in the task that reads its signature, and its audit is one value."""
    found = summaries(prepared(turns)).repartitionByRange("backward", "conv_id").sortWithinPartitions("backward")
    counts = [c.split()[0] for c in COUNTS_SQL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, last, found = Automaton(), None, (0, "")
        for batch in batches:
            costs, audits = [], []
            for backward in batch.column("backward").to_pylist():
                if backward != last:
                    last, found = backward, automaton.audit(backward)
                costs.append(found[0])
                audits.append(found[1])
            columns = {c: batch.column(c) for c in counts}
            columns |= {"cost": pa.array(costs, pa.int64()), "audit": pa.array(audits, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return found.mapInArrow(run, f"{COUNTS_SQL}, cost bigint, audit string")


REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64())]
    + [("role", pa.string()), ("text", pa.string())]
)


class Editing:
    """One conversation while its audit is applied to its rows."""

    def __init__(self, conv_id: int | None, audit: str) -> None:
        self.conv_id, self.audit = conv_id, audit
        self.at = self.place = 0
        self.state = START

    def write(self, edit: str, turn: int | None, role: str, text: str) -> dict:
        values = (self.conv_id, self.place, edit, turn, role, text)
        self.place += 1
        return dict(zip(REPAIRED.names, values, strict=True))

    def inserts(self) -> Iterator[dict]:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = answer(self.state)
            self.at += 1
            yield self.write("I", None, ROLE[self.state], "")

    def row(self, turn: int | None, role: str, text: str) -> Iterator[dict]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = SYSTEM if role[0] == "s" else answer(self.state)
            yield self.write(edit, turn, role, text)
        elif edit == "R":
            self.state = answer(self.state)
            yield self.write(edit, turn, ROLE[self.state], text)


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Turns of the repaired conversations: conv_id, place (from 0), edit (K, R or I), turn, role, text.

    ``audits`` is what ``audited`` gives for the same turns, read from a table. Rows stream through the tasks after the
    audit of their conversation, and leave them in the order of conversation and place."""
    rows = prepared(turns).withColumn("audit", F.lit(None).cast("string"))
    heads = audits.select("conv_id", "audit").select(
        "conv_id", *[F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes if c not in ("conv_id", "audit")], "audit"
    )
    both = heads.union(rows).withColumn("head", F.col("audit").isNull())
    order = ["conv_id", "head", "turn", "role", "digest"]
    dealt = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Editing | None = None
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.slice(begin, 1024)
                out: list[dict] = []
                columns = (part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "audit"))
                for conv_id, turn, role, text, audit in zip(*columns, strict=True):
                    if audit is not None:
                        out += own.inserts() if own else ()
                        own = Editing(conv_id, audit)
                    else:
                        out += own.row(turn, role, text)
                yield pa.RecordBatch.from_pylist(out, REPAIRED)
        if own is not None:
            yield pa.RecordBatch.from_pylist(list(own.inserts()), REPAIRED)

    return dealt.mapInArrow(run, "conv_id bigint, place bigint, edit string, turn bigint, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text``, joined by new lines, of turns in the order that ``repaired`` gives."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest = None, None
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for conv_id, role, text in zip(*columns, strict=True):
                if digest is None or conv_id != own:
                    if digest is not None:
                        out.append({"conv_id": own, "repaired_sha256": digest.hexdigest()})
                    own, digest = conv_id, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": own, "repaired_sha256": digest.hexdigest()}], schema)

    return turns.mapInArrow(run, "conv_id bigint, repaired_sha256 string")
