"""Conversations formatted into windows of a token budget, with a mask of the texts to learn.

A turn is written as ``<|turn|>role\\n``, its text and ``<|end|>\\n``. In roles and texts a backslash is put into
everything that could be read as a control string of this or another common template (``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``, ``<<SYS>>`` and those with backslashes already in them), so that it reads back exactly.

Prefix sums of turn tokens choose the spans: a window takes as many whole turns as fit. Every window starts with the
system turns that open the conversation, then repeats the last turns of the window before as far as ``HISTORY`` tokens
allow. Assistant texts are learnt once: in the window where they are new. Turns too long for the budget have a window to
themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 1_024
HISTORY = 256
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
CONTROL = regex.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)")
ESCAPED = regex.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)")
TURN = regex.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", regex.DOTALL)
TOKEN = regex.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def escape_role(role: str | None) -> str:
    """A role is one line; null is told apart from every string."""
    if role is None:
        return "~"
    return "=" + escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(written: str) -> str | None:
    return None if written == "~" else unescape(written[1:]).replace("%0A", "\n").replace("%25", "%")


class Windows:
    """Windows of one conversation, turn by turn; holds no more than a window, its history and the system turns."""

    def __init__(self, conv_id: int | None, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.number = 0
        self.system: list[tuple[str, str, int]] = []
        self.opening = True
        self.past: list[tuple[str, str, int]] = []
        self.fresh: list[tuple[str, str, int]] = []
        self.used = 0

    def add(self, role: str | None, text: str) -> dict | None:
        """Takes a turn; gives the window that it completes, if any."""
        turn = (escape_role(role), escape(text), len(TOKEN.findall(text)) + 4)
        if self.opening and role == "system":
            self.system.append(turn)
            return None
        self.opening = False
        head = sum(t[2] for t in self.system)
        done = None
        if self.fresh and head + self.used + turn[2] > self.budget:
            done = self.window()
            # Turns from the end whose prefix sums stay within both the history and what the new turn leaves.
            turns = self.past + self.fresh
            sums = np.cumsum([t[2] for t in reversed(turns)])
            room = min(self.history, self.budget - head - turn[2])
            count = int(np.searchsorted(sums, room, side="right"))
            self.past, self.fresh = turns[len(turns) - count :], []
            self.used = int(sums[count - 1]) if count else 0
        self.fresh.append(turn)
        self.used += turn[2]
        return done

    def window(self) -> dict:
        """The window of the turns at hand. System turns are new in the first window alone."""
        parts: list[str] = []
        spans, at = [], 0
        new_from = 0 if self.number == 0 else len(self.system) + len(self.past)
        for k, (role, text, _) in enumerate(self.system + self.past + self.fresh):
            head = f"{OPEN}{role}\n"
            parts += [head, text, CLOSE]
            if k >= new_from and role == "=assistant":
                spans.append({"start": at + len(head), "length": len(text)})
            at += len(head) + len(text) + len(CLOSE)
        out = {
            "conv_id": self.conv_id,
            "window": self.number,
            "new_from": new_from,
            "tokens": sum(t[2] for t in self.system) + self.used,
            "formatted": "".join(parts),
            "loss": spans,
        }
        self.number += 1
        return out

    def last(self) -> dict | None:
        return self.window() if self.fresh or (self.number == 0 and self.system) else None


FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("window", pa.int32()),
        ("new_from", pa.int32()),
        ("tokens", pa.int32()),
        ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ]
)
FORMATTED_SQL = (
    "conv_id bigint, window int, new_from int, tokens int, formatted string,"
    " loss array<struct<start: bigint, length: bigint>>"
)


def formatted(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of ``conversations`` (conv_id, turn, role, text; further columns are ignored).

    Returns conv_id, window, new_from (first turn of the window that no earlier one holds), tokens, formatted and loss
    (ranges of formatted, in code points). Turns are taken by number, null first, equal numbers by role and text; a null
    text counts as empty, rows of a null conv_id are one conversation, repeated rows are repeated turns. No rows give no
    rows.

    Rows are sorted by conversation and stream through a task, which holds one window at a time, however long a
    conversation is. Windows leave a task in the order of conversation and window, and a conversation stays in one
    partition."""
    columns = [F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text")]
    dealt = conversations.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Windows | None = None
        out: list[dict] = []
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.slice(begin, 1024)
                for conv_id, role, text in zip(
                    *(part.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True
                ):
                    if own is None or own.conv_id != conv_id:
                        if own is not None and (done := own.last()):
                            out.append(done)
                        own = Windows(conv_id, budget, history)
                    if done := own.add(role, text):
                        out.append(done)
                if out:
                    yield pa.RecordBatch.from_pylist(out, FORMATTED)
                    out = []
        if own is not None and (done := own.last()):
            yield pa.RecordBatch.from_pylist([done], FORMATTED)

    return dealt.mapInArrow(run, FORMATTED_SQL)


class Reading:
    """What one conversation's windows say, read back window by window."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, new_from: int, loss: list[dict]) -> None:
        self.chars += len(text)
        for k, (role, body) in enumerate(TURN.findall(text)):
            if k >= new_from:
                self.turns += 1
                self.all.update(f"{unescape_role(role) or ''}\n{unescape(body)}\n".encode())
        for span in loss:
            learnt = unescape(text[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id,
            "n_turns": self.turns,
            "turns_sha256": self.all.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
        }


READ_BACK = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of turns and learnt texts of each conversation, from formatted windows alone.

    Takes the windows in the order in which ``formatted`` leaves them; others are to be dealt and sorted by conv_id and
    window first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Reading | None = None
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "new_from", "formatted", "loss"))
            for conv_id, new_from, text, loss in zip(*columns, strict=True):
                if own is None or own.conv_id != conv_id:
                    if own is not None:
                        out.append(own.row())
                    own = Reading(conv_id)
                own.add(text, new_from, loss)
            yield pa.RecordBatch.from_pylist(out, READ_BACK)
        if own is not None:
            yield pa.RecordBatch.from_pylist([own.row()], READ_BACK)

    return windows.mapInArrow(
        run,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
        " formatted_chars bigint",
    )
