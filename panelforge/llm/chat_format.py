"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from a list of turns to a string. Successive prefixes of a conversation are rendered and
consecutive outputs compared: what a prefix adds after the longest common part is the new turn's span. If an output
doesn't begin with the one before it, the template rewrites history, which is reported and leaves the spans undefined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
START, END = "<|im_start|>", "<|im_end|>"
#: A control string inside a text, and one that is escaped already, gets one more bar.
ESCAPE = re.compile(r"<(\|+)(im_start|im_end)(\|+)>")


def escape(text: str) -> str:
    """text with every control string defused: <|im_end|> becomes <||im_end|>, <||im_end|> becomes <|||im_end|>, and so on."""
    return ESCAPE.sub(r"<\1|\2\3>", text)


def unescape(text: str) -> str:
    """The text that escape() made text of."""
    return re.sub(r"<\|(\|+)(im_start|im_end)(\|+)>", r"<\1\2\3>", text)


def render_chat(turns: Sequence[Turn]) -> str:
    """The production template: every turn as <|im_start|>role, newline, text, <|im_end|>, newline."""
    return "".join(f"{START}{escape(role)}\n{escape(text)}{END}\n" for role, text in turns)


def common_prefix(a: str, b: str) -> int:
    """How many characters a and b share from the start, by halving."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


#: Stands in for a text when a turn's frame is looked for; free of anything that templates escape or trim.
PROBE = "qzprobetextzq"


class Spans:
    """Adds turns one by one and locates each one's span in the rendered conversation.

    memory bounds what is rendered again: None renders all prefixes from the first turn on; a number says that the template
    looks back at most so many turns, so a prefix is rendered from there on (long conversations then take linear time), and
    holds() compares what was added with one rendering of the whole at the end.
    """

    def __init__(self, render: Callable[[Sequence[Turn]], str], memory: int | None = None):
        self.render, self.memory = render, memory
        self.turns: list[Turn] = []
        self.said: list[Turn] = []
        self.before, self.rewrites, self.at = render([]), False, 0
        self.at = len(self.before)
        self.sha = sha256(self.before.encode("utf-8", "surrogatepass"))

    def add(self, role: str, text: str) -> tuple[int, str, int, int]:
        """The new turn's start in the conversation, what it adds to it, and where in that its text begins and ends."""
        if self.memory is not None and len(self.turns) > self.memory:
            self.turns = self.turns[len(self.turns) - self.memory :]
            self.before = self.render(self.turns)
        if self.memory is not None:
            self.said.append((role, text))
        probe = self.render([*self.turns, (role, PROBE)])
        self.turns.append((role, text))
        now = self.render(self.turns)
        # only what both a text and the probe leave in place can be this turn's frame
        same = min(common_prefix(self.before, now), common_prefix(self.before, probe))
        self.rewrites |= same < len(self.before)
        start, piece = self.at - (len(self.before) - same), now[same:]
        self.at, self.before = start + len(piece), now
        if self.memory is not None:
            self.sha.update(piece.encode("utf-8", "surrogatepass"))
        head = max(probe.find(PROBE, same) - same, 0)
        tail = len(probe) - same - head - len(PROBE)
        return start, piece, min(head, len(piece)), max(len(piece) - tail, head)

    def holds(self) -> bool:
        """Whether the pieces together are the rendered conversation."""
        return not self.rewrites and (self.memory is None or self.sha.digest() == sha256(self.render(self.said).encode("utf-8", "surrogatepass")).digest())


def chat_role(head: str) -> str:
    """The role, read from what the production template puts before a text."""
    return unescape(head.removeprefix(START).removesuffix("\n"))


def format_conversations(
    rows: DataFrame, render: Callable[[Sequence[Turn]], str] = render_chat, read_role: Callable[[str], str] = chat_role, memory: int | None = None, keep_text: bool = True, loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): conv_id, n_turns, formatted, spans, loss_spans, rewrites,
    and digests read back from the output: turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns go by turn, then role, then text; null texts and roles are empty ones; repeated rows are turns of their own; a
    null conv_id is one conversation. spans are (role, start, end) in code points; loss_spans are the parts of formatted that
    are assistant texts. Conversations are streamed turn by turn from sorted partitions, so none is ever gathered as a
    group; with keep_text off neither is its output. An empty table gives an empty result. All prefixes are rendered unless
    memory declares how many turns the template looks back at. Where rewrites is true all that is read from the output is null.
    A conversation is handled by one task, turn by turn; very long texts are texts like others; further columns aren't read.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        now: _Conversation | None = None
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *FIELDS])
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = _Conversation(conv, render, memory, keep_text, read_role, loss_role)
                now.add(role, text)
            if len(done) >= 512:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now:
            done.append(now.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return rows.mapInArrow(formatted, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, n_turns long, formatted string, spans array<struct<role:string,start:long,end:long>>, loss_spans array<struct<start:long,end:long>>, rewrites boolean, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


FIELDS = [
    ("n_turns", pa.int64()),
    ("formatted", pa.string()),
    ("spans", pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("rewrites", pa.bool_()),
    ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()),
]


class _Conversation:
    def __init__(self, conv: int | None, render: Callable[[Sequence[Turn]], str], memory: int | None, keep_text: bool, read_role: Callable[[str], str], loss_role: str):
        self.conv, self.keep, self.spans, self.read_role, self.loss_role = conv, keep_text, Spans(render, memory), read_role, loss_role
        self.out, self.places, self.loss = [self.spans.before], [], []
        self.n, self.chars, self.loss_chars = 0, len(self.spans.before), 0
        self.turns_sha, self.loss_sha = sha256(), sha256()

    def add(self, role: str, text: str) -> None:
        start, piece, first, last = self.spans.add(role, text)
        self.n, self.chars = self.n + 1, start + len(piece)
        # what follows is read back from the rendered piece, not from the row
        said, read = self.read_role(piece[:first]), unescape(piece[first:last])
        self.turns_sha.update(f"{said}\n{read}\n".encode("utf-8", "surrogatepass"))
        if said == self.loss_role:
            self.loss_chars += len(read)
            self.loss_sha.update(read.encode("utf-8", "surrogatepass"))
        if self.keep:
            if said == self.loss_role:
                self.loss.append({"start": start + first, "end": start + last})
            self.out.append(piece)
            self.places.append({"role": said, "start": start, "end": start + len(piece)})

    def row(self) -> dict:
        rewrites = not self.spans.holds()
        whole = self.keep and not rewrites
        return {
            "conv_id": self.conv,
            "n_turns": self.n,
            "formatted": "".join(self.out) if whole else None,
            "spans": self.places if whole else None,
            "loss_spans": self.loss if whole else None,
            "rewrites": rewrites,
            "turns_sha256": None if rewrites else self.turns_sha.hexdigest(),
            "loss_chars": None if rewrites else self.loss_chars,
            "loss_sha256": None if rewrites else self.loss_sha.hexdigest(),
            "formatted_chars": None if rewrites else self.chars,
        }
