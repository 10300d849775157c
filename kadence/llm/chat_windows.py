"""Conversations as training windows under a token budget.

A window holds whole turns. Prefix sums of the turns' token counts choose where it
ends; it opens with the conversation's leading system turn and then repeats as
many of the last turns as the history budget takes. Only assistant turns that no
earlier window held are under the loss mask.

Template: ``<turn>`` role, line end, text, ``</turn>``, line end; a repeated turn
opens with ``<again>``. Inside texts and roles the backslash becomes two and ``<``
becomes ``\\l``, in roles a line end ``\\n``; so no text can contain a mark, and
the change is undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from kadence.llm.byte_bpe import encode_text, load_encoding
from kadence.llm.shipping import ship

#: Tokens of a window, and how many of them may go to repeated turns besides the system turn.
BUDGET, HISTORY = 1024, 256
_TURN, _AGAIN, _END = "<turn>", "<again>", "</turn>\n"
_MARKED = re.compile(r"<(turn|again)>([^\n<]*)\n([^<]*)</turn>\n")
_ESCAPED = re.compile(r"\\(.)")
_PLAIN = {"\\": "\\", "l": "<", "n": "\n"}

WINDOWS = "window long, n_turns long, n_repeated long, n_tokens long, text string, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


class Windows:
    """Cuts one conversation into windows while its turns arrive; holds one window's turns and no more."""

    def __init__(self, count: Callable[[str], int], budget: int, history: int) -> None:
        self.count, self.budget, self.history = count, budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []  # role, text, tokens; both escaped
        self.sums = [0]  # prefix sums of the held turns' tokens
        self.fresh = 0  # the first held turn that no window has held
        self.made = 0

    def add(self, role: str, text: str) -> Iterator[dict]:
        role, text = escape_role(role), escape(text)
        turn = (role, text, self.count(f"{_TURN}{role}\n{text}{_END}"))
        if role == "system" and not self.made and not self.turns and not self.system:
            self.system = turn
            return
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[2])
        if self._room() < self.sums[-1] - self.sums[0] and len(self.turns) - self.fresh > 1:
            yield self._window(len(self.turns) - 1)

    def _room(self) -> int:
        return self.budget - (self.system[2] if self.system else 0)

    def _window(self, end: int) -> dict:
        """The window of all held turns before ``end``; afterwards only its history stays held."""
        parts, loss, at = [], [], 0
        tokens = self.sums[end] - self.sums[0] + (self.system[2] if self.system else 0)
        held = [(t, i < self.fresh) for i, t in enumerate(self.turns[:end])]
        if self.system:
            held.insert(0, (self.system, self.made > 0))
        for (role, text, _), again in held:
            opening = f"{_AGAIN if again else _TURN}{role}\n"
            if role == "assistant" and not again:
                loss.append({"start": at + len(opening), "end": at + len(opening) + len(text)})
            parts += (opening, text, _END)
            at += len(opening) + len(text) + len(_END)
        window = {
            "window": self.made,
            "n_turns": len(held),
            "n_repeated": sum(again for _, again in held),
            "n_tokens": tokens,
            "text": "".join(parts),
            "loss": loss,
        }
        self.made += 1
        # The next window's history: the longest run of last turns within both budgets.
        least = max(self.sums[end] - self.history, self.sums[-1] - self._room())
        first = min(end, bisect_left(self.sums, least))
        self.turns, self.sums = self.turns[first:], [s - self.sums[first] for s in self.sums[first:]]
        self.fresh = end - first
        return window

    def close(self) -> Iterator[dict]:
        if len(self.turns) > self.fresh or (self.system and not self.made):
            yield self._window(len(self.turns))


def format_windows(
    df: DataFrame,
    conv_col: str,
    turn_col: str,
    role_col: str,
    text_col: str,
    ranks_path: str,
    pattern: str,
    *,
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """One row per window: conversation, window number, turns, repeated turns, tokens, text, loss spans.

    Spans are code points of ``text``, end exclusive. Turns go in the order of their number, nulls first, equal
    ones by role and text; repeated rows are repeated turns. Null roles and texts count as empty; rows with a
    null conversation form one. A turn over the budget has a window of its own, without history. A conversation
    is streamed by one task, which holds one window at a time, however many turns it has.
    """
    ship(df.sparkSession)
    names = [F.col(f"`{c}`").alias(n) for c, n in ((conv_col, "conv_"), (turn_col, "turn_"))]
    texts = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((role_col, "role_"), (text_col, "text_"))]
    rows = df.select(*names, *texts).repartition("conv_").sortWithinPartitions("conv_", "turn_", "role_", "text_")
    conv = rows.schema["conv_"]
    schema = StructType([type(conv)(conv_col, conv.dataType, True)])
    schema = StructType([*schema.fields, *StructType.fromDDL(WINDOWS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_path, pattern)
        current, conversation = None, None
        for batch in batches:
            arrow = pa.schema([pa.field(conv_col, batch.schema.field(0).type), *_WINDOW_FIELDS])
            out = []
            for id_, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conversation is None or id_ != current:
                    if conversation:
                        out += [{conv_col: current} | w for w in conversation.close()]
                    current = id_
                    conversation = Windows(lambda t: len(encode_text(encoding, t)), budget, history)
                out += [{conv_col: current} | w for w in conversation.add(role, text)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if conversation:
            yield pa.RecordBatch.from_pylist([{conv_col: current} | w for w in conversation.close()], schema=arrow)

    return rows.mapInArrow(run, schema)


_WINDOW_FIELDS = [
    *[pa.field(n, pa.int64()) for n in ("window", "n_turns", "n_repeated", "n_tokens")],
    pa.field("text", pa.string()),
    pa.field("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
]


def new_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of the turns that a window does not repeat."""
    for kind, role, body in _MARKED.findall(text):
        if kind == "turn":
            yield unescape(role), unescape(body)


def read_back(windows: DataFrame, conv_col: str) -> DataFrame:
    """One row per conversation, from its windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ship(windows.sparkSession)
    rows = windows.select(F.col(f"`{conv_col}`").alias("conv_"), "window", "text", "loss")
    rows = rows.repartition("conv_").sortWithinPartitions("conv_", "window")
    schema = StructType([type(f := windows.schema[conv_col])(conv_col, f.dataType, True)]).add("n_turns", LongType())
    schema = schema.add("turns_sha256", StringType()).add("loss_chars", LongType()).add("loss_sha256", StringType())
    schema = schema.add("formatted_chars", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def ended() -> tuple:
            n, turns, chars, loss, formatted = state
            return current, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for batch in batches:
            out = []
            id_type = batch.schema.field(0).type
            for id_, text, loss in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if state is None or id_ != current:
                    if state:
                        out.append(ended())
                    current, state = id_, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in new_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss or ():
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield _digests(out, schema.names, id_type)
        if state:
            yield _digests([ended()], schema.names, id_type)

    return rows.mapInArrow(run, schema)


def _digests(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
