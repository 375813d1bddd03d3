"""Chat formatting by event-sourced reconstruction.

A log of events is dealt by conversation and sorted by sequence; a fold applies streamed deltas,
edits, regenerations and deletions to messages; messages are rendered in a template that marks
turns. Control strings inside roles and texts are escaped, so that reading the output back gives
the same turns. A close makes what a conversation has so far final: the fold lets go of these
messages and they are rendered. Rendered pieces are rows, one for a message, so that a
conversation of any length passes through a task as a stream, of which the task holds what is
not closed.

Events: (conv_id, seq, op, message, role, text) with op one of
    message     a whole message                      delta   text to append to a message
    edit        a new text for a message             delete  drops a message
    regenerate  clears a message's text and drops every later message
    close       ends all messages so far; an event that names one of them later begins another of that name

Template: ``<|im_start|>`` role ``\\n`` text ``<|im_end|>\\n``. In roles and texts ``\\`` becomes ``\\\\``
and ``<|`` becomes ``<\\|``; in roles a line feed becomes ``\\n``. So ``<|`` in the output always
begins a control string. The loss mask covers the texts of assistant turns.

Defined results: null roles and texts are empty; a null op is a message; null conversation ids
are one conversation; ties of seq go by message, then role and text; equal rows by turn are turns
of their own; an end of the log closes what is open; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import new_path, record, small_batches

# The control strings of the template.
START, STOP = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"

_PIECES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("rendered", pa.string()), ("mask_from", pa.int64()), ("mask_to", pa.int64())])
_PIECES_SQL = "conv_id long, part long, rendered string, mask_from long, mask_to long"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn and the span of its text."""
    head = f"{START}{escaped(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escaped(text)
    return f"{head}{body}{STOP}", len(head), len(head) + len(body)


def parsed(rendered: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in the output."""
    at = 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError("a turn doesn't begin with its control string")
        line = rendered.index("\n", at)
        end = rendered.index("<|", line)
        if not rendered.startswith(STOP, end):
            raise ValueError("a turn doesn't end with its control string")
        yield unescaped(rendered[at + len(START) : line]), unescaped(rendered[line + 1 : end])
        at = end + len(STOP)


class Fold:
    """State of one conversation: the messages that events can still change, in order of first appearance."""

    def __init__(self):
        self.messages: dict = {}

    def apply(self, op: str | None, message, role: str, text: str) -> None:
        if op in (None, "message"):
            self.messages[message if message not in self.messages else (message, len(self.messages), object())] = [role, [text]]
        elif op == "delta":
            self.messages.setdefault(message, [role, []])[1].append(text)
        elif op == "edit":
            self.messages.setdefault(message, [role, []])[1] = [text]
        elif op == "delete":
            self.messages.pop(message, None)
        elif op == "regenerate":
            keys = [*self.messages]
            if message in self.messages:
                for later in keys[keys.index(message) + 1 :]:
                    del self.messages[later]
            self.messages[message] = [role or self.messages.get(message, [""])[0], [text] if text else []]
        else:
            raise ValueError(f"unknown event {op!r}")

    def close(self) -> Iterator[tuple[str, str]]:
        """The messages as turns; none is held afterwards."""
        done, self.messages = self.messages, {}
        for role, parts in done.values():
            yield role, "".join(parts)


def _render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from events (conv_id, op, message, role, text) in order."""
    now, fold, n = None, Fold(), 0
    out: list[tuple] = []
    size = 0

    def end():
        nonlocal n, size
        for role, text in fold.close():
            shown, a, b = piece(role, text)
            out.append((now, n, shown, *((a, b) if role == LEARNED else (None, None))))
            n, size = n + 1, size + len(shown)

    for batch in batches:
        for conv_id, op, message, role, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if conv_id != now:
                end()
                now, n = conv_id, 0
            if op == "close":
                end()
            else:
                fold.apply(op, message, role or "", text or "")
            if size > 1 << 22:
                yield record(_PIECES, *zip(*out, strict=True))
                out, size = [], 0
    end()
    if out:
        yield record(_PIECES, *zip(*out, strict=True))


def rendered(events: DataFrame) -> DataFrame:
    """conv_id, part, rendered, and mask_from and mask_to, the span under the loss mask (null: none)."""
    e = events.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", "op", "message", "role", "text")
    e = e.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "role", "text")
    return e.drop("seq").mapInArrow(_render, _PIECES_SQL)


#: Events of a turn at most.
STEPS = 8


def as_events(turns: DataFrame) -> DataFrame:
    """The log that conversations by turn may have come from: a learned turn is an answer that is broken off, regenerated and streamed in three deltas; any other is a draft that is edited, beside a message that is taken back. Each turn is closed."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", (F.row_number().over(order) * STEPS).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    name, taken_back = F.concat(F.lit("turn "), F.col("turn").cast("string")), F.concat(F.lit("unsent "), F.col("turn").cast("string"))
    step = lambda k, op, text=F.lit(""), message=name: F.struct((F.col("turn") + k).alias("seq"), F.lit(op).alias("op"), message.alias("message"), F.col("role").alias("role"), text.alias("text"))
    cut = lambda a, n: F.substring(F.col("text"), a + 1, n)
    draft = F.concat(cut(F.lit(0), F.lit(12)), F.lit(" ..."))
    learned = [step(0, "delta", draft), step(1, "regenerate"), step(2, "delta", cut(F.lit(0), third)), step(3, "delta", cut(third, third)), step(4, "delta", cut(2 * third, F.length("text"))), step(5, "close")]
    other = [step(0, "message", draft), step(1, "message", F.lit("a slip"), taken_back), step(2, "edit", F.col("text")), step(3, "delete", message=taken_back), step(4, "close")]
    log = F.when(F.col("role") == LEARNED, F.array(*learned)).otherwise(F.array(*other))
    return t.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, out = None, None, []
    new = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
    close = lambda: out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
    for batch in batches:
        for conv_id, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if state is None or conv_id != now:
                if state:
                    close()
                now, state = conv_id, new()
            for role, body in parsed(text):
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            if a is not None:
                lost = unescaped(text[a:b])
                state[2] += len(lost)
                state[3].update(lost.encode())
            state[4] += len(text)
        if len(out) > 4096:
            yield record(_DIGESTS, *zip(*out, strict=True))
            out.clear()
    if state:
        close()
    if out:
        yield record(_DIGESTS, *zip(*out, strict=True))


def written(pieces: DataFrame, path: str | None = None) -> str:
    """Write the formatted conversations; their path."""
    path = path or new_path(pieces.sparkSession, "chats")
    with small_batches(pieces.sparkSession):
        pieces.write.option("compression", "zstd").parquet(path)
    return path


def digests(pieces: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read back from formatted conversations."""
    p = pieces.select("conv_id", "part", "rendered", "mask_from", "mask_to").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return p.drop("part").mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
