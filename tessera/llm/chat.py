"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events. Logs are partitioned by message and sorted
by sequence number; a streaming fold applies deltas, edits and regenerations
to the message they belong to and renders it. The rendered messages of a
conversation, in order, are its formatted text. The fold holds one message at
a time, whatever the length of a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col

#: The marks of the chat template.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
_MESSAGE = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BACK = {"n": "\n"}


def escape(text: str) -> str:
    """``text`` without any ``<|``; ``unescape`` gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    """As ``escape``, and on one line."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK.get(m[1], m[1]), text) if "\\" in text else text


def render(role: str, content: str) -> tuple[str, int, int]:
    """A message in the template, and the code points under the loss mask."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(content)
    mask = (len(head), len(head) + len(body)) if role == LEARNED_ROLE else (0, 0)
    return f"{head}{body}{END}\n", *mask


class _Fold:
    """State of one message."""

    def __init__(self):
        self.role, self.position, self.pieces = None, None, []

    def apply(self, kind: str, role: str | None, position: int | None, text: str | None) -> None:
        if kind == "open":
            self.role, self.position = role, position
        elif kind == "delta":
            self.pieces.append(text or "")
        elif kind == "edit":
            self.pieces = [text or ""]
        elif kind == "regenerate":
            self.pieces = []
        else:
            raise ValueError(f"no such event: {kind!r}")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: (conv_id, position, role, rendered, mask_start, mask_stop).

    ``events``: conv_id, message_id, seq, kind, role, position, text. Kinds:
    ``open`` (gives role and position), ``delta`` (appends text), ``edit``
    (replaces all text so far), ``regenerate`` (drops all text so far). Events
    count in the order of seq, then kind and text, however they arrive. Null
    texts are empty, a null role is the empty role, a message without an open
    event has neither role nor position; null ids are ids like any other. Other
    columns are ignored; an empty log gives no messages. Messages are dealt out
    one by one, so a conversation with a large share of all events is folded
    by many tasks.
    """
    names = ["conv_id", "message_id", "seq", "kind", "role", "position", "text"]
    log = events.select(*[col(n) for n in names]).repartition("conv_id", "message_id")
    log = log.sortWithinPartitions("conv_id", "message_id", "seq", F.col("kind").desc(), "text")
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            nonlocal out
            done, out = out, []
            return pa.RecordBatch.from_pylist(done, schema=shape)

        def close() -> None:
            text, start, stop = render(state.role or "", "".join(state.pieces))
            out.append({"conv_id": key[0], "position": state.position, "role": state.role or "", "rendered": text, "mask_start": start, "mask_stop": stop})

        for b in batches:
            types = b.schema
            shape = pa.schema([("conv_id", types.field("conv_id").type), ("position", types.field("position").type), ("role", pa.string()), ("rendered", pa.string()), ("mask_start", pa.int64()), ("mask_stop", pa.int64())])
            for conv, message, _, kind, role, position, text in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                if state is None or key != (conv, message):
                    if state is not None:
                        close()
                    key, state = (conv, message), _Fold()
                state.apply(kind, role, position, text)
            if out:
                yield flush()
        if state is not None:
            close()
            yield flush()

    return log.mapInArrow(fold, f"conv_id {kinds['conv_id']}, position {kinds['position']}, role string, rendered string, mask_start long, mask_stop long")


def read_back(messages: DataFrame) -> DataFrame:
    """What the formatted conversations say, parsed from the rendered text.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).
    Hashes run along a conversation, so its messages stream through one task
    in order (position, then role and text), one message in memory at a time.
    """
    rows = messages.repartition("conv_id").sortWithinPartitions("conv_id", "position", "role", "rendered")
    conv_type = rows.schema["conv_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for b in batches:
            shape = pa.schema([("conv_id", b.schema.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            columns = [b.column(n).to_pylist() for n in ("conv_id", "rendered", "mask_start", "mask_stop")]
            for conv, text, start, stop in zip(*columns, strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(_totals(key, state))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                m = _MESSAGE.fullmatch(text)
                if m is None:
                    raise ValueError(f"conversation {conv}: not a rendered message")
                learned = unescape(text[start:stop])
                state[0] += 1
                state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=shape)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([_totals(key, state)], schema=shape)

    return rows.mapInArrow(parse, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _totals(conv, state: list) -> dict:
    turns, said, chars, learned, formatted = state
    return {"conv_id": conv, "n_turns": turns, "turns_sha256": said.hexdigest(), "loss_chars": chars, "loss_sha256": learned.hexdigest(), "formatted_chars": formatted}


def turns_to_events(turns: DataFrame, piece: int = 200) -> DataFrame:
    """The log of a service that streamed these turns (conv_id, turn, role, text).

    Assistant texts come in deltas of ``piece`` code points; every other one
    was regenerated after its first piece. All other texts come at once, every
    other one with its first half first, then edited. Folding gives the turns.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    odd = F.col("turn") % 4 >= 2
    learned = F.coalesce(F.col("role") == LEARNED_ROLE, F.lit(False))
    step = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(text) / piece).cast("int") - 1, F.lit(0)))
    deltas = F.transform(cuts, lambda i: step("delta", F.substr(text, i * piece + 1, F.lit(piece))))
    false_start = F.array(step("delta", F.substr(text, F.lit(1), F.lit(piece))), step("regenerate", F.lit(None).cast("string")))
    half = F.substr(text, F.lit(1), F.floor(F.char_length(text) / 2).cast("int"))
    edited = F.array(step("delta", half), step("edit", text))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    steps = F.when(learned, F.concat(F.when(odd, false_start).otherwise(none), deltas)).otherwise(F.when(odd, edited).otherwise(F.array(step("delta", text))))
    events = F.concat(F.array(step("open", F.lit(None).cast("string"))), steps)
    rows = turns.select("conv_id", F.monotonically_increasing_id().alias("message_id"), F.col("turn").alias("position"), "role", events.alias("events"))
    rows = rows.select("conv_id", "message_id", "position", "role", F.posexplode("events").alias("seq", "event"))
    return rows.select("conv_id", "message_id", "seq", "event.kind", "role", "position", "event.text")
