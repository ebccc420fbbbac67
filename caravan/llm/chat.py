"""Event-sourced chat formatting.

A log has events (conv_id, seq, message_id, step, kind, role, text); seq may be of any type that has an order. Folding a
conversation in order of seq and step:

    delta       appends text to the message, which it opens if new; its role, if any, counts when it opens
    edit        replaces the message's text, and its role if it has one
    regenerate  empties the message, whose coming deltas start anew, and drops the messages opened after it
    anything else, null included, is ignored

The messages that remain are rendered in the order in which they were opened. A marker after a message's last event tells the
fold that the message is complete; complete messages with nothing open before them can't change any more and are rendered, so a
task holds no more of a conversation than its events reach back. A turn becomes

    <|im_start|>role LF text<|im_end|> LF

Control strings inside roles and texts are escaped: after the first character of each comes a backslash more than there
was, which is reversible, and no escaped text holds a control string. Line ends and backslashes of roles are written as
backslash n and two backslashes. The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravan.llm.shared import attach, text_slices

#: Strings that chat templates give a meaning.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"({re.escape(c[0])})\\\\(\\\\*)({re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\".join([(g := [x for x in m.groups() if x is not None])[0], g[1] + g[2]]), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "".join(x for x in m.groups() if x is not None), text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Messages:
    """The fold of one conversation's events, as far as they have come."""

    def __init__(self):
        self.messages: dict = {}  # id -> [role, parts of text, complete]

    def add(self, message_id, kind: str | None, role: str | None, text: str | None) -> None:
        m = self.messages.get(message_id)
        if kind == "delta":
            if m is None:
                m = self.messages[message_id] = [role or "", [], False]
            m[1].append(text or "")
        elif m is None:
            return
        elif kind == "edit":
            m[0], m[1] = role or m[0], [text or ""]
        elif kind == "regenerate":
            m[1] = []
            ids = list(self.messages)
            for k in ids[ids.index(message_id) + 1 :]:
                del self.messages[k]
        elif kind == END:
            m[2] = True

    def release(self, rest: bool = False) -> Iterator[tuple[str, str]]:
        """(role, text) of the oldest messages, as far as they are complete, or of all; they are forgotten."""
        while self.messages and (rest or next(iter(self.messages.values()))[2]):
            role, parts, _ = self.messages.pop(next(iter(self.messages)))
            yield role, "".join(parts)


#: Kind of the marker after a message's last event.
END = "end of message"
ROWS = [("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
SCHEMA = "conv_id long, part long, formatted string, mask array<struct<start:bigint,end:bigint>>"
#: Characters after which a conversation's output goes on in a further row.
PART_CHARS = 1_000_000


def _render(part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = run
        state, out = Messages(), []
        text: list[str] = []
        mask: list[dict] = []
        size = base = part = 0

        def put(role: str, content: str) -> None:
            nonlocal size
            head, body = f"{OPEN}{escape_role(role)}\n", escape(content)
            if role == "assistant":
                mask.append({"start": base + size + len(head), "end": base + size + len(head) + len(body)})
            text.append(f"{head}{body}{CLOSE}\n")
            size += len(text[-1])

        def close() -> None:
            nonlocal size, base, part
            out.append((at, part, "".join(text), list(mask)))
            base, part, size = base + size, part + 1, 0
            text.clear()
            mask.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, ROWS, strict=True)], [n for n, _ in ROWS])

        held = 0
        for batch in text_slices(batches):
            for x in batch.to_pylist():
                if at is run or x["conv_id"] != at:
                    if at is not run:
                        for m in state.release(rest=True):
                            put(*m)
                        close()
                    at, state, base, part = x["conv_id"], Messages(), 0, 0
                state.add(x["message_id"], x["kind"], x["role"], x["text"])
                held += len(x["text"] or "")
                for m in state.release():
                    put(*m)
                if size >= part_chars:
                    close()
                if held > part_chars and out:
                    yield flush()
                    held = 0
        if at is not run:
            for m in state.release(rest=True):
                put(*m)
            close()
            yield flush()

    return run


def format_events(events: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, formatted, mask: spans of loss in code points of the whole conversation).

    events(conv_id, seq, message_id, step, kind, role, text, ...). Events of one seq are taken in order of message_id, step, kind,
    role and text; a null conv_id is a conversation like any other, null roles and texts are empty; repeated rows are events of their
    own; an empty log gives an empty result. A conversation whose messages are all dropped has one empty part.

    Logs are partitioned by conversation, sorted, and folded as a stream. However late an event comes, it counts. A conversation of
    any length needs memory for the messages that its events reach back over and a part of part_chars characters; a single
    message is held whole. Parts follow each other without a separator.
    """
    attach(events.sparkSession)
    text = lambda c: F.col(c).cast("string").alias(c)
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", F.col("message_id").cast("long").alias("message_id"), F.col("step").cast("long").alias("step"), text("kind"), text("role"), text("text"), F.lit(0).alias("mark"))
    last = log.groupBy("conv_id", "message_id").agg(F.max(F.struct("seq", "step")).alias("last"))
    nothing = F.lit(None).cast("string")
    marks = last.select("conv_id", "last.seq", "message_id", "last.step", F.lit(END).alias("kind"), nothing.alias("role"), nothing.alias("text"), F.lit(1).alias("mark"))
    placed = log.where(F.coalesce(F.col("kind") != END, F.lit(True))).unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message_id", "step", "mark", "kind", "role", "text")
    return placed.select("conv_id", "message_id", "kind", "role", "text").mapInArrow(_render(part_chars), SCHEMA)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn of a rendered part."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line + 1)
        yield unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end]), line + 1, end
        at = end + len(CLOSE) + 1


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    row: list | None = None

    def done(rows: list[list]) -> pa.RecordBatch:
        columns = zip(*([r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in text_slices(batches, column="formatted"):
        rows = []
        for x in batch.to_pylist():
            if x["part"] == 0:
                if row:
                    rows.append(row)
                row = [x["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(x["formatted"]):
                row[1] += 1
                row[2].update(f"{role}\n{text}\n".encode())
            for span in x["mask"]:
                learnt = unescape(x["formatted"][span["start"] - row[5] : span["end"] - row[5]])
                row[3] += len(learnt)
                row[4].update(learnt.encode())
            row[5] += len(x["formatted"])
        if rows:
            yield done(rows)
    if row:
        yield done([row])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its parts: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    attach(formatted.sparkSession)
    placed = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return placed.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of_turns(turns: DataFrame, chunk: int = 256) -> DataFrame:
    """A log that reconstructs turns(conv_id, turn, role, text, ...), with drafts that must not remain.

    Every row is a message of its own, repeated ones too; rows of one turn follow each other in order of a hash of role and text.
    By another hash, a message is streamed plainly, as deltas of at most chunk characters; or as a draft and an edit that has the
    whole text; or as a draft, an answer to it, and a regeneration, which drops that answer, with new deltas.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("id"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text")).withColumn("way", F.pmod(F.xxhash64(F.lit("way"), "conv_id", "turn", "role", "text"), F.lit(3)))

    def event(phase: int, kind: str, of: Column, step: Column, message: Column | None = None) -> Column:
        return F.struct(F.lit(phase).alias("phase"), (F.col("id") if message is None else message).alias("message_id"), step.cast("long").alias("step"), F.lit(kind).alias("kind"), of.alias("text"))

    def streamed(phase: int, of: Column) -> Column:
        last = F.ceil(F.greatest(F.length(of), F.lit(1)) / F.lit(chunk)).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: event(phase, "delta", F.substring(of, i * chunk + 1, F.lit(chunk)), i))

    body, first = F.col("text"), F.lit(0)
    draft = F.concat(F.lit("Draft: "), F.substring(body, 1, chunk // 2))
    edited = F.concat(streamed(0, draft), F.array(event(1, "edit", body, first)))
    answer = event(1, "delta", F.lit("An answer to the draft"), first, -F.col("id") - 1)
    again = F.concat(streamed(0, draft), F.array(answer, event(2, "regenerate", F.lit(None).cast("string"), first)), streamed(3, body))
    log = F.when(F.col("way") == 0, streamed(0, body)).when(F.col("way") == 1, edited).otherwise(again)
    events = rows.select("conv_id", "turn", "tie", "id", "role", F.explode(log).alias("e"))
    return events.select("conv_id", F.struct("turn", "tie", "id", "e.phase").alias("seq"), "e.message_id", "e.step", "e.kind", "role", "e.text")
