"""Chat formatting by event-sourced reconstruction: logs of conversations are folded into final messages, and these are rendered for training.

A log row belongs to a message of a conversation and is one of
  open        the message begins, with a role
  delta       a streamed piece is appended to its text
  edit        its text so far is replaced
  regenerate  its text so far is dropped; what follows is the new attempt
Messages stand in the order of the column `message`, the rows of one in the order of `seq`.

A message is rendered as `<turn:ROLE>` line end TEXT `</turn>` line end. Inside roles and texts a backslash goes before every backslash and before each place
where a mark begins (in roles also before `>`), so no text can open or close a turn, and taking the backslashes away gives it back. The loss mask is a list of
spans, in code points of the rendered text: the texts of assistant messages, without their marks.

The log is range-partitioned by conversation and message and sorted by sequence, so a conversation that holds a third of all rows is dealt to many tasks, while
a message is never cut. Tasks stream through their rows and give segments of about SEGMENT characters; a conversation's text is its segments, one after the other by
`part`. Only the digests of conversations that may lie in several segments (the first and the last of each partition, and long ones) need them
in one place: there they are hashed as they stream by, because SHA-256 runs over bytes in order.

Edge cases: null roles and texts are empty; rows without a conversation id are one conversation with the id null. A message without an open row has the role "", of
several open rows the last one counts. Rows of unknown kinds count for nothing, but make the message exist. No rows give no rows. A message is handled in memory,
however long. Bytes that aren't UTF-8 become U+FFFD. Other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.llm.common import Scratch, frugal, strings

OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
#: The role whose texts the loss counts.
LEARNED = "assistant"
#: Characters of a rendered segment, from which on the next message begins another one.
SEGMENT = 1 << 18
#: Characters of a streamed piece in logs made from finished turns.
PIECE = 1000
#: Characters of the first attempt that such a log holds, which is edited or regenerated away.
DRAFT = 20

_BEGIN, _END = "<turn:", "</turn>\n"
_IN_TEXT = re.compile(r"\\|<(?=turn:|/turn>)")
_IN_ROLE = re.compile(r"[\\>]|<(?=turn:|/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_MARK = re.compile(r"\\.|(<turn:)|(>\n)|(</turn>\n)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: "\\" + m[0], text) if "\\" in text or "<" in text or role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered message, and where its text starts and ends in it."""
    head, body = f"{_BEGIN}{escape(role, role=True)}>\n", escape(text)
    return head + body + _END, len(head), len(head) + len(body)


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each message of a rendered text."""
    out, at, role = [], 0, None
    for m in _MARK.finditer(rendered):
        if m[1] and role is None:
            at = m.end()
        elif m[2] and role is None:
            role, at = unescape(rendered[at : m.start()]), m.end()
        elif m[3] and role is not None:
            out.append((role, unescape(rendered[at : m.start()])))
            role = None
    return out


def fold(events) -> tuple[str, str]:
    """(kind, role, text) of one message, in order, to its role and text."""
    final, pieces = "", []
    for kind, role, text in events:
        if kind == OPEN:
            final = role
        elif kind == DELTA:
            pieces.append(text)
        elif kind == EDIT:
            pieces = [text]
        elif kind == REGENERATE:
            pieces = []
    return final, "".join(pieces)


def log(turns: DataFrame, id_col: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log that would have led to finished turns: a message is opened, a draft of it comes first and is edited (by the first piece) or, where the model
    speaks, regenerated, and its text streams in pieces. Turns with equal order come by a hash of role and text."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    event = lambda kind, who, what: F.struct(F.lit(kind).alias("kind"), who.alias("role"), what.alias("text"))
    none = F.lit(None).cast("string")
    pieces = F.regexp_extract_all(text_, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    learned = role_ == LEARNED
    reset = F.when(learned, event(REGENERATE, none, none)).otherwise(event(EDIT, none, F.coalesce(F.get("pieces", F.lit(0)), F.lit(""))))
    rest = F.when(learned, F.col("pieces")).otherwise(F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0))))
    rows = turns.select(
        F.col(id_col).alias("id"), F.struct(F.col(order).alias("turn"), F.xxhash64(role_, text_).alias("hash"), F.monotonically_increasing_id().alias("row")).alias("message"), role_.alias("role"), text_.alias("text"), pieces.alias("pieces")
    )
    deltas = F.transform(rest, lambda p: event(DELTA, none, p))
    events = F.concat(F.array(event(OPEN, F.col("role"), none), event(DELTA, none, F.left("text", F.lit(DRAFT))), reset), deltas)
    return rows.withColumn("learned", F.col("role") == LEARNED).select("id", "message", F.posexplode(events).alias("seq", "e")).select(F.col("id").alias(id_col), "message", "seq", "e.kind", "e.role", "e.text")


class _Renderer:
    """Folds and renders the sorted rows of a task. rows: finished segments that nobody took yet."""

    def __init__(self, part: int):
        self.part, self.rows, self.held = part, [], 0
        self.id = self.message = None
        self.events: list[tuple] | None = None  # of the message that rows come for; none before the first row
        self.first = True  # the partition's first conversation may have begun in the partition before
        self.cut = False  # the conversation has segments already
        self._begin()

    def _begin(self) -> None:
        self.turns, self.loss, self.size = [], [], 0

    def _segment(self, whole: bool) -> None:
        self.rows.append((self.id, self.part, whole, len(self.turns), "".join(self.turns), self.loss))
        self.part, self.held = self.part + 1, self.held + self.size
        self._begin()

    def _close_message(self) -> None:
        if self.size > SEGMENT:
            self._segment(False)
            self.cut = True
        role, text = fold(self.events)
        turn, start, end = render(role, text)
        if role == LEARNED:
            self.loss.append({"start": self.size + start, "end": self.size + end})
        self.turns.append(turn)
        self.size += len(turn)

    def add(self, id_, message, event: tuple) -> None:
        if self.events is None:
            self.id, self.message, self.events = id_, message, []
        elif message != self.message or id_ != self.id:
            self._close_message()
            if id_ != self.id:
                self._segment(not self.first and not self.cut)
                self.first = self.cut = False
            self.id, self.message, self.events = id_, message, []
        self.events.append(event)

    def close(self) -> None:
        if self.events is not None:
            self._close_message()
            self._segment(False)


def format_chats(events: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Segments of the rendered conversations: id, part (their order within a conversation), whole (there is no other segment of it), n_turns, text, and loss
    (array of struct start, end in code points of this segment). events: columns id, message (of any type with an order), seq, kind, role, text."""
    schema = T.StructType([T.StructField(id_col, events.schema[id_col].dataType), *_fields("part bigint, whole boolean, n_turns bigint, text string, loss array<struct<start:bigint,end:bigint>>")])

    def run(batches):
        import pyarrow as pa

        out, id_type = _Renderer(TaskContext.get().partitionId() << 33), None
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def taken():
            columns = zip(*out.rows)
            batch = pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, (id_type, pa.int64(), pa.bool_(), pa.int64(), pa.string(), span))], names=schema.names)
            out.rows, out.held = [], 0
            return batch

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, messages = (batch.column(k).to_pylist() for k in range(2))
            for id_, message, *event in zip(ids, messages, *(strings(batch.column(k)) for k in range(2, 5))):
                out.add(id_, message, event)
                if out.held > SEGMENT:
                    yield taken()
        out.close()
        if out.rows:
            yield taken()

    log_ = events.select(F.col(id_col).alias("id"), "message", "seq", "kind", "role", "text")
    return log_.repartitionByRange("id", "message").sortWithinPartitions("id", "message", "seq").select("id", "message", "kind", "role", "text").mapInArrow(frugal(run), schema)


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def read_back(segments: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the segments say: id, part, whole, turns (array of struct role, text), loss_text (what the loss counts, without marks and backslashes), n_chars (of the rendered text)."""
    schema = T.StructType([T.StructField(id_col, segments.schema[id_col].dataType), *_fields("part bigint, whole boolean, turns array<struct<role:string,text:string>>, loss_text string, n_chars bigint")])

    def run(batches):
        import pyarrow as pa

        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts, spans = strings(batch.column(3)), batch.column(4).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in texts]
            loss = ["".join(unescape(x[s["start"] : s["end"]]) for s in at) for x, at in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(turns, turn), pa.array(loss, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return segments.select(F.col(id_col).alias("id"), "part", "whole", "text", "loss").mapInArrow(frugal(run), schema)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self):
        self.n = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, turns: list[dict], loss: str, chars: int) -> None:
        self.n, self.loss_chars, self.chars = self.n + len(turns), self.loss_chars + len(loss), self.chars + chars
        for t in turns:
            self.turns.update(f"{t['role']}\n{t['text']}\n".encode())
        self.loss.update(loss.encode())

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest(found: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A row a conversation of what read_back() gives: id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars, loss_sha256, formatted_chars.
    Conversations in one segment are hashed where they are; the segments of others go to one task for each, in order, and are hashed as they pass."""
    scratch = Scratch(found.sparkSession)
    digests = _fields("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    id_field = T.StructField(id_col, found.schema[id_col].dataType)
    body = [f for f in found.schema.fields if f.name in ("part", "turns", "loss_text", "n_chars")]
    whole_schema = T.StructType([id_field, *digests, *body])

    def here(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            whole = batch.column(1).to_pylist()
            for w, turns, loss, chars in zip(whole, *(batch.column(k).to_pylist() for k in (3, 4, 5))):
                d = _Digest()
                if w:
                    d.add(turns, loss, chars)
                rows.append(d.row() if w else (None,) * 5)
            mask = pa.array(whole, pa.bool_())
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            done = [pa.array(list(v), t) for v, t in zip(zip(*rows) if rows else [()] * 5, types)]
            rest = [pa.compute.if_else(mask, pa.scalar(None, batch.column(k).type), batch.column(k)) for k in (2, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *done, *rest], names=[f.name for f in whole_schema])

    def joined(batches):
        import pyarrow as pa

        now, id_type, d, rows = None, None, None, []
        for batch in batches:
            id_type = batch.schema.field(0).type
            for id_, turns, loss, chars in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if d is None or id_ != now:
                    if d is not None:
                        rows.append((now, *d.row()))
                    now, d = id_, _Digest()
                d.add(turns, loss, chars)
        if d is not None:
            rows.append((now, *d.row()))
            types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names=[id_col, *(f.name for f in digests)])

    parts = scratch.keep(found.select(id_col, "whole", "part", "turns", "loss_text", "n_chars").mapInArrow(frugal(here), whole_schema), "parts")
    rest = parts.where("n_turns is null").select(id_col, "part", "turns", "loss_text", "n_chars").repartition(id_col).sortWithinPartitions(id_col, "part")
    rest = rest.select(id_col, "turns", "loss_text", "n_chars").mapInArrow(frugal(joined), T.StructType([id_field, *digests]))
    return parts.where("n_turns is not null").select(id_col, *(f.name for f in digests)).unionByName(rest)
