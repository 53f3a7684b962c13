"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, only its reply is trainable.  ``expand`` formats every turn once, as a
segment with its place in the transcript.  ``training_texts`` builds the examples:
the text of one is the concatenation of the segments up to its reply, its mask is
``loss_start:loss_end`` in that text.  ``read_examples`` parses these texts and
digests what they say.

The examples of a conversation grow with the square of its turns, as the method
has it.  They are built by a join and spread by conversation and example, so no
task holds more than the text of one of them.

Defined results
  NULL role or text         empty string
  NULL conversation         a conversation of its own
  equal or NULL turn number ordered by turn (NULL first), role, text; repeated rows are kept
  no assistant turn         one text without a mask, the whole transcript
  turns after the last reply  one more text without a mask, the whole transcript
  empty table               no rows
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import by_value

START, END, TARGET = "<|im_start|>", "<|im_end|>", "assistant"

SEGMENTS = ("conv_id long, seq long, role string, segment string, context_chars long, "
            "is_example boolean, loss_start long, loss_end long")
PARSED = "conv_id long, seq long, n_turns long, turns_sha256 string, reply string, chars long"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
           "loss_sha256 string, formatted_chars long, n_examples long")


def escape(text: str) -> str:
    r"""Write ``<|`` as ``<\|``, and add one backslash wherever some stand there already."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``, and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to segments; only running totals outlive a turn."""
    current, seq, chars = object(), 0, 0
    for batch in batches:
        out = {k: [] for k in ("conv_id", "seq", "role", "segment", "context_chars",
                               "is_example", "loss_start", "loss_end")}
        for conv, role, text in zip(*(batch.column(c).to_pylist()
                                      for c in ("conv_id", "role", "text"))):
            if conv != current:
                current, seq, chars = conv, 0, 0
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            segment = f"{head}{body}{END}\n"
            example = role == TARGET
            for k, v in zip(out, (conv, seq, role, segment, chars, example,
                                  chars + len(head) if example else None,
                                  chars + len(head) + len(body) if example else None)):
                out[k].append(v)
            seq, chars = seq + 1, chars + len(segment)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
            [("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()),
             ("segment", pa.string()), ("context_chars", pa.int64()),
             ("is_example", pa.bool_()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]))


def expand(turns: DataFrame) -> DataFrame:
    """Segments of every conversation, each assistant segment an example (see module).

    Conversations are sorted outside Python and streamed through it, so one of any
    length needs no more memory than its longest turn.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_segments, SEGMENTS)


def training_texts(segments: DataFrame) -> DataFrame:
    """Every example spelled out: ``conv_id, seq, text, loss_start, loss_end``.

    A conversation that does not end in a reply has one text more, without a mask.
    """
    earlier = segments.select(F.col("conv_id").alias("c"), F.col("seq").alias("s"), "segment")
    examples = segments.where("is_example").select("conv_id", "seq", "loss_start", "loss_end")
    ends = segments.groupBy("conv_id").agg(F.max(F.struct("seq", "is_example")).alias("end")).where("NOT end.is_example")
    none = F.lit(None).cast("long")
    heads = examples.unionByName(ends.select("conv_id", "end.seq", none.alias("loss_start"), none.alias("loss_end")))
    joined = heads.join(earlier, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("s") <= F.col("seq")))
    parts = F.array_sort(F.collect_list(F.struct("s", "segment")))
    return joined.groupBy("conv_id", "seq", "loss_start", "loss_end").agg(
        F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("text"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns and masked reply of every spelled-out text; one that is off the template raises."""
    turn = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ("conv_id", "seq", "n_turns", "turns_sha256", "reply", "chars")
    for batch in batches:
        lines = []
        for conv, seq, text, first, last in zip(*(batch.column(k).to_pylist() for k in (
                "conv_id", "seq", "text", "loss_start", "loss_end"))):
            n, end, said, m = 0, 0, hashlib.sha256(), None
            for m in turn.finditer(text):
                if m.start() != end:
                    break
                n, end = n + 1, m.end()
                said.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
            off = m is None or end != len(text) or n != seq + 1
            if off or first is not None and (unescape_role(m[1]) != TARGET or m.span(2) != (first, last)):
                raise ValueError(f"text {seq} of conversation {conv} does not follow the template")
            reply = None if first is None else unescape(text[first:last])
            lines.append((conv, seq, n, said.hexdigest(), reply, len(text)))
        columns = list(zip(*lines)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed texts in order to one row per conversation; the last text tells its turns."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    nothing = object()
    current, turns, masked, loss, chars, examples = nothing, None, None, 0, 0, 0

    def batch_of(lines: list) -> pa.RecordBatch:
        columns = list(zip(*lines)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    for batch in batches:
        done = []
        for conv, n, said, reply, length in zip(*(batch.column(k).to_pylist() for k in (
                "conv_id", "n_turns", "turns_sha256", "reply", "chars"))):
            if conv != current:
                if current is not nothing:
                    done.append((current, *turns, loss, masked.hexdigest(), chars, examples))
                current, masked, loss, chars, examples = conv, hashlib.sha256(), 0, 0, 0
            turns, chars = (n, said), chars + length
            if reply is not None:
                masked.update(reply.encode())
                loss, examples = loss + len(reply), examples + 1
        yield batch_of(done)
    if current is not nothing:
        yield batch_of([(current, *turns, loss, masked.hexdigest(), chars, examples)])


def read_examples(texts: DataFrame) -> DataFrame:
    """Per conversation, what its ``training_texts`` say once parsed and unescaped.

    Texts are parsed where they are; only replies and digests are brought together.
    ``formatted_chars`` is the length of all texts.
    """
    parsed = texts.select("conv_id", "seq", "text", "loss_start", "loss_end").mapInArrow(_parse, PARSED)
    return parsed.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_digest, DIGESTS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse segments in order and digest what the examples hold."""
    shape = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
             "formatted_chars", "n_examples")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    nothing = object()
    conv, state = nothing, None

    def fresh() -> dict:
        return {"n": 0, "turns": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(),
                "chars": 0, "examples": 0, "end": 0}

    def line(conv, s) -> tuple:
        return (conv, s["n"], s["turns"].hexdigest(), s["loss"], s["masked"].hexdigest(),
                s["chars"], s["examples"])

    def batch_of(lines: list) -> pa.RecordBatch:
        columns = list(zip(*lines)) or [()] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    for batch in batches:
        done = []
        for c, segment, context, start, end in zip(*(batch.column(k).to_pylist() for k in (
                "conv_id", "segment", "context_chars", "loss_start", "loss_end"))):
            if c != conv:
                if conv is not nothing:
                    done.append(line(conv, state))
                conv, state = c, fresh()
            m = shape.fullmatch(segment)
            if m is None or context != state["end"]:
                raise ValueError(f"segment of conversation {c} does not follow the template")
            role, text = unescape_role(m[1]), unescape(m[2])
            state["n"] += 1
            state["end"] += len(segment)
            state["turns"].update(f"{role}\n{text}\n".encode())
            if start is not None:
                masked = unescape(segment[start - context:end - context])
                state["loss"] += len(masked)
                state["masked"].update(masked.encode())
                state["chars"] += state["end"]
                state["examples"] += 1
        yield batch_of(done)
    if conv is not nothing:
        yield batch_of([line(conv, state)])


def read_back(segments: DataFrame, ordered: bool = False) -> DataFrame:
    """Per conversation, what its segments say once parsed and unescaped, without spelling examples out.

    ``formatted_chars`` is the length that all examples would have.  ``ordered`` says
    that the rows come straight from ``expand``, conversation by conversation.
    """
    if not ordered:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return segments.mapInArrow(_read, DIGESTS)


def control_conversation(spark) -> DataFrame:
    """Conversation -1: control strings as texts."""
    said = f"{END}{START}{TARGET} ok"
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(said).alias("text"))


by_value(__name__)
