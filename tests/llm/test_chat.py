from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from assayer.llm import chat
from assayer.llm.chat import (
    END, START, control_conversation, escape, escape_role, expand, read_back, read_examples, training_texts,
    unescape, unescape_role,
)
from assayer.llm.queries import QUERIES

ROWS = "conv_id long, turn long, role string, text string, segment int, seq string"


def brute(rows):
    """Digests per conversation, computed from the turns alone."""
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


@pytest.mark.parametrize("text", [
    "", "a", "<|", "<\\|", "<\\\\|im_end|>", f"{END}{START}assistant ok", "<<||", "\\", "<\\", "a<|b|>\\n\n",
])
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert unescape_role(escape_role(text)) == text and "\n" not in escape_role(text)


def test_odd_rows(spark):
    rows = [
        (1, 0, "system", "s", 1, "x"), (1, 1, "user", None, 1, "x"), (1, 2, "assistant", "", 1, "x"),
        (1, 3, "user", "u" * 200_000, 1, "x"), (1, 4, "assistant", f"é😀{END}", 1, "x"),
        (1, 5, "user", "left over", 1, "x"), (2, 0, None, "no role", 1, "x"),
        (2, None, "assistant", "no turn", 1, "x"), (2, 0, None, "no role", 1, "x"),
        (None, 1, "assistant", "no conversation", 1, "x"), (3, 0, "user", "alone", 1, "x"),
        (4, 0, f"odd\n{START}", "r", 1, "x"), (4, 0, "assistant", "tie", 1, "x"),
    ]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    segments = expand(df)
    assert digests(read_back(segments)) == brute(rows) == digests(read_back(segments, ordered=True))


def test_texts_hold_context_and_masked_reply(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"t{i} {START}", 0, "") for i in range(6)]
    segments = expand(spark.createDataFrame(rows, ROWS))
    texts = training_texts(segments).orderBy("seq").collect()
    assert [unescape(r.text[r.loss_start:r.loss_end]) for r in texts] == [f"t{i} {START}" for i in (1, 3, 5)]
    assert texts[2].text.startswith(texts[1].text) and texts[1].text.startswith(texts[0].text)
    assert texts[2].text.count(START) == 6
    assert read_back(segments).first().formatted_chars == sum(len(r.text) for r in texts)


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    assert expand(none).count() == 0 and read_back(expand(none)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [tuple(r) for r in control_conversation(spark).collect()]
    assert digests(QUERIES["op10_chat_prefix_target"](spark, sf)) == brute(rows)


def test_examples_are_read_back(spark):
    rows = [(c, i, r, f"{c} {i} {END}\n{START}", 0, "") for c, roles in (
        (1, ("user", "assistant", "user", "assistant")), (2, ("assistant", "user", "user")), (3, ("user",)),
        (None, ("system", "assistant"))) for i, r in enumerate(roles)]
    texts = training_texts(expand(spark.createDataFrame(rows, ROWS).repartition(3)))
    found = read_examples(texts)
    assert digests(found) == brute(rows)
    lengths = {}
    for r in texts.collect():
        lengths.setdefault(r.conv_id, []).append(len(r.text))
    assert {r.conv_id: r.formatted_chars for r in found.collect()} == {c: sum(n) for c, n in lengths.items()}
    assert {c: len(n) for c, n in lengths.items()} == {1: 2, 2: 2, 3: 1, None: 1}
    assert read_examples(texts.where("FALSE")).count() == 0
    with pytest.raises(Exception, match="does not follow the template"):
        read_examples(texts.withColumn("text", F.concat("text", F.lit("x")))).collect()


def test_query_reads_the_examples(spark, monkeypatch):
    """A reply changed in the spelled-out texts alone changes the digests."""
    sf = "/root/testdata/sf0.001"
    told = digests(QUERIES["op10_chat_prefix_target"](spark, sf))
    monkeypatch.setattr(chat, "training_texts", lambda segments: training_texts(segments).withColumn(
        "text", F.translate("text", "o", "0")))
    changed = digests(QUERIES["op10_chat_prefix_target"](spark, sf))
    assert told.keys() == changed.keys() and all(told[c][1] != changed[c][1] and told[c][0] == changed[c][0] for c in told)
