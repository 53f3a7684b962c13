from __future__ import annotations

import zlib
from collections import Counter
from math import exp, log

import pytest

from assayer.llm import langid
from assayer.llm.langid import fit, grams, identify, learning_rows
from assayer.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_against_plain_bayes(spark):
    docs = [(1, "the cat sat", "en"), (2, "le chat assis", "fr"), (3, "the dog", "en"), (4, "12 34", "en"), (5, None, "fr"),
            (6, "le chien", None), (7, "", "en"), (8, "Der Hund", "de")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    names, log_p = fit(df.select("lang", "text"))
    counts = {}
    for _, text, lang in docs:
        if text and lang and any(c.isalpha() for c in text):
            counts.setdefault(lang, Counter()).update(grams(text).tolist())
    assert names == sorted(counts) == ["de", "en", "fr"]
    for r in identify(df, (names, log_p)).collect():
        text = dict((d[0], d[1]) for d in docs)[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {x: sum(log((c[g] + langid.SMOOTHING) / (sum(c.values()) + langid.SMOOTHING * langid.BUCKETS))
                       for g in grams(text).tolist()) for x, c in counts.items()}
        best = max(logs, key=logs.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(exp(v - logs[best]) for v in logs.values()), abs=1e-9)


def test_more_languages_than_a_full_table_has_room_for(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_MODEL", 300 * 1024 * 8)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} word", f"l{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, log_p = fit(df.select("lang", "text"))
    assert len(names) == 500 and log_p.shape == (500, 512)
    found = {r.doc_id: r.lang_pred for r in identify(df, (names, log_p)).collect()}
    assert sum(found[i] == f"l{i}" for i in range(500)) > 400


def test_odd_rows(spark):
    rows = [(None, "the", "en"), (1, "ÉÉ é" * 90_000, "fr"), (1, "ÉÉ é", "fr"), (2, "\n\t", None), (3, "😀", "fr"), (4, "a", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, held_out int")
    got = identify(df, fit(df.select("lang", "text"))).collect()
    assert len(got) == 6 and sum(r.lang_pred == "und" for r in got) == 2
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    nothing = fit(df.limit(0).select("lang", "text"))
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}
    assert identify(df.limit(0), nothing).count() == 0


def test_held_out_rows_are_not_learned_from(spark):
    df = spark.createDataFrame([(i, "x", str(i)) for i in range(200)], "doc_id long, text string, lang string")
    kept = {int(r.lang) for r in learning_rows(df).collect()}
    assert kept == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 0}


def test_accuracy_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_lang_naive_bayes"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert {r.doc_id for r in rows if r.held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
