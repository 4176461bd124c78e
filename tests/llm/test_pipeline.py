"""The corpus pipeline: each stage against brute force on its own input."""

from __future__ import annotations

import collections
import os

import pytest

import corpus_pipeline
from terrabag.llm import language_id, line_dedup
from terrabag.llm.common import materialize

from .test_operators import COLUMNS, DATA, EDGE, VOCAB, near_brute

pytestmark = pytest.mark.skipif(not (os.path.isdir(DATA) and os.path.exists(VOCAB)), reason="test tables or tokenizer are missing")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mix_sources", "pack"]

    docs = materialize(stages["language_id"](spark, docs, DATA), "t")
    after = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r for r in language_id.language_id(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    letters = lambda t: sum(language_id.letter_codes()[ord(c)] > 0 for c in t)
    want = {i for i, r in before.items() if scores[i].lang_pred != "und" and (letters(r.text) < 200 or scores[i].score >= 0.6)}
    assert docs.columns == columns and set(after) == want and all(after[i] == before[i] for i in after)

    before, docs = after, materialize(stages["line_dedup"](spark, docs, DATA), "t")
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(after) == set(before)
    for i, r in after.items():
        old, new = before[i].text.split("\n"), iter(r.text.split("\n"))
        left = [x for x in old if len(x.strip(" ").split(" ")) < line_dedup.MIN_TOKENS]
        assert r.text == before[i].text or r.n_chars == len(r.text) and all(x in old for x in new) and all(x in r.text.split("\n") for x in left)

    before, docs = after, materialize(stages["near_dedup"](spark, docs, DATA), "t")
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(after) == {i for i, (_, c) in near_brute([(i, r.text) for i, r in before.items()], 80).items() if i == c}

    before, docs = after, materialize(stages["mix_sources"](spark, docs, DATA), "t")
    rows = docs.collect()
    assert docs.columns == columns and all(r == before[r.doc_id] for r in rows)
    times = collections.Counter(r.doc_id for r in rows)

    packed = stages["pack"](spark, docs, DATA).collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == times
    assert all(r.offset + r.length <= 4096 for r in packed)


def test_stages_of_odd_rows(spark):
    """Nulls, empties, repeated rows, clashing names and empty tables in every stage."""
    docs = spark.createDataFrame(EDGE, COLUMNS)
    kept = {"language_id": {"5", "6", "7", "8"}, "line_dedup": {"None", "3", "4", "5", "6", "7", "8", "9"}, "near_dedup": {"None", "3", "4", "5", "7", "8", "9"}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "pack":
            assert out.columns == docs.columns
        ids = {str(r.doc_id) for r in out.collect()}
        assert ids == kept[name] if name in kept else ids <= {str(r[0]) for r in EDGE}
        assert stage(spark, docs.limit(0), DATA).isEmpty()


def test_copies_leave_no_empty_texts(spark):
    """A copy would lose every line; it stays whole for the next stage, which drops it."""
    text = "\n".join(f"line {a} of a text that was copied as a whole, word by word" for a in ("one", "two", "three"))
    rows = [(i, text if i < 3 else f"{text.split(chr(10))[0]}\n\n{('ships sail at dawn', 'my aunt grows five red pears there')[i - 3]}", "en", "s", 7, 1, None) for i in range(5)]
    stages = dict(corpus_pipeline.STAGES)
    docs = materialize(stages["line_dedup"](spark, spark.createDataFrame(rows, COLUMNS), DATA), "t")
    assert {r.doc_id: r.text for r in docs.collect()} == {i: text if i < 3 else t.split("\n", 1)[1] for i, t, *_ in rows}
    assert all(r.n_chars == (7 if r.doc_id < 3 else len(r.text)) for r in docs.collect())
    assert {r.doc_id for r in stages["near_dedup"](spark, docs, DATA).collect()} == {0, 3, 4}
