"""Substring dedup on planted passages, insertions and clean texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import common as C
from plumbline.llm import substring as S
from plumbline.llm import words as W
from tests.llm.helpers import SCHEMA, documents, prose, rows


def test_cuts_resist_insertions():
    base = prose(5, 400)
    moved = "inserted words " + base[:900] + "x" + base[900:]
    t = W.texts_of(pa.array([base, moved, base]))
    c = S.chunks(t)
    parts = [[t.data[c.start[k]:c.end[k]].tobytes() for k in range(c.first[i], c.first[i + 1])] for i in range(3)]
    assert [b"".join(p).decode() for p in parts] == [base, moved, base]
    assert parts[0] == parts[2] and len(set(parts[0]) - set(parts[1])) <= 6
    W_slice, W.SLICE = W.SLICE, 97
    try:
        again = S.chunks(t)
    finally:
        W.SLICE = W_slice
    assert (again.start == c.start).all()


@pytest.fixture(scope="module")
def planted():
    r = random.Random(9)
    unique = lambda n: " ".join("".join(r.choice("abcdefghijklmnoprstuvwäé") for _ in range(r.randrange(2, 10))) for _ in range(n))
    passages = [unique(n) for n in (55, 60, 80, 200)]
    table, holds = [], {}
    for k in range(80):
        p = passages[k % 4] if k < 40 else None
        text = f"{unique(30)} {p} {unique(40)}" if p else unique(120)
        table.append((k, text, None, None, None))
        if p:
            holds[k] = (text, p)
    return table, holds


def test_passages_are_found_and_clean_texts_left_alone(spark, planted):
    table, holds = planted
    found = S.repeats(spark.createDataFrame(table, SCHEMA).repartition(4)).collect()
    assert {f["doc_id"] for f in found} == set(holds)
    for f in found:
        text, passage = holds[f["doc_id"]]
        got = text.encode()[f["start"]:f["end"]].decode()
        assert got in passage or set(got.split()[2:-2]) <= set(passage.split())
        cut = sum(c["end"] - c["start"] for c in f["removable"])
        assert cut > 0.6 * len(passage.encode()) if f["doc_id"] >= 4 else cut == 0


def test_deduplicated_keeps_the_first_place(spark, planted):
    table, holds = planted
    kept = {r["doc_id"]: r["text"] for r in S.deduplicated(spark.createDataFrame(table, SCHEMA)).collect()}
    for doc_id, text, *_ in table:
        if doc_id in holds and doc_id >= 4:
            assert len(kept[doc_id].split()) < len(text.split()) - 20
        else:
            assert kept[doc_id] == text


def test_digests_against_brute_force(spark):
    """Shared runs by hand: the documents and spans agree on the awkward table."""
    table = rows()
    texts = W.texts_of(pa.array([r[1] for r in table]))
    grams, owner, start, end = S.runs(texts)
    places = {}
    for g, o, s, e in zip(grams.tolist(), owner.tolist(), start.tolist(), end.tolist()):
        places.setdefault(g, []).append((o, s - texts.offsets[o], e - texts.offsets[o]))
    covered = {}
    for spots in places.values():
        if len(spots) > 1:
            for o, s, e in spots:
                covered.setdefault(table[o][0], set()).update(range(s, e))
    found = S.repeats(spark.createDataFrame(table, SCHEMA), 1).collect()
    got = {}
    for f in found:
        got.setdefault(f["doc_id"], set()).update(range(f["start"], f["end"]))
    assert {k: v for k, v in got.items()} == covered


def test_empty_table(spark):
    assert S.op5(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.op5(documents(spark)).count() > 0


PHRASES = ["no ", "click here ", "lorem ipsum dolor ", "нет ", "terms of use and privacy notice apply to this page\n"]


def test_repeated_phrases_are_found(spark):
    """Text of a short period, between other words in each document, and copies of texts with few chunks."""
    r = random.Random(3)
    unique = lambda n: " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randrange(2, 10))) for _ in range(n))
    passages = [p * -(-60 // len(p.split())) for p in PHRASES]
    table = [(10 * d + k, f"{unique(20 + d)} {p} {unique(30)}", None, None, None) for d in range(3) for k, p in enumerate(passages)]
    short = " ".join("abcdefghijklmnopqrstuvwxyzab")
    table += [(100, short, None, None, None), (101, short, None, None, None)]
    found = {}
    for f in S.repeats(spark.createDataFrame(table, SCHEMA)).collect():
        found.setdefault(f["doc_id"], []).append(f)
    assert set(found) == {t[0] for t in table}
    for doc_id, text, *_ in table:
        at = text.encode().find(passages[doc_id % 10].encode()) if doc_id < 100 else 0
        size = len(passages[doc_id % 10].encode()) if doc_id < 100 else len(short)
        assert all(f["start"] >= at - 1 and f["end"] <= at + size + 1 for f in found[doc_id])
        if 10 <= doc_id < 100 or doc_id == 101:
            assert sum(c["end"] - c["start"] for f in found[doc_id] for c in f["removable"]) > 0.6 * size


def test_every_window_holds_a_cut(monkeypatch):
    texts = W.texts_of(pa.array([prose(2, 200), "", *[p * 60 for p in PHRASES], "x" * 500, prose(4, 3)]))
    c = S.chunks(texts)
    assert (c.end - c.start).max() < S.REACH + S.MOST + 4
    for size in (61, 97, 1000):
        monkeypatch.setattr(W, "SLICE", size)
        again = S.chunks(texts)
        assert (again.start == c.start).all() and (again.end == c.end).all()


def test_texts_of_one_document_are_told_apart(spark):
    passage, other = prose(70, 80), prose(71, 300)
    table = [(1, f"{passage} {prose(72, 40)}", None, None, None), (2, f"{prose(73, 40)} {passage}", None, None, None), (1, other, None, None, None), (1, f"{passage} {prose(72, 40)}", None, None, None)]
    found = S.repeats(spark.createDataFrame(table, SCHEMA)).distinct().collect()
    by_text = {}
    for f in found:
        by_text.setdefault((f.doc_id, f.text_id), []).append(f)
    assert len(by_text) == 2 and {d for d, _ in by_text} == {1, 2}
    kept = [(r.doc_id, r.text) for r in S.deduplicated(spark.createDataFrame(table, SCHEMA)).collect()]
    assert (1, other) in kept


def test_texts_are_told_apart_without_being_shuffled_and_steps_let_their_shuffles_go(spark):
    rows = [(i, f"{i} " + "text " * 400) for i in range(200)] + [(7, "another text of the same document")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        told = S.with_text_id(docs)
        assert "SortMergeJoin" not in told._jdf.queryExecution().executedPlan().toString()
        assert told.filter("text_id <> 0").count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.conf.get(C.RELEASE, "false") == "false"
