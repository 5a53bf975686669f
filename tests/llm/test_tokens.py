"""Alignment and packing against the libraries on whole texts, token by token."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import alignment, packing, units
from plumbline.llm.words import texts_of
from tests.llm.helpers import SCHEMA, documents

ODD = [
    " ", "  x", "x  ", "\n\nx", "a▁b c", "x ▁ y", "<|endoftext|> a <|endoftext|>b  <|endoftext|>", "中文 字 符　空格 x", "x\n y\r\n z \n\n  w", "é è    a \x00 b",
    "a  b \u0085 c  d", "don't we'll  I'm 12 345 !!! ...  ok", "<s> </s> <0x0A> <unk>", "é a", "😀 😀😀 x 😀\n", "word" * 900, "no " * 1500, "\t\t x\t y", "x  y ﻿ z",
]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, [(900 + i, t, None, "s1", len(t)) for i, t in enumerate(ODD)] + [(900, " ", None, "s1", 1)])


def test_units_put_together_are_the_text():
    import pyarrow as pa
    r = random.Random(5)
    texts = ["".join(r.choice(" \n\tab.é中▁　😀") for _ in range(r.randrange(40))) for _ in range(500)]
    t = texts_of(pa.array(texts))
    u = units.find_units(t)
    raw = t.data.tobytes()
    for i, text in enumerate(texts):
        assert b"".join(raw[s:e] for s, e in zip(u.start[u.first[i]:u.first[i + 1]], u.end[u.first[i]:u.first[i + 1]])).decode() == text


def test_forgetting_keeps_what_is_known(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(packing.Encoder, "remembered", 3)
    e = packing.Encoder(units.vocabulary(packing.TOKENIZER))
    texts = texts_of(pa.array(["one two three four five", "five one " + "x" * 90 + " six", "two six"]))
    first, again = e.encode(texts, 0), e.encode(texts, 0)
    assert len(e.number) == len(e.packed) == 3 and "x" * 90 not in str(list(e.number)) and first[0].tolist() == again[0].tolist()


def test_pointer_jumping_needs_a_logarithm_of_rounds():
    n = 4096
    a = np.append(np.arange(2, 2 * n, 2), 2 * n)
    b = np.append(np.arange(1, 2 * n, 2), 2 * n)
    to_a, to_b, rounds = alignment.terminals(a, b)
    assert set(to_a) == set(to_b) == {len(a) - 1} and rounds <= 14
    assert alignment.terminals(np.array([1, 3, 4]), np.array([1, 2, 4]))[0].tolist() == [0, 2, 2]


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(units.vocabulary(alignment.A))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=units.vocabulary(alignment.B))
    letters = units._byte_letters()
    out, links = [], []
    for doc_id, text in rows:
        tokens = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text or "")]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in tokens) != whole or b"".join(t for _, t in other) != whole:
            out.append((doc_id, 0, 0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for side in (tokens, other):
            at, held = 0, []
            for i, t in side:
                held.append((at, at + len(t), i))
                at += len(t)
            spans.append(held)
        found, k = [], 0
        for s, e, i in spans[0]:
            while k and spans[1][k][0] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                found.append((i, spans[1][j][2]))
                j += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        shown, low = [], 0
        for end in ends:
            shown.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= end) for side in spans))
            low = end
        out.append((doc_id, len(tokens), len(other), len(ends), len(found), hashlib.sha256(";".join(shown).encode()).hexdigest()))
        links.append(found)
    count = Counter(p for f in links for p in f)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted((*o[:5], sum(count[p] == most[p[1]] for p in f), sum(count[p] for p in f), o[5]) for o, f in zip(out, links) if o[0] is not None), count


def test_alignment_is_that_of_whole_texts(spark, odd, monkeypatch):
    want, count = brute_alignment([(r.doc_id, r.text) for r in odd.collect()])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.op11(odd.withColumn("chunk", F.lit(1)).withColumn("docs", F.lit("x"))).select(*names)
    assert sorted(tuple(r) for r in got.filter("doc_id IS NOT NULL").collect()) == want
    assert got.filter("doc_id IS NULL").count() == 1
    assert {(r.a_id, r.b_id): r.links for r in alignment.id_pairs(odd).collect()} == dict(count)
    texts = {r.doc_id: r.groups for r in alignment.aligned(odd).filter("doc_id >= 901").collect()}
    assert texts[904] == [] and sum(len(g.a) for g in texts[911]) == dict((w[0], w[1]) for w in want)[911]
    assert alignment.op11(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_chunks_count_as_few(docs):
    few, many = alignment.op11(docs.coalesce(1)), alignment.op11(docs.repartition(7))
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()


@pytest.mark.parametrize("capacity", [1, 64, 1024])
def test_packing_holds_every_token_once_and_pads_nothing(odd, capacity):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(units.vocabulary(packing.TOKENIZER))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids + [0])) for d, t in rows)
    pieces = packing.packed(odd.withColumn("length", F.lit(1)), capacity=capacity).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id, p.doc_tokens].append(p)
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0
        assert len({n for _, n in held}) == 1  # a bin holds one class
    got = Counter()
    for (doc_id, size), held in by_doc.items():
        texts = [w for w in want if w[0] == doc_id and len(w[1]) == size]
        copies = sum(want[t] for t in texts)
        assert sum(p.length for p in held) == copies * size
        if len(texts) == 1:
            ids = texts[0][1]
            assert all(tuple(p.ids) == ids[p.start:p.start + p.length] for p in held)
            got[doc_id, ids] += copies
    assert all(got[w] == n for w, n in want.items() if sum(v[0] == w[0] and len(v[1]) == len(w[1]) for v in want) == 1)


def test_sequences_are_put_together(odd):
    pieces = packing.packed(odd)
    made = packing.sequences(pieces).collect()
    assert all(len(r.ids) == r.n_tokens + r.n_padding and r.n_padding == 0 for r in made)
    assert sum(r.n_tokens for r in made) == pieces.agg(F.sum("length")).first()[0]
    short = odd.sparkSession.createDataFrame([(1, 0, [5, 6, 7]), (2, 0, [5, 6])], "sequence_id long, offset long, ids array<int>")
    assert {r.sequence_id: r.ids for r in packing.sequences(short, capacity=8).collect()} == {1: [5, 6, 7, 0, 0, 0, 0, 0], 2: [5, 6]}


def test_packing_of_an_empty_table_and_a_wrong_capacity(spark):
    assert packing.op13(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame([], SCHEMA), capacity=1000)
