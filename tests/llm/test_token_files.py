"""Token files against the tokenizer itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import token_files as T
from plumbline.llm import words as W
from tests.llm.helpers import SCHEMA, documents, rows, twins

ODD = ["It's I'M we'll don't THEY'RE", "ÀÉÎÕÜ straße ÿ œ Ž", "İstanbul ΣΊΣΥΦΟΣ ﬁ ½ ² x²", "<|endoftext|> a<|startoftext|>b <| |>", "é café ́x",
       "a b c\x1cd\x85e", "日本語 テスト 123,456.78 %%% &&& ###!!", "\x00\x01 tab\tnl\nx", "''s 'sx 'tt a's'd", "×÷ µ ª º ŉ ſ ĸ", "w" * 3000, "🙂👩‍👩‍👧 ok", " ".join(twins()), " ".join(twins(64))]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.tokenizer_path())


def test_words_encode_as_the_whole_text(tokenizer):
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("aZé'ß1 \t.!s<|ts>İ") for _ in range(60)) for _ in range(300)]
    got = T.Encoder(T.tokenizer_path()).encode(W.texts_of(pa.array(texts)))
    ends = np.cumsum(got[1])
    for text, ids in zip(texts, np.split(got[0], ends[:-1])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 33, n)).astype("<u4")
        assert (T.unpack(*T.pack(values), n) == values).all()


def brute(table, tokenizer):
    out, start = [], 0
    for doc_id, text, *_ in table:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op8(spark, tokenizer):
    table = rows() + [(600 + k, t, None, None, None) for k, t in enumerate(ODD)]
    got = T.op8(spark.createDataFrame(table, SCHEMA).repartition(6)).collect()
    want = brute(sorted(table, key=lambda x: (x[0] is not None, x[0] or 0)), tokenizer)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


def test_op8_empty_and_blocks(spark, tokenizer, monkeypatch):
    assert T.op8(spark.createDataFrame([], SCHEMA)).count() == 0
    folder, shards = T.write_tokens(documents(spark))
    lists = T.read_tokens(folder, shards).collect()
    assert sum(len(r["ids"]) for r in lists) == sum(r["n_ids"] for r in shards.collect())
    assert all(r["ids"][-1] == T.END_ID for r in lists)
