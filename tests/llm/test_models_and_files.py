"""Quality classifier, archives and the awkward rows."""

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from plumbline.llm import common, quality, warc
from plumbline.llm import words as W
from plumbline.llm.common import table
from tests.llm.helpers import SCHEMA, documents, rows


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    got = quality.op1(table(spark, sf, "documents"), labels)
    assert got.count() == 1000
    known = got.join(labels, "doc_id").filter("held_out").toPandas()
    label, score = known["quality"].to_numpy(), known["score"].to_numpy()
    assert len(known) > 40 and auc(score, label) > 0.97
    assert ((score >= quality.THRESHOLD) == known["predicted"]).all() and ((score >= 0) & (score <= 1)).all()
    assert np.mean((known["predicted"] == label)) > 0.95
    assert np.mean((score - label) ** 2) < 0.05


def test_scores_of_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(3, None, 0), (None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.op1(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    same = {}
    for r in got:
        same.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(v) == 1 for v in same.values())
    for one in (labels.filter("quality = 1"), labels.limit(0)):
        assert {r["score"] for r in quality.op1(docs, one).collect()} <= {1.0, 0.5}
    assert quality.op1(docs.limit(0), labels).count() == 0
    extra = docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "quality")
    out = quality.scored(extra, quality.fit(extra, labels))
    assert out.columns == [*extra.columns, "_score"] and out.count() == len(rows())
    assert quality.accepted(extra, labels, 0.0).columns == extra.columns


def test_contexts_by_hand():
    """Context sums against a plain loop over tokens."""
    index = quality.index_vectors()
    texts = W.texts_of(pa.array(["a b, c A9", None, "b a a", ""]))
    word, shape, owner = quality.tokens(texts)
    want = np.zeros((quality.ROWS + quality.SHAPES, quality.DIM), np.int64)
    for i in range(len(word)):
        for j in range(len(word)):
            if i != j and owner[i] == owner[j] and abs(i - j) <= quality.REACH:
                for row in (word[i], shape[i]):
                    want[row] += index[word[j]].astype(int) + index[shape[j]]
    got, count = np.zeros_like(want), np.zeros(len(want), np.int64)
    quality.add_contexts(got, count, texts, index)
    assert (got == want).all() and count.sum() == 2 * len(word) == 18


@pytest.fixture(scope="module")
def pages(spark):
    made = [(k, f"http://x/{k}\n", f"<p>page {k % 7}</p>" * (1 + k % 3)) for k in range(60)]
    made += [(100, None, None), (101, "u", ""), (102, "u", "é" * 50_000), (103, "u", "é" * 50_000), (None, "u", "<p>page 1</p>"), (104, "u", "only"), (59, "again", made[59][2])]
    return spark.createDataFrame(made, "page_id long, url string, html string").repartition(3), made


def test_archives_round_trip(spark, pages, monkeypatch):
    df, made = pages
    best = {}
    for page, _, html in made:
        if page is not None:
            best[html or ""] = max(best.get(html or "", -1), page)
    want = []
    for page, _, html in made:
        body = (html or "").encode()
        keeper = best[html or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page, len(body), digest, "response" if page == keeper else "revisit", None if page == keeper else keeper))
    got = warc.op9(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    folder, files = warc.write_archives(df)
    stored = warc.read_archives(folder, files, "bigint", payloads=True).filter("record_type = 'response'").collect()
    assert {(r["page_id"], bytes(r["payload"])) for r in stored} == {(p, (h or "").encode()) for (p, _, h), w in zip(made, want) if w[3] == "response"}
    assert warc.op9(df.limit(0)).count() == 0


def test_archive_frames(spark, pages):
    """The first frame is skippable and holds the dictionary; every record is a frame of its own."""
    folder, files = warc.write_archives(pages[0])
    name = files.first()["name"]
    with common.open_file(folder, name) as f:
        raw = f.read()
    magic, size = np.frombuffer(raw[:8], "<u4").tolist()
    book = raw[8:8 + size]
    assert magic == warc.MAGIC and size > 0
    plain, at, seen = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(book)), 8 + size, 0
    while at < len(raw):
        one = plain.decompressobj()
        assert one.decompress(raw[at:]).startswith(b"WARC/1.1\r\n") and one.eof
        at, seen = len(raw) - len(one.unused_data), seen + 1
    assert seen == files.filter(files["name"] == name).first()["records"]
    with pytest.raises(ValueError):
        list(warc.read_records(pa.BufferReader(raw[:-5])))


def test_files_are_whole_or_absent(tmp_path):
    folder = f"file://{tmp_path}/a"
    out = common.AtomicFile(folder, "x")
    out.write(b"one")
    assert not common.exists(folder, "x")
    out.close()
    again = common.AtomicFile(folder, "x")
    again.write(b"two")
    again.close()
    with common.open_file(folder.replace("file://", "file:"), "x") as f:
        assert f.read() == b"two"
    common.remove(folder, "x")
    assert not common.exists(folder, "x")


def test_long_rows_are_pieces_of_their_own():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, "b" * 50, None, "c", "d" * 200, "e"])})
    sizes = [part.num_rows for part, _ in common.pieces(batch, limit=60)]
    assert sizes == [3, 1, 1, 1] and sum(sizes) == batch.num_rows


def test_schema_is_the_given_one(spark):
    assert documents(spark).schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()


def test_long_pages_teach_the_dictionary_too(spark):
    long = [(k, "u", f"<html>{k}" + "common words of every page here " * 3000) for k in range(30)]
    pages = spark.createDataFrame(long + [(99, "u", ""), (98, "u", None)], "page_id long, url string, html string")
    book = warc.dictionary(pages)
    assert 0 < len(book) <= warc.DICTIONARY_BYTES and b"common words of every page" in book
    assert warc.dictionary(pages.filter("page_id > 90")) == b""
