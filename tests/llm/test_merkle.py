"""The manifest against a plain recursive tree."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle
from tests.llm.helpers import SCHEMA, documents, prose


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(digests):
    """The root, and for each leaf its (left, right) siblings from the bottom up."""
    ways = [[] for _ in digests]
    held = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, under = [], []
        for low in range(0, len(digests), 16):
            run = digests[low:low + 16]
            for k in range(len(run)):
                for i in held[low + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h(run))
            under.append([i for part in held[low:low + 16] for i in part])
        digests, held = up, under
    return digests[0], ways


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    by = defaultdict(list)
    for d, text, lang, source, n in rows:
        first = leaf_of((d, source, lang, n, text))
        second = leaf_of((d, source, lang, n, lower(text))) if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else first
        by[source].append((d is not None, d or 0, first, second))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    lowers = {}
    for s in order:
        by[s].sort()
        lowers[s] = tree([x[2] for x in by[s]])
    root, ups = tree([lowers[s][0] for s in order])
    out = []
    for s, up in zip(order, ups):
        for (there, d, first, second), way in zip(by[s], lowers[s][1]):
            got = second
            for left, right in way + up:
                got = h((left, got, right))
            out.append((d if there else None, first, lowers[s][0], root, h(left + right for left, right in way + up), got, got == root))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(df):
    return sorted((tuple(r) for r in merkle.op12(df).select(*NAMES).collect()), key=repr)


def test_deep_trees_nulls_and_repeated_rows(spark):
    more = [(10_000 + 7 * i, f"Row {i}", "en", "s1", i) for i in range(300)] + [(20_000, "A", None, "é", 1), (20_005, "B", None, "z", None), (20_005, "B", None, "z", None), (20_006, "", "", "", 0)]
    df = documents(spark, more)
    want = brute([tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    got = run(df.withColumns({"digest": F.lit("x"), "tree": F.lit(1), "lo": F.lit(5)}))
    assert got == want
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_one_source(spark, n):
    df = spark.createDataFrame([(i, f"Text {i}", "en", "only", i) for i in range(n)], SCHEMA)
    assert run(df) == brute([tuple(r) for r in df.collect()])


def test_many_sources_of_one_document(spark):
    df = spark.createDataFrame([(i, prose(i, 5), "en", f"s{i:03}" if i else None, i) for i in range(40)], SCHEMA)
    assert run(df) == brute([tuple(r) for r in df.collect()])


def test_the_manifest_covers_every_leaf_on_every_level(spark):
    df = spark.createDataFrame([(i, "x", "en", f"s{i % 3}", i) for i in range(100)], SCHEMA)
    nodes = merkle.manifest(df).collect()
    for source, level in {(r.source, r.level) for r in nodes if not r.of_sources}:
        spans = sorted((r.lo, r.hi) for r in nodes if (r.source, r.level, r.of_sources) == (source, level, False))
        assert spans[0][0] == 0 and spans[-1][1] in (33, 34) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert [r.level for r in nodes if r.of_sources].count(0) == 3


def test_empty_table(spark):
    assert merkle.op12(spark.createDataFrame([], SCHEMA)).count() == 0
