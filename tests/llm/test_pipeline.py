"""The pipeline, stage by stage, against brute-force versions."""

import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import mixing, quality
from plumbline.llm.common import table
from tests.llm.helpers import SCHEMA, documents, edited, prose
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_token_files import brute as brute_tokens
from tests.llm.test_token_files import tokenizer  # noqa: F401


def brute_windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 10]) for i in range(len(w) - 9)}, w


def brute_mix(rows, repeats=3, weights=(5, 2, 1)):
    """(doc_id, source, size) -> words taken, by sorting."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, t, n in rows if t == s) for s in sources}
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in sources if s not in capped]
        level = (total - sum(repeats * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0.0
        more = {s for s in free if repeats * size[s] < weight[s] * level}
        if not more:
            break
        capped |= more
    taken = []
    for s in sources:
        target = min(float(repeats * size[s]), weight[s] * level) if s not in capped else float(repeats * size[s])
        copies = int(target // size[s]) if size[s] else 0
        rest, mine = target - copies * size[s], {}
        for d, t, n in rows:
            if t == s:
                mine.setdefault(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], []).append((d, n))
        extra, used, open_ = set(), 0, rest > 0
        for h in sorted(mine):
            n = sum(x for _, x in mine[h])
            if open_ and used + n <= rest:
                extra.add(h)
                used += n
            elif open_:
                open_ = False
                if used + n - rest <= rest - used:
                    extra.add(h)
        taken += [(d, n, n * (copies + (h in extra))) for h, docs in mine.items() for d, n in docs]
    return taken


def test_pipeline_stages(spark, sf, tokenizer):  # noqa: F811
    docs = table(spark, sf, "documents")
    columns = docs.columns
    states = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep_table(stage(spark, docs, sf), "stage")
        states.append(docs.collect())
        if stage is not corpus_pipeline.encoded:
            assert docs.columns == columns, name
    first, good, single, clean, mixed, tokens = states
    scores = {r["doc_id"]: r["predicted"] for r in quality.op1(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    assert sorted(good) == sorted(r for r in first if scores[r["doc_id"]] == 1) and len(good) < len(first)
    keep = {c for _, _, c in brute_groups(map(tuple, good))}
    assert sorted(single) == sorted(r for r in good if r["doc_id"] in keep) and len(single) < len(good)
    tests = set()
    for item in table(spark, sf, "benchmark").collect():
        grams, w = brute_windows(item["text"])
        assert len(w) >= 10
        tests |= grams
    assert sorted(clean) == sorted(r for r in single if not brute_windows(r["text"])[0] & tests) and len(clean) < len(single)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = []
    rows = {r["doc_id"]: r for r in clean}
    for doc_id, n, taken in brute_mix([(r["doc_id"], r["source"], count(r["text"])) for r in clean]):
        want += [rows[doc_id]] * (taken // n if n else 0)
    assert sorted(mixed) == sorted(want)
    assert sorted(map(tuple, tokens), key=lambda x: x[1]) == brute_tokens(sorted(map(tuple, mixed)), tokenizer)


def test_mix_against_sorting(spark, docs):
    got = mixing.op10(docs)
    rows = got.select("doc_id", "source", "size").collect()
    assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in got.collect()), key=repr) == sorted(brute_mix(list(map(tuple, rows))), key=repr)
    by = {r["source"]: (r["target"], r["words"]) for r in got.groupBy("source").agg({"target": "max", "taken": "sum"}).toDF("source", "target", "words").collect()}
    assert all(abs(t - w) <= 6000 for t, w in by.values())
    assert got.filter("taken > 3 * size").count() == 0
    assert mixing.op10(docs.limit(0)).count() == 0
    weights = mixing.mixed(docs).groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert weights >= 1


def test_near_copies_are_told_by_five_words_and_80_percent(spark, sf):
    texts = [prose(k, 300) for k in range(4)]
    texts += [" ".join(t.split()[:n]) for t, n in zip(texts, (255, 250, 242, 230))] + [edited(texts[3], 7, 6), edited(texts[2], 8, 14)]
    sets = [{" ".join(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    up = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, sf).collect()} == set(up)
    assert {4, 5, 6} & set(up) == set()


def test_awkward_rows_pass_through_all_stages(spark, sf):
    """NULL and repeated ids, empty and NULL texts, and columns named like those the stages make."""
    awkward = {"size": F.lit(7), "score": F.lit("x"), "component_id": F.lit(None).cast("long"), "taken": F.lit(1.5), "text_id": F.lit("y"), "n_hit": F.lit(2)}
    docs = documents(spark).withColumns(awkward)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        docs = corpus_pipeline.keep_table(stage(spark, docs, sf), "stage")
        if stage is not corpus_pipeline.encoded:
            assert docs.columns == columns, name
            assert {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()} <= before, name
    assert docs.count() == docs.select("start", "doc_id").distinct().count()


def test_an_empty_table_passes_through_all_stages(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep_table(stage(spark, docs, sf), "stage")
        assert docs.count() == 0
