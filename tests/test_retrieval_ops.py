"""Retrieval and grounding against hand tables and plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import dense as de
from plumbline.operators import grounding as gr
from plumbline.operators import retrieval as rt
from plumbline.sources import tables as tb


def ranks(spark, rows):
    return spark.createDataFrame([("q", 1, i, r, 1.0) for i, r in rows], "question_id string, paper_id long, section_idx int, rank int, score double")


def test_fusion_table(spark):
    got = rt.fuse(ranks(spark, [(0, 0), (1, 1)]), ranks(spark, [(1, 0), (2, 1)])).orderBy("rank").collect()
    assert [r["section_idx"] for r in got] == [1, 0, 2]
    assert abs(got[0]["score"] - (1 / 61 + 1 / 60)) < 1e-8


def test_dense_gate(spark):
    dense = ranks(spark, [(i, i) for i in range(8)])
    got = rt.gate_dense(dense, ranks(spark, [(7, 0)]))
    assert sorted(r["section_idx"] for r in got.collect()) == [0, 1, 2, 3, 4, 7]


def test_no_scorer_means_words_only(spark):
    s = spark.createDataFrame([(1, 0, "Storage", "quorum writes are durable"), (1, 1, "Other", "nothing here")], "paper_id long, section_idx int, heading string, content string")
    q = spark.createDataFrame([("q", 1, "which quorum writes?"), ("z", 1, "zebra")], "question_id string, paper_id long, text string")
    got = rt.rank_sections(q, s, lambda *_: None).collect()
    assert [(r["question_id"], r["section_idx"], r["method"]) for r in got] == [("q", 0, "lexical")]
    loose = rt.rank_sections(q, s, de.profile_scorer, require_lexical=False)
    assert loose.filter("question_id = 'z' and not lexical_match").count() == 2


def select(order, lens, frame, budget):
    chosen, used = [], 0
    for i in order:
        if used + lens[i] > budget and chosen:
            continue
        chosen.append(i)
        used += lens[i]
    for i in sorted(frame):
        if i not in chosen and used + lens[i] <= budget:
            chosen.append(i)
            used += lens[i]
    return sorted(chosen)


def test_select_context_matches_walk(spark):
    rng = random.Random(3)
    sections, ranked, questions, expected = [], [], [], {}
    for p in range(12):
        n = rng.randint(3, 9)
        lens = [rng.randint(20, 400) for _ in range(n)]
        heads = [rng.choice(["Introduction", "Method", "1. Background", "Results"]) for _ in range(n)]
        sections += [(p, i, heads[i], "w" * lens[i]) for i in range(n)]
        order = rng.sample(range(n), rng.randint(1, n))
        ranked += [(f"q{p}", p, i, r, 1.0, True, "hybrid") for r, i in enumerate(order)]
        questions.append((f"q{p}", p, "quorum"))
        frame = [i for i in range(n) if heads[i] in ("Introduction", "1. Background")]
        got = select(order, lens, frame, 600)
        expected[f"q{p}"] = [] if len(got) == n else got
    out = rt.select_context(
        spark.createDataFrame(questions, "question_id string, paper_id long, text string"),
        spark.createDataFrame(sections, "paper_id long, section_idx int, heading string, content string"),
        spark.createDataFrame(ranked, "question_id string, paper_id long, section_idx int, rank int, score double, lexical_match boolean, method string"),
        budget=600, small=10,
    ).collect()
    assert {r["question_id"]: r["sections"] for r in out} == expected


def vectors(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 8))
    return m, spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], "id long, vector array<double>")


def cosines(m):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    return u @ u.T


def test_knn_by_block_and_by_tiles(spark, monkeypatch):
    m, v = vectors(spark, 60)
    q = v.filter("id < 7").withColumnRenamed("id", "query_id")
    c = cosines(m)
    want = {(i, int(j)) for i in range(7) for j in np.argsort(-c[i], kind="stable")[:4]}
    as_set = lambda df: {(r["query_id"], r["id"]) for r in df.collect()}
    assert as_set(de.knn(q, v, 4)) == want
    monkeypatch.setattr(de, "TILE", 5)
    assert as_set(de.knn(q, v, 4)) == want


def test_similar_pairs_with_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(de, "TILE", 6)
    m, v = vectors(spark, 80)
    c = cosines(m)
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if round(c[i, j], 9) >= 0.6}
    assert {(r["a"], r["b"]) for r in de.similar_pairs(v, 0.6).collect()} == want and want


def test_locate(spark):
    text = "Intro words here.\nThe system uses a write quo-\nrum of four out of six copies in every zone. Tail."
    papers = spark.createDataFrame([(1, text)], "paper_id long, text string")
    quotes = spark.createDataFrame(
        [("exact", 1, "a write quorum of four out"), ("loose", 1, "write quorumof four outof six copies"),
         ("near", 1, "quorum with four copies placed across every zone"), ("none", 1, "entirely unrelated words about penguins swimming"), ("short", 1, "write quorum")],
        "quote_id string, paper_id long, text string")
    assert [r["quote_id"] for r in gr.locate_exact(quotes, papers).collect()] == ["exact"]
    assert {r["quote_id"] for r in gr.locate_squeezed(quotes, papers).collect()} >= {"loose"}
    assert {r["quote_id"] for r in gr.locate_approx(quotes, papers).collect()} >= {"near"}
    assert {r["quote_id"] for r in gr.evidence_found(quotes, papers).collect()} == {"exact", "loose", "near"}
    hit = gr.raw_offsets(gr.locate_exact(quotes, papers), papers).collect()[0]
    assert text[hit["start"]:hit["end"]] == "a write quo-\nrum of four out"


def test_approx_without_a_named_paper_agrees_with_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("paper_id"), "text")
    quotes = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("quote_id"), "text")
    free = gr.locate_approx(quotes, docs).select("quote_id", "paper_id", "score")
    ids = [r["paper_id"] for r in docs.select("paper_id").collect()]
    every = quotes.withColumn("paper_id", F.explode(F.array(*[F.lit(i) for i in ids])))
    named = every.withColumn("quote_id", F.concat_ws(":", "quote_id", "paper_id"))
    full = {r["quote_id"]: round(r["score"], 6) for r in gr.locate_approx(named, docs).collect()}
    assert {f'{r["quote_id"]}:{r["paper_id"]}': round(r["score"], 6) for r in free.collect()} == full and full


def test_resolve_names_page_and_skips_scaffolding(spark):
    hits = spark.createDataFrame([("a", 1, 15, 25), ("b", 1, 2, 6), ("c", 1, 18, 45)], "quote_id string, paper_id long, start long, end long")
    segs = spark.createDataFrame([(1, 10, 30, 100, "One"), (1, 40, 60, 300, "Two")], "paper_id long, from long, to long, at long, heading string")
    pages = spark.createDataFrame([(1, 1, 0, 200), (1, 2, 200, 400)], "paper_id long, page long, start long, end long")
    got = {r["quote_id"]: r for r in gr.resolve(hits, segs, pages).collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"]["page"], got["a"]["page_end"], got["a"]["start"], got["a"]["end"]) == (1, None, 105, 115)
    assert (got["c"]["page"], got["c"]["page_end"], got["c"]["end"]) == (1, 2, 305)


def test_overlapping_quotes(spark):
    rows = [(1, 0, 10, 20), (1, 1, 15, 30), (1, 2, 20, 25), (1, 3, 90, 95), (2, 0, None, None), (2, 1, 5, 9)]
    df = spark.createDataFrame(rows, "answer_id long, quote_no int, start int, end int")
    got = {(r["answer_id"], r["quote_no"]) for r in gr.dedupe_overlaps(df).collect()}
    assert got == {(1, 0), (1, 2), (2, 1)}


def test_concept_and_relation_gates(spark):
    papers = spark.createDataFrame([(1, "My Title", "We use write-ahead logs and quorums to keep six copies of the data safe.")], "paper_id long, title string, text string")
    c = spark.createDataFrame(
        [(1, 0, "My Title", [], "x"), (1, 1, "Quorum", ["voting"], "nope"), (1, 2, "Penguins", [], "nothing of the kind at all"),
         (1, 3, "Durability", [], "keep six copies of the data safe"), (1, 4, "quorum", [], "nope")],
        "paper_id long, concept_no int, name string, aliases array<string>, evidence string")
    kept = gr.ground_concepts(c, papers)
    assert {r["name"] for r in kept.collect()} == {"Quorum", "Durability"}
    rel = spark.createDataFrame(
        [(1, 0, "voting", "durability", "contrasts-with", "keep six copies of the data safe"), (1, 1, "Durability", "Quorum", "contrasts-with", "keep six copies of the data safe"),
         (1, 2, "Quorum", "Penguins", "builds-on", "keep six copies of the data safe"), (1, 3, "Quorum", "Durability", "builds-on", "a quote that is not there")],
        "paper_id long, relation_no int, source string, target string, type string, evidence string")
    got = gr.ground_relations(rel, kept, papers).collect()
    assert [(r["relation_no"], r["source"], r["target"]) for r in got] == [(0, "Quorum", "Durability")]
    assert gr.grounding_report(c, kept, "concept_no").collect()[0]["dropped"] == 3


def test_terms_are_counted_beside_their_text(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    once = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "paper_id long, text string")
    counted = rt.term_counts(once)
    assert "Exchange" not in plan(counted)
    assert sorted(map(tuple, counted.collect())) == [(1, "alpha", 2), (1, "beta", 1)]
    twice = once.union(spark.createDataFrame([(1, "beta gamma"), (None, "delta"), (None, "delta")], once.schema))
    assert sorted(map(str, rt.term_counts(twice).collect())) == sorted(map(str, twice.groupBy("paper_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("t")).select(
        "paper_id", F.explode(F.split("t", " ")).alias("word")).filter("word <> ''").groupBy("paper_id", "word").agg(F.count("*").alias("n")).collect()))
    sections = spark.createDataFrame([(1, 0, "alpha", "alpha beta alpha"), (1, 1, "beta", "beta gamma"), (2, 0, "", "")], "paper_id long, section_idx int, heading string, content string")
    assert {(r["word"], round(r["idf"], 6)) for r in rt.idf(sections).collect()} == {("alpha", 0.693147), ("beta", 0.510826), ("gamma", 0.693147)}
    assert "Join" not in plan(rt.idf(sections))
    asked = spark.createDataFrame([("q", 1, "beta gamma"), ("r", 2, "beta")], "question_id string, paper_id long, text string")
    scores = rt.bm25(sections, asked)
    assert "LeftSemi" not in plan(scores) and sorted((r["question_id"], r["section_idx"]) for r in scores.collect()) == [("q", 0), ("q", 1)]


def test_similar_pairs_multiply_a_strip_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    v = spark.createDataFrame(vectors, "id long, vector array<double>")
    monkeypatch.setattr(de, "TILE", 16)
    whole = {tuple(r) for r in de.similar_pairs(v, 0.5).collect()}
    monkeypatch.setattr(de, "STRIP", 3)
    assert {tuple(r) for r in de.similar_pairs(v, 0.5).collect()} == whole and whole


def test_idf_is_counted_beside_the_text(spark):
    key = lambda df: sorted((r["paper_id"], r["word"], round(r["idf"], 9)) for r in df.collect())
    once = spark.createDataFrame([(1, "alpha beta alpha\n\nbeta gamma\n  "), (2, ""), (3, None), (4, "alpha\r\nalpha")], "paper_id long, text string")
    counted = rt.idf_in_texts(once, tb.contents)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert key(counted) == key(rt.idf(tb.sections_of(once))) == [(1, "alpha", 0.693147181), (1, "beta", 0.510825624), (1, "gamma", 0.693147181), (4, "alpha", 0.510825624)]
    twice = once.union(spark.createDataFrame([(4, "beta\nalpha")], once.schema))
    assert key(rt.idf_in_texts(twice, tb.contents)) == key(rt.idf(tb.sections_of(twice)))
    assert (4, "alpha", round(float(np.log(1 + 4 / 4)), 9)) in key(rt.idf_in_texts(twice, tb.contents))
