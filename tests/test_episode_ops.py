"""Checks, fault matrices, scoring, timelines, jobs, traces, graph and ledger."""

import random
import re

import pytest

from pyspark.sql import functions as F

from plumbline.operators import checks as ck
from plumbline.operators import graph as gp
from plumbline.operators import jobs as jb
from plumbline.operators import ledger as le
from plumbline.operators import scoring as sc
from plumbline.operators import timeline as tl
from plumbline.operators import trace as tr
from plumbline.plans import registry
from plumbline.sources import library as lb

SAY = "the log is the database and storage keeps six copies across three zones with a quorum of four "


def clean(spark):
    turns = [("e", i, "host" if i % 2 == 0 else "guest", (SAY * 3).strip().capitalize() + ".") for i in range(6)]
    return (spark.createDataFrame(turns, "episode_id string, turn_idx long, speaker string, text string"),
            spark.createDataFrame([("e", 1, 1)], "episode_id string, paper_id long, minutes int"),
            spark.createDataFrame([(1, SAY)], "paper_id long, text string"))


def test_clean_control_passes_and_every_fault_is_caught(spark):
    args = clean(spark)
    assert ck.run_checks(*args).filter("not passed").count() == 0
    rows = ck.detection_rate(ck.detection(*args)).collect()
    assert len(rows) == 9 and all(r["rate"] == 1.0 for r in rows)


def test_all_checks_together_see_the_summary_and_key_points(spark, sf):
    queries = registry.queries()
    want = {(r["episode_id"], r["passed"], r["offences"]) for r in queries["c1_schema"](spark, sf).collect()}
    got = {(r["episode_id"], r["passed"], r["offences"]) for r in queries["x3_run_checks"](spark, sf).filter("check_id = 'schema'").collect()}
    assert got == want and not all(passed for _, passed, _ in want)


def test_turn_targets(spark):
    got = spark.range(1).select(ck.target_turns(F.lit(4), F.lit("dialogue")).alias("a"), ck.target_turns(F.lit(1), F.lit("dialogue")).alias("b")).collect()[0]
    assert (got["a"], got["b"]) == (14, 6)


def test_numbers_allow_rounding(spark):
    turns = spark.createDataFrame([("e", 0, "host", "about 5.4 ms, 1,200 users, 77 zebras, 2 things and 6 ms")], "episode_id string, turn_idx long, speaker string, text string")
    eps = spark.createDataFrame([("e", 1, 1)], "episode_id string, paper_id long, minutes int")
    papers = spark.createDataFrame([(1, "5.38 milliseconds for 1200 users, 5.5x")], "paper_id long, text string")
    assert [r["raw"] for r in ck.unknown_numbers(turns, eps, papers).collect()] == ["77"]


def test_append_matches_one_by_one(spark):
    rng = random.Random(1)
    extra = [(e, i, rng.choice(["host", "guest", "narrator"]), rng.choice(["x", " "])) for e in range(8) for i in range(10, 20)]
    base = [(e, 0, "host", "a") for e in range(8)]
    want = []
    for e in range(8):
        expected, n = "guest", 1
        for _, i, s, t in [x for x in extra if x[0] == e]:
            if t.strip() and s == expected:
                want.append((e, n, s))
                n, expected = n + 1, "guest" if s == "host" else "host"
    schema = "episode_id long, turn_idx long, speaker string, text string"
    got = ck.append_turns(spark.createDataFrame(base, schema), spark.createDataFrame(extra, schema)).filter("turn_idx > 0").collect()
    assert sorted((r["episode_id"], r["turn_idx"], r["speaker"]) for r in got) == sorted(want)


def test_recall_counts_repeats(spark):
    df = spark.createDataFrame([(1, "the the cat", "the cat"), (2, "", "x")], "k int, expected string, actual string")
    got = {r["k"]: r["recall"] for r in tl.word_recall(df, "k").collect()}
    assert abs(got[1] - 2 / 3) < 1e-9 and got[2] == 1.0


def test_truncation_detector(spark):
    df = spark.createDataFrame([(1, 4000, 400), (2, 4000, 900), (3, 4000, None)], "k int, chars int, processed int")
    assert {r["k"]: r["truncated"] for r in sc.truncated_calls(df).collect()} == {1: True, 2: False, 3: False}


def test_error_rules(spark):
    msgs = ["402 payment required", "Error 401", "quota", "HTTP 503", "ECONNREFUSED", "Piper synthesis failed: ENOENT", "piper synthesis failed", "not a wave", "bad PDF", "boom"]
    df = spark.createDataFrame([(i, m, None) for i, m in enumerate(msgs)] + [(99, "x", "OutputTruncationError")], "i int, message string, name string")
    got = [r["code"] for r in sc.classify_errors(df, "message", "name").orderBy("i").collect()]
    assert got == ["no_credit", "auth_failed", "rate_limited", "provider_unavailable", "provider_unreachable", "voice_missing", "synthesis_failed",
                   "audio_join_failed", "unreadable_input", "internal", "output_truncated"]


def recording(spark):
    timings = [("e", i, "host" if i % 2 == 0 else "guest", i * 10_000.0, i * 10_000.0 + 9_000, 1) for i in range(6)]
    turns = [("e", i, "host" if i % 2 == 0 else "guest", "word " * 20) for i in range(6)]
    frames = [("e", f, 500) for f in range(590)]
    pitch = [("e", "host" if i % 2 == 0 else "guest", i, f, 120.0 + f % 3) for i in range(6) for f in range(25)]
    return (spark.createDataFrame(turns, "episode_id string, turn_idx long, speaker string, text string"),
            spark.createDataFrame(timings, "episode_id string, turn_idx long, speaker string, start_ms double, end_ms double, chunks long"),
            spark.createDataFrame([("e", 59_000.0, 59_000.0)], "episode_id string, file_ms double, total_ms double"),
            spark.createDataFrame(frames, "episode_id string, frame long, sample int"),
            spark.createDataFrame(pitch, "episode_id string, speaker string, turn_idx long, frame long, hz double"),
            10.0, spark.createDataFrame([("e", 1, 1)], "episode_id string, paper_id long, minutes int"))


def test_audio_faults_are_caught(spark):
    args = recording(spark)
    assert tl.run_audio_checks(*args).filter("not passed").count() == 0
    rows = tl.detection(*args).collect()
    assert len(rows) == 6 and all(r["clean"] and r["detected"] for r in rows)


def test_progress_weights(spark):
    t = F.lit(True)
    got = spark.range(1).select(jb.overall_percent(F.lit("scripting"), F.lit(1.0), t, t, t).alias("p"), jb.overall_percent(F.lit("error"), F.lit(0.0), t, t, t).alias("e")).collect()[0]
    assert (got["p"], got["e"]) == (37, 100)


def test_gate_daily_limit(spark):
    rows, seq = [], 0
    for i in range(26):
        for release in (False, True):
            rows.append((1, seq, float(seq), release))
            seq += 1
    rows.append((1, seq, 86_400.0, False))
    df = spark.createDataFrame(rows, "key long, seq long, at double, release boolean")
    got = [r["outcome"] for r in jb.admit(df).orderBy("seq").collect() if r["outcome"] != "released"]
    assert got[:25] == ["admitted"] * 25 and got[25] == "daily" and got[26] == "admitted"


@pytest.mark.parametrize("batch,stream", [("r1_job_state", "r1_job_state_stream"), ("r5_admit", "r5_admit_stream"),
                                          ("r3_progress_feed", "r3_progress_feed_stream"), ("r6_event_windows", "r6_event_windows_stream")])
def test_stream_equals_batch(spark, sf, batch, stream):
    q = registry.queries()
    a, b = q[batch](spark, sf), q[stream](spark, sf)
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


def test_visible_field(spark):
    from plumbline.streaming.jobs import visible_text

    parts = ['{"kind":"x","answer":"He said \\"', '{"answer":"a\\', '{"answer":"caf\\u00', '{"answer":"caf\\u00e9\\n"}', '{"other":1']
    want = ['He said "', "a", "caf", "café\n", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, p string")
    assert [r["o"] for r in df.orderBy("i").select(jb.visible_field(F.col("p"), "answer").alias("o")).collect()] == want
    assert [visible_text(p, "answer") for p in parts] == want


def test_subtree_totals_and_preorder(spark):
    rows = [(1, None, 10, 1), (2, 1, 5, 3), (3, 1, 7, 2), (4, 2, 1, 4), (9, 77, 8, 0)]
    spans = spark.createDataFrame(rows, "span_id long, parent_id long, tokens int, s int").withColumn("start", F.timestamp_seconds("s"))
    assert {r["span_id"]: r["tokens"] for r in tr.subtree_totals(spans, ["tokens"]).collect()} == {1: 23, 2: 6, 3: 7, 4: 1, 9: 8}
    got = tr.preorder(spans).orderBy("position").collect()
    assert [(r["span_id"], r["depth"]) for r in got] == [(9, 0), (1, 0), (3, 1), (2, 1), (4, 2)]


def test_deep_chain(spark):
    n = 70
    spans = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(n)], "span_id long, parent_id long, v int")
    assert {r["span_id"]: r["v"] for r in tr.subtree_totals(spans, ["v"]).collect()} == {i: n - i for i in range(n)}


def test_title_matches(spark):
    df = spark.createDataFrame([("alpha bravo charlie delta eagle",), ("alpha bravo charlie xxxx yyyy",), ("alpha bravo qqqq rrrr ssss",), ("one two",)], "title string")
    got = {(r["a"][:22], r["b"][:22]) for r in le.matching_titles(df, df).filter("a <> b").collect()}
    assert got == {("alpha bravo charlie de", "alpha bravo charlie xx"), ("alpha bravo charlie xx", "alpha bravo charlie de")}


def test_suggestions_follow_first_match(spark):
    rng = random.Random(7)
    words = ["alpha", "bravo", "charlie", "delta", "eagle", "foxtrot"]
    refs = [(p, i, " ".join(rng.sample(words, 3)), 1990 + rng.randint(0, 20)) for p in range(12) for i in range(4)]
    wordset = lambda t: set(t.split())
    match = lambda a, b: len(wordset(a) & wordset(b)) / 3 >= 0.6
    by = {}
    for p in range(12):
        here = set()
        for _, _, t, y in [r for r in refs if r[0] == p]:
            key = next((k for k in by if match(k, t)), t)
            if key in here:
                continue
            here.add(key)
            by.setdefault(key, [y, 0])[1] += 1
    want = sorted(((k, y, n) for k, (y, n) in by.items()), key=lambda x: (-x[2], -x[1]))
    lib = spark.createDataFrame([("unrelated thing",)], "title string")
    got = [(r["title"], r["year"], r["citations"]) for r in le.suggest(spark.createDataFrame(refs, "paper_id long, ref_idx long, title string, year int"), lib, 100).collect()]
    assert sorted(got) == sorted(want) and [g[2] for g in got] == [w[2] for w in want]


def test_learned_keeps_first_date(spark):
    schema = "paper_id string, text string, provenance string, first_seen string, item_no long"
    old = spark.createDataFrame([("p", "The log is the database.", "stated", "day1", 0)], schema)
    new = spark.createDataFrame([("p", "the log is  the database", "verified", "day2", 0)], schema)
    got = le.merge_learned(old, new).collect()
    assert [(r["provenance"], r["first_seen"]) for r in got] == [("verified", "day1")]
    assert le.merge_learned(new, old).collect()[0]["provenance"] == "verified"


def test_components_of_a_long_path(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")]
    got = {r["node"]: r["component"] for r in gp.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert set(got.values()) == {"n000", "x"} and got["n060"] == "n000"


def test_families_merge_through_a_bridge(spark):
    rows = [(1, "crash", 4.0, 0), (1, "recovery", 3.0, 1), (1, "crash recovery", 2.0, 2), (1, "storage node", 5.0, 3)]
    got = gp.concept_families(spark.createDataFrame(rows, "paper_id long, term string, raw double, pos int")).orderBy("rank").collect()
    assert [(r["term"], round(r["weight"], 3)) for r in got] == [("storage node", 1.0), ("crash recovery", 0.8)]


def test_acronyms(spark):
    text = "We study Retrieval-Augmented Generation (RAG) with small language models (SLMs) and BLEU Training Cost (FLOPs)."
    got = {r["acronym"]: r["expansion"] for r in gp.acronyms(spark.createDataFrame([(1, text)], "paper_id long, text string")).collect()}
    assert got == {"rag": "retrieval-augmented generation", "rags": "retrieval-augmented generation", "slm": "small language models", "slms": "small language models"}


def test_canonical_names(spark):
    rows = [("LLM", ["large language model"]), ("Large Language Models", []), ("large language model", []), ("graphs", [])]
    got = {r["key"]: r["name"] for r in gp.canonical_names(spark.createDataFrame(rows, "term string, aliases array<string>")).collect()}
    assert got == {"llm": "large language model", "large language model": "large language model", "graph": "graph"}


def test_ego(spark):
    edges = spark.createDataFrame([("a", "c"), ("b", "d"), ("c", "e")], "a string, b string")
    rel = spark.createDataFrame([("b", "a")], "source string, target string")
    got = gp.ego(lambda terms: edges, rel, spark.createDataFrame([("a",)], "term string")).orderBy(F.desc("ring"), "place").collect()
    assert [(r["term"], r["ring"]) for r in got] == [("b", "near"), ("c", "near"), ("d", "far"), ("e", "far")]


def test_library_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a1", "createdAt": 5, "episode": {"summary": "told", "keyPoints": ["k"], "turns": []}}')
    (tmp_path / "b.json").write_text('{"id": "b2", "createdAt": 9, "summary": "own"}')
    (tmp_path / "c.json").write_text("{not json")
    (tmp_path / "d.json").write_text('{"createdAt": 1}')
    rows = lb.list_library(lb.read_library(spark, str(tmp_path))).collect()
    assert [(r["id"], r["summary"], r["keyPoints"]) for r in rows] == [("b2", "own", []), ("a1", "told", ["k"])]
    with pytest.raises(ValueError):
        lb.check_id("../x")


def test_save_table_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        lb.load_table(spark, path)
    lb.save_table(spark.range(5), path)
    lb.save_table(lb.load_table(spark, path).filter("id > 2"), path)
    assert sorted(r["id"] for r in lb.load_table(spark, path).collect()) == [3, 4]
    for n in range(1, 4):
        lb.save_table(spark.range(n), path, grace=0)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2 and lb.load_table(spark, path).count() == 3


def test_a_reader_always_meets_a_whole_table(spark, tmp_path):
    from threading import Thread

    path, seen = str(tmp_path / "t"), []
    lb.save_table(spark.range(0, 100, 1, 2), path)
    writer = Thread(target=lambda: [lb.save_table(spark.range(0, 100 * (k + 2), 1, 2), path) for k in range(6)])
    writer.start()
    while writer.is_alive() or not seen:
        seen.append(lb.load_table(spark, path).count())
    writer.join()
    assert all(n % 100 == 0 and n > 0 for n in seen) and seen == sorted(seen)


def test_embed_cache(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "i int, text string")
    key = texts.filter("i = 1").select(lb.cache_key(F.col("text"), "m").alias("key"), F.array(F.lit(9.0)).cast("array<float>").alias("vector"))
    found, fresh = lb.embed_with_cache(texts, key, lambda t: [[1.0]] * len(t), "m")
    assert {r["i"]: r["vector"] for r in found.collect()} == {1: [9.0], 2: [1.0], 3: [1.0]} and fresh.count() == 1
    assert lb.embed_with_cache(texts, key, lambda t: [], "m") is None


def test_schema_wants_a_summary_and_key_points(spark):
    from plumbline.operators import checks as ck

    turns = spark.createDataFrame([(k, 0, "host", "Hello.") for k in range(4)] + [(1, 1, "robot", "Beep.")], "episode_id long, turn_idx int, speaker string, text string")
    episodes = spark.createDataFrame([(0, "All good.", ["One."]), (1, None, ["One."]), (2, "Fine.", ["One.", None]), (3, None, None)], "episode_id long, summary string, key_points array<string>")
    got = {r.episode_id: (r.passed, r.offences, r.first_offence) for r in ck.check_schema(turns, episodes, None).collect()}
    assert got == {0: (True, 0, None), 1: (False, 2, "summary"), 2: (False, 1, "keyPoints"), 3: (False, 2, "summary")}
    assert {r.episode_id: r.offences for r in ck.check_schema(turns, episodes.select("episode_id"), None).collect()} == {0: 0, 1: 1, 2: 0, 3: 0}


def test_a_text_that_wraps_no_word_is_read_once(spark):
    texts = {1: "Well-known state-of-the-art, a--b", 2: "a re-\nread wrap- \r\n ped co-op", 3: "", 4: "plain words only"}
    found = ck.lexicon(spark.createDataFrame(list(texts.items()), "paper_id long, text string"))

    def words(text):
        out = set()
        for t in (text.lower(), re.sub(r"-[ \t]*\r?\n[ \t]*", "", text.lower()), re.sub(r"-[ \t]*\r?\n[ \t]*", "-", text.lower())):
            for w in re.findall(r"[a-z0-9'’-]+", t):
                out |= {w} | {p for p in w.split("-") if p}
        return out

    assert sorted(map(tuple, found.collect())) == sorted((p, w) for p, t in texts.items() for w in words(t))
    assert "CASE WHEN RLIKE" in found._jdf.queryExecution().executedPlan().toString()
