"""Work done beside a paper's text: what is not shuffled, and the same rows as by joins."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators import grounding as gr
from plumbline.operators import parsing as pa
from plumbline.plans import registry
from plumbline.sources import tables as tb
from tests.test_spans import locate, paper, quoted


def exchanges(df):
    """Shuffles of a plan by key; a small scan may still be dealt out to all cores."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange" in x and "REPARTITION" not in x]


def test_quotes_beside_lines_are_resolved_as_by_joins(spark):
    r = random.Random(11)
    texts = [(k, ("\n" if k % 2 else "") + paper(r, 150)) for k in range(6)] + [(6, " \n\r\n"), (7, "İstanbul quorum writes four copies.\fin every zone of the ﬁrst volume")]
    quotes = [(f"{k}:{i}", k, quoted(r, t)) for k, t in texts if len(t) > 100 for i in range(12)]
    quotes += [(f"{k}:line{i}", k, line) for k, t in texts for i, line in enumerate(t.splitlines())] + [("7:0", 7, "copies. in every zone of the"), ("6:0", 6, "four words are enough")]
    p = spark.createDataFrame(texts, "paper_id long, text string")
    q = spark.createDataFrame(quotes, "quote_id string, paper_id long, text string")
    lines = pa.lines(p)
    sections = tb.sections_of(p).join(lines.select("paper_id", F.col("line_no").alias("section_idx"), "at"), ["paper_id", "section_idx"])
    pages = lines.select("paper_id", (F.col("line_no") + 1).alias("page"), F.col("at").alias("start"), (F.col("at") + F.length("text") + 1).alias("end"))
    rendered = pa.render(sections)
    row = lambda x: (x.quote_id, x.match, round(x.score, 6), x.heading, x.page, x.page_end, x.start, x.end)
    want = {row(x) for x in gr.resolve(gr.in_source(gr.find(q, rendered), rendered), pa.segments(sections), pages).collect()}
    held = q.groupBy("paper_id").agg(F.collect_list(F.struct("quote_id", "text")).alias("quotes")).join(p, "paper_id")
    assert {row(x) for x in gr.resolve_lines(held).collect()} == want
    assert {w[1] for w in want} == {"exact", "approximate"} and any(w[5] for w in want)


def test_no_line_is_shuffled_to_be_resolved(spark, sf):
    assert exchanges(registry.queries()["g5_resolve"](spark, sf)) == []


def test_a_long_quote_is_found_in_time_that_grows_with_it():
    r = random.Random(3)
    words = [f"w{r.randrange(900)}" for _ in range(12_000)]
    find, place = gr._finder(" ".join(words))
    began = time.process_time()
    got = find(" ".join([*words[:2], *words[3:6_000]]), gr.MIN_SCORE)
    assert got[:1] == ("approximate",) and place(*got[2:]) is not None
    assert time.process_time() - began < 5


@pytest.mark.parametrize("seed", range(3))
def test_windows_are_those_of_a_plain_search(seed):
    r = random.Random(seed)
    for _ in range(60):
        text = " ".join(f"word{r.randrange(r.choice([5, 40]))}" for _ in range(80))
        quote = " ".join(f"word{r.randrange(12)}" for _ in range(r.randrange(4, 12)))
        find, place = gr._finder(text)
        hit = find(quote, gr.MIN_SCORE)
        want = locate(quote, text, gr.MIN_SCORE)
        assert (hit and (hit[0], hit[1], *place(*hit[2:]))) == want


def test_turns_beside_lines_are_grounded_as_by_joins(spark):
    r = random.Random(5)
    texts = [(k, paper(r, 150)) for k in range(5)]
    turns = [(k, i, "host", r.choice(["Yes.", "So. Well then", quoted(r, t)])) for k, t in texts for i in range(-1, 12)] + [(77, 0, "host", "of a paper that is not there")]
    p = spark.createDataFrame(texts, "paper_id long, text string")
    t = spark.createDataFrame(turns, "episode_id long, turn_idx int, speaker string, text string")
    lines = pa.lines(p)
    sections = tb.sections_of(p).join(lines.select("paper_id", F.col("line_no").alias("section_idx"), "at"), ["paper_id", "section_idx"])
    pages = lines.select("paper_id", (F.col("line_no") + 1).alias("page"), F.col("at").alias("start"), (F.col("at") + F.length("text") + 1).alias("end"))
    line = sections.select(F.col("paper_id").alias("episode_id"), F.col("section_idx").alias("turn_idx"), "content")
    said = t.join(line, ["episode_id", "turn_idx"], "left").withColumn("text", F.concat_ws(" ", "text", "content"))
    episodes = t.select("episode_id", F.col("episode_id").alias("paper_id")).distinct()
    want = gr.resolve(gr.ground_turns(said, episodes, pa.render(sections)), pa.segments(sections), pages)
    got = gr.ground_lines(t, p)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(*got.columns).collect()), key=repr)
    assert got.count() > 10


def test_no_line_of_any_document_is_kept_to_ground_turns(spark, sf):
    plan = registry.queries()["g6_ground_turns"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan and "Window" not in plan and "LeftSemi" in plan
