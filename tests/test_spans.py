"""Quotes located in source characters, against a plain locator."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import lexicons as lx
from plumbline.operators import grounding as gr


def normal(text):
    """The normalised text and, for each of its characters, the place in the text."""
    kept = []
    drop = {i for m in re.finditer(r"-[\r\n]+", text) for i in range(*m.span())}
    for i, c in enumerate(text):
        if i in drop:
            continue
        if c in " \t\n\r\f\v":
            if kept and kept[-1][0] != " ":
                kept.append((" ", i))
        else:
            kept.append((c.lower(), i))
    while kept and kept[-1][0] == " ":
        kept.pop()
    return "".join(c for c, _ in kept), [i for _, i in kept]


def locate(quote, text, least):
    """(match, score, start, end) or None."""
    words = re.findall("[a-z0-9]+", quote.lower())
    if len(words) < gr.MIN_WORDS:
        return None
    norm, back = normal(text)
    needle, _ = normal(quote)
    at = norm.find(needle)
    if at >= 0:
        return "exact", 1.0, back[at], back[at + len(needle) - 1] + 1
    tight = [(c, i) for c, i in zip(norm, back) if c != " "]
    bare = needle.replace(" ", "")
    at = "".join(c for c, _ in tight).find(bare)
    if at >= 0 and len(bare) >= gr.SQUEEZED_MIN:
        return "exact", 1.0, tight[at][1], tight[at + len(bare) - 1][1] + 1
    want = {w for w in words if len(w) > 2 and w not in lx.QUOTE_STOP}
    if len(want) < gr.MIN_CONTENT_WORDS:
        return None
    tokens = [(m.group(), m.start(), m.end()) for m in re.finditer("[a-z0-9]+", norm)]
    size = min(len(tokens), int(len(words) * 1.6 + 0.5))
    spans = []
    for i in range(len(tokens)):
        seen = set()
        for j in range(i, min(i + size, len(tokens))):
            if tokens[j][0] in want:
                seen.add(tokens[j][0])
                spans.append((-len(seen), j - i, i, j))
    if not spans:
        return None
    n, _, i, j = min(spans)
    if -n / len(want) < least - 1e-9:
        return None
    return "approximate", -n / len(want), back[tokens[i][1]], back[tokens[j][2] - 1] + 1


WORDS = "quorum write copies zone four six segment volume repair window latency replica commit ledger page storage".split()


def paper(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "  ", "\n", ".\n\n", ", ", "-\n", "\t", "-", "; "]) for _ in range(n))


def quoted(r, text):
    at = r.randrange(len(text) - 90)
    part = text[at:at + r.randrange(30, 90)]
    kind = r.randrange(4)
    if kind == 1:
        part = re.sub(r"\s+", " ", part).replace(" ", "", 1)
    if kind == 2:
        words = part.split()
        r.shuffle(words)
        part = " ".join(words)
    if kind == 3:
        part = part.upper()
    return part


def test_spans_of_three_kinds_are_those_of_a_plain_locator(spark):
    r = random.Random(4)
    texts = {k: ("\n " if k % 2 else "") + paper(r, 160) for k in range(8)} | {8: "", 9: "İstanbul quorum writes four copies in every zone of the ﬁrst volume "}
    quotes = [(f"q{i}", k, quoted(r, texts[k])) for i in range(40) for k in [i % 8]]
    quotes += [("long", 2, texts[2]), ("none", 3, "nothing of this kind stands anywhere at all"), ("short", 1, "two words"), ("ls", 9, "copies in every zone of the")]
    q = spark.createDataFrame(quotes, "quote_id string, paper_id long, text string")
    p = spark.createDataFrame(list(texts.items()), "paper_id long, text string")
    got = {x.quote_id: (x.match, round(x.score, 6), x.start, x.end) for x in gr.in_source(gr.find(q, p), p).collect()}
    want = {i: locate(t, texts[k], gr.MIN_SCORE) for i, k, t in quotes if i != "ls"}
    want = {i: (w[0], round(w[1], 6), w[2], w[3]) for i, w in want.items() if w}
    # A letter whose lower case is longer moves what follows in its run by what it grew.
    last = got.pop("ls")
    assert got == want
    assert last[0] == "exact"
    assert {w[0] for w in want.values()} == {"exact", "approximate"}


def test_one_paper_with_many_quotes(spark, monkeypatch):
    monkeypatch.setattr(gr, "QUOTES_HELD", 3)
    r = random.Random(9)
    text = paper(r, 200)
    quotes = [(k, 1, text[5 * k:5 * k + 60]) for k in range(100)]
    q = spark.createDataFrame(quotes, "quote_id long, paper_id long, text string")
    p = spark.createDataFrame([(1, text)], "paper_id long, text string")
    got = {x.quote_id: (x.start, x.end) for x in gr.raw_offsets(gr.locate_exact(q, p), p).collect()}
    want = {k: locate(t, text, 1) for k, _, t in quotes}
    assert got == {k: w[2:] for k, w in want.items() if w and w[0] == "exact" and normal(quotes[k][2])[0] in normal(text)[0]}


@pytest.mark.parametrize("text", ["", "   ", "-\n", "one"])
def test_papers_without_words(spark, text):
    p = spark.createDataFrame([(1, text)], "paper_id long, text string")
    q = spark.createDataFrame([("a", 1, "four words are enough here")], "quote_id string, paper_id long, text string")
    assert gr.in_source(gr.find(q, p), p).count() == 0


def test_turns_get_heading_and_page(spark):
    rendered = "## Log\nEvery write goes to four of six copies before it is acknowledged.\n\n## Repair\nA lost segment is rebuilt from its replicas within a short window."
    segs, at = [], 0
    for heading in ("Log", "Repair"):
        start = rendered.index(f"## {heading}\n") + len(heading) + 4
        stop = rendered.find("\n\n", start) if heading == "Log" else len(rendered)
        segs.append((1, start, stop, 100 * (len(segs) + 1), heading))
    s = spark.createDataFrame(segs, "paper_id long, from long, to long, at long, heading string")
    pages = spark.createDataFrame([(1, 3, 0, 200), (1, 4, 200, 900)], "paper_id long, page long, start long, end long")
    p = spark.createDataFrame([(1, rendered)], "paper_id long, text string")
    turns = spark.createDataFrame([(7, 0, "host", "Picture some penguins. A lost segment is rebuilt from its replicas within a short window."), (7, 1, "guest", "So four of six copies hold every write before anyone is acknowledged, right?"),
                                   (7, 2, "host", "Nothing to do with it whatsoever, my friend.")], "episode_id long, turn_idx int, speaker string, text string")
    episodes = spark.createDataFrame([(7, 1)], "episode_id long, paper_id long")
    got = {r.turn_idx: r for r in gr.resolve(gr.ground_turns(turns, episodes, p), s, pages).collect()}
    assert set(got) == {0, 1}
    assert (got[0].match, got[0].heading, got[0].page, got[0].start) == ("exact", "Repair", 4, 200)
    assert (got[1].match, got[1].heading, got[1].page) == ("approximate", "Log", 3)
    assert rendered[segs[0][1] + got[1].start - 100:segs[0][1] + got[1].end - 100] == "write goes to four of six copies before it is acknowledged"


def test_words_of_a_paper_are_not_shuffled(spark):
    """Quotes travel to their paper; its words, many times its size as rows, stay there."""
    text, quote = "Every write goes to four of six copies before it is acknowledged.", "every write goes then to four of six copies"
    p = spark.createDataFrame([(1, text)], "paper_id long, text string")
    q = spark.createDataFrame([("a", 1, quote)], "quote_id string, paper_id long, text string")
    hits = gr.locate_approx(q, p).select("quote_id", "paper_id", F.lit("word").alias("unit"), F.col("start_tok").alias("start"), (F.col("end_tok") + 1).alias("end"))
    placed = gr.in_source(hits, p)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    assert [(r.start, r.end) for r in placed.collect()] == [locate(quote, text, gr.MIN_SCORE)[2:]]
