"""Hand tables for parsing."""

import random

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import parsing as pa


def col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.orderBy("i").select(expr(F.col("v")).alias("o")).collect()]


def test_concept_keys(spark):
    got = col(spark, ["The Self-Attention Mechanisms", "Batches", "analysis", "Ontologies"], tx.concept_key)
    assert got == ["self attention mechanism", "batche", "analysis", "ontology"]


def test_spoken_sentences_keep_decimals(spark):
    got = col(spark, ['It took 5.38 ms. "Really?" Yes! See a.b.c now'], tx.spoken_sentences)
    assert got[0] == ["It took 5.38 ms.", '"Really?"', "Yes!", "See a.b.c now"]


def test_heading_shapes(spark):
    lines = ["1 Introduction", "3.2. Model Architecture", "2025. Accessed May", "10 GB 107,000 2,400", "Introduction", "model",
             "PEER GOSSIP", "ASYNC", "2 Exercise: Produces customized teaching", "4 Sketch: Asynchronous Processing", "a plain line"]
    got = col(spark, lines, pa.heading_shape)
    assert got == ["numbered", "numbered", None, None, "known", None, "caps", None, None, "numbered", None]


PAPER = """Google grants permission to reproduce
the tables in this paper.
Attention for
Everyone
Ada Lovelace, Somewhere
1 Introduction
This is a paragraph about attention that has many words in it.
3. On this list item
continues in lower case here
2 Method
Another paragraph about the method with enough words here.
Figure 1: a caption
12


After the gap there is more text in this section.
9 Nowhere Near
A leap too far for a section number in this paper.
References
[1] A. Author. A long title about things. 2017.
[2] B. Author. Another title about other things. 2018.
[3] C. Author. Third title with several words. Venue, 1999.
"""


def parsed(spark):
    papers = spark.createDataFrame([(1, PAPER)], "paper_id long, text string")
    lines = pa.lines(papers)
    titles = pa.titles(lines)
    starts = pa.section_starts(lines, titles.select("paper_id", "from_line"))
    body = lines.join(titles.select("paper_id", "from_line"), "paper_id").filter("line_no >= from_line").drop("from_line")
    return papers, lines, titles, starts, body


def test_title_skips_notice_and_stops_at_byline(spark):
    _, _, titles, _, _ = parsed(spark)
    row = titles.collect()[0]
    assert row["title"] == "Attention for Everyone" and row["from_line"] == 4


def test_sections(spark):
    _, lines, _, starts, body = parsed(spark)
    heads = {r["text"] for r in lines.join(starts, ["paper_id", "line_no"]).collect()}
    assert heads == {"1 Introduction", "2 Method", "References"}
    got = pa.body_sections(pa.sections(body, starts), body).orderBy("section_idx").collect()
    assert [r["heading"] for r in got] == ["1 Introduction", "2 Method"]
    assert "caption" not in got[1]["content"] and "\n\n\n" not in got[1]["content"]


def test_body_fallback(spark):
    papers = spark.createDataFrame([(1, "just one\nplain text\nReferences\nx")], "paper_id long, text string")
    lines = pa.lines(papers)
    none = lines.filter("false").select("paper_id", "line_no")
    sections = pa.sections(lines, none).filter("false")
    got = pa.body_sections(sections, lines).collect()
    assert got[0]["heading"] == "Body" and got[0]["content"] == "just one\nplain text"


def test_references(spark):
    papers = parsed(spark)[0]
    got = pa.references(papers).orderBy("ref_idx").collect()
    assert [r["year"] for r in got] == [2017, 2018, 1999]
    assert got[0]["title"] == "A long title about things" and got[2]["index"] == 3


def test_page_spans(spark):
    pages = spark.createDataFrame([("p", 0, "x" * 10), ("p", 1, "y" * 20)], "paper_id string, page_key long, text string")
    got = [(r["start"], r["end"]) for r in pa.page_spans(pages).orderBy("page").collect()]
    assert got == [(0, 10), (10, 32)]


def test_stitch(spark):
    rows = [("p", 0, "by more than", 10.0, 0.0, 0.0, 100.0, 50.0), ("p", 1, "2.0 BLEU", 10.0, 0.0, 51.5, 100.0, 30.0),
            ("p", 2, "s", 10.0, 0.0, 81.6, 100.0, 5.0), ("p", 3, "Name", 10.0, 0.0, 100.0, 100.0, 5.0), ("p", 4, "next", 10.0, 0.0, 0.0, 90.0, 5.0)]
    df = spark.createDataFrame(rows, "page string, item_idx int, str string, a double, b double, x double, y double, width double")
    assert pa.stitch(df, ["page"]).collect()[0]["text"] == "by more than 2.0 BLEUs  Name\nnext"


def test_chunks():
    assert pa.pack_sentences(["aa.", "bb.", "cc."], "aa. bb. cc.", 7) == ["aa. bb.", "cc."]
    assert pa.pack_sentences(["a", "x" * 12], "a " + "x" * 12, 5) == ["a", "xxxxx", "xxxxx", "xx"]
    assert pa.pack_sentences([], "  ", 5) == []


def test_figures_and_captions(spark):
    pages = spark.createDataFrame([(1, 1, "see Figure 2: x and Table 3. y and figure 2: z"), (1, 2, "notable 4: no")], "paper_id long, page long, text string")
    got = pa.caption_pages(pages).collect()
    assert len(got) == 1 and got[0]["captions"] == ["Figure 2:", "Table 3.", "figure 2:"]
    figs = spark.createDataFrame([("NONE.",), (" ",), ("Nonetheless a chart",)], "description string")
    assert pa.described(figs).count() == 1


def test_digest_stops_at_first_overflow(spark):
    s = spark.createDataFrame([(1, i, f"H{i}", "w" * n) for i, n in enumerate([50, 400, 10])], "paper_id long, section_idx int, heading string, content string")
    t = spark.createDataFrame([(1, "T")], "paper_id long, title string")
    assert pa.digest(s, t, 700, 200).collect()[0]["openings"] == 1


ODD = ["", "", " ", "\t", "Figure 1: a caption", "figure 3a", "12", "12 \u0085", "\u0085", "abc \u0085", "  abc  ", "1 Introduction", "2 Method", "References",
       "Abstract", "RELATED WORK", "Ada Lovelace, Somewhere", "goes on in lower case with more than six words", "A paragraph of text with more than six words in it."]


def odd_papers(spark):
    rng = random.Random(11)
    texts = [None, "", "\n \n", PAPER] + ["\n".join(rng.choices(ODD, k=rng.randint(1, 25))) for _ in range(60)]
    return spark.createDataFrame(list(enumerate(texts)), "paper_id long, text string").coalesce(1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def no_shuffle(df):
    return "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_sections_are_cut_beside_their_text(spark):
    papers = odd_papers(spark)
    lines = pa.lines(papers)
    titles = pa.titles(lines)
    starts = pa.section_starts(lines, titles.select("paper_id", "from_line"))
    body = lines.join(titles.select("paper_id", "from_line"), "paper_id").filter("line_no >= from_line").drop("from_line")
    for whole, by_line in ((pa.paper_titles(papers), titles), (pa.paper_starts(papers), starts), (pa.paper_sections(papers), pa.sections(body, starts))):
        assert no_shuffle(whole) and rows(whole) == rows(by_line) and whole.count()


def test_clean_text_is_what_clean_block_leaves(spark):
    papers = odd_papers(spark)
    block = pa.clean_block(pa.lines(papers), ["paper_id"]).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    want = block.select("paper_id", F.array_join(F.transform("l", lambda e: e["text"]), "\n").alias("text")).filter("text <> ''")
    got = papers.select("paper_id", pa.clean_text(tx.lines_of(F.col("text"))).alias("text")).filter("text <> ''")
    assert rows(got) == rows(want)


def test_bodies_are_cut_beside_their_text(spark):
    papers = odd_papers(spark).union(spark.createDataFrame([
        (90, "A title\n\nAbstract\nwhat it says\n1 Introduction\nWords of this paper in some number here\nReferences\n[1] x"),
        (91, "A title\n\nREFERENCES\nonly a list"), (92, "A title\n\njust one\nplain text\nReferences \nx")], "paper_id long, text string"))
    lines = pa.lines(papers)
    titles = pa.titles(lines).select("paper_id", "from_line")
    body = lines.join(titles, "paper_id").filter("line_no >= from_line").drop("from_line")
    got = pa.paper_body(papers)
    assert no_shuffle(got) and rows(got) == rows(pa.body_sections(pa.sections(body, pa.section_starts(lines, titles)), body))
    kinds = {(r["paper_id"], r["kind"], r["heading"], r["content"]) for r in got.filter("paper_id >= 90").collect()}
    assert kinds == {(90, "abstract", "Abstract", "what it says"), (90, "section", "1 Introduction", "Words of this paper in some number here"),
                     (92, "section", "Body", "just one\nplain text")}
