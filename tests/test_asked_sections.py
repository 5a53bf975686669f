"""Papers that nobody asks about are let go where their texts are read."""

from pyspark.sql import functions as F

from plumbline.plans import retrieval as rq
from plumbline.sources import tables as tb


def test_only_asked_papers_are_cut(spark, sf):
    key = lambda df: sorted((r["paper_id"], r["section_idx"], r["heading"], r["content"]) for r in df.collect())
    asked = tb.questions(spark, sf).select("paper_id").distinct()
    want = tb.sections(spark, sf).join(asked, "paper_id", "left_semi")
    assert key(tb.asked_sections(spark, sf)) == key(want)
    assert 0 < want.select("paper_id").distinct().count() < tb.papers(spark, sf).count()


def test_ranking_reads_documents_no_more(spark, sf):
    """Texts are read and cut once; what ranks reads the sections kept, and no file of documents."""
    for query in (rq.veto, rq.rrf, rq.lexical, rq.snippet):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "doc_id" not in plan and "regexp_replace(text" not in plan


def test_unasked_papers_change_no_rank(spark, sf):
    got = rq.rrf(spark, sf)
    assert got.count() and got.select("question_id").distinct().count() == tb.questions(spark, sf).join(
        tb.papers(spark, sf).filter(F.col("text").rlike(r"\S")), "paper_id", "left_semi").count()
