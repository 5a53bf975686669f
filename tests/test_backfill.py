"""Re-parsed structures: sections and anchors before and after, evidence that moves with them."""

from pyspark.sql import functions as F

from plumbline.operators import parsing as pa
from plumbline.plans import registry
from plumbline.sources import library as lb
from plumbline.sources import tables as tb
from tests.test_beside_texts import exchanges

SECTIONS = "paper_id long, section_idx int, heading string, content string"


def test_backfill_moves_what_is_found_and_keeps_the_rest(spark):
    first, second = "Every write goes to four of six copies before it is acknowledged.", "A lost segment is rebuilt from its replicas within a short window."
    before = spark.createDataFrame([(1, 0, "All", f"{first}\n{second}\nThis line is dropped by the newer parse of the paper."), (2, 0, "Only", "Nothing is quoted from here at all.")], SECTIONS)
    after = spark.createDataFrame([(1, 0, "Log", first), (1, 1, "Repair", second), (3, 0, "New", "A paper that was not there before.")], SECTIONS)
    evidence = spark.createDataFrame(
        [("a", 1, first), ("b", 1, "lost segment is rebuilt fromits replicas"), ("c", 1, "This line is dropped by the newer parse of the paper."), ("d", 1, "nothing of this kind stands anywhere in it"), ("e", 2, "two words")],
        "evidence_id string, paper_id long, text string")
    moved, report = lb.backfill(evidence, before, after)
    assert {r.evidence_id: (r.heading, r.moved) for r in moved.collect()} == {"a": ("Log", True), "b": ("Repair", True), "c": ("All", False), "d": (None, False), "e": (None, False)}
    assert {r.paper_id: (r.sections_before, r.anchors_before, r.sections_after, r.anchors_after) for r in report.collect()} == {1: (1, 3, 2, 2), 2: (1, 0, 0, 0), 3: (0, 0, 1, 0)}


def test_papers_that_are_one_row_are_backfilled_as_by_joins(spark, sf):
    papers = tb.papers(spark, sf)
    after, before = pa.paper_body(papers).filter("paper_id % 3 > 0"), tb.sections(spark, sf)
    said = F.when(F.col("section_idx") % 2 == 0, F.regexp_replace("content", r"^(\S+ \S+) \S+ ", "$1 ")).otherwise(F.col("content"))
    evidence = before.select(F.concat_ws(":", "paper_id", "section_idx").alias("evidence_id"), "paper_id", said.alias("text"))
    moved, report = lb.backfill(evidence, before, after)
    packed = lambda s, name: s.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("section_idx", "heading", "content"))).alias(name))
    empty = F.array().cast("array<struct<section_idx:int,heading:string,content:string>>")
    held = evidence.groupBy("paper_id").agg(F.collect_list(F.struct("evidence_id", "text")).alias("evidence")).join(packed(before, "before"), "paper_id").join(
        packed(after, "after"), "paper_id", "left").withColumn("after", F.coalesce("after", empty))
    got = lb.backfill_beside(held).collect()
    assert {(r.paper_id, *r[1:5]) for r in got} == {tuple(r) for r in report.collect()}
    assert {(e.evidence_id, e.heading, e.moved) for r in got for e in r.found} == {(r.evidence_id, r.heading, r.moved) for r in moved.collect()}


def test_no_line_is_shuffled_or_kept_to_be_looked_up_again(spark, sf):
    found = registry.queries()["s11_backfill"](spark, sf)
    assert exchanges(found) == [] and "RDD" not in found._jdf.queryExecution().optimizedPlan().toString()
