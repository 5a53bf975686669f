"""Registered ledger queries and their SQL."""

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import ledger as le
from plumbline.operators import timeline as tl
from plumbline.plans import sqltext as sq
from plumbline.plans.timeline import _TIME
from plumbline.sources import tables as tb


def _items(spark, d):
    """Every line of every labelled document, checked where its label is good."""
    docs = tb.table(spark, d, "documents")
    return tb.table(spark, d, "labels").join(docs, "doc_id").select(
        F.col("source").alias("paper_id"), F.when(F.col("quality") == 1, "verified").otherwise("stated").alias("provenance"),
        F.col("doc_id").alias("first_seen"), "lang", F.posexplode(tx.lines_of(F.col("text"))).alias("item_no", "text"))


def _learned(spark, d):
    items = _items(spark, d)
    return le.merge_learned(items.filter("lang = 'en'").drop("lang"), items.filter("lang <> 'en'").drop("lang"))


def learned(spark, d):
    return _learned(spark, d).withColumn("text", F.md5("text"))


def _coverage(spark, d):
    """Toxic labels were measured after the others."""
    docs = tb.table(spark, d, "documents").select("doc_id", "source", "lang")
    rows = tb.table(spark, d, "labels").join(docs, "doc_id").select(
        F.col("source").alias("paper_id"), F.col("lang").alias("contribution"), (F.col("quality") == 1).alias("covered"), "toxic")
    return le.merge_coverage(rows.filter("toxic = 0").drop("toxic"), rows.filter("toxic = 1").drop("toxic"))


def coverage(spark, d):
    return _coverage(spark, d)


def links(spark, d):
    """Where each conversation's closing words were said before."""
    t = tb.turns(spark, d)
    last = t.groupBy("episode_id").agg(F.max_by("text", "turn_idx").alias("text"))
    return le.link_items(last.withColumn("item_id", F.col("episode_id")), t, tl.timeline(tl.spoken_chunks(t)))


def gaps(spark, d):
    return le.open_gaps(_coverage(spark, d))


def titles(spark, d):
    t = tb.table(spark, d, "part").select(F.col("p_name").alias("title"))
    return le.matching_titles(t, t)


def suggest(spark, d):
    """Suppliers as papers, the parts they ship as the works they cite."""
    parts = tb.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"), (F.col("p_size") + 1950).alias("year"))
    refs = tb.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("paper_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ref_idx"), "l_partkey", "l_extendedprice"
    ).join(parts, "l_partkey").groupBy("paper_id", "ref_idx", "title").agg(F.min("year").alias("year"))
    library = tb.table(spark, d, "region").select(F.col("r_name").alias("title"))
    return le.suggest(refs, library)


def summary(spark, d):
    studied = tb.table(spark, d, "labels").join(tb.table(spark, d, "documents"), "doc_id").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("episode_id"))
    return le.ledger_summary(_learned(spark, d), _coverage(spark, d), studied)


QUERIES = {
    "l1_merge_learned": learned, "l2_merge_coverage": coverage, "l3_link_items": links, "l4_open_gaps": gaps,
    "l5_title_match": titles, "l6_suggest": suggest, "l7_summary": summary,
}

_KEY = sq.squeeze("regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')")
_LEARNED = f"""it AS (SELECT source AS paper_id, unnest(l) AS text, generate_subscripts(l, 1) AS item_no, provenance, first_seen, wave FROM (
    SELECT source, string_split(regexp_replace(text, '\\r\\n?|\\f', chr(10), 'g'), chr(10)) AS l, CASE WHEN quality = 1 THEN 'verified' ELSE 'stated' END AS provenance,
      l.doc_id AS first_seen, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS wave FROM labels l JOIN documents d USING (doc_id))),
  rk AS (SELECT *, {_KEY} AS item_key, row_number() OVER (PARTITION BY paper_id, {_KEY} ORDER BY CASE provenance WHEN 'verified' THEN 0 ELSE 1 END, wave, first_seen, item_no) AS n,
    min(first_seen) OVER (PARTITION BY paper_id, {_KEY}) AS fs FROM it),
  learned AS (SELECT paper_id, item_key, text, provenance, fs AS first_seen FROM rk WHERE n = 1)"""
_COV = """r AS (SELECT source AS paper_id, lang AS contribution, quality = 1 AS covered, toxic FROM labels JOIN documents USING (doc_id)),
  hit AS (SELECT DISTINCT paper_id, contribution FROM r WHERE covered),
  miss AS (SELECT DISTINCT paper_id, contribution FROM r WHERE NOT covered AND (toxic = 1 OR paper_id NOT IN (SELECT paper_id FROM r WHERE toxic = 1))),
  cov AS (SELECT *, true AS covered FROM hit UNION ALL SELECT *, false FROM miss ANTI JOIN hit USING (paper_id, contribution))"""

ORACLE = {
    "l1_merge_learned": f"WITH {_LEARNED} SELECT paper_id, item_key, md5(text) AS text, provenance, first_seen FROM learned",
    "l2_merge_coverage": f"WITH {_COV} SELECT * FROM cov",
    "l3_link_items": f"""WITH {_TIME},
        i AS (SELECT episode_id, regexp_extract_all(lower(max_by(text, turn_idx)), '[a-z][a-z0-9''-]{{4,}}')[1:8] AS w FROM turns GROUP BY 1),
        s AS (SELECT i.episode_id, turn_idx, len([x for x in w if contains(lower(text), x)]) / len(w) AS share FROM i JOIN turns USING (episode_id) WHERE len(w) > 0),
        b AS (SELECT episode_id, turn_idx, row_number() OVER (PARTITION BY episode_id ORDER BY share DESC, turn_idx) AS n FROM s WHERE share >= 0.5)
        SELECT i.episode_id, i.episode_id AS item_id, b.turn_idx, CAST(round(start_ms) AS BIGINT) AS start_ms FROM i LEFT JOIN b ON b.episode_id = i.episode_id AND n = 1
        LEFT JOIN timings t ON t.episode_id = b.episode_id AND t.turn_idx = b.turn_idx""",
    "l4_open_gaps": f"WITH {_COV} SELECT paper_id, contribution FROM cov WHERE NOT covered",
    "l5_title_match": """WITH t AS (SELECT DISTINCT p_name AS title FROM part),
        w AS (SELECT title, list_distinct([x for x in string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ') if length(x) > 3]) AS w FROM t)
        SELECT a.title AS a, b.title AS b FROM w a CROSS JOIN w b WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.6""",
    "l7_summary": f"""WITH {_LEARNED}, {_COV} SELECT (SELECT count(DISTINCT source) FROM labels JOIN documents USING (doc_id)) AS papers, (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS episodes,
        (SELECT count(*) FROM learned) AS learned, (SELECT count(*) FROM learned WHERE provenance = 'verified') AS verified, (SELECT count(*) FROM cov WHERE NOT covered) AS gaps""",
}
