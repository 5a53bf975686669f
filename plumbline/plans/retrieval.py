"""Registered retrieval queries and their SQL."""

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import dense as de
from plumbline.operators import grounding as gr
from plumbline.operators import retrieval as rt
from plumbline.plans import sqltext as sq
from plumbline.session import cut_lineage
from plumbline.sources import tables as tb


def terms(spark, d):
    return rt.term_counts(tb.papers(spark, d))


def idf(spark, d):
    return rt.idf_in_texts(tb.papers(spark, d), tb.contents).select("paper_id", "word", F.round("idf", 6).alias("idf"))


def _asked(spark, d):
    """Questions, and the sections of the papers they ask about."""
    return tb.questions(spark, d), tb.asked_sections(spark, d)


def _lexical(spark, d):
    q, s = _asked(spark, d)
    return rt.lexical_rank(s, q)


def _scored(spark, d):
    q, s = _asked(spark, d)
    return rt.bm25(s, q)


def bm25(spark, d):
    return _scored(spark, d).select("question_id", "section_idx", F.round("score", 6).alias("score"))


def lexical(spark, d):
    return _lexical(spark, d).select("question_id", "section_idx", "rank")


def top_sections(spark, d, k=5):
    return _lexical(spark, d).filter(F.col("rank") < k).select("question_id", "section_idx", "rank", F.round("score", 6).alias("score"))


def cosine(spark, d):
    v = tb.vectors(spark, d)
    return de.cosine_scores(de.centroids(v), v).select("query_id", "id", F.round("score", 6).alias("score"))


def knn(spark, d):
    v = tb.vectors(spark, d)
    return de.knn(de.centroids(v), v, 10).select("query_id", "id", "rank")


def _rankings(spark, d):
    """By words, and dense."""
    q, s = _asked(spark, d)
    return cut_lineage(rt.lexical_rank(s, q)), rt.rank(de.profile_scorer(q, s))


def gate(spark, d):
    lex, dense = _rankings(spark, d)
    return rt.gate_dense(dense, lex).select("question_id", "section_idx", "rank")


def rrf(spark, d):
    lex, dense = _rankings(spark, d)
    return rt.fuse(lex, rt.gate_dense(dense, lex)).select(
        "question_id", "section_idx", "rank", F.round("score", 6).alias("score"))


def veto(spark, d):
    q, s = _asked(spark, d)
    strict = rt.rank_sections(q, s, de.profile_scorer, True)
    loose = rt.rank_sections(q, s, de.profile_scorer, False)
    n = lambda df, name: df.groupBy("question_id", "lexical_match", "method").agg(F.count("*").alias(name))
    keys = ["question_id", "lexical_match", "method"]
    return n(loose, "ranked").join(n(strict, "ranked_strict"), keys, "left").fillna(0, ["ranked_strict"])


def context(spark, d):
    q, s = _asked(spark, d)
    ranked = rt.rank_sections(q, s, de.profile_scorer)
    return rt.select_context(q, s, ranked).withColumn("sections", F.array_join("sections", ","))


def snippet(spark, d):
    q, s = _asked(spark, d)
    top = rt.lexical_rank(s, q).filter(F.col("rank") < 4).select("question_id", "paper_id", "section_idx")
    joined = top.join(s, ["paper_id", "section_idx"]).join(
        q.select("question_id", F.col("text").alias("query")), "question_id")
    return rt.best_snippet(joined).select("question_id", "section_idx", "snippet")


def _longest_term(spark, d):
    """Each question's longest term, first in the alphabet on ties."""
    pick = F.array_min(F.transform(tx.terms(F.col("text")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return tb.questions(spark, d).select("question_id", "paper_id", pick["w"].alias("phrase")).filter("phrase is not null")


def phrase(spark, d):
    return rt.find_phrase(tb.asked_sections(spark, d), _longest_term(spark, d))


def heading(spark, d):
    return rt.resolve_heading(tb.asked_sections(spark, d), _longest_term(spark, d).withColumnRenamed("phrase", "asked"))


def pages(spark, d):
    return rt.page_slices(tb.papers(spark, d), "paper_id", "text").select(
        "paper_id", "start", F.md5("part").alias("part_md5"), "remaining", "note")


def history(spark, d):
    return rt.history_tail(tb.turns(spark, d))


def fitted(spark, d):
    return rt.fit_history(tb.turns(spark, d), 2_000).select("episode_id", "turn_idx", "was_cut", F.length("observation").alias("chars"))


def quality(spark, d):
    """Passages known to stand in a document, asked of that document."""
    quotes, papers, sections = tb.quotes(spark, d), tb.papers(spark, d), tb.sections(spark, d)
    at = gr.locate_exact(quotes, papers).select("quote_id", "paper_id").join(quotes, "quote_id")
    asked = at.select(F.concat_ws("-", "quote_id", "paper_id").alias("question_id"), "paper_id", "text")
    opening = tx.normal_text(F.element_at(tx.lines_of(F.col("text")), 1))
    gold = (
        asked.withColumn("opening", opening).join(sections, "paper_id")
        .filter(F.contains(tx.normal_text(F.col("content")), F.col("opening")))
        .groupBy("question_id").agg(F.min("section_idx").alias("section_idx"))
    )
    lex = rt.rank_sections(asked, sections)
    hyb = rt.rank_sections(asked, sections, de.profile_scorer)
    return rt.hit_rate(lex.unionByName(hyb).filter(F.col("rank") < 4), gold)


QUERIES = {
    "q1_terms": terms, "q2_idf": idf, "q3_bm25": bm25, "q4_rank": lexical, "q4_top_sections": top_sections,
    "q5_cosine": cosine, "q6_knn": knn, "q7_dense_gate": gate, "q8_rrf": rrf, "q9_lexical_veto": veto,
    "q10_select_context": context, "q11_snippet": snippet, "q12_find_phrase": phrase,
    "q13_resolve_heading": heading, "q14_page_slices": pages, "q15_history_tail": history,
    "q16_fit_history": fitted, "q17_hit_rate": quality,
}

BM25 = f"""
{sq.SECTIONS}, {sq.QUESTIONS},
asked AS (SELECT DISTINCT question_id, paper_id, word FROM (
  SELECT question_id, paper_id, unnest({sq.terms('text')}) AS word FROM questions)),
bag AS (SELECT paper_id, section_idx, {sq.terms('content')} AS body, {sq.terms('heading')} AS head FROM sections),
shape AS (SELECT paper_id, count(*) AS total, greatest(1.0, sum(len(body)) / count(*)) AS mean FROM bag GROUP BY 1),
tok AS (SELECT paper_id, section_idx, len(body) AS n, unnest(body) AS word FROM bag),
tf AS (SELECT paper_id, section_idx, n, word, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT paper_id, word, count(*) AS df FROM tf GROUP BY 1, 2),
weight AS (SELECT a.question_id, a.paper_id, a.word, s.mean, ln(1 + s.total / (1 + coalesce(df, 0))) AS idf
  FROM asked a JOIN shape s USING (paper_id) LEFT JOIN df USING (paper_id, word)),
part AS (
  SELECT question_id, w.paper_id, section_idx, idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * n / mean)) AS p
  FROM weight w JOIN tf USING (paper_id, word)
  UNION ALL
  SELECT question_id, w.paper_id, section_idx, 2 * idf FROM weight w
  JOIN (SELECT paper_id, section_idx, unnest(head) AS word FROM bag) h USING (paper_id, word)),
scored AS (SELECT question_id, paper_id, section_idx, round(sum(p), 9) AS score FROM part GROUP BY 1, 2, 3),
lexical AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, section_idx) - 1 AS rank FROM scored)
"""

_LETTERS = ", ".join(f"CAST(len([w for w in {{t}} if w[1] = '{chr(c)}']) AS DOUBLE)" for c in range(97, 123))


def _profile(t):
    return "[" + _LETTERS.format(t=t) + "]"


DENSE = f"""
qp AS (SELECT question_id, paper_id, {_profile('t')} AS q FROM (SELECT *, {sq.terms('text')} AS t FROM questions)),
sp AS (SELECT paper_id, section_idx, {_profile('t')} AS s
       FROM (SELECT *, {sq.terms("(heading || '. ' || content)")} AS t FROM sections)),
dscore AS (SELECT question_id, paper_id, section_idx, round(CASE WHEN list_sum(q) > 0 AND list_sum(s) > 0
    THEN list_inner_product(q, s) / sqrt(list_inner_product(q, q) * list_inner_product(s, s)) ELSE 0 END, 9) AS score
  FROM qp JOIN sp USING (paper_id)),
dense AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, section_idx) - 1 AS rank FROM dscore),
gated AS (SELECT d.* FROM dense d LEFT JOIN lexical l USING (question_id, section_idx) WHERE d.rank < 5 OR l.rank IS NOT NULL),
fused AS (SELECT question_id, section_idx,
    round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + g.rank), 0), 9) AS score
  FROM lexical l FULL JOIN gated g USING (question_id, section_idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, section_idx) - 1 AS rank FROM fused)
"""

_HEAD_KEY = "trim(regexp_replace(regexp_replace(lower({c}), '^\\s*(\\d+(\\.\\d+)*\\.?|[ivx]+\\.)\\s*', ''), '[^a-z0-9]+', ' ', 'g'))"


def head_key(c):
    return _HEAD_KEY.format(c=c)


_LONGEST = f"""
longest AS (SELECT question_id, paper_id, w AS phrase FROM (
  SELECT question_id, paper_id, w, row_number() OVER (PARTITION BY question_id ORDER BY length(w) DESC, w) AS n
  FROM (SELECT question_id, paper_id, unnest({sq.terms('text')}) AS w FROM questions)) WHERE n = 1)
"""

_VECTORS = """
v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
cell AS (SELECT label, unnest(range(len(x))) AS pos, unnest(x) AS c FROM v),
cent AS (SELECT label AS query_id, list(m ORDER BY pos) AS q FROM (SELECT label, pos, avg(c) AS m FROM cell GROUP BY 1, 2) GROUP BY 1),
scores AS (SELECT query_id, id, round(list_cosine_similarity(q, x), 9) AS score FROM cent CROSS JOIN v)
"""

ORACLE = {
    "q1_terms": f"SELECT paper_id, word, count(*) AS n FROM (SELECT doc_id AS paper_id, unnest({sq.terms('text')}) AS word FROM documents) GROUP BY 1, 2",
    "q2_idf": f"WITH {BM25} SELECT d.paper_id, d.word, round(ln(1 + total / (1 + df)), 6) AS idf FROM df d JOIN shape USING (paper_id)",
    "q3_bm25": f"WITH {BM25} SELECT question_id, section_idx, round(score, 6) AS score FROM scored",
    "q4_rank": f"WITH {BM25} SELECT question_id, section_idx, rank FROM lexical",
    "q4_top_sections": f"WITH {BM25} SELECT question_id, section_idx, rank, round(score, 6) AS score FROM lexical WHERE rank < 5",
    "q5_cosine": f"WITH {_VECTORS} SELECT query_id, id, round(score, 6) AS score FROM scores",
    "q6_knn": f"WITH {_VECTORS} SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM scores) WHERE rank < 10",
    "q7_dense_gate": f"WITH {BM25}, {DENSE} SELECT question_id, section_idx, rank FROM gated",
    "q8_rrf": f"WITH {BM25}, {DENSE} SELECT question_id, section_idx, rank, round(score, 6) AS score FROM ranked",
    "q9_lexical_veto": f"""WITH {BM25}, {DENSE}
        SELECT question_id, question_id IN (SELECT question_id FROM lexical) AS lexical_match, 'hybrid' AS method, count(*) AS ranked,
               CASE WHEN question_id IN (SELECT question_id FROM lexical) THEN count(*) ELSE 0 END AS ranked_strict
        FROM ranked GROUP BY question_id""",
    "q11_snippet": f"""WITH {BM25},
        top AS (SELECT l.question_id, l.section_idx, s.content, q.text AS query FROM lexical l JOIN sections s USING (paper_id, section_idx)
                JOIN questions q ON q.question_id = l.question_id WHERE rank < 4),
        sent AS (SELECT question_id, section_idx, [w for w in list_distinct(string_split({head_key('query')}, ' ')) if length(w) > 2] AS want,
                 unnest(range(len(ss))) AS pos, unnest(ss) AS s FROM (SELECT *, {sq.after_mark('content')} AS ss FROM top)),
        hit AS (SELECT *, len([w for w in string_split({head_key('s')}, ' ') if list_contains(want, w)]) AS hits FROM sent),
        best AS (SELECT question_id, section_idx, {sq.squeeze('s')} AS t,
                 row_number() OVER (PARTITION BY question_id, section_idx ORDER BY hits DESC, pos) AS n FROM hit)
        SELECT question_id, section_idx, CASE WHEN length(t) > 220 THEN substring(t, 1, 219) || '…' ELSE t END AS snippet FROM best WHERE n = 1""",
    "q12_find_phrase": f"""WITH {sq.SECTIONS}, {sq.QUESTIONS}, {_LONGEST},
        sent AS (SELECT question_id, phrase, section_idx, unnest(range(len(ss))) AS pos, unnest(ss) AS s
                 FROM (SELECT l.*, section_idx, {sq.after_mark('content')} AS ss FROM longest l JOIN sections USING (paper_id))),
        hit AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY section_idx, pos) AS hit_no FROM sent
                WHERE length(phrase) >= 2 AND contains(lower(s), lower(phrase)))
        SELECT question_id, phrase, section_idx, hit_no,
               CASE WHEN length({sq.squeeze('s')}) > 300 THEN substring({sq.squeeze('s')}, 1, 299) || '…' ELSE {sq.squeeze('s')} END AS sentence
        FROM hit WHERE hit_no <= 6""",
    "q13_resolve_heading": f"""WITH {sq.SECTIONS}, {sq.QUESTIONS}, {_LONGEST},
        pair AS (SELECT question_id, phrase AS asked, section_idx, heading, {head_key('phrase')} AS want, {head_key('heading')} AS have
                 FROM longest JOIN sections USING (paper_id)),
        tiered AS (SELECT *, CASE WHEN heading = asked THEN 0 WHEN have = want THEN 1 WHEN starts_with(have, want) THEN 2
                   WHEN contains(have, want) THEN 3 END AS tier FROM pair WHERE want <> '')
        SELECT question_id, asked, tier, section_idx, heading FROM (
          SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY tier, section_idx) AS n FROM tiered WHERE tier IS NOT NULL) WHERE n = 1""",
    "q14_page_slices": """
        SELECT doc_id AS paper_id, start, md5(substring(text, start + 1, 5000)) AS part_md5, greatest(length(text) - start - 5000, 0) AS remaining,
               CASE WHEN start > 0 THEN 'continued' WHEN length(text) > 5000 THEN 'first part' ELSE 'whole section' END AS note
        FROM (SELECT *, unnest(range(0, length(text), 5000)) AS start FROM documents WHERE length(text) > 0)""",
    "q15_history_tail": f"""WITH {sq.TURNS},
        tail AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY turn_idx DESC) AS n FROM turns)
        SELECT episode_id, string_agg(CASE speaker WHEN 'host' THEN 'READER: ' ELSE 'YOU: ' END || text, chr(10) ORDER BY turn_idx) AS history,
               count(*) AS n_turns FROM tail WHERE n <= 6 GROUP BY 1""",
    "q16_fit_history": f"""WITH {sq.TURNS},
        newer AS (SELECT *, greatest(0, 2000 - coalesce(sum(length(text)) OVER (PARTITION BY episode_id ORDER BY turn_idx DESC
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM turns)
        SELECT episode_id, turn_idx, length(text) > room AS was_cut,
               CASE WHEN length(text) > room THEN length(substring(text, 1, CAST(greatest(400, room) AS BIGINT))) + length('[…cut for length]') + 1
                    ELSE length(text) END AS chars FROM newer""",
}
