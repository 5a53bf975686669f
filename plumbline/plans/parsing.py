"""Registered parsing queries and their SQL."""

from pyspark.sql import functions as F

from plumbline.functions import lexicons as lx
from plumbline.functions import text as tx
from plumbline.operators import grounding as gr
from plumbline.operators import parsing as pa
from plumbline.plans import sqltext as sq
from plumbline.sources import tables as tb


def _pages(spark, d):
    """Documents as the pages of their source."""
    return tb.table(spark, d, "documents").select(
        F.col("source").alias("paper_id"), F.col("doc_id").alias("page_key"), "text")


def lines(spark, d):
    return pa.lines(tb.papers(spark, d)).select("paper_id", "line_no", "at", F.length("text").alias("chars"))


def spans(spark, d):
    return pa.page_spans(_pages(spark, d))


def page_at(spark, d):
    pages = pa.page_spans(_pages(spark, d))
    size = tb.table(spark, d, "documents").select(F.col("doc_id").alias("page_key"), F.length("text").alias("n"))
    starts = pages.join(size, "page_key").select("paper_id", "page_key", (F.col("end") - F.col("n")).alias("base"))
    at = pa.lines(tb.papers(spark, d)).select(F.col("paper_id").alias("page_key"), "line_no", "at")
    points = starts.join(at, "page_key").select(
        "paper_id", F.col("page_key").alias("doc_id"), "line_no", (F.col("base") + F.col("at")).alias("offset"))
    return gr.page_at(points, pages)


def stitch(spark, d):
    """Events laid out as fragments of one page per user and day."""
    k = F.get_json_object("props", "$.k").cast("double")
    items = tb.table(spark, d, "events").select(
        F.col("user_id").alias("paper_id"), F.dayofyear("ts").alias("page"), F.col("event_id").alias("item_idx"),
        F.col("event_type").alias("str"), F.lit(10.0).alias("a"), F.lit(0.0).alias("b"),
        F.col("value").alias("x"), F.floor(k / 50).cast("double").alias("y"), (k / 4).alias("width"))
    return pa.stitch(items, ["paper_id", "page"])


def shapes(spark, d):
    rows = pa.lines(tb.papers(spark, d)).select(F.coalesce(pa.heading_shape(F.col("text")), F.lit("text")).alias("shape"))
    return rows.groupBy("shape").agg(F.count("*").alias("n"))


def starts(spark, d):
    return pa.paper_starts(tb.papers(spark, d))


def sections(spark, d):
    return pa.paper_sections(tb.papers(spark, d)).select("paper_id", "section_idx", "heading", F.length("content").alias("chars"))


def clean(spark, d):
    return pa.clean_block(pa.lines(tb.papers(spark, d)), ["paper_id"]).select("paper_id", "line_no", "at", F.md5("text").alias("text_md5"))


def body(spark, d):
    return pa.paper_body(tb.papers(spark, d)).select(
        "paper_id", "section_idx", "kind", "heading", F.length("content").alias("chars"))


def titles(spark, d):
    return pa.paper_titles(tb.papers(spark, d))


def counts(spark, d):
    return pa.word_counts(tb.sections(spark, d)).select("paper_id", "word_count", "sections")


def render(spark, d):
    return pa.render(tb.sections(spark, d)).select("paper_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


def prompt(spark, d):
    return pa.prompt(pa.render(tb.sections(spark, d))).select("paper_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("chars"), "truncated")


def segments(spark, d):
    at = pa.lines(tb.papers(spark, d)).select("paper_id", F.col("line_no").alias("section_idx"), "at")
    return pa.segments(tb.sections(spark, d).join(at, ["paper_id", "section_idx"])).drop("heading")


def references(spark, d):
    """Each document read as a bibliography."""
    text = F.concat(F.lit("\nReferences\n"), F.col("text"))
    return pa.references(tb.papers(spark, d).withColumn("text", text)).select(
        "paper_id", "ref_idx", F.md5("raw").alias("raw_md5"), F.coalesce("title", F.lit("")).alias("title"), "year")


def captions(spark, d):
    pages = _pages(spark, d).withColumnRenamed("page_key", "page")
    return pa.caption_pages(pages).withColumn("captions", F.array_join("captions", "|"))


def title_key(spark, d):
    return tb.table(spark, d, "part").select("p_partkey", tx.title_key(F.col("p_name")).alias("key"))


def sentences(spark, d):
    return pa.sentences(tb.papers(spark, d), "paper_id", "text").select("paper_id", "sentence_no", F.md5("sentence").alias("sentence_md5"))


def chunks(spark, d):
    return pa.chunks(tb.papers(spark, d), "paper_id", "text", 900).select("paper_id", "chunk_no", F.length("chunk").alias("chars"))


def digest(spark, d):
    return pa.digest(tb.sections(spark, d), titles(spark, d)).select("paper_id", "openings", F.length("digest").alias("chars"))


def outline(spark, d):
    return pa.outline(tb.sections(spark, d))


QUERIES = {
    "p1_lines": lines, "p2_page_spans": spans, "p3_page_at": page_at, "p4_stitch": stitch, "p5_heading_shape": shapes,
    "p6_section_starts": starts, "p7_sections": sections, "p8_clean_block": clean, "p9_body_sections": body,
    "p10_titles": titles, "p11_word_counts": counts, "p12_render": render, "p12_prompt": prompt, "p12_segments": segments,
    "p13_references": references, "p14_caption_pages": captions, "p16_title_key": title_key, "p17_sentences": sentences,
    "p18_chunks": chunks, "p19_digest": digest, "p21_outline": outline,
}

_AT = "coalesce(sum(length(text) + 1) OVER (PARTITION BY paper_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"

_SPANS = """
page AS (SELECT source AS paper_id, doc_id AS page_key, text, row_number() OVER w AS page,
         sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS len FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
ended AS (SELECT *, (len + 2 * (page - 1))::BIGINT AS "end" FROM page),
spans AS (SELECT paper_id, page_key, page, coalesce(lag("end") OVER (PARTITION BY paper_id ORDER BY page), 0) AS start, "end" FROM ended)
"""

_KNOWN = sq.words(lx.KNOWN_HEADINGS)
_BLOCK = "'## ' || heading || chr(10) || content"

ORACLE = {
    "p1_lines": f"WITH {sq.LINES} SELECT paper_id, line_no, {_AT} AS at, length(text) AS chars FROM lines",
    "p2_page_spans": f"WITH {_SPANS} SELECT * FROM spans",
    "p3_page_at": f"""WITH {sq.LINES}, {_SPANS},
        pt AS (SELECT s.paper_id, l.paper_id AS doc_id, line_no, (s."end" - length(d.text) + l.at)::BIGINT AS "offset"
               FROM (SELECT *, {_AT} AS at FROM lines) l JOIN spans s ON s.page_key = l.paper_id JOIN documents d ON d.doc_id = l.paper_id)
        SELECT pt.paper_id, doc_id, line_no, "offset", p.page FROM pt LEFT JOIN spans p ON p.paper_id = pt.paper_id AND "offset" >= p.start AND "offset" < p."end" """,
    "p5_heading_shape": f"""WITH {sq.LINES},
        c AS (SELECT {sq.strip('text')} AS line FROM lines),
        w AS (SELECT line, string_split_regex(line, '\\s+') AS ws, regexp_matches(line, '^(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$') AS num,
              regexp_extract(line, '^(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$', 2) AS rest,
              [CAST(x AS DOUBLE) for x in string_split(regexp_extract(line, '^(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$', 1), '.') if x <> ''] AS parts,
              {sq.strip("lower(regexp_replace(regexp_replace(line, '^\\d+(\\.\\d+)*\\.?\\s*', ''), '[:.]+$', ''))")} AS norm FROM c),
        s AS (SELECT CASE WHEN line = '' OR length(line) > 80 OR len(ws) > 10 THEN NULL
          WHEN num THEN CASE WHEN parts[1] >= 1 AND list_max(parts) <= 20 AND regexp_matches(rest, '^[A-Z]') AND regexp_matches(rest, '[A-Za-z]{{3,}}')
            AND len([x for x in string_split_regex(regexp_extract(rest, ':\\s*(.+)$', 1), '\\s+')
                     if regexp_matches(x, '^[a-z]') and x not in {sq.words(lx.TITLE_SMALL_WORDS)}]) = 0 THEN 'numbered' END
          WHEN norm IN {_KNOWN} AND regexp_matches(line, '^[A-Z]') THEN 'known'
          WHEN regexp_matches(line, '^[A-Z][A-Z0-9 :&,-]{{2,60}}$') AND len(ws) BETWEEN 2 AND 8
            AND len([x for x in ws if regexp_matches(x, '^[A-Z&]+[,:]?$')]) >= 2
            AND len([x for x in ws if regexp_matches(x, '^[A-Z&]+[,:]?$') and length(regexp_replace(x, '[^A-Za-z0-9_]', '', 'g')) >= 4]) > 0 THEN 'caps' END AS shape FROM w)
        SELECT coalesce(shape, 'text') AS shape, count(*) AS n FROM s GROUP BY 1""",
    "p8_clean_block": f"""WITH {sq.LINES},
        l AS (SELECT *, {_AT} AS at FROM lines),
        q AS (SELECT *, lag(text) OVER (PARTITION BY paper_id ORDER BY line_no) AS prev FROM l
              WHERE NOT regexp_matches({sq.strip('text')}, '(?i)^(figure|fig\\.?|table|algorithm)\\s*\\d+(?:[^A-Za-z0-9_]|$)') AND NOT regexp_matches({sq.strip('text')}, '^\\d+$')),
        k AS (SELECT * FROM q WHERE NOT (text = '' AND coalesce(prev = '', false))),
        b AS (SELECT *, min(CASE WHEN regexp_matches(text, '\\S') THEN line_no END) OVER p AS lo,
                     max(CASE WHEN regexp_matches(text, '\\S') THEN line_no END) OVER p AS hi FROM k WINDOW p AS (PARTITION BY paper_id)),
        f AS (SELECT *, CASE WHEN line_no = lo THEN regexp_replace(text, '^\\s+', '') ELSE text END AS led FROM b WHERE line_no BETWEEN lo AND hi)
        SELECT paper_id, line_no, ("at" + length(text) - length(led))::BIGINT AS at,
               md5(CASE WHEN line_no = hi THEN regexp_replace(led, '\\s+$', '') ELSE led END) AS text_md5 FROM f""",
    "p11_word_counts": f"WITH {sq.SECTIONS} SELECT paper_id, sum(len(regexp_extract_all(content, '\\S+')))::BIGINT AS word_count, count(*) AS sections FROM sections GROUP BY 1",
    "p12_render": f"""WITH {sq.SECTIONS}, r AS (SELECT paper_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY section_idx) AS t FROM sections GROUP BY 1)
        SELECT paper_id, md5(t) AS text_md5, length(t) AS chars FROM r""",
    "p12_prompt": f"""WITH {sq.SECTIONS}, r AS (SELECT paper_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY section_idx) AS t FROM sections GROUP BY 1)
        SELECT paper_id, md5(substring(t, 1, 120000)) AS prompt_md5, least(length(t), 120000) AS chars, length(t) > 120000 AS truncated FROM r""",
    "p12_segments": f"""WITH {sq.SECTIONS}, l AS (SELECT paper_id, line_no, {_AT} AS at FROM lines),
        s AS (SELECT s.*, l."at", coalesce(sum(length({_BLOCK}) + 2) OVER (PARTITION BY s.paper_id ORDER BY section_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead_in
              FROM sections s JOIN l ON l.paper_id = s.paper_id AND l.line_no = s.section_idx)
        SELECT paper_id, section_idx, (lead_in + length(heading) + 4)::BIGINT AS "from", (lead_in + length(heading) + 4 + length(content))::BIGINT AS "to", "at" FROM s""",
    "p13_references": f"""WITH e AS (SELECT doc_id AS paper_id, {sq.squeeze('text')} AS raw FROM documents),
        k AS (SELECT * FROM e WHERE length(raw) > 30 AND NOT regexp_matches(raw, '(?i)https?://|available at|(^|[^A-Za-z0-9_])(manual|documentation)([^A-Za-z0-9_]|$)')),
        p AS (SELECT paper_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (
                SELECT paper_id, [x for x in [{sq.strip('y')} for y in string_split_regex(raw, '\\.\\s+')] if x <> ''] AS ps FROM k)),
        t AS (SELECT paper_id, p, row_number() OVER (PARTITION BY paper_id ORDER BY length(p) DESC, i) AS n FROM p
              WHERE len(string_split_regex(p, '\\s+')) >= 3 AND len(regexp_extract_all(p, '(^|[^A-Za-z0-9_])[A-Z]\\.')) < 2)
        SELECT k.paper_id, 0 AS ref_idx, md5(raw) AS raw_md5, coalesce(regexp_replace(p, '[.,;]+$', ''), '') AS title,
               CAST(nullif(regexp_extract(raw, '(?:^|[^A-Za-z0-9_])((?:19|20)\\d\\d)(?:[^A-Za-z0-9_]|$)', 1), '') AS INTEGER) AS year
        FROM k LEFT JOIN t ON t.paper_id = k.paper_id AND n = 1""",
    "p14_caption_pages": """WITH c AS (SELECT source AS paper_id, doc_id AS page,
            regexp_extract_all(text, '(?i)\\b(?:figure|fig\\.|table|algorithm)\\s*\\d+\\s*[:.]') AS cs FROM documents)
        SELECT paper_id, page, array_to_string(list_distinct(cs), '|') AS captions FROM (
          SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY page) AS n FROM c WHERE len(cs) > 0) WHERE n <= 8""",
    "p16_title_key": "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part",
    "p17_sentences": f"""SELECT paper_id, unnest(range(len(s))) AS sentence_no, md5(unnest(s)) AS sentence_md5
        FROM (SELECT doc_id AS paper_id, {sq.spoken('text')} AS s FROM documents)""",
    "p21_outline": f"""WITH {sq.SECTIONS} SELECT paper_id, string_agg('- ' || heading || ' (' || length(content) || ' characters)', chr(10) ORDER BY section_idx) AS outline,
        count(*) AS sections FROM sections GROUP BY 1""",
}
