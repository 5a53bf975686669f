"""Registered grounding queries and their SQL."""

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import grounding as gr
from plumbline.plans import sqltext as sq
from plumbline.session import cut_lineage
from plumbline.sources import tables as tb


def norm(spark, d):
    return gr.norm_text(tb.papers(spark, d)).select("paper_id", F.length("norm").alias("chars"), F.md5("norm").alias("norm_md5"))


def tokens(spark, d):
    return gr.token_positions(tb.papers(spark, d)).groupBy("paper_id").agg(
        F.count("*").alias("tokens"), F.countDistinct("word").alias("words"))


def exact(spark, d):
    return gr.locate_exact(tb.quotes(spark, d), tb.papers(spark, d))


def squeezed(spark, d):
    """Lines of each document with a space lost, looked up in the document."""
    lines = tb.sections(spark, d).select(
        F.concat_ws(":", "paper_id", "section_idx").alias("quote_id"), "paper_id",
        F.regexp_replace("content", r"^(\S+ \S+) ", "$1").alias("text"))
    missed = lines.join(gr.locate_exact(lines, tb.papers(spark, d)).select("quote_id"), "quote_id", "left_anti")
    return gr.locate_squeezed(missed, tb.papers(spark, d))


def approx(spark, d):
    """Windows by number of words, and where they stand in the document."""
    papers = tb.papers(spark, d)
    hits = cut_lineage(gr.locate_approx(tb.quotes(spark, d), papers).withColumn("score", F.round("score", 6)))
    spans = hits.withColumns({"start": F.col("start_tok").cast("bigint"), "end": (F.col("end_tok") + 1).cast("bigint")})
    return gr.raw_offsets(gr.word_offsets(spans, papers), papers)


QUERIES = {
    "g1_normalise": norm, "g1_tokens": tokens, "g2_locate_exact": exact, "g3_locate_squeezed": squeezed,
    "g4_locate_approx": approx,
}

NORM = "regexp_replace(regexp_replace(lower(regexp_replace({c}, '-[\\r\\n]+', '', 'g')), '\\s+', ' ', 'g'), '^ | $', '', 'g')"


def norm_sql(c):
    return NORM.format(c=c)


_RUN = "PARTITION BY paper_id ORDER BY k"
_PAST = f"{_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def source_map(table: str) -> str:
    """``map``: where each word of the normalised text of ``table`` stands, in it and in the text itself.
    ``tight``: the same without spaces. ``toks``: words of letters and digits. ``norms``: the normalised text."""
    return f"""
        norms AS (SELECT paper_id, {norm_sql('text')} AS norm FROM {table}),
        pc AS (SELECT paper_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT paper_id, regexp_extract_all(text, '-[\\r\\n]+|\\s+|[^\\s-]+|-') AS p FROM {table})),
        wd AS (SELECT paper_id, k, coalesce(sum(length(piece)) OVER ({_PAST}), 0) AS raw, count(*) FILTER (regexp_matches(piece, '^\\s')) OVER ({_RUN}) AS gaps,
                 NOT regexp_matches(piece, '^(\\s|-[\\r\\n])') AS word, length(lower(piece)) AS size FROM pc),
        sp AS (SELECT *, CASE WHEN gaps <> lag(gaps) OVER ({_RUN}) THEN 1 ELSE 0 END AS space FROM wd WHERE word),
        map AS (SELECT paper_id, CAST(coalesce(sum(size) OVER ({_PAST}), 0) + sum(space) OVER ({_RUN}) AS BIGINT) AS norm_at, CAST(raw AS BIGINT) AS raw FROM sp),
        tp AS (SELECT paper_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (SELECT paper_id, string_split(norm, ' ') AS w FROM norms)),
        tight AS (SELECT paper_id, CAST(coalesce(sum(length(word)) OVER ({_PAST}), 0) AS BIGINT) AS tight_at, k - 1 AS by FROM tp WHERE word <> ''),
        np AS (SELECT paper_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT paper_id, regexp_extract_all(norm, '[a-z0-9]+|[^a-z0-9]+') AS p FROM norms)),
        toks AS (SELECT paper_id, word, CAST(stop - length(word) AS BIGINT) AS at, CAST(stop AS BIGINT) AS stop, row_number() OVER ({_RUN}) - 1 AS pos, count(*) OVER (PARTITION BY paper_id) AS n_tok
                 FROM (SELECT paper_id, k, piece AS word, sum(length(piece)) OVER ({_RUN}) AS stop FROM np) WHERE regexp_matches(word, '^[a-z0-9]'))"""


def windows(quotes: str, least: float) -> str:
    """``pick``: the best window of each pair of ``quotes`` (quote_id, paper_id, text) and its paper."""
    return f"""
        aq AS (SELECT quote_id, paper_id, len(w) AS n, list_distinct([x for x in w if length(x) > 2 and x not in {sq.QUOTE_STOP}]) AS want
               FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {quotes}) WHERE len(w) >= 4),
        aw AS (SELECT quote_id, paper_id, CAST(floor(n * 1.6 + 0.5) AS BIGINT) AS size, len(want) AS n_want, unnest(want) AS word FROM aq WHERE len(want) >= 4),
        post AS (SELECT quote_id, paper_id, n_want, least(size, n_tok) AS size, pos, word FROM aw JOIN toks USING (paper_id, word)),
        prev AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY quote_id, paper_id, word ORDER BY pos), -1) AS before FROM post),
        win AS (SELECT quote_id, paper_id, n_want, pos, list({{'p': pos, 'b': before}}) OVER (PARTITION BY quote_id, paper_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS f FROM prev),
        tip AS (SELECT quote_id, paper_id, n_want, pos, [x.p for x in f if x.b < pos] AS f FROM win),
        pick AS (SELECT quote_id, paper_id, pos AS start_tok, list_max(f) AS end_tok, len(f) / n_want AS score FROM tip WHERE len(f) >= ceil(n_want * {least} - 1e-9)
                 QUALIFY row_number() OVER (PARTITION BY quote_id, paper_id ORDER BY len(f) DESC, list_max(f) - pos, pos) = 1)"""


def found(quotes: str, least: float) -> str:
    """``hit``: quote_id, paper_id, match, score, start, stop in the normalised text, of each quote that is found."""
    return f"""
        nd AS (SELECT quote_id, paper_id, text, CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= 4 THEN nullif({norm_sql('text')}, '') END AS needle FROM {quotes}),
        pl AS (SELECT nd.*, replace(needle, ' ', '') AS bare, nullif(strpos(norm, needle), 0) - 1 AS norm_at,
                 CASE WHEN length(replace(needle, ' ', '')) >= 12 THEN nullif(strpos(replace(norm, ' ', ''), replace(needle, ' ', '')), 0) - 1 END AS tight_at FROM nd JOIN norms USING (paper_id)),
        rest AS (SELECT quote_id, paper_id, text FROM pl WHERE norm_at IS NULL AND tight_at IS NULL),
        {windows('rest', least)},
        loose AS (SELECT x.quote_id, x.paper_id, x.tight_at + a.by AS start, x.tight_at + length(x.bare) + z.by AS stop
                  FROM (SELECT *, tight_at + length(bare) - 1 AS last FROM pl WHERE norm_at IS NULL AND tight_at IS NOT NULL) x
                  ASOF JOIN tight a ON x.paper_id = a.paper_id AND x.tight_at >= a.tight_at ASOF JOIN tight z ON x.paper_id = z.paper_id AND x.last >= z.tight_at),
        hit AS (SELECT quote_id, paper_id, 'exact' AS match, 1.0 AS score, norm_at AS start, norm_at + length(needle) AS stop FROM pl WHERE norm_at IS NOT NULL
                UNION ALL SELECT quote_id, paper_id, 'exact', 1.0, start, stop FROM loose
                UNION ALL SELECT quote_id, p.paper_id, 'approximate', score, a.at, z.stop FROM pick p JOIN toks a ON a.paper_id = p.paper_id AND a.pos = start_tok JOIN toks z ON z.paper_id = p.paper_id AND z.pos = end_tok)"""


#: ``src``: hits in the text itself.
IN_SOURCE = """
        src AS (SELECT h.*, a.raw + h.start - a.norm_at AS s, z.raw + h.stop - z.norm_at AS e FROM (SELECT *, stop - 1 AS last FROM hit) h
                ASOF JOIN map a ON h.paper_id = a.paper_id AND h.start >= a.norm_at ASOF JOIN map z ON h.paper_id = z.paper_id AND h.last >= z.norm_at)"""

#: Rendered documents, their segments and pages.
RENDERED = sq.SECTIONS + """,
        lat AS (SELECT paper_id, line_no, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY paper_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM lines),
        rd AS (SELECT paper_id, string_agg('## ' || heading || chr(10) || content, chr(10) || chr(10) ORDER BY section_idx) AS text FROM sections GROUP BY 1),
        sg AS (SELECT s.paper_id, heading, length(content) AS n, lat.at AS at, length(heading) + 4 + coalesce(sum(length(heading) + length(content) + 6) OVER (PARTITION BY s.paper_id ORDER BY section_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f
               FROM sections s JOIN lat ON lat.paper_id = s.paper_id AND line_no = section_idx)"""

RESOLVED = """
        r1 AS (SELECT x.*, a.heading, a.at + s - a.f AS ss, CASE WHEN z.f IS NOT NULL THEN z.at + e - 1 - z.f + 1 ELSE a.at + a.n END AS se FROM src x
               JOIN sg a ON a.paper_id = x.paper_id AND s >= a.f AND s < a.f + a.n LEFT JOIN sg z ON z.paper_id = x.paper_id AND e - 1 >= z.f AND e - 1 < z.f + z.n),
        r2 AS (SELECT r1.*, p.line_no + 1 AS page, q.line_no + 1 AS last_page FROM r1 JOIN lat p ON p.paper_id = r1.paper_id AND ss >= p.at AND ss < p.at + p.n + 1
               LEFT JOIN lat q ON q.paper_id = r1.paper_id AND greatest(ss, se - 1) >= q.at AND greatest(ss, se - 1) < q.at + q.n + 1)"""

_PLACE = "page, CASE WHEN last_page <> page THEN last_page END AS page_end, CAST(ss AS BIGINT) AS start, CAST(se AS BIGINT) AS \"end\", md5(heading) AS heading_md5"

ORACLE = {
    "g1_normalise": f"SELECT doc_id AS paper_id, length(n) AS chars, md5(n) AS norm_md5 FROM (SELECT doc_id, {norm_sql('text')} AS n FROM documents)",
    "g1_tokens": f"""SELECT paper_id, count(*) AS tokens, count(DISTINCT w) AS words FROM (
        SELECT doc_id AS paper_id, unnest(regexp_extract_all({norm_sql('text')}, '[a-z0-9]+')) AS w FROM documents) GROUP BY 1""",
    "g2_locate_exact": f"""
        SELECT quote_id, paper_id, start, start + length(q) AS "end", 'exact' AS match, 1.0::DOUBLE AS score FROM (
          SELECT item_id AS quote_id, doc_id AS paper_id, q, strpos(n, q) - 1 AS start
          FROM (SELECT item_id, {norm_sql('text')} AS q FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= 4)
          CROSS JOIN (SELECT doc_id, {norm_sql('text')} AS n FROM documents)) WHERE start >= 0""",
    "g3_locate_squeezed": f"""WITH {sq.SECTIONS}, papers AS (SELECT doc_id AS paper_id, text FROM documents), {source_map('papers')},
        quote AS (SELECT paper_id || ':' || section_idx AS quote_id, paper_id, regexp_replace(content, '^(\\S+ \\S+) ', '\\1') AS text FROM sections), {found('quote', 0.6)}
        SELECT quote_id, paper_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", 'exact' AS match, 1.0::DOUBLE AS score FROM loose""",
    "g4_locate_approx": f"""WITH papers AS (SELECT doc_id AS paper_id, text FROM documents), {source_map('papers')},
        quote AS (SELECT item_id AS quote_id, doc_id AS paper_id, benchmark.text FROM benchmark, documents), {windows('quote', 0.6)},
        hit AS (SELECT p.*, a.at AS start, z.stop FROM pick p JOIN toks a ON a.paper_id = p.paper_id AND a.pos = start_tok JOIN toks z ON z.paper_id = p.paper_id AND z.pos = end_tok), {IN_SOURCE}
        SELECT quote_id, paper_id, start_tok, end_tok, round(score, 6) AS score, s AS start, e AS "end" FROM src""",
    "g5_resolve": f"""WITH {RENDERED}, {source_map('rd')},
        quote AS (SELECT paper_id || ':' || section_idx AS quote_id, paper_id, CASE section_idx % 3 WHEN 1 THEN regexp_replace(content, '^(\\S+ \\S+) ', '\\1')
                    WHEN 2 THEN regexp_replace(content, '^(\\S+ \\S+) \\S+ ', '\\1 ') ELSE content END AS text FROM sections),
        {found('quote', 0.6)}, {IN_SOURCE}, {RESOLVED}
        SELECT quote_id, match, round(score, 6) AS score, {_PLACE} FROM r2""",
    "g6_ground_turns": f"""WITH {RENDERED}, {source_map('rd')}, {sq.TURNS},
        said AS (SELECT episode_id, turn_idx, concat_ws(' ', t.text, content) AS text FROM turns t LEFT JOIN sections s ON s.paper_id = episode_id AND section_idx = turn_idx),
        parts AS (SELECT episode_id, turn_idx, list_concat([text], [x for x in [{sq.strip('y')} for y in string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))]
                    if len(string_split_regex(x, '\\s+')) >= 6]) AS c FROM said),
        quote AS (SELECT concat_ws(':', episode_id, turn_idx, cand) AS quote_id, * FROM
                    (SELECT episode_id, turn_idx, episode_id AS paper_id, unnest(c) AS text, generate_subscripts(c, 1) - 1 AS cand FROM parts)),
        {found('quote', 0.45).replace('hit AS (', 'every AS (')},
        hit AS (SELECT e.*, episode_id, turn_idx, cand FROM every e JOIN quote q USING (quote_id) QUALIFY row_number() OVER (PARTITION BY episode_id, turn_idx ORDER BY e.score DESC, cand) = 1), {IN_SOURCE}, {RESOLVED}
        SELECT episode_id, turn_idx, paper_id, cand AS candidate, match, round(score, 6) AS score, {_PLACE} FROM r2""",
}
