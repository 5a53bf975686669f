"""Shared pieces of the comparison SQL: the given tables in canonical shape."""

from plumbline.functions import lexicons as lx


def words(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in dict.fromkeys(values)) + ")"


QUESTION_STOP = words(lx.QUESTION_STOP)
QUOTE_STOP = words(lx.QUOTE_STOP)


def terms(col: str) -> str:
    return f"[w for w in regexp_extract_all(lower({col}), '[a-z][a-z0-9-]{{2,}}') if w not in {QUESTION_STOP}]"


def squeeze(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


def flatten(col: str) -> str:
    return squeeze(f"regexp_replace(lower({col}), '[-‐–]', ' ', 'g')")


def after_mark(col: str) -> str:
    return f"string_split(regexp_replace({col}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def spoken(col: str) -> str:
    marked = f"""regexp_replace({col}, '([.!?][.!?"''’)\\]]*)(\\s+|$)', '\\1' || chr(1), 'g')"""
    return f"[x for x in [{strip('s')} for s in string_split({marked}, chr(1))] if x <> '']"


LINES = """
lines AS (
  SELECT doc_id AS paper_id, unnest(range(len(l))) AS line_no, unnest(l) AS text
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?|\\f', chr(10), 'g'), chr(10)) AS l FROM documents))
"""

SECTIONS = LINES + """,
sections AS (
  SELECT paper_id, line_no AS section_idx, regexp_extract(text, '^[^.]*') AS heading, text AS content
  FROM lines WHERE regexp_matches(text, '\\S'))
"""

TURNS = """
turns AS (
  SELECT conv_id AS episode_id, turn AS turn_idx,
         CASE role WHEN 'user' THEN 'host' WHEN 'assistant' THEN 'guest' ELSE 'narrator' END AS speaker, text
  FROM conversations)
"""

QUESTIONS = """
questions AS (
  SELECT conv_id || '-' || turn AS question_id, conv_id AS paper_id, text
  FROM conversations WHERE role = 'user')
"""

VERDICTS = """
verdicts AS (
  SELECT source AS paper_id, l.doc_id AS claim_id,
         CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS verdict,
         n_chars > 500 AS specific
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""

SPANS = """
spans AS (
  SELECT event_id AS span_id, CASE WHEN event_id > 0 THEN event_id // 4 END AS parent_id, event_type AS name,
         ts AS start, value AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens,
         CAST(floor(value) AS BIGINT) AS output_tokens, value AS cost, user_id
  FROM events)
"""

JOB_EVENTS = """
job_events AS (
  SELECT user_id AS job_id, event_id, ts AS ev_at,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'scripting'
              WHEN 'purchase' THEN 'done' ELSE 'error' END AS stage,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS percent, value
  FROM events)
"""
