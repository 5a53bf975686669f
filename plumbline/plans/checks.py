"""Registered script checks and their SQL."""

from pyspark.sql import functions as F

from plumbline.functions import lexicons as lx
from plumbline.functions import text as tx
from plumbline.operators import checks as ck
from plumbline.plans import sqltext as sq
from plumbline.sources import tables as tb


KINDS = [ck.CONTROL] + [k for k, _ in ck.MUTATIONS]


def _faulty(spark, d):
    """The conversations, nine in ten with one of the injected faults, and some with a speaker that does not exist."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("episode_id") % len(KINDS)).cast("int") + 1)
    stranger = (F.col("episode_id") % 7 == 3) & (F.col("turn_idx") == 1)
    return ck.mutate(tb.turns(spark, d)).filter(F.col("kind") == kind).select(
        "episode_id", "turn_idx", F.when(stranger, "announcer").otherwise(F.col("speaker")).alias("speaker"), "text")


def _args(spark, d):
    return _faulty(spark, d), tb.episodes(spark, d), tb.papers(spark, d)


def _check(fn):
    return lambda spark, d: fn(*_args(spark, d))


def _told(spark, d):
    """As ``_args``; an episode's narrator gives its summary, its guest the key points, and not every episode has both."""
    t, e, p = _args(spark, d)
    said = t.groupBy("episode_id").agg(F.min_by(F.when(F.col("speaker") == "narrator", F.col("text")), F.when(F.col("speaker") == "narrator", F.col("turn_idx"))).alias("summary"),
                                       F.collect_list(F.when(F.col("speaker") == "guest", F.col("text"))).alias("points"))
    told = said.select("episode_id", "summary", F.when(F.size("points") > 0, F.col("points")).alias("key_points"))
    return t, e.join(told, "episode_id", "left"), p


def schema(spark, d):
    return ck.check_schema(*_told(spark, d))


def length(spark, d):
    t, e, _ = _args(spark, d)
    return ck.measure_length(t, e).drop("minutes", "format").withColumn("ratio", F.round("ratio", 6))


def lexicon(spark, d):
    return ck.lexicon(tb.papers(spark, d))


def run_all(spark, d):
    return ck.run_checks(*_told(spark, d)).drop("first_offence")


def compliance(spark, d):
    return ck.compliance(ck.run_checks(*_told(spark, d)))


def mutated(spark, d):
    return ck.mutate(tb.turns(spark, d)).select("episode_id", "kind", "turn_idx", "speaker", F.md5("text").alias("text_md5"))


def matrix(spark, d):
    return ck.detection_rate(ck.detection(tb.turns(spark, d), tb.episodes(spark, d), tb.papers(spark, d)))


def append(spark, d):
    """Each conversation's opening pair, continued by the rest of it."""
    t = tb.turns(spark, d)
    return ck.append_turns(t.filter("turn_idx < 2"), t.filter("turn_idx >= 2")).select(
        "episode_id", "turn_idx", "speaker", F.md5("text").alias("text_md5"))


def revisions(spark, d):
    """Each turn offered the wording of the turn after it; a narrator's is blank."""
    t = tb.turns(spark, d)
    revs = t.select("episode_id", (F.col("turn_idx") - 1).alias("turn_idx"), F.lit(1).alias("rev_no"),
                    F.when(F.col("speaker") == "narrator", " ").otherwise(F.col("text")).alias("text"))
    return ck.apply_revisions(t, revs).withColumn("text", F.md5("text"))


def notes(spark, d):
    """Ten judged claims to an episode, one to a turn."""
    v = tb.verdicts(spark, d)
    claims = v.select(F.floor(F.col("claim_id") / 10).alias("episode_id"), (F.col("claim_id") % 10).alias("turn_idx"),
                      F.col("claim_id").alias("claim_no"), F.col("claim_id").cast("string").alias("claim"), "verdict", "specific")
    return ck.revision_notes(claims, tb.turns(spark, d))


QUERIES = {
    "c1_schema": schema, "c2_alternation": _check(ck.check_alternation),
    "c3_turn_count": _check(ck.check_turn_count), "c4_length": length, "c4_word_count": _check(ck.check_word_count),
    "c5_show_name": _check(ck.check_show_name), "c6_honorifics": _check(ck.check_honorifics),
    "c7_expertise": _check(ck.check_expertise), "c8_impersonation": _check(ck.check_impersonation),
    "c9_direct_address": _check(ck.check_direct_address), "c10_lexicon": lexicon,
    "c11_proper_nouns": _check(ck.check_proper_nouns), "c12_numbers": _check(ck.check_numbers),
    "c13_compliance": compliance, "c14_mutate": mutated, "c14_detection_rate": matrix, "c16_append_turns": append,
    "c17_apply_revisions": revisions, "c18_revision_notes": notes, "x3_run_checks": run_all,
}

EPISODES = "episodes AS (SELECT DISTINCT conv_id AS episode_id, conv_id AS paper_id, conv_id % 5 + 1 AS minutes FROM conversations)"


def _say(kind):
    return "'" + ck.SAID[kind].replace("'", "''") + "'"


_NUMBER = "\\b\\d[\\d,]*(?:\\.\\d+)?\\b"
_KINDS = ", ".join(f"'{k}'" for k in KINDS)
#: The faults on table ``said``, each row with its ``kind``.
_FACTS = f"""SELECT episode_id, max(turn_idx) AS last, coalesce(min(turn_idx) FILTER (regexp_matches(text, '{_NUMBER}')), 0) AS num, min_by(speaker, turn_idx) AS opener FROM said GROUP BY 1"""
_SPEAKER = "CASE WHEN kind = 'break-alternation' AND turn_idx = 1 THEN opener ELSE speaker END"
_TEXT = f"""CASE WHEN kind = 'swap-number' AND turn_idx = num THEN CASE WHEN regexp_matches(text, '{_NUMBER}') THEN regexp_replace(text, '{_NUMBER}', '8317') ELSE text || {_say('swap-number')} END
        WHEN kind = 'fabricate-entity' AND turn_idx = least(1, last) THEN text || {_say('fabricate-entity')} WHEN kind = 'claim-authorship' AND turn_idx = least(1, last) THEN text || {_say('claim-authorship')}
        WHEN kind = 'add-honorific' AND turn_idx = 0 THEN text || {_say('add-honorific')} WHEN kind = 'claim-expertise' AND turn_idx = 0 THEN text || {_say('claim-expertise')}
        WHEN kind = 'invent-show-name' AND turn_idx = 0 THEN {_say('invent-show-name')} || text WHEN kind = 'address-by-name' AND turn_idx = last THEN {_say('address-by-name')} || text
        ELSE text END"""
_SAID = sq.TURNS.replace("turns AS", "said AS", 1)
_FAULTY = f"""{_SAID}, facts AS ({_FACTS}),
    marked AS (SELECT *, list_extract([{_KINDS}], CAST(episode_id % {len(KINDS)} AS INTEGER) + 1) AS kind FROM said JOIN facts USING (episode_id)),
    turns AS (SELECT episode_id, turn_idx, CASE WHEN episode_id % 7 = 3 AND turn_idx = 1 THEN 'announcer' ELSE {_SPEAKER} END AS speaker, {_TEXT} AS text
      FROM marked WHERE kind <> 'truncate-dialogue' OR turn_idx < 3)"""
BASE = f"{_FAULTY}, {EPISODES}"
FORMATS = """formats AS (SELECT episode_id, count(*) AS turns, count(*) FILTER (speaker = 'narrator') AS narrated FROM turns GROUP BY 1)"""


def _result(ctes, check, severity):
    """``off`` holds episode_id, a, b, what."""
    return f"""{ctes}
        SELECT e.episode_id, '{check}' AS check_id, count(o.what) = 0 AS passed, '{severity}' AS severity, count(o.what) AS offences,
               first(o.what ORDER BY a, b) AS first_offence
        FROM episodes e LEFT JOIN off o USING (episode_id) GROUP BY 1"""


def _regex(check, pattern, severity="error", group=0, where="true", col="text"):
    return _result(f"""WITH {BASE}, off AS (SELECT * FROM (SELECT episode_id, turn_idx AS a, unnest(range(len(h))) AS b, unnest(h) AS what FROM (
        SELECT *, regexp_extract_all({col}, '{pattern}', {group}) AS h FROM turns)) WHERE {where})""", check, severity)


LEX = """lexicon AS (SELECT DISTINCT paper_id, word FROM (
    SELECT paper_id, unnest(w) AS word FROM (SELECT doc_id AS paper_id, regexp_extract_all(lower(text), '[a-z0-9''’-]+')
        || regexp_extract_all(regexp_replace(lower(text), '-[ \\t]*\\r?\\n[ \\t]*', '', 'g'), '[a-z0-9''’-]+')
        || regexp_extract_all(regexp_replace(lower(text), '-[ \\t]*\\r?\\n[ \\t]*', '-', 'g'), '[a-z0-9''’-]+') AS w FROM documents)
    UNION ALL
    SELECT paper_id, unnest(string_split(word, '-')) FROM (SELECT paper_id, unnest(w) AS word FROM (SELECT doc_id AS paper_id,
        regexp_extract_all(lower(text), '[a-z0-9''’-]+')
        || regexp_extract_all(regexp_replace(lower(text), '-[ \\t]*\\r?\\n[ \\t]*', '', 'g'), '[a-z0-9''’-]+')
        || regexp_extract_all(regexp_replace(lower(text), '-[ \\t]*\\r?\\n[ \\t]*', '-', 'g'), '[a-z0-9''’-]+') AS w FROM documents))) WHERE word <> '')"""

NOUNS = f"""
sent AS (SELECT episode_id, turn_idx, unnest(range(len(s))) AS si, unnest(s) AS s FROM (SELECT *, {sq.after_mark('text')} AS s FROM turns)),
tok AS (SELECT episode_id, turn_idx, si, unnest(range(len(w))) AS wi, unnest(w) AS tok FROM (SELECT *, string_split_regex({sq.strip('s')}, '\\s+') AS w FROM sent)),
noun AS (SELECT *, lower(word) AS lower, regexp_replace(lower(word), '[''’]s$|s$', '') AS stem FROM (
    SELECT *, regexp_replace(tok, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g') AS word FROM tok WHERE wi > 0)
  WHERE regexp_matches(word, '^[A-Z][a-zA-Z''’-]{{2,}}$') AND lower(word) NOT IN {sq.words(lx.PROPER_NOUN_ALLOW)} AND lower(word) <> 'paperline'),
once AS (SELECT episode_id, word, lower, stem, min(turn_idx * 1000000 + si * 1000 + wi) AS a FROM noun GROUP BY 1, 2, 3, 4),
"""

_NUM = "\\d[\\d,]*(?:\\.\\d+)?"
_B = "(?:^|[^A-Za-z0-9_])"

_AUTHOR = " || ".join(f"regexp_extract_all(text, '(?i){_B}({p})', 1)" for p in (
    "we\\s+(?:found|showed|built|designed|proposed?|developed|implemented|evaluated|introduced?)\\b",
    "our\\s+(?:approach|methods?|experiments|system|paper|architecture|design|results|work|model)\\b", "in our\\s+\\w+"))

ORACLE = {
    "c1_schema": _result(f"WITH {BASE}, off AS (SELECT episode_id, turn_idx AS a, 0 AS b, coalesce(speaker, '') AS what FROM turns WHERE coalesce(speaker NOT IN ('host', 'guest', 'narrator'), true) OR text IS NULL"
                         " UNION ALL SELECT episode_id, -2, 0, 'summary' FROM episodes WHERE episode_id NOT IN (SELECT episode_id FROM turns WHERE speaker = 'narrator' AND text IS NOT NULL)"
                         " UNION ALL SELECT episode_id, -1, 0, 'keyPoints' FROM episodes WHERE episode_id NOT IN (SELECT episode_id FROM turns WHERE speaker = 'guest' AND text IS NOT NULL))", "schema", "error"),
    "c2_alternation": _result(f"""WITH {BASE}, {FORMATS},
        p AS (SELECT *, lag(speaker) OVER (PARTITION BY episode_id ORDER BY turn_idx) AS before FROM turns),
        off AS (SELECT episode_id, -1 AS a, 0 AS b, 'mixed formats' AS what FROM formats WHERE narrated > 0 AND narrated < turns
          UNION ALL SELECT p.episode_id, turn_idx, 0, 'turns ' || (turn_idx - 1) || ' and ' || turn_idx FROM p JOIN formats USING (episode_id)
          WHERE narrated = 0 AND before = speaker)""", "alternation", "error"),
    "c3_turn_count": _result(f"""WITH {BASE}, {FORMATS},
        t AS (SELECT episode_id, turns, least(60, greatest(CASE WHEN narrated = turns THEN 4 ELSE 6 END,
              CAST(floor(minutes * CASE WHEN narrated = turns THEN 2 ELSE 3.5 END + 0.5) AS INTEGER))) AS target FROM episodes JOIN formats USING (episode_id)),
        off AS (SELECT episode_id, 0 AS a, 0 AS b, turns || ' of ' || target AS what FROM t WHERE turns < target)""", "turn-count", "warning"),
    "c4_length": f"""WITH {BASE}, {FORMATS},
        s AS (SELECT episode_id, (sum(length({sq.strip('text')})) + count(*) - 1)::BIGINT AS chars, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words FROM turns GROUP BY 1)
        SELECT episode_id, chars, words, turns, CAST(floor(minutes * 1100 / CASE WHEN narrated = turns THEN 7.0 ELSE 6.8 END + 0.5) AS BIGINT) AS word_target,
               round(chars / 1100 / minutes, 6) AS ratio, chars / 1100 / minutes < 0.85 AS short, chars / 1100 / minutes < 0.7 AS collapsed
        FROM s JOIN formats USING (episode_id) JOIN episodes USING (episode_id)""",
    "c4_word_count": _result(f"""WITH {BASE},
        s AS (SELECT episode_id, sum(length({sq.strip('text')})) + count(*) - 1 AS chars, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words FROM turns GROUP BY 1),
        off AS (SELECT episode_id, 0 AS a, 0 AS b, words || ' words' AS what FROM s JOIN episodes USING (episode_id) WHERE chars / 1100 / minutes < 0.7)""", "word-count", "warning"),
    "c5_show_name": _regex("show-name", _B + "(?i:welcome(?:\\s+back)?\\s+to|listening\\s+to|here\\s+on|this\\s+is)\\s+(?i:(?:(?:this|another|our|the)\\s+)?(?:episode\\s+of\\s+)?)([A-Z][\\w''’-]*(?:\\s+[A-Z][\\w''’-]*){0,3})", group=1, where="NOT starts_with(lower(what), 'paperline')"),
    "c6_honorifics": _result(f"""WITH {BASE}, hit AS (SELECT episode_id, turn_idx AS a, unnest(range(len(h))) AS b, trim(unnest(h)) AS what FROM (
        SELECT *, regexp_extract_all(text, '{_B}((?:Dr\\.|Prof\\.|Professor|PhD|Ph\\.D\\.)\\s*[A-Z]?)', 1) AS h FROM turns)),
        off AS (SELECT hit.* FROM hit JOIN episodes USING (episode_id) LEFT JOIN documents d ON d.doc_id = paper_id WHERE NOT coalesce(contains(lower(text), lower(what)), false))""", "honorifics", "error"),
    "c7_expertise": _regex("claimed-expertise", "(?i)" + _B + "((?:expert|specialist|authority|researcher)\\s+(?:in|on)\\s+[a-z])", group=1),
    "c8_impersonation": _result(f"""WITH {BASE}, hit AS (SELECT episode_id, turn_idx AS a, unnest(range(len(h))) AS b, unnest(h) AS what FROM (SELECT *, {_AUTHOR} AS h FROM turns)),
        off AS (SELECT episode_id, a, min(b) AS b, what FROM hit GROUP BY 1, 2, 4)""", "author-impersonation", "error"),
    "c9_direct_address": _result(f"""WITH {BASE}, {LEX}, hit AS (SELECT episode_id, turn_idx AS a, unnest(range(len(h))) AS b, unnest(h) AS what FROM (
        SELECT *, regexp_extract_all(text, '{_B}(?i:thanks|thank you|so|well|right|okay|ok|yes|and|but|now)\\s*,\\s*([A-Z][\\w''’-]*)', 1) AS h FROM turns)),
        off AS (SELECT hit.* FROM hit JOIN episodes e USING (episode_id) WHERE NOT EXISTS (SELECT 1 FROM lexicon l WHERE l.paper_id = e.paper_id AND l.word = lower(what)))""", "no-names", "error"),
    "c10_lexicon": f"WITH {LEX} SELECT paper_id, word FROM lexicon",
    "c11_proper_nouns": _result(f"""WITH {BASE}, {LEX}, {NOUNS}
        off AS (SELECT episode_id, a, 0 AS b, o.word AS what FROM once o JOIN episodes e USING (episode_id)
          WHERE NOT EXISTS (SELECT 1 FROM lexicon l WHERE l.paper_id = e.paper_id AND l.word IN (o.lower, o.stem)))""", "proper-nouns", "warning"),
    "c12_numbers": _result(f"""WITH {BASE},
        pn AS (SELECT DISTINCT doc_id AS paper_id, CAST(replace(unnest(regexp_extract_all(text, '{_NUM}')), ',', '') AS DOUBLE) AS p FROM documents),
        tn AS (SELECT episode_id, turn_idx AS a, unnest(range(len(h))) AS b, replace(unnest(h), ',', '') AS what FROM (
          SELECT *, regexp_extract_all(text, '{_B}({_NUM})(?:[^A-Za-z0-9_]|$)', 1) AS h FROM turns)),
        once AS (SELECT episode_id, what, min(a * 1000 + b) AS a, 0 AS b FROM tn WHERE CAST(what AS DOUBLE) > 3 GROUP BY 1, 2),
        off AS (SELECT o.* FROM once o JOIN episodes e USING (episode_id) WHERE NOT EXISTS (SELECT 1 FROM pn WHERE pn.paper_id = e.paper_id AND
          (p = CAST(what AS DOUBLE) OR floor(p * pow(10, length(regexp_extract(what, '\\.(\\d+)$', 1))) + 0.5) / pow(10, length(regexp_extract(what, '\\.(\\d+)$', 1))) = CAST(what AS DOUBLE))))""",
        "numbers", "warning"),
    "c16_append_turns": f"""WITH {sq.TURNS},
        base AS (SELECT * FROM turns WHERE turn_idx < 2),
        lst AS (SELECT episode_id, max_by(speaker, turn_idx) AS last, max(turn_idx) + 1 AS n FROM base GROUP BY 1),
        ext AS (SELECT t.*, last, n, lag(speaker) OVER (PARTITION BY t.episode_id ORDER BY turn_idx) AS before FROM turns t JOIN lst USING (episode_id)
                WHERE turn_idx >= 2 AND speaker IN ('host', 'guest') AND {sq.strip('text')} <> ''),
        kept AS (SELECT episode_id, n + row_number() OVER (PARTITION BY episode_id ORDER BY turn_idx) - 1 AS turn_idx, speaker, text FROM ext
                 WHERE CASE WHEN before IS NULL THEN speaker = CASE WHEN last = 'host' THEN 'guest' ELSE 'host' END ELSE before <> speaker END)
        SELECT episode_id, turn_idx, speaker, md5(text) AS text_md5 FROM (SELECT * FROM base UNION ALL SELECT * FROM kept)""",
    "c17_apply_revisions": f"""WITH {sq.TURNS}, r AS (SELECT episode_id, turn_idx - 1 AS turn_idx, {sq.strip('text')} AS new FROM turns WHERE speaker <> 'narrator' AND {sq.strip('text')} <> '')
        SELECT t.episode_id, t.turn_idx, speaker, md5(coalesce(new, text)) AS text, coalesce(new <> text, false) AS revised FROM turns t LEFT JOIN r USING (episode_id, turn_idx)""",
    "c18_revision_notes": f"""WITH {sq.TURNS}, {sq.VERDICTS},
        f AS (SELECT claim_id // 10 AS episode_id, claim_id % 10 AS turn_idx, claim_id, verdict FROM verdicts WHERE verdict = 'contradicted' OR (verdict = 'unsupported' AND specific))
        SELECT episode_id, turn_idx, string_agg(CASE verdict WHEN 'contradicted' THEN 'CONTRADICTS THE PAPER' ELSE 'NOT IN THE PAPER' END || ': ' || claim_id, chr(10) ORDER BY claim_id) AS note,
               count(*) AS claims FROM f SEMI JOIN turns USING (episode_id, turn_idx) GROUP BY 1, 2""",
}

_ALL = ["c1_schema", "c2_alternation", "c3_turn_count", "c4_word_count", "c5_show_name", "c6_honorifics", "c7_expertise",
        "c8_impersonation", "c9_direct_address", "c11_proper_nouns", "c12_numbers"]
_UNION = " UNION ALL ".join(f"SELECT episode_id, check_id, passed, severity, offences FROM ({ORACLE[n]})" for n in _ALL)
ORACLE["x3_run_checks"] = _UNION
ORACLE["c13_compliance"] = f"""SELECT episode_id, count(*) FILTER (NOT passed AND severity = 'error') AS errors,
    count(*) FILTER (NOT passed AND severity = 'warning') AS warnings, round(avg(CAST(passed AS INTEGER)), 6) AS compliance FROM ({_UNION}) GROUP BY 1"""


ORACLE["c14_mutate"] = f"""WITH {_SAID}, facts AS ({_FACTS}), marked AS (SELECT *, unnest([{_KINDS}]) AS kind FROM said JOIN facts USING (episode_id))
    SELECT episode_id, kind, turn_idx, {_SPEAKER} AS speaker, md5({_TEXT}) AS text_md5 FROM marked WHERE kind <> 'truncate-dialogue' OR turn_idx < 3"""
# Every episode once per fault: ten times its id and the fault's place, so that the checks' own SQL runs on all of them.
_EVERY = f"""{_SAID}, facts AS ({_FACTS}),
    marked AS (SELECT *, list_extract([{_KINDS}], CAST(kn + 1 AS INTEGER)) AS kind FROM (SELECT *, unnest(range({len(KINDS)})) AS kn FROM said JOIN facts USING (episode_id))),
    turns AS (SELECT episode_id * {len(KINDS)} + kn AS episode_id, turn_idx, {_SPEAKER} AS speaker, {_TEXT} AS text FROM marked WHERE kind <> 'truncate-dialogue' OR turn_idx < 3),
    episodes AS (SELECT DISTINCT conv_id * {len(KINDS)} + kn AS episode_id, conv_id AS paper_id, conv_id % 5 + 1 AS minutes FROM conversations, range({len(KINDS)}) AS k(kn))"""
_BOOK = ", ".join(f"({k + 1}, '{kind}', '{check}')" for k, (kind, check) in enumerate(ck.MUTATIONS))
ORACLE["c14_detection_rate"] = f"""WITH r AS ({_UNION.replace(BASE, _EVERY)}), book(kn, kind, check_id) AS (VALUES {_BOOK}),
    d AS (SELECT kind, r.check_id, CAST(c.passed AS INTEGER) AS clean, 1 - CAST(r.passed AS INTEGER) AS detected FROM r
      JOIN book ON r.episode_id % {len(KINDS)} = kn AND r.check_id = book.check_id
      JOIN r AS c ON c.episode_id = r.episode_id - r.episode_id % {len(KINDS)} AND c.check_id = r.check_id)
    SELECT kind, check_id, CAST(sum(clean) AS BIGINT) AS clean_controls, CAST(sum(clean * detected) AS BIGINT) AS caught, round(avg(detected) FILTER (clean = 1), 6) AS rate FROM d GROUP BY 1, 2"""
