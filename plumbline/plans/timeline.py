"""Registered timeline queries and their SQL."""

from pyspark.sql import functions as F

from plumbline.functions import segments as sg
from plumbline.operators import timeline as tl
from plumbline.plans import sqltext as sq
from plumbline.plans.checks import EPISODES, _result
from plumbline.sources import tables as tb

RATE = 1.0


def _pairs(spark, d):
    """Each turn as the script, the turn after it as what was heard."""
    t = tb.turns(spark, d)
    heard = t.select("episode_id", (F.col("turn_idx") - 1).alias("turn_idx"), F.col("text").alias("heard"))
    return t.join(heard, ["episode_id", "turn_idx"], "left").select(
        "episode_id", "turn_idx", F.col("text").alias("script"), F.coalesce("heard", F.lit("")).alias("heard"))


def _timings(spark, d):
    return tl.timeline(tl.spoken_chunks(tb.turns(spark, d)))


def _audio(spark, d):
    """The files of odd episodes were joined without the gaps their timelines count."""
    spoken = F.round(F.sum(F.col("end_ms") - F.col("start_ms")), 6)
    return _timings(spark, d).groupBy("episode_id").agg(
        F.when(F.col("episode_id") % 2 == 1, spoken).otherwise(F.max("end_ms")).alias("file_ms"), F.max("end_ms").alias("total_ms"))


def _frames(spark, d):
    e = tb.table(spark, d, "events").select(F.col("user_id").alias("episode_id"), "event_id", F.floor(F.col("value") * 100).alias("sample"))
    n = sg.running_sum(e, ["episode_id"], ["event_id"], sg.segment_of(F.col("event_id")), F.lit(1), "frame")
    return n.select("episode_id", F.col("frame").cast("bigint").alias("frame"), "sample")


def _pitch(spark, d):
    """Event values as frame pitch; one event type is one speaker."""
    e = tb.table(spark, d, "events").select(
        F.floor(F.dayofmonth("ts") / 10).cast("bigint").alias("episode_id"), F.col("event_type").alias("speaker"),
        (F.col("user_id") % 10).alias("turn_idx"), "event_id", F.when(F.col("value") > 1, F.col("value") + 60 + 8 * (F.col("user_id") % 10)).alias("hz"))
    keys = ["episode_id", "speaker", "turn_idx"]
    n = sg.running_sum(e, keys, ["event_id"], sg.segment_of(F.col("event_id")), F.lit(1), "frame")
    return n.select(*keys, F.col("frame").cast("bigint").alias("frame"), "hz")


def _voices(spark, d):
    """Every episode's own events as the pitch frames of its first three turns, one voice; every fifth episode's third turn is higher."""
    e = tb.table(spark, d, "events").select(F.col("user_id").alias("episode_id"), "event_id", "value")
    n = sg.running_sum(e, ["episode_id"], ["event_id"], sg.segment_of(F.col("event_id")), F.lit(1), "n")
    turn = F.col("n") % 3
    hz = (120 + F.col("value") / 50) * F.when((F.col("episode_id") % 5 == 4) & (turn == 2), 1.5).otherwise(1.0)
    return n.select("episode_id", F.lit("host").alias("speaker"), turn.cast("int").alias("turn_idx"), F.floor(F.col("n") / 3).cast("bigint").alias("frame"), hz.alias("hz"))


def norm_words(spark, d):
    return tl.norm_words(tb.turns(spark, d), "episode_id", "turn_idx")


def recall(spark, d):
    p = _pairs(spark, d).withColumnRenamed("script", "expected").withColumnRenamed("heard", "actual")
    return tl.word_recall(p, "episode_id", "turn_idx").withColumn("recall", F.round("recall", 6))


def _fidelity(spark, d):
    return tl.turn_fidelity(_pairs(spark, d))


def fidelity(spark, d):
    return _fidelity(spark, d).withColumn("recall", F.round("recall", 6)).withColumn("missing", F.array_join("missing", " "))


def verdict(spark, d):
    return tl.fidelity_check(_fidelity(spark, d))


def episode(spark, d):
    return tl.episode_recall(_fidelity(spark, d)).withColumn("recall", F.round("recall", 6))


def clips(spark, d):
    c = tl.clip_plan(_timings(spark, d))
    return c.select("episode_id", "turn_idx", "clip", F.round("from_ms", 3).alias("from_ms"), F.round("to_ms", 3).alias("to_ms"))


def timings(spark, d):
    return _timings(spark, d).withColumn("start_ms", F.round("start_ms", 3)).withColumn("end_ms", F.round("end_ms", 3))


def voiced(spark, d):
    """Blank turns have no chunk, so no timing."""
    return tl.check_turns_voiced(tb.turns(spark, d), _timings(spark, d), tb.episodes(spark, d))


def _early(spark, d):
    """A guest that comes in a second early."""
    t = _timings(spark, d)
    return t.withColumn("start_ms", F.when(F.col("speaker") == "guest", F.greatest(F.lit(0.0), F.col("start_ms") - 1000)).otherwise(F.col("start_ms")))


def order(spark, d):
    return tl.check_timeline_order(_early(spark, d), tb.episodes(spark, d))


def matches(spark, d):
    return tl.check_timeline_matches(_timings(spark, d), _audio(spark, d), tb.episodes(spark, d))


def silent(spark, d):
    return tl.check_silent_turns(tb.turns(spark, d), _timings(spark, d), _frames(spark, d), RATE, tb.episodes(spark, d))


def rate(spark, d):
    return tl.check_speech_rate(tb.turns(spark, d), _timings(spark, d), tb.episodes(spark, d))


def duration(spark, d):
    return tl.check_duration(_audio(spark, d), tb.episodes(spark, d))


def floors(spark, d):
    return tl.pitch_floor(_pitch(spark, d))


def voice(spark, d):
    return tl.off_voice(tl.pitch_floor(_pitch(spark, d))).withColumn("off", F.round("off", 6))


def _all(spark, d):
    return (tb.turns(spark, d), _timings(spark, d), _audio(spark, d), _frames(spark, d), _voices(spark, d), RATE, tb.episodes(spark, d))


def compliance(spark, d):
    from plumbline.operators.checks import compliance as share

    return share(tl.run_audio_checks(*_all(spark, d)))


def matrix(spark, d):
    from plumbline.operators.checks import detection_rate

    return detection_rate(tl.detection(*_all(spark, d)))


def active(spark, d):
    points = tb.table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("episode_id"), (F.get_json_object("props", "$.k").cast("double") * 1000).alias("t_ms"))
    return tl.active_turn(points, _timings(spark, d)).select("event_id", "turn_idx")


def sliced(spark, d):
    """The second turn of each conversation."""
    second = _timings(spark, d).filter("turn_idx = 1").select("episode_id", "start_ms", "end_ms")
    return tl.slice_frames(_frames(spark, d), second, RATE)


def formats(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    seg = tb.table(spark, d, "events").select(
        F.col("user_id").alias("episode_id"), F.col("event_id").alias("segment"), F.when(k >= 95, 22050).otherwise(24000).alias("rate"),
        F.lit(1).alias("channels"), F.lit(16).alias("bits"))
    return tl.check_formats(seg)


QUERIES = {
    "a1_norm_words": norm_words, "a2_word_recall": recall, "a3_turn_fidelity": fidelity, "a4_fidelity_check": verdict,
    "a5_episode_recall": episode, "a6_clip_plan": clips, "a7_timeline": timings, "a8_turns_voiced": voiced, "a9_timeline_order": order,
    "a10_timeline_matches": matches, "a11_silent_turns": silent, "a12_speech_rate": rate, "a13_duration": duration,
    "a14_pitch_floor": floors, "a15_voice": voice, "a16_audio_compliance": compliance, "a17_detection_rate": matrix,
    "a18_active_turn": active, "a19_slice_frames": sliced, "a20_formats": formats,
}

_HW = "[w for w in string_split_regex(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\s''-]', ' ', 'g'), '\\s+') if w <> '']"


def hw(c):
    return _HW.format(c=c)


_PAIRS = f"""{sq.TURNS}, pairs AS (SELECT episode_id, turn_idx, {hw('text')} AS script, coalesce({hw("coalesce(lead(text) OVER (PARTITION BY episode_id ORDER BY turn_idx), '')")}, []) AS heard FROM turns)"""
_FID = f"""{_PAIRS},
s0 AS (SELECT episode_id, turn_idx, unnest(range(len(script))) AS pos, unnest(script) AS word FROM pairs),
s AS (SELECT *, row_number() OVER (PARTITION BY episode_id, turn_idx, word ORDER BY pos) AS k FROM s0),
h AS (SELECT episode_id, turn_idx, word, count(*) AS n FROM (SELECT episode_id, turn_idx, unnest(heard) AS word FROM pairs) GROUP BY 1, 2, 3),
m AS (SELECT s.*, k > coalesce(n, 0) AS gone FROM s LEFT JOIN h USING (episode_id, turn_idx, word)),
f AS (SELECT episode_id, turn_idx, count(*) AS words, count(*) FILTER (NOT gone) AS found, list(word ORDER BY pos) FILTER (gone) AS lost FROM m GROUP BY 1, 2),
fid AS (SELECT p.episode_id, p.turn_idx, coalesce(words, 0) AS words, coalesce(found / words, 1.0) AS recall, coalesce(array_to_string(lost[1:12], ' '), '') AS missing,
  coalesce(words, 0) >= 8 AND coalesce(found / words, 1.0) < 0.6 AS suspect FROM pairs p LEFT JOIN f USING (episode_id, turn_idx)),
ep AS (SELECT episode_id, sum(words)::BIGINT AS words, CASE WHEN sum(words) > 0 THEN sum(recall * words) / sum(words) ELSE 1.0 END AS recall, sum(suspect::INT)::BIGINT AS suspects FROM fid GROUP BY 1)"""
_TIME = f"""{sq.TURNS}, {EPISODES},
chunk AS (SELECT episode_id, turn_idx, speaker, unnest([length(x) * 60000 / 1100 for x in string_split(regexp_replace(text, '\\r\\n?|\\f', chr(10), 'g'), chr(10)) if regexp_matches(x, '\\S')]) AS ms FROM turns),
per AS (SELECT episode_id, turn_idx, speaker, sum(ms) AS ms, count(*) AS chunks FROM chunk GROUP BY 1, 2, 3),
timings AS (SELECT episode_id, turn_idx, speaker, round(s, 6) AS start_ms, round(s + ms, 6) AS end_ms, chunks FROM (
  SELECT *, coalesce(sum(ms + 350) OVER (PARTITION BY episode_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM per)),
audio AS (SELECT episode_id, CASE WHEN episode_id % 2 = 1 THEN sum(end_ms - start_ms) ELSE max(end_ms) END AS file_ms, max(end_ms) AS total_ms FROM timings GROUP BY 1)"""
_FRAMES = "frames AS (SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, CAST(floor(value * 100) AS BIGINT) AS sample FROM events)"
_PITCH = """pitch0 AS (SELECT day(ts) // 10 AS episode_id, event_type AS speaker, user_id % 10 AS turn_idx, CASE WHEN value > 1 THEN value + 60 + 8 * (user_id % 10) END AS hz,
  row_number() OVER w - 1 AS frame, count(*) OVER (PARTITION BY day(ts) // 10, event_type, user_id % 10) AS n FROM events WINDOW w AS (PARTITION BY day(ts) // 10, event_type, user_id % 10 ORDER BY event_id)),
floors AS (SELECT episode_id, speaker, turn_idx, count(hz) AS voiced, CASE WHEN count(hz) >= 20 THEN (list(hz ORDER BY hz) FILTER (hz IS NOT NULL))[CAST(floor(count(hz) * 0.1) AS BIGINT) + 1] END AS floor_hz FROM pitch0 GROUP BY 1, 2, 3)"""

ORACLE = {
    "a1_norm_words": f"WITH {sq.TURNS} SELECT episode_id, turn_idx, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT *, {hw('text')} AS w FROM turns)",
    "a2_word_recall": f"WITH {_FID} SELECT episode_id, turn_idx, words, round(recall, 6) AS recall FROM fid",
    "a3_turn_fidelity": f"WITH {_FID} SELECT episode_id, turn_idx, words, round(recall, 6) AS recall, missing, suspect FROM fid",
    "a4_fidelity_check": f"""WITH {_FID} SELECT episode_id, 'transcript-fidelity' AS check_id, suspects = 0 AND recall >= 0.85 AS passed,
        CASE WHEN suspects = 0 AND recall < 0.85 THEN 'warning' ELSE 'error' END AS severity, suspects FROM ep""",
    "a5_episode_recall": f"WITH {_FID} SELECT episode_id, words, round(recall, 6) AS recall, suspects FROM ep",
    "a6_clip_plan": f"""WITH {_TIME} SELECT episode_id, turn_idx, clip, round(start_ms + clip * 20000, 3) AS from_ms, round(least(start_ms + clip * 20000 + 20000, end_ms), 3) AS to_ms
        FROM (SELECT *, unnest(range(CAST(ceil((end_ms - start_ms) / 20000) AS BIGINT))) AS clip FROM timings WHERE end_ms > start_ms)""",
    "a7_timeline": f"WITH {_TIME} SELECT episode_id, turn_idx, speaker, round(start_ms, 3) AS start_ms, round(end_ms, 3) AS end_ms, chunks FROM timings",
    "a8_turns_voiced": _result(f"WITH {_TIME}, off AS (SELECT episode_id, turn_idx AS a, 0 AS b, 'no audio: ' || turn_idx AS what FROM turns ANTI JOIN timings USING (episode_id, turn_idx))", "turns-voiced", "error"),
    "a9_timeline_order": _result(f"""WITH {_TIME}, e AS (SELECT *, CASE WHEN speaker = 'guest' THEN greatest(0.0, start_ms - 1000) ELSE start_ms END AS s, lag(end_ms) OVER (PARTITION BY episode_id ORDER BY turn_idx) AS p FROM timings),
        off AS (SELECT episode_id, turn_idx AS a, 0 AS b, turn_idx::VARCHAR AS what FROM e WHERE s < p)""", "timeline-order", "error"),
    "a10_timeline_matches": _result(f"""WITH {_TIME}, l AS (SELECT episode_id, max_by(end_ms, turn_idx) AS last FROM timings GROUP BY 1),
        off AS (SELECT episode_id, 0 AS a, 0 AS b, CASE WHEN abs(file_ms - total_ms) > 50 THEN 'drift' ELSE 'past the end' END AS what FROM audio JOIN l USING (episode_id)
                WHERE abs(file_ms - total_ms) > 50 OR last > file_ms + 50)""", "timeline-matches-audio", "error"),
    "a11_silent_turns": _result(f"""WITH {_TIME}, {_FRAMES}, n AS (SELECT episode_id, count(*) AS total FROM frames GROUP BY 1),
        r AS (SELECT t.episode_id, turn_idx, greatest(0, floor(start_ms / 1000)) AS f0, least(coalesce(total, 0), ceil(end_ms / 1000)) AS f1 FROM timings t LEFT JOIN n USING (episode_id)),
        p AS (SELECT r.episode_id, r.turn_idx, sqrt(avg(sample * sample)) AS rms FROM r LEFT JOIN frames f ON f.episode_id = r.episode_id AND frame >= f0 AND frame < f1 GROUP BY 1, 2),
        off AS (SELECT episode_id, turn_idx AS a, 0 AS b, turn_idx::VARCHAR AS what FROM p SEMI JOIN (SELECT * FROM turns WHERE regexp_matches(text, '\\S')) USING (episode_id, turn_idx) WHERE coalesce(rms, 0) < 30)""", "silent-turns", "error"),
    "a12_speech_rate": _result(f"""WITH {_TIME}, r AS (SELECT t.episode_id, t.turn_idx, len(regexp_extract_all(text, '\\S+')) / ((end_ms - start_ms) / 60000) AS wpm FROM timings t JOIN turns USING (episode_id, turn_idx)
          WHERE len(regexp_extract_all(text, '\\S+')) >= 5 AND end_ms > start_ms),
        off AS (SELECT episode_id, turn_idx AS a, 0 AS b, turn_idx || CASE WHEN wpm > 260 THEN ': fast' ELSE ': slow' END AS what FROM r WHERE wpm > 260 OR wpm < 80)""", "speech-rate", "warning"),
    "a13_duration": _result(f"""WITH {_TIME}, off AS (SELECT episode_id, 0 AS a, 0 AS b, CAST(CAST(round(total_ms / 60000 / minutes * 100) AS INTEGER) AS VARCHAR) AS what FROM episodes JOIN audio USING (episode_id)
        WHERE total_ms / 60000 / minutes < 0.6 OR total_ms / 60000 / minutes > 1.6)""", "episode-duration", "warning"),
    "a14_pitch_floor": f"WITH {_PITCH} SELECT * FROM floors",
    "a15_voice": f"""WITH {_PITCH}, u AS (SELECT episode_id, speaker, count(*) AS n, (list(floor_hz ORDER BY floor_hz))[count(*) // 2 + 1] AS usual FROM floors WHERE floor_hz IS NOT NULL GROUP BY 1, 2)
        SELECT f.*, n, usual, round(floor_hz / usual - 1, 6) AS off FROM floors f JOIN u USING (episode_id, speaker) WHERE floor_hz IS NOT NULL AND n >= 3 AND abs(floor_hz / usual - 1) > 0.16""",
    "a18_active_turn": f"""WITH {_TIME}, p AS (SELECT event_id, user_id AS episode_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1000 AS t_ms FROM events)
        SELECT event_id, turn_idx FROM p ASOF LEFT JOIN timings t ON p.episode_id = t.episode_id AND p.t_ms >= t.start_ms""",
    "a19_slice_frames": f"WITH {_TIME}, {_FRAMES} SELECT f.episode_id, frame, sample FROM frames f JOIN timings t ON t.episode_id = f.episode_id AND turn_idx = 1 AND frame >= floor(start_ms / 1000) AND frame < floor(end_ms / 1000)",
    "a20_formats": """WITH s AS (SELECT user_id AS episode_id, event_id AS segment, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 95 THEN 22050 ELSE 24000 END AS rate FROM events),
        f AS (SELECT episode_id, min_by(rate, segment) AS expected_rate FROM s GROUP BY 1)
        SELECT episode_id, min(segment) AS segment, min_by(rate, segment) AS rate, any_value(expected_rate) AS expected_rate FROM s JOIN f USING (episode_id) WHERE rate <> expected_rate GROUP BY 1""",
}
