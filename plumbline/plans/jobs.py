"""Registered job-event queries and their SQL."""

from pyspark.sql import functions as F

from plumbline.operators import jobs as jb
from plumbline.plans import sqltext as sq
from plumbline.sources import tables as tb


def _costed(spark, d):
    """Events with the cost fields they report; an event reports some or none."""
    e = tb.job_events(spark, d)
    return e.withColumn("usd", F.when(F.col("stage") != "queued", F.col("value"))).withColumn(
        "input_tokens", F.when(F.col("stage") == "scripting", F.col("percent")))


def state(spark, d):
    return jb.job_state(_costed(spark, d)).select("job_id", "stage", "percent", "input_tokens", F.round("usd", 6).alias("usd"), "events")


def percent(spark, d):
    e = tb.job_events(spark, d)
    flag = lambda n: F.col("percent") % n == 0
    return e.select("event_id", jb.overall_percent(F.col("stage"), F.col("percent") / 80, flag(2), flag(3), flag(5)).alias("overall"))


def feed(spark, d):
    return jb.progress_feed(tb.job_events(spark, d)).select("job_id", "event_id")


def evicted(spark, d):
    """Jobs created in the twelve hours before noon of the first day or since."""
    return jb.evict(tb.job_events(spark, d), F.lit("2024-01-01 12:00:00"), 12 * 3600).select("job_id")


def gate(spark, d):
    e = tb.table(spark, d, "events").filter(F.col("event_type").isin("click", "view")).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "view").alias("release"))
    return jb.admit(e, 1, 2)


def _stamp(df, c):
    return df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm"))


def windows(spark, d):
    return _stamp(jb.event_windows(tb.job_events(spark, d), "1 day"), "window_start")


def sliding(spark, d):
    return _stamp(jb.event_windows(tb.job_events(spark, d), "1 day", "12 hours"), "window_start")


def sessions(spark, d):
    return jb.job_sessions(tb.job_events(spark, d), "6 hours").withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


def durations(spark, d):
    return jb.stage_durations(tb.job_events(spark, d))


def failed(spark, d):
    return jb.failed_stage(tb.job_events(spark, d))


def monotone(spark, d):
    return jb.check_monotone(tb.job_events(spark, d))


def assembled(spark, d):
    """Every turn as the deltas of its words."""
    t = tb.turns(spark, d)
    deltas = t.select("episode_id", "turn_idx", F.posexplode(F.split("text", "(?<= )")).alias("seq", "content"))
    return jb.assemble(deltas, "episode_id", "turn_idx").withColumn("content", F.md5("content"))


def visible(spark, d):
    """What a reader sees of each turn when four fifths of its JSON has come."""
    whole = F.to_json(F.struct(F.col("speaker").alias("kind"), F.col("text").alias("answer")))
    t = tb.turns(spark, d).withColumn("json", whole)
    part = F.substring(F.col("json"), F.lit(1), F.floor(F.length("json") * 0.8).cast("int"))
    return t.select("episode_id", "turn_idx", F.length(jb.visible_field(part, "answer")).alias("chars"))


QUERIES = {
    "r1_job_state": state, "r2_overall_percent": percent, "r3_progress_feed": feed, "r4_evict": evicted, "r5_admit": gate,
    "r6_event_windows": windows, "r6_sliding_windows": sliding, "r6_sessions": sessions, "r7_stage_durations": durations,
    "r7_failed_stage": failed, "r8_monotone": monotone, "r9_assemble": assembled, "r9_visible_field": visible,
}

_W = "[('queued', 0, 0), ('parsing', 1, 3), ('scripting', 2, 34), ('reviewing', 3, 28), ('synthesizing', 4, 24), ('verifying', 5, 11), ('done', 6, 0)]"

ORACLE = {
    "r1_job_state": f"""WITH {sq.JOB_EVENTS} SELECT job_id, max_by(stage, event_id) AS stage, max_by(percent, event_id) AS percent,
        max_by(percent, event_id) FILTER (stage = 'scripting') AS input_tokens, round(max_by(value, event_id) FILTER (stage <> 'queued'), 6) AS usd, count(*) AS events FROM job_events GROUP BY 1""",
    "r2_overall_percent": f"""WITH {sq.JOB_EVENTS}, w(s, i, w) AS (VALUES ('queued', 0, 0), ('parsing', 1, 3), ('scripting', 2, 34), ('reviewing', 3, 28), ('synthesizing', 4, 24), ('verifying', 5, 11), ('done', 6, 0)),
        x AS (SELECT event_id, stage, percent, o.i AS ev_at, o.w AS own, w.i, CASE WHEN w.s = 'reviewing' AND percent % 2 <> 0 THEN 0 WHEN w.s = 'synthesizing' AND percent % 3 <> 0 THEN 0
              WHEN w.s = 'verifying' AND (percent % 3 <> 0 OR percent % 5 <> 0) THEN 0 ELSE w.w END AS w FROM job_events LEFT JOIN w o ON o.s = stage CROSS JOIN w)
        SELECT event_id, CASE WHEN any_value(stage) IN ('done', 'error') THEN 100 ELSE CAST(floor((coalesce(sum(w) FILTER (i < ev_at), 0) + any_value(own) * least(1.0, any_value(percent) / 80)) / sum(w) * 100 + 0.5) AS INTEGER) END AS overall
        FROM x GROUP BY 1""",
    "r3_progress_feed": f"""WITH {sq.JOB_EVENTS} SELECT job_id, event_id FROM (SELECT *, coalesce(sum(CASE WHEN stage IN ('done', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ev_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM job_events) WHERE ended = 0""",
    "r4_evict": f"WITH {sq.JOB_EVENTS} SELECT job_id FROM job_events GROUP BY 1 HAVING min(ev_at) >= TIMESTAMP '2024-01-01 00:00:00'",
    "r6_event_windows": f"WITH {sq.JOB_EVENTS} SELECT strftime(date_trunc('day', ev_at), '%Y-%m-%d %H:%M') AS window_start, stage, count(*) AS n FROM job_events GROUP BY 1, 2",
    "r6_sliding_windows": f"""WITH {sq.JOB_EVENTS}, w AS (SELECT stage, unnest([time_bucket(INTERVAL 12 HOURS, ev_at, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 12 HOURS, ev_at, TIMESTAMP '2024-01-01') - INTERVAL 12 HOURS]) AS s FROM job_events)
        SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, stage, count(*) AS n FROM w GROUP BY 1, 2""",
    "r6_sessions": f"""WITH {sq.JOB_EVENTS}, g AS (SELECT *, CASE WHEN ev_at - lag(ev_at) OVER (PARTITION BY job_id ORDER BY ev_at) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM job_events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ev_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT job_id, strftime(min(ev_at), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY job_id, k""",
    "r7_stage_durations": f"""WITH {sq.JOB_EVENTS}, n AS (SELECT *, lead(ev_at) OVER (PARTITION BY job_id ORDER BY ev_at, event_id) AS until FROM job_events)
        SELECT job_id, event_id, stage, round((epoch_us(until) - epoch_us(ev_at)) / 1e6, 3) AS seconds FROM n WHERE until IS NOT NULL""",
    "r7_failed_stage": f"""WITH {sq.JOB_EVENTS}, e AS (SELECT job_id, min(event_id) AS e FROM job_events WHERE stage = 'error' GROUP BY 1)
        SELECT e.job_id, max_by(stage, event_id) AS failed_stage FROM e LEFT JOIN job_events j ON j.job_id = e.job_id AND event_id < e GROUP BY 1""",
    "r8_monotone": f"WITH {sq.JOB_EVENTS} SELECT job_id, event_id, before, percent FROM (SELECT *, lag(percent) OVER (PARTITION BY job_id ORDER BY ev_at, event_id) AS before FROM job_events) WHERE percent < before",
    "r9_assemble": f"WITH {sq.TURNS} SELECT episode_id, turn_idx, md5(text) AS content FROM turns",
}
