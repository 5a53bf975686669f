"""Job event logs: current state, progress, limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexicons as lx
from plumbline.functions import segments as sg

TTL_SECONDS = 3600
DAY_SECONDS = 86_400
COST_FIELDS = ["input_tokens", "output_tokens", "cached_tokens", "tts_calls", "usd"]


def terminal(stage: Column) -> Column:
    return stage.isin("done", "error")


def job_state(events: DataFrame, cost_fields: list[str] | None = None) -> DataFrame:
    """Latest stage and percent of each job; each cost field's last known value.

    ``events``: job_id, event_id, at, stage, percent, and any cost fields. All are
    aggregates with partial results, so one busy job does not need one task.
    """
    when = F.struct("at", "event_id")
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(c)
    fields = [c for c in (cost_fields or COST_FIELDS) if c in events.columns]
    return events.groupBy("job_id").agg(
        F.min("at").alias("created_at"), F.max("at").alias("updated_at"), latest("stage"), latest("percent"),
        *[latest(c) for c in fields], F.count("*").alias("events"))


def overall_percent(stage: Column, within: Column, revise: Column, audio: Column, verify: Column) -> Column:
    """Weighted progress over the stages a run passes through; 100 at either end.

    A stage the run does not have is weighed against the full list.
    """
    true = F.lit(True)
    on = {s: true for s, _ in lx.STAGE_WEIGHTS} | {"reviewing": revise, "synthesizing": audio, "verifying": audio & verify}
    listed = F.coalesce(*[F.when(stage == s, flag) for s, flag in on.items()], F.lit(False))
    before, total, own = F.lit(0), F.lit(0), F.lit(0)
    position = {s: i for i, (s, _) in enumerate(lx.STAGE_WEIGHTS)}
    at = F.coalesce(*[F.when(stage == s, i) for s, i in position.items()], F.lit(len(position)))
    for s, w in lx.STAGE_WEIGHTS:
        weight = F.when(~listed | on[s], w).otherwise(0)
        total = total + weight
        before = before + F.when(F.lit(position[s]) < at, weight).otherwise(0)
        own = own + F.when(stage == s, w).otherwise(0)
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), within))
    return F.when(terminal(stage), 100).otherwise(F.floor((before + own * inside) / total * 100 + 0.5)).cast("int")


def progress_feed(events: DataFrame) -> DataFrame:
    """Events a subscriber sees: nothing after the first done or error."""
    order = F.struct("at", "event_id")
    ends = events.filter(terminal(F.col("stage"))).groupBy("job_id").agg(F.min(order).alias("_end"))
    return events.join(ends, "job_id", "left").filter(F.col("_end").isNull() | (order <= F.col("_end"))).drop("_end")


def evict(events: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Jobs created within the time to live."""
    created = events.groupBy("job_id").agg(F.min("at").alias("created_at"))
    return created.filter(F.col("created_at").cast("double") >= now.cast("timestamp").cast("double") - ttl_seconds)


def idle_gate(concurrent: int, daily: int) -> tuple[int, int, float]:
    """What a gate has to give: free places, starts left today, and when the day ends (the first request opens one)."""
    return concurrent, daily, float("-inf")


def play_gate(gate: tuple[int, int, float], at, release, concurrent: int, daily: int) -> tuple[list[str], tuple[int, int, float]]:
    """The outcome of each event of one key, in order of time, and what the gate has left."""
    free, left, day_end = gate
    out = []
    for now, back in zip(at, release):
        if not back and now >= day_end:
            left, day_end = daily, now + DAY_SECONDS
        outcome = "released" if back else "admitted" if free and left else "daily" if free else "busy"
        change = {"released": 1, "admitted": -1}.get(outcome, 0)
        free, left = min(concurrent, free + change), left + min(change, 0)
        out.append(outcome)
    return out, (free, left, day_end)


def admit(requests: DataFrame, concurrent: int = 1, daily: int = 25) -> DataFrame:
    """Which requests each gate admits; refused ones say busy or daily.

    ``requests``: key, seq, at, release. A gate is sequential by nature, so keys
    are spread and sorted, and each task streams through its rows holding one
    key's three numbers, never a key's events.
    """
    placed = requests.select("key", "seq", F.col("at").cast("double").alias("at"), "release").repartition("key").sortWithinPartitions("key", "at", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, gate = None, None
        for b in batches:
            cuts = np.flatnonzero(b["key"].to_numpy()[1:] != b["key"].to_numpy()[:-1]) + 1
            for part in np.split(np.arange(len(b)), cuts):
                rows = b.iloc[part]
                if gate is None or rows["key"].iloc[0] != key:
                    key, gate = rows["key"].iloc[0], idle_gate(concurrent, daily)
                outcomes, gate = play_gate(gate, rows["at"], rows["release"], concurrent, daily)
                yield pd.DataFrame({"key": rows["key"], "seq": rows["seq"], "outcome": outcomes})

    types = dict(requests.dtypes)
    return placed.mapInPandas(run, f"key {types['key']}, seq {types['seq']}, outcome string")


def event_windows(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Events per stage in each window of event time."""
    span = F.window("at", length, slide) if slide else F.window("at", length)
    return events.groupBy(span.alias("w"), "stage").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "stage", "n")


def job_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Bursts of a job's events with no pause longer than ``gap``."""
    return events.groupBy(F.session_window("at", gap).alias("w"), "job_id").agg(F.count("*").alias("n")).select(
        "job_id", F.col("w.start").alias("session_start"), "n")


def _hour(c: str = "at") -> Column:
    return F.floor(F.col(c).cast("double") / 3600).cast("bigint")


def stage_durations(events: DataFrame) -> DataFrame:
    """How long each event's stage lasted, until the job's next event."""
    seen = sg.neighbour(events, ["job_id"], ["at", "event_id"], _hour(), {"until": F.col("at")}, after=True)
    seconds = (F.unix_micros("until") - F.unix_micros("at")) / 1e6
    return seen.filter(F.col("until").isNotNull()).select("job_id", "event_id", "stage", F.round(seconds, 3).alias("seconds"))


def failed_stage(events: DataFrame) -> DataFrame:
    """The stage each failed job was in when it first failed."""
    order = F.struct("at", "event_id")
    bad = events.filter(F.col("stage") == "error").groupBy("job_id").agg(F.min(order).alias("_end"))
    before = events.join(bad, "job_id").filter(order < F.col("_end"))
    last = before.groupBy("job_id").agg(F.max_by("stage", order).alias("failed_stage"))
    return bad.select("job_id").join(last, "job_id", "left")


def check_monotone(events: DataFrame) -> DataFrame:
    """Events whose percent is below the one before."""
    seen = sg.neighbour(events, ["job_id"], ["at", "event_id"], _hour(), {"before": F.col("percent")})
    return seen.filter(F.col("percent") < F.col("before")).select("job_id", "event_id", "before", "percent")


def assemble(deltas: DataFrame, *keys: str) -> DataFrame:
    """Messages from their token deltas in order; the last usage and finish reason win.

    ``deltas``: keys, seq, content, and maybe usage and finish. A message is one row's text.
    """
    packed = F.array_sort(F.collect_list(F.struct("seq", "content")))
    extra = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("usage", "finish") if c in deltas.columns]
    return deltas.groupBy(*keys).agg(
        F.array_join(F.transform(packed, lambda e: F.coalesce(e["content"], F.lit(""))), "").alias("content"), *extra)


def visible_field(json: Column, field: str) -> Column:
    """What a partly received JSON object shows of one string field; NULL before it starts."""
    pattern = rf'(?s)"{field}"\s*:\s*"((?:[^"\\]|\\[^u]|\\u[0-9a-fA-F]{{4}})*)'
    raw = F.regexp_extract(json, pattern, 1)
    literal = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "\n", r"\\\\n"), "\r", r"\\\\r"), "\t", r"\\\\t")
    decoded = F.get_json_object(F.concat(F.lit('{"v":"'), literal, F.lit('"}')), "$.v")
    return F.when(json.rlike(rf'"{field}"\s*:\s*"'), decoded)
