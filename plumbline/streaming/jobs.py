"""Job events as streams. Each has a batch twin in ``plumbline.operators.jobs``."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.operators import jobs as jb
from plumbline.session import fresh_folder


#: State with timers and expiry lives in this store.
TIMER_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Files of a folder as they arrive; a bound on files bounds each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def job_state(events: DataFrame) -> DataFrame:
    """Running state of every job: the batch aggregate, kept as streaming state."""
    return jb.job_state(events)


def event_windows(events: DataFrame, length: str, late: str) -> DataFrame:
    """Counts per window and stage; events later than the watermark are dropped."""
    return jb.event_windows(events.withWatermark("at", late), length)


def admit(requests: DataFrame, concurrent: int = 1, daily: int = 25) -> DataFrame:
    """The admission gate with its three numbers as state. ``requests``: key, seq, at, release.

    A batch's rows of one key are put in order of time before the gate sees them.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = state.get if state.exists else jb.idle_gate(concurrent, daily)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        out, gate = jb.play_gate(gate, rows["at"], rows["release"], concurrent, daily)
        state.update(gate)
        yield pd.DataFrame({"key": rows["key"].to_numpy(), "seq": rows["seq"].to_numpy(), "outcome": out})

    placed = requests.select("key", "seq", F.col("at").cast("double").alias("at"), "release")
    return placed.groupBy("key").applyInPandasWithState(
        run, "key bigint, seq bigint, outcome string", "free int, left int, day_end double",
        "append", GroupStateTimeout.NoTimeout)


class _Evictor(StatefulProcessor):
    """Keeps when a job was created, and a timer for the end of its time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.created = handle.getValueState("created", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min(int(b["ms"].min()) for b in rows)
        if self.created.exists():
            known = self.created.get()[0]
            over = known + self.ttl_ms <= timerValues.getCurrentWatermarkInMs()
            if not over and known <= first:
                return
            self.handle.deleteTimer(known + self.ttl_ms)
            if over:  # its timer would fire after these rows
                yield pd.DataFrame({"job_id": [key[0]], "created_ms": [known]})
        self.created.update((first,))
        self.handle.registerTimer(first + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.created.get()[0]
        self.created.clear()
        yield pd.DataFrame({"job_id": [key[0]], "created_ms": [at]})


def evictions(events: DataFrame, late: str, ttl_seconds: int = jb.TTL_SECONDS) -> DataFrame:
    """Jobs whose time to live has passed, each once, when the watermark reaches its end: job_id, created_ms.

    Only the time of creation is kept, and only for jobs that still live; a job
    heard of again after that is a new one. Needs the state store that has timers
    (``TIMER_STORE``).
    """
    rows = events.withWatermark("at", late).select("job_id", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Evictor(ttl_seconds * 1000), outputStructType="job_id bigint, created_ms bigint", outputMode="Append", timeMode="EventTime")


def progress_feed(events: DataFrame, ttl_ms: int = jb.TTL_SECONDS * 1000) -> DataFrame:
    """Events up to each job's first done or error; state is dropped after the time to live.

    ``events`` carries a watermark on ``at``.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ended = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        over = rows["stage"].isin(["done", "error"]).astype(int)
        seen = rows[(over.cumsum() - over) == 0] if not ended else rows.iloc[:0]
        state.update((bool(ended or over.any()),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["at"].max().timestamp() * 1000)) + ttl_ms)
        yield seen[["job_id", "event_id", "stage"]]

    return events.select("job_id", "event_id", "stage", "at").groupBy("job_id").applyInPandasWithState(
        run, "job_id bigint, event_id bigint, stage string", "ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def assemble(deltas: DataFrame, field: str) -> DataFrame:
    """The visible text of one JSON field as deltas arrive, given only when it grows.

    ``deltas``: message_id, seq, content.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reader = FieldReader(field, *(state.get if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values("seq")
        out = [(key[0], seq, reader.shown) for seq, part in zip(rows["seq"], rows["content"]) if reader.feed(part or "")]
        state.update((reader.phase, reader.rest, reader.shown))
        yield pd.DataFrame(out, columns=["message_id", "seq", "visible"])

    return deltas.groupBy("message_id").applyInPandasWithState(
        run, "message_id bigint, seq bigint, visible string", "phase int, rest string, shown string", "append", GroupStateTimeout.NoTimeout)


class FieldReader:
    """Reads one string field of a JSON object as it arrives; a piece costs its own length.

    Held between pieces: whether the field is ahead, open or over, what has come
    and cannot be read yet (a piece of its name, or of an escape), and its text so far.
    """

    AHEAD, OPEN, OVER = range(3)
    _TEXT = re.compile(r'(?:[^"\\]|\\[^u]|\\u[0-9a-fA-F]{4})*', re.S)
    #: An escape that may still be completed, and the first half of a pair of escapes.
    _BROKEN, _HALF = re.compile(r"\\(?:u[0-9a-fA-F]{0,3})?"), re.compile(r"(?<!\\)(?:\\\\)*(\\u[dD][89abAB][0-9a-fA-F]{2})\Z")

    def __init__(self, field: str, phase: int = AHEAD, rest: str = "", shown: str | None = None):
        self.phase, self.rest, self.shown = phase, rest, shown
        name = f'"{field}"'
        self._start = re.compile(rf'{re.escape(name)}\s*:\s*"')
        # A start that the next piece may complete, else as many letters as a part of the name can have.
        self._begun, self._least = re.compile(rf"{re.escape(name)}\s*:?\s*\Z"), len(name) - 1

    def feed(self, part: str) -> bool:
        """Take a piece in; whether the text has grown, or has come to be known."""
        got, before = self.rest + part, self.shown
        if self.phase == self.AHEAD:
            start = self._start.search(got)
            if not start:
                begun = self._begun.search(got)
                self.rest = got[begun.start():] if begun else got[len(got) - self._least:] if len(got) > self._least else got
                return False
            self.phase, self.shown, got = self.OPEN, "", got[start.end():]
        if self.phase == self.OPEN:
            text = self._TEXT.match(got)[0]
            rest = got[len(text):]
            half = None if rest[:1] == '"' else self._HALF.search(text)
            if half and (not rest or self._BROKEN.fullmatch(rest)):
                text, rest = text[:half.start(1)], text[half.start(1):] + rest
            elif rest and not self._BROKEN.fullmatch(rest):
                self.phase, rest = self.OVER, ""
            self.rest = rest
            self.shown += json.loads(f'"{text}"', strict=False)
        return self.shown != before


def visible_text(whole: str, field: str) -> str | None:
    """What a partly received JSON object shows of one string field."""
    m = re.search(rf'"{re.escape(field)}"\s*:\s*"((?:[^"\\]|\\[^u]|\\u[0-9a-fA-F]{{4}})*)', whole, re.S)
    return json.loads(f'"{m.group(1)}"', strict=False) if m else None


@contextmanager
def timer_store(spark: SparkSession):
    """The session's state store set to the one with timers, and set back."""
    name, store = TIMER_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_to_table(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run what is there through a stream and read back the table it wrote.

    In update mode a batch writes only the keys it changed, into a folder of its
    own that a repeated batch replaces; the table holds the latest row of each key.
    """
    spark = stream.sparkSession
    out, marks = fresh_folder(spark, name), fresh_folder(spark, name + "-marks")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks)
    if mode == "append":
        query = query.format("parquet").option("path", out)
    else:
        query = query.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
    query.trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    written = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in stream.columns])
