"""Late rows are dropped and changed keys merged."""

import datetime as dt
import json
import random
import time

from plumbline.streaming import jobs as sj

SCHEMA = "at timestamp, stage string"


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    first = [(day(1), "a"), (day(1, 5), "a"), (day(3), "b")]
    next_ = [(day(4), "a")]
    late = [(day(1, 6), "a"), (day(4, 1), "b"), (day(5), "a")]
    for rows in (first, next_, late):  # a batch drops what was late for the batch before it
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = sj.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    got = sj.run_to_table(sj.event_windows(stream, "1 day", "2 hours"), "update", "late", ["window_start", "stage"]).collect()
    assert {(r["window_start"].day, r["stage"]): r["n"] for r in got} == {(1, "a"): 2, (3, "b"): 1, (4, "a"): 1, (4, "b"): 1, (5, "a"): 1}


def test_jobs_are_evicted_when_the_watermark_passes_their_time_to_live(spark, tmp_path):
    folder = str(tmp_path / "in")
    hour = 3600
    batches = [[(1, day(1, 0)), (2, day(1, 3)), (1, day(1, 1))], [(3, day(1, 6)), (2, day(1, 2))], [(1, day(1, 9)), (4, day(1, 10))], [(5, day(2, 0))]]
    for rows in batches:
        spark.createDataFrame(rows, "job_id long, at timestamp").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    with sj.timer_store(spark):
        stream = sj.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
        got = sj.run_to_table(sj.evictions(stream, "1 hour", 4 * hour), "append", "evicted").collect()
    base = int(day(1).replace(tzinfo=dt.timezone.utc).timestamp())
    # Job 2 was first heard of at two; job 1 comes again at nine, after it was let go, and is let go again; job 5 still lives.
    assert sorted((r.job_id, (r.created_ms // 1000 - base) // hour) for r in got) == [(1, 0), (1, 9), (2, 2), (3, 6), (4, 10)]


def test_a_field_read_piece_by_piece_is_the_field_read_whole():
    r = random.Random(6)
    letters = ["a", '"', "\\", "\n", "é", "😀", "\u0001", "answer", '"answer": "', " ", "u12", "ud83d", "{"]
    for _ in range(400):
        answer = "".join(r.choice(letters) for _ in range(r.randrange(12)))
        whole = json.dumps({"kind": r.choice(["x", 'the "answer"', ""]), "answer": answer, "rest": "z"}, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        whole = whole[:r.randrange(len(whole) // 2, len(whole) + 1)] if r.random() < 0.3 else whole
        reader, at, grown = sj.FieldReader("answer"), 0, []
        while at < len(whole):
            size = r.randrange(1, 6)
            if reader.feed(whole[at:at + size]):
                grown.append(reader.shown)
            at += size
        want = sj.visible_text(whole, "answer")
        if want is not None and want[-1:] and "\ud800" <= want[-1] <= "\udbff":
            want = want[:-1]  # half a character is held back
        assert reader.shown == want
        assert grown == sorted(set(grown), key=len) and (not grown or grown[-1] == want)


def test_a_broken_escape_ends_the_field():
    for whole in ('{"answer":"ab\\u12x4 more"', '{"answer" : "ab\\q\\u00e9"}'):
        reader = sj.FieldReader("answer")
        try:
            want = sj.visible_text(whole, "answer")
        except ValueError:
            continue
        for c in whole:
            reader.feed(c)
        assert reader.shown == want
