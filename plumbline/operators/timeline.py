"""Did the recording say the script, and does its timeline hold together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import segments as sg
from plumbline.functions import text as tx
from plumbline.operators.checks import CHARS_PER_MINUTE, result

TURN_FLOOR, EPISODE_FLOOR, MIN_WORDS, MISSING_SHOWN = 0.6, 0.85, 8, 12
CLIP_MS = 20_000
TOLERANCE_MS = 50
SILENCE_RMS = 30
MIN_WPM, MAX_WPM = 80, 260
VOICE_TOLERANCE, VOICE_MIN_TURNS, MIN_VOICED = 0.16, 3, 20
GAP_MS = 350
FRAME_BUCKET = 1024


def norm_words(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    return df.select(*keys, F.posexplode(tx.heard_words(F.col(text))).alias("pos", "word"))


def word_recall(pairs: DataFrame, *keys: str) -> DataFrame:
    """Share of the expected words heard, repeats counted; 1 where none is expected.

    ``pairs``: keys, expected, actual.
    """
    bag = lambda c: norm_words(pairs, *keys, text=c).groupBy(*keys, "word").agg(F.count("*").alias(c))
    found = bag("expected").join(bag("actual"), [*keys, "word"], "left").groupBy(*keys).agg(
        F.sum(F.least("expected", F.coalesce("actual", F.lit(0)))).alias("found"), F.sum("expected").alias("words"))
    return pairs.select(*keys).distinct().join(found, list(keys), "left").select(
        *keys, F.coalesce("words", F.lit(0)).alias("words"),
        F.coalesce(F.col("found") / F.col("words"), F.lit(1.0)).alias("recall"))


def turn_fidelity(pairs: DataFrame) -> DataFrame:
    """Per turn: recall, the first words missing in order, and whether it is suspect.

    ``pairs``: episode_id, turn_idx, script, heard. The k-th use of a word is
    missing when the recording has it fewer than k times.
    """
    keys = ["episode_id", "turn_idx"]
    heard = norm_words(pairs, *keys, text="heard").groupBy(*keys, "word").agg(F.count("*").alias("n"))
    nth = Window.partitionBy(*keys, "word").orderBy("pos")
    said = norm_words(pairs, *keys, text="script").withColumn("k", F.row_number().over(nth))
    marked = said.join(heard, [*keys, "word"], "left").withColumn("gone", F.col("k") > F.coalesce("n", F.lit(0)))
    lost = F.array_sort(F.collect_list(F.when(F.col("gone"), F.struct("pos", "word"))))
    per = marked.groupBy(*keys).agg(
        F.count("*").alias("words"), F.sum(F.when(F.col("gone"), 0).otherwise(1)).alias("found"), lost.alias("lost"))
    full = pairs.select(*keys).join(per, keys, "left")
    recall = F.coalesce(F.col("found") / F.col("words"), F.lit(1.0))
    words = F.coalesce("words", F.lit(0))
    return full.select(
        *keys, words.alias("words"), recall.alias("recall"),
        F.coalesce(F.transform(F.slice("lost", 1, MISSING_SHOWN), lambda e: e["word"]), F.array().cast("array<string>")).alias("missing"),
        ((words >= MIN_WORDS) & (recall < TURN_FLOOR)).alias("suspect"))


def episode_recall(fidelity: DataFrame) -> DataFrame:
    """Recall over an episode, each turn weighted by its words."""
    n = F.sum("words")
    return fidelity.groupBy("episode_id").agg(
        n.alias("words"), F.when(n > 0, F.sum(F.col("recall") * F.col("words")) / n).otherwise(1.0).alias("recall"),
        F.sum(F.col("suspect").cast("int")).alias("suspects"))


def fidelity_check(fidelity: DataFrame) -> DataFrame:
    """An error where a turn is suspect; else a warning where the episode is thin."""
    bad, thin = F.col("suspects") > 0, F.col("recall") < EPISODE_FLOOR
    return episode_recall(fidelity).select(
        "episode_id", F.lit("transcript-fidelity").alias("check_id"), (~bad & ~thin).alias("passed"),
        F.when(~bad & thin, "warning").otherwise("error").alias("severity"), "suspects")


def clip_plan(timings: DataFrame, longest: int = CLIP_MS) -> DataFrame:
    """Cut each turn into clips a recogniser takes."""
    count = F.ceil((F.col("end_ms") - F.col("start_ms")) / longest).cast("int")
    cut = timings.filter(F.col("end_ms") > F.col("start_ms")).select(
        "episode_id", "turn_idx", "start_ms", "end_ms", F.explode(F.sequence(F.lit(0), count - 1)).alias("clip"))
    start = F.col("start_ms") + F.col("clip") * longest
    return cut.select("episode_id", "turn_idx", "clip", start.alias("from_ms"), F.least(start + longest, F.col("end_ms")).alias("to_ms"))


def spoken_chunks(turns: DataFrame) -> DataFrame:
    """Lines of a turn as chunks of speech, timed by their length."""
    lines = F.filter(tx.lines_of(F.col("text")), lambda s: s.rlike(r"\S"))
    return turns.select("episode_id", "turn_idx", "speaker", F.posexplode(lines).alias("chunk_no", "line")).select(
        "episode_id", "turn_idx", "speaker", "chunk_no", (F.length("line") * 60_000 / CHARS_PER_MINUTE).alias("duration_ms"))


def timeline(chunks: DataFrame, gap_ms: float = GAP_MS) -> DataFrame:
    """Turns laid end to end with a gap between: start, end and chunk count."""
    per = chunks.groupBy("episode_id", "turn_idx", "speaker").agg(F.sum("duration_ms").alias("ms"), F.count("*").alias("chunks"))
    placed = sg.running_sum(per, ["episode_id"], ["turn_idx"], sg.segment_of(F.col("turn_idx")), F.col("ms") + gap_ms, "start_ms")
    return placed.select("episode_id", "turn_idx", "speaker", F.round("start_ms", 6).alias("start_ms"),
                         F.round(F.col("start_ms") + F.col("ms"), 6).alias("end_ms"), "chunks")


def total_ms(timings: DataFrame) -> DataFrame:
    return timings.groupBy("episode_id").agg(F.max("end_ms").alias("total_ms"))


def _at(name: str = "turn_idx") -> Column:
    return F.col(name).alias("at")


def check_turns_voiced(turns, timings, episodes) -> DataFrame:
    dumb = turns.select("episode_id", "turn_idx").join(timings, ["episode_id", "turn_idx"], "left_anti").select(
        "episode_id", _at(), F.concat(F.lit("no audio: "), "turn_idx").alias("what"))
    empty = timings.filter(F.col("end_ms") <= F.col("start_ms")).select(
        "episode_id", _at(), F.concat(F.lit("zero length: "), "turn_idx").alias("what"))
    return result(episodes, dumb.unionByName(empty), "turns-voiced", "error")


def check_timeline_order(timings, episodes) -> DataFrame:
    seen = sg.neighbour(timings.select("episode_id", "turn_idx", "start_ms", "end_ms"), ["episode_id"], ["turn_idx"],
                        sg.segment_of(F.col("turn_idx")), {"before": F.col("end_ms")})
    rows = seen.filter(F.col("start_ms") < F.col("before")).select("episode_id", _at(), F.col("turn_idx").cast("string").alias("what"))
    return result(episodes, rows, "timeline-order", "error")


def check_timeline_matches(timings, audio, episodes) -> DataFrame:
    """``audio``: episode_id, file_ms, total_ms as reported."""
    last = timings.groupBy("episode_id").agg(F.max_by("end_ms", "turn_idx").alias("last"))
    both = audio.join(last, "episode_id", "left")
    drift = F.abs(F.col("file_ms") - F.col("total_ms")) > TOLERANCE_MS
    past = F.col("last") > F.col("file_ms") + TOLERANCE_MS
    rows = both.filter(drift | F.coalesce(past, F.lit(False))).select(
        "episode_id", F.lit(0).alias("at"), F.when(drift, "drift").otherwise("past the end").alias("what"))
    return result(episodes, rows, "timeline-matches-audio", "error")


def turn_loudness(frames: DataFrame, timings: DataFrame, rate: float, at_most: int | None = None) -> DataFrame:
    """RMS of all frames inside each turn, or of about ``at_most`` of them at an even step.

    ``frames``: episode_id, frame, sample. Frames meet turns on a bucket of frame numbers.
    """
    count = frames.groupBy("episode_id").agg((F.max("frame") + 1).alias("total"))
    first = F.greatest(F.lit(0), F.floor(F.col("start_ms") / 1000 * rate)).cast("bigint")
    spanned = timings.join(count, "episode_id", "left").withColumn("f0", first).withColumn(
        "f1", F.least(F.coalesce("total", F.lit(0)), F.ceil(F.col("end_ms") / 1000 * rate)).cast("bigint"))
    step = F.greatest(F.lit(1), F.floor((F.col("f1") - F.col("f0")) / at_most)).cast("bigint") if at_most else F.lit(1)
    wide = spanned.filter(F.col("f1") > F.col("f0")).select(
        "episode_id", "turn_idx", "f0", "f1", step.alias("step"),
        F.explode(F.sequence(F.floor(F.col("f0") / FRAME_BUCKET), F.floor((F.col("f1") - 1) / FRAME_BUCKET))).alias("b"))
    heard = frames.withColumn("b", F.floor(F.col("frame") / FRAME_BUCKET)).join(wide, ["episode_id", "b"]).filter(
        (F.col("frame") >= F.col("f0")) & (F.col("frame") < F.col("f1")) & ((F.col("frame") - F.col("f0")) % F.col("step") == 0))
    power = heard.groupBy("episode_id", "turn_idx").agg(F.sqrt(F.avg(F.col("sample").cast("double") * F.col("sample"))).alias("rms"))
    return timings.select("episode_id", "turn_idx").join(power, ["episode_id", "turn_idx"], "left").fillna(0.0, ["rms"])


def check_silent_turns(turns, timings, frames, rate, episodes) -> DataFrame:
    worded = turns.filter(F.col("text").rlike(r"\S")).select("episode_id", "turn_idx")
    quiet = turn_loudness(frames, timings, rate).filter(F.col("rms") < SILENCE_RMS).join(worded, ["episode_id", "turn_idx"], "left_semi")
    return result(episodes, quiet.select("episode_id", _at(), F.col("turn_idx").cast("string").alias("what")), "silent-turns", "error")


def check_speech_rate(turns, timings, episodes) -> DataFrame:
    n = turns.select("episode_id", "turn_idx", tx.word_count(F.col("text")).alias("n")).filter(F.col("n") >= 5)
    wpm = F.col("n") / ((F.col("end_ms") - F.col("start_ms")) / 60_000)
    rated = timings.filter(F.col("end_ms") > F.col("start_ms")).join(n, ["episode_id", "turn_idx"]).withColumn("wpm", wpm)
    rows = rated.filter((F.col("wpm") > MAX_WPM) | (F.col("wpm") < MIN_WPM)).select(
        "episode_id", _at(), F.concat("turn_idx", F.when(F.col("wpm") > MAX_WPM, ": fast").otherwise(": slow")).alias("what"))
    return result(episodes, rows, "speech-rate", "warning")


def check_duration(audio, episodes) -> DataFrame:
    ratio = F.col("total_ms") / 60_000 / F.col("minutes")
    both = episodes.filter(F.col("minutes") > 0).join(audio, "episode_id")
    rows = both.filter((ratio < 0.6) | (ratio > 1.6)).select("episode_id", F.lit(0).alias("at"), F.round(ratio * 100).cast("int").cast("string").alias("what"))
    return result(episodes, rows, "episode-duration", "warning")


def check_audio_parses(audio, episodes) -> DataFrame:
    """The decoded file has samples; a missing or empty one fails."""
    lengths = episodes.select("episode_id").join(audio.select("episode_id", "file_ms"), "episode_id", "left")
    rows = lengths.filter(F.coalesce("file_ms", F.lit(0.0)) <= 0).select("episode_id", F.lit(0).alias("at"), F.lit("no samples").alias("what"))
    return result(episodes, rows, "audio-parses", "error")


def pitch_floor(pitch: DataFrame, at_most: int | None = None) -> DataFrame:
    """Tenth percentile of the voiced pitch of each turn; NULL under 20 voiced frames.

    ``pitch``: episode_id, speaker, turn_idx, frame (from 0), hz (NULL where
    unvoiced). Equal pitches of a turn are counted together before they are
    ordered. ``at_most`` keeps about so many evenly spread frames of a turn.
    """
    keys = ["episode_id", "speaker", "turn_idx"]
    if at_most:
        n = pitch.groupBy(*keys).agg(F.count("*").alias("n"))
        step = F.greatest(F.lit(1.0), F.col("n") / at_most)
        pitch = pitch.join(n, keys).withColumn("step", step).filter(F.floor(F.ceil(F.col("frame") / F.col("step")) * F.col("step")) == F.col("frame"))
    tally = pitch.groupBy(*keys, "hz").agg(F.count("hz").alias("n"))
    turn = Window.partitionBy(*keys)
    upto = tally.withColumn("voiced", F.sum("n").over(turn)).withColumn("upto", F.sum("n").over(turn.orderBy(F.col("hz").asc_nulls_first())))
    # The value at place floor(voiced / 10) of the sorted pitches, counted from 0.
    floor = F.min(F.when((F.col("voiced") >= MIN_VOICED) & (F.col("upto") > F.floor(F.col("voiced") * 0.1)), F.col("hz")))
    return upto.groupBy(*keys).agg(F.max("voiced").cast("int").alias("voiced"), floor.alias("floor_hz"))


def off_voice(floors: DataFrame) -> DataFrame:
    """Turns far from their speaker's upper median floor, for speakers with enough turns."""
    rated = floors.filter(F.col("floor_hz").isNotNull())
    usual = rated.groupBy("episode_id", "speaker").agg(
        F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by floor_hz desc)").alias("usual"))
    off = F.col("floor_hz") / F.col("usual") - 1
    return rated.join(usual.filter(F.col("n") >= VOICE_MIN_TURNS), ["episode_id", "speaker"]).withColumn("off", off).filter(F.abs("off") > VOICE_TOLERANCE)


def check_voice(floors, episodes) -> DataFrame:
    rows = off_voice(floors).select("episode_id", F.struct("speaker", "turn_idx").alias("at"), F.concat_ws(" turn ", "speaker", "turn_idx").alias("what"))
    return result(episodes, rows, "voice-consistency", "error")


def run_audio_checks(turns, timings, audio, frames, pitch, rate, episodes) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        check_audio_parses(audio, episodes), check_turns_voiced(turns, timings, episodes), check_timeline_order(timings, episodes),
        check_timeline_matches(timings, audio, episodes), check_silent_turns(turns, timings, frames, rate, episodes),
        check_speech_rate(turns, timings, episodes), check_duration(audio, episodes), check_voice(pitch_floor(pitch), episodes),
    ])


# Each fault and the check that must notice it.
AUDIO_MUTATIONS = [
    ("silence-turn", "silent-turns"), ("truncate-audio", "timeline-matches-audio"), ("desync-timeline", "timeline-matches-audio"),
    ("overlap-turns", "timeline-order"), ("drop-turn-timing", "turns-voiced"), ("change-voice", "voice-consistency"),
]
CONTROL = "control"


def _kinds() -> Column:
    return F.explode(F.array(*[F.lit(k) for k in [CONTROL] + [k for k, _ in AUDIO_MUTATIONS]]))


def _targets(timings: DataFrame) -> DataFrame:
    """episode_id, _first, _target: the first turn, and the one a fault strikes."""
    bounds = timings.groupBy("episode_id").agg(F.array_sort(F.collect_set(F.when(F.col("turn_idx") < 2, F.col("turn_idx")))).alias("_two"),
                                               F.min("turn_idx").alias("_first"), F.count("*").alias("_n"))
    target = F.when(F.col("_n") > 1, F.coalesce(F.get("_two", F.lit(1)), F.col("_first"))).otherwise(F.col("_first"))
    return bounds.select("episode_id", "_first", target.alias("_target"))


def mutate_timeline(timings, audio, frames, pitch, rate):
    """(timings, audio, frames, pitch), each once clean and once per fault, keyed by ``kind``."""
    mark = _targets(timings)
    head = timings.join(mark, "episode_id").filter(F.col("turn_idx") == F.col("_first")).select("episode_id", F.col("end_ms").alias("_head_end"))
    span = timings.join(mark, "episode_id").filter(F.col("turn_idx") == F.col("_target")).select(
        "episode_id", F.floor(F.col("start_ms") / 1000 * rate).alias("_f0"), F.ceil(F.col("end_ms") / 1000 * rate).alias("_f1"))
    k = F.col("kind")
    shift = F.when(k == "desync-timeline", 5_000.0).otherwise(0.0)
    late = (k == "overlap-turns") & (F.col("turn_idx") == F.col("_target")) & (F.col("_target") != F.col("_first"))
    t = timings.join(mark, "episode_id").join(head, "episode_id").withColumn("kind", _kinds()).filter(
        ~((k == "drop-turn-timing") & (F.col("turn_idx") == F.col("_target")))
    ).select(
        "episode_id", "kind", "turn_idx", "speaker",
        F.when(late, F.greatest(F.lit(0.0), F.col("_head_end") - 1_000)).otherwise(F.col("start_ms") + shift).alias("start_ms"),
        (F.col("end_ms") + shift).alias("end_ms"), "chunks")
    a = audio.withColumn("kind", _kinds()).select(
        "episode_id", "kind", F.when(k == "truncate-audio", F.col("file_ms") * 0.66).otherwise(F.col("file_ms")).alias("file_ms"),
        (F.col("total_ms") + shift).alias("total_ms"))
    count = frames.groupBy("episode_id").agg((F.max("frame") + 1).alias("_all"))
    hush = (k == "silence-turn") & (F.col("frame") >= F.col("_f0")) & (F.col("frame") < F.col("_f1"))
    f = frames.join(span, "episode_id", "left").join(count, "episode_id").withColumn("kind", _kinds()).filter(
        ~((k == "truncate-audio") & (F.col("frame") >= F.floor(F.col("_all") * 0.66)))
    ).select("episode_id", "kind", "frame", F.when(hush, 0).otherwise(F.col("sample")).alias("sample"))
    p = pitch.join(mark, "episode_id", "left").withColumn("kind", _kinds()).select(
        "episode_id", "kind", "speaker", "turn_idx", "frame",
        F.when((k == "change-voice") & (F.col("turn_idx") == F.col("_target")), F.col("hz") * 0.75).otherwise(F.col("hz")).alias("hz"))
    return t, a, f, p


def detection(turns, timings, audio, frames, pitch, rate, episodes) -> DataFrame:
    """Per episode and fault: was the named check clean before, and did it fail after.

    An episode counts for a changed voice only where its voices can be told: the
    changed turn and enough turns of its speaker have a floor.
    """
    variant = F.concat_ws("|", "episode_id", "kind")
    keyed = lambda df: df.withColumn("episode_id", variant).drop("kind")
    t, a, f, p = (keyed(df) for df in mutate_timeline(timings, audio, frames, pitch, rate))
    every = lambda df: keyed(df.withColumn("kind", _kinds()))
    rows = run_audio_checks(every(turns), t, a, f, p, rate, every(episodes)).select(
        F.substring_index("episode_id", "|", 1).alias("episode_id"), F.substring_index("episode_id", "|", -1).alias("kind"), "check_id", "passed")
    book = F.create_map(*[F.lit(x) for pair in AUDIO_MUTATIONS for x in pair])
    hit = rows.filter(F.col("check_id") == book[F.col("kind")]).select("episode_id", "kind", "check_id", (~F.col("passed")).alias("detected"))
    clean = rows.filter(F.col("kind") == CONTROL).select("episode_id", "check_id", F.col("passed").alias("clean"))
    floors = pitch_floor(pitch).filter(F.col("floor_hz").isNotNull())
    told = floors.withColumn("n", F.count("*").over(Window.partitionBy("episode_id", "speaker"))).filter(F.col("n") >= VOICE_MIN_TURNS).join(
        _targets(timings), "episode_id").filter(F.col("turn_idx") == F.col("_target"))
    told = told.select(F.col("episode_id").cast("string").alias("episode_id"), F.lit("change-voice").alias("kind"), F.lit(True).alias("_told")).distinct()
    return hit.join(clean, ["episode_id", "check_id"]).join(told, ["episode_id", "kind"], "left").filter(
        (F.col("kind") != "change-voice") | F.col("_told")).drop("_told")


def active_turn(points: DataFrame, timings: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """The latest turn started at each moment; NULL before the first.

    A turn is active until the next starts, so moments meet turns on a bucket of
    time; moments after the last start take the last turn.
    """
    runs = sg.neighbour(timings.select("episode_id", "turn_idx", "start_ms"), ["episode_id"], ["turn_idx"],
                        sg.segment_of(F.col("turn_idx")), {"until": F.col("start_ms")}, after=True)
    closed = runs.filter(F.col("until") > F.col("start_ms")).select(
        "episode_id", "turn_idx", "start_ms", "until",
        F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("until") / bucket_ms))).alias("b"))
    last = runs.filter(F.col("until").isNull()).select("episode_id", F.col("turn_idx").alias("_last"), F.col("start_ms").alias("_from"))
    t = F.col("t_ms")
    p = points.join(last, "episode_id", "left").withColumn("b", F.floor(t / bucket_ms))
    c = closed.select(F.col("episode_id").alias("_e"), F.col("b").alias("_b"), F.col("turn_idx").alias("_turn"), "start_ms", "until")
    on = (F.col("episode_id") == F.col("_e")) & (F.col("b") == F.col("_b")) & (t >= F.col("start_ms")) & (t < F.col("until"))
    return p.join(c, on, "left").select(
        *points.columns, F.when(t >= F.col("_from"), F.col("_last")).otherwise(F.col("_turn")).alias("turn_idx"))


def slice_frames(frames: DataFrame, requests: DataFrame, rate: float) -> DataFrame:
    """Frames of each episode's requested stretch, clamped to what there is.

    ``requests``: episode_id, start_ms, end_ms (one per episode).
    """
    at = lambda c: F.greatest(F.lit(0), F.floor(F.col(c) / 1000 * rate))
    return frames.join(requests, "episode_id").filter((F.col("frame") >= at("start_ms")) & (F.col("frame") < at("end_ms"))).select(
        "episode_id", "frame", "sample")


def check_formats(segments: DataFrame) -> DataFrame:
    """The first segment whose format is not the first one's, per episode.

    ``segments``: episode_id, segment, rate, channels, bits.
    """
    fmt = F.struct("rate", "channels", "bits")
    first = segments.groupBy("episode_id").agg(F.min_by(fmt, "segment").alias("_fmt"))
    odd = segments.join(first, "episode_id").filter(fmt != F.col("_fmt"))
    return odd.groupBy("episode_id").agg(F.min(F.struct("segment", "rate", "channels"))["segment"].alias("segment"),
                                         F.min(F.struct("segment", "rate"))["rate"].alias("rate"), F.first(F.col("_fmt")["rate"]).alias("expected_rate"))
