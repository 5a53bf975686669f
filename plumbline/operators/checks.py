"""Rule-based checks of scripts, over every episode at once.

Each check gives one row per episode: episode_id, check_id, passed, severity,
offences, first_offence. A phrase is looked for inside a turn, so no episode is
ever gathered into one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexicons as lx
from plumbline.functions import segments as sg
from plumbline.functions import text as tx
from plumbline.session import cut_lineage

CHARS_PER_MINUTE = 1_100
COLLAPSED, SHORT = 0.7, 0.85
SHOW = "Paperline"
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
NUMBER = r"\d[\d,]*(?:\.\d+)?"


def result(episodes: DataFrame, offences: DataFrame, check: str, severity: str) -> DataFrame:
    """One row per episode from rows (episode_id, at, what), one per offence.

    Episodes and offences are counted together, so that neither is ever sent whole to the driver to be joined.
    """
    off = F.col("_off")
    told = offences.filter("episode_id IS NOT NULL").select("episode_id", "at", "what", F.lit(True).alias("_off"))
    asked = episodes.select("episode_id", *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in ("at", "what")], F.lit(False).alias("_off"))
    counted = asked.unionByName(told).groupBy("episode_id").agg(
        F.count(F.when(off, 1)).alias("offences"), F.min(F.when(off, F.struct("at", "what")))["what"].alias("first_offence"), F.min("_off").alias("_off"))
    return counted.filter(~off).select(
        "episode_id", F.lit(check).alias("check_id"), (F.col("offences") == 0).alias("passed"),
        F.lit(severity).alias("severity"), "offences", "first_offence",
    )


def _apart(df: DataFrame) -> DataFrame:
    """A table that grows with the episodes, for a join in which it is not sent whole to every task.

    Its rows repeat each other, so that it looks small to Spark once it is written and is not when it is read.
    """
    return df.hint("merge")


def _hits(turns: DataFrame, found: Column) -> DataFrame:
    """One row per match of an array of matches in a turn."""
    return turns.select("episode_id", "turn_idx", F.posexplode(found).alias("pos", "what")).select(
        "episode_id", F.struct("turn_idx", "pos").alias("at"), "what"
    )


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def check_schema(turns, episodes, papers) -> DataFrame:
    """Turns without a known speaker or a text; where episodes carry them, a summary and key points that are no texts.

    ``episodes`` may have ``summary`` and ``key_points`` (an array of texts).
    """
    bad = ~F.coalesce(F.col("speaker").isin("host", "guest", "narrator"), F.lit(False)) | F.col("text").isNull()
    rows = turns.filter(bad).select("episode_id", F.struct("turn_idx").alias("at"), F.coalesce("speaker", F.lit("")).alias("what"))
    wanted = {"summary": ("summary", F.col("summary").isNull()),
              "key_points": ("keyPoints", F.col("key_points").isNull() | F.exists("key_points", lambda k: k.isNull()))}
    kind = turns.schema["turn_idx"].dataType
    for n, column in enumerate(c for c in wanted if c in episodes.columns):
        name, missing = wanted[column]
        rows = episodes.filter(missing).select("episode_id", F.struct(F.lit(n - len(wanted)).cast(kind).alias("turn_idx")).alias("at"), F.lit(name).alias("what")).unionByName(rows)
    return result(episodes, rows, "schema", "error")


def formats(turns: DataFrame) -> DataFrame:
    """Turns, narrated turns and the format they imply, per episode."""
    n = turns.groupBy("episode_id").agg(
        F.count("*").alias("turns"), F.sum(F.when(F.col("speaker") == "narrator", 1).otherwise(0)).alias("narrated")
    )
    return n.withColumn("format", F.when(F.col("narrated") == F.col("turns"), "solo").otherwise("dialogue"))


def check_alternation(turns, episodes, papers) -> DataFrame:
    kind = formats(turns)
    mixed = kind.filter((F.col("narrated") > 0) & (F.col("narrated") < F.col("turns"))).select(
        "episode_id", F.struct(F.lit(-1).cast("bigint").alias("turn_idx")).alias("at"), F.lit("mixed formats").alias("what")
    )
    pairs = sg.neighbour(
        turns.select("episode_id", "turn_idx", "speaker"), ["episode_id"], ["turn_idx"], sg.segment_of(F.col("turn_idx")),
        {"before": F.col("speaker")},
    ).filter(F.col("before") == F.col("speaker"))
    same = pairs.join(_apart(kind.filter(F.col("narrated") == 0)), "episode_id", "left_semi").select(
        "episode_id", F.struct(F.col("turn_idx").cast("bigint").alias("turn_idx")).alias("at"),
        F.concat(F.lit("turns "), F.col("turn_idx") - 1, F.lit(" and "), F.col("turn_idx")).alias("what"),
    )
    return result(episodes, mixed.unionByName(same), "alternation", "error")


def target_turns(minutes: Column, fmt: Column) -> Column:
    rate = F.when(fmt == "eli5", 2.5).when(fmt == "solo", 2.0).otherwise(3.5)
    floor = F.when(fmt == "dialogue", 6).otherwise(4)
    return F.least(F.lit(60), F.greatest(floor, F.floor(minutes * rate + 0.5).cast("int")))


def check_turn_count(turns, episodes, papers) -> DataFrame:
    short = episodes.join(_apart(formats(turns)), "episode_id", "left").withColumn(
        "target", target_turns(F.col("minutes"), F.coalesce("format", F.lit("dialogue")))
    ).filter(F.coalesce("turns", F.lit(0)) < F.col("target"))
    rows = short.select("episode_id", F.lit(0).alias("at"),
                        F.concat(F.coalesce("turns", F.lit(0)), F.lit(" of "), F.col("target")).alias("what"))
    return result(episodes, rows, "turn-count", "warning")


def measure_length(turns: DataFrame, episodes: DataFrame) -> DataFrame:
    """Characters spoken against the minutes asked for."""
    said = turns.groupBy("episode_id").agg(
        (F.sum(F.length(tx.strip(F.col("text")))) + F.count("*") - 1).alias("chars"),
        F.sum(tx.word_count(F.col("text"))).alias("words"),
    ).join(formats(turns), "episode_id")
    per_word = F.when(F.col("format") == "solo", 7.0).when(F.col("format") == "eli5", 5.6).otherwise(6.8)
    ratio = F.when(F.col("minutes") == 0, 1.0).otherwise(F.col("chars") / CHARS_PER_MINUTE / F.col("minutes"))
    return said.join(episodes, "episode_id").select(
        "episode_id", "chars", "words", "turns", "format", "minutes",
        F.floor(F.floor(F.col("minutes") * CHARS_PER_MINUTE + 0.5) / per_word + 0.5).cast("bigint").alias("word_target"),
        ratio.alias("ratio"), (ratio < SHORT).alias("short"), (ratio < COLLAPSED).alias("collapsed"),
    )


def check_word_count(turns, episodes, papers) -> DataFrame:
    rows = measure_length(turns, episodes).filter("collapsed").select(
        "episode_id", F.lit(0).alias("at"), F.concat(F.col("words"), F.lit(" words")).alias("what"))
    return result(episodes, rows, "word-count", "warning")


def check_show_name(turns, episodes, papers, show: str = SHOW) -> DataFrame:
    lead = (LEFT + r"(?i:welcome(?:\s+back)?\s+to|listening\s+to|here\s+on|this\s+is)\s+"
            r"(?i:(?:(?:this|another|our|the)\s+)?(?:episode\s+of\s+)?)([A-Z][\w'’-]*(?:\s+[A-Z][\w'’-]*){0,3})")
    wrong = F.filter(_matches(F.col("text"), lead, 1), lambda n: ~F.lower(n).startswith(show.lower()))
    return result(episodes, _hits(turns, wrong), "show-name", "error")


def check_honorifics(turns, episodes, papers) -> DataFrame:
    hits = _hits(turns, F.transform(
        _matches(F.col("text"), LEFT + r"(Dr\.|Prof\.|Professor|PhD|Ph\.D\.)\s*[A-Z]?"), tx.strip))
    placed = hits.join(_apart(episodes.select("episode_id", "paper_id")), "episode_id")
    text = papers.join(_apart(placed.select("paper_id").distinct()), "paper_id", "left_semi").select("paper_id", F.lower("text").alias("_text"))
    absent = placed.join(_apart(text), "paper_id", "left").filter(
        ~F.coalesce(F.contains(F.col("_text"), F.lower("what")), F.lit(False)))
    return result(episodes, absent.select("episode_id", "at", "what"), "honorifics", "error")


def check_expertise(turns, episodes, papers) -> DataFrame:
    pattern = r"(?i)" + LEFT + r"(?:expert|specialist|authority|researcher)\s+(?:in|on)\s+[a-z]"
    return result(episodes, _hits(turns, _matches(F.col("text"), pattern)), "claimed-expertise", "error")


def check_impersonation(turns, episodes, papers) -> DataFrame:
    patterns = [
        r"we\s+(?:found|showed|built|designed|proposed?|developed|implemented|evaluated|introduced?)" + RIGHT,
        r"our\s+(?:approach|methods?|experiments|system|paper|architecture|design|results|work|model)" + RIGHT,
        r"in our\s+\w+",
    ]
    found = F.array_distinct(F.concat(*[_matches(F.col("text"), "(?i)" + LEFT + p) for p in patterns]))
    return result(episodes, _hits(turns, found), "author-impersonation", "error")


def lexicon_of(text: Column) -> Column:
    """Every word of a text, with a wrapped word read whole, joined and hyphenated."""
    raw = F.lower(text)
    wrap = r"-[ \t]*\r?\n[ \t]*"
    read = lambda t: _matches(t, r"[a-z0-9'’-]+")
    # A text that wraps no word reads the same three ways, and a word without a hyphen is its own part.
    readings = F.array_distinct(F.when(raw.rlike(wrap), F.concat(
        read(raw), read(F.regexp_replace(raw, wrap, "")), read(F.regexp_replace(raw, wrap, "-")))).otherwise(read(raw)))
    return tx.let(readings, lambda r: F.array_distinct(F.concat(r, F.flatten(F.transform(
        F.filter(r, lambda w: F.contains(w, F.lit("-"))), lambda w: F.filter(F.split(w, "-", -1), lambda p: p != ""))))))


def lexicon(papers: DataFrame) -> DataFrame:
    """Every word of a paper, with a wrapped word read whole, joined and hyphenated."""
    # One paper is one row, so its words are made distinct without a shuffle.
    return papers.select("paper_id", F.explode(lexicon_of(F.col("text"))).alias("word"))


def _unknown(rows: DataFrame, papers: DataFrame, forms: list[str]) -> DataFrame:
    """Rows none of whose forms is a word of their paper; only papers named are read.

    The words asked for travel to their paper, not its words to them.
    """
    told = rows.groupBy("paper_id").agg(F.collect_set(F.struct(*forms)).alias("told"))
    has = lambda words: F.filter("told", lambda t: F.arrays_overlap(F.array(*[t[f] for f in forms]), words))
    met = papers.join(_apart(told), "paper_id").select("paper_id", F.explode(tx.let(lexicon_of(F.col("text")), has)).alias("t"))
    known = met.select("paper_id", F.col(f"t.{forms[0]}").alias(forms[0])).distinct()
    return rows.join(_apart(known), ["paper_id", forms[0]], "left_anti")


def check_direct_address(turns, episodes, papers) -> DataFrame:
    lead = LEFT + r"(?i:thanks|thank you|so|well|right|okay|ok|yes|and|but|now)\s*,\s*([A-Z][\w'’-]*)"
    hits = _hits(turns, _matches(F.col("text"), lead, 1)).withColumn("_w", F.lower("what"))
    rows = _unknown(hits.join(_apart(episodes.select("episode_id", "paper_id")), "episode_id"), papers, ["_w"])
    return result(episodes, rows.select("episode_id", "at", "what"), "no-names", "error")


def proper_nouns(turns: DataFrame, show: str = SHOW) -> DataFrame:
    """Capitalised words inside sentences: episode_id, turn_idx, word, lower, stem."""
    inner = F.flatten(F.transform(
        tx.sentences_after_mark(F.col("text")),
        lambda s: F.filter(F.split(tx.strip(s), r"\s+"), lambda w, i: i > 0),
    ))
    tokens = turns.select("episode_id", "turn_idx", F.posexplode(inner).alias("pos", "tok"))
    word = F.regexp_replace("tok", r"^[^\w]+|[^\w]+$", "")
    return (
        tokens.withColumn("word", word).filter(F.col("word").rlike(r"^[A-Z][a-zA-Z'’-]{2,}$"))
        .withColumn("lower", F.lower("word"))
        .filter(~F.col("lower").isin(lx.PROPER_NOUN_ALLOW) & (F.col("lower") != show.lower()))
        .withColumn("stem", F.regexp_replace("lower", r"['’]s$|s$", ""))
    )


def unknown_nouns(turns, episodes, papers) -> DataFrame:
    """Each proper noun an episode says and its paper does not, once."""
    said = proper_nouns(turns).groupBy("episode_id", "word", "lower", "stem").agg(
        F.min(F.struct("turn_idx", "pos")).alias("at"))
    return _unknown(said.join(_apart(episodes.select("episode_id", "paper_id")), "episode_id"), papers, ["lower", "stem"])


def check_proper_nouns(turns, episodes, papers) -> DataFrame:
    rows = unknown_nouns(turns, episodes, papers).select("episode_id", "at", F.col("word").alias("what"))
    return result(episodes, rows, "proper-nouns", "warning")


def unknown_numbers(turns, episodes, papers) -> DataFrame:
    """Numbers above 3 that the paper neither states nor rounds to.

    A number that rounds to another is within one of its whole part, so the two
    sides meet on the whole part rather than on every pair.
    """
    bare = lambda c: F.regexp_replace(c, ",", "")
    said = turns.select(
        "episode_id", "turn_idx", F.posexplode(_matches(F.col("text"), LEFT + NUMBER + RIGHT)).alias("pos", "raw")
    ).withColumn("raw", bare(F.col("raw"))).withColumn("value", F.col("raw").cast("double")).filter(F.col("value") > 3)
    once = said.groupBy("episode_id", "raw", "value").agg(F.min(F.struct("turn_idx", "pos")).alias("at")).join(
        _apart(episodes.select("episode_id", "paper_id")), "episode_id")
    named = papers.join(_apart(once.select("paper_id").distinct()), "paper_id", "left_semi")
    stated = named.select("paper_id", F.explode(F.array_distinct(_matches(F.col("text"), NUMBER))).alias("n")).select(
        "paper_id", bare(F.col("n")).cast("double").alias("p")).distinct().withColumn("whole", F.floor("p"))
    factor = F.pow(F.lit(10.0), F.length(F.regexp_extract("raw", r"\.(\d+)$", 1)))
    near = once.withColumn("whole", F.explode(F.array(*[F.floor("value") + d for d in (-1, 0, 1)])))
    met = near.join(_apart(stated), ["paper_id", "whole"]).filter(
        (F.col("p") == F.col("value")) | (F.floor(F.col("p") * factor + 0.5) / factor == F.col("value"))
    ).select("episode_id", "raw").distinct()
    return once.join(_apart(met), ["episode_id", "raw"], "left_anti")


def check_numbers(turns, episodes, papers) -> DataFrame:
    rows = unknown_numbers(turns, episodes, papers).select("episode_id", "at", F.col("raw").alias("what"))
    return result(episodes, rows, "numbers", "warning")


ALL_CHECKS = [
    check_schema, check_alternation, check_turn_count, check_word_count, check_show_name, check_honorifics,
    check_expertise, check_impersonation, check_direct_address, check_proper_nouns, check_numbers,
]


def run_checks(turns: DataFrame, episodes: DataFrame, papers: DataFrame, checks=None) -> DataFrame:
    """All registered checks as one table. The turns are settled once for all of them."""
    turns = cut_lineage(turns)
    return reduce(DataFrame.unionByName, [c(turns, episodes, papers) for c in (checks or ALL_CHECKS)])


def compliance(results: DataFrame) -> DataFrame:
    """Errors, warnings and the share passed, per episode."""
    fails = lambda level: F.sum(F.when(~F.col("passed") & (F.col("severity") == level), 1).otherwise(0))
    return results.groupBy("episode_id").agg(
        fails("error").alias("errors"), fails("warning").alias("warnings"),
        F.round(F.avg(F.col("passed").cast("int")), 6).alias("compliance"),
    )


# Each corruption and the check that must notice it.
MUTATIONS = [
    ("swap-number", "numbers"), ("fabricate-entity", "proper-nouns"), ("add-honorific", "honorifics"),
    ("claim-authorship", "author-impersonation"), ("claim-expertise", "claimed-expertise"),
    ("invent-show-name", "show-name"), ("address-by-name", "no-names"), ("break-alternation", "alternation"),
    ("truncate-dialogue", "turn-count"),
]
CHECK_OF = {
    "numbers": check_numbers, "proper-nouns": check_proper_nouns, "honorifics": check_honorifics, "author-impersonation": check_impersonation,
    "claimed-expertise": check_expertise, "show-name": check_show_name, "no-names": check_direct_address, "alternation": check_alternation,
    "turn-count": check_turn_count,
}
# What a corruption adds to a turn.
SAID = {
    "fabricate-entity": " This builds directly on the Chubby coordination service.",
    "add-honorific": " Dr. Halloran walks us through it.",
    "claim-authorship": " In our experiments we designed the quorum scheme to cut latency.",
    "claim-expertise": " Joining us is an expert in distributed storage systems.",
    "invent-show-name": "Welcome to Science Uncovered. ",
    "address-by-name": "Thanks, Marcus, for that. ",
    "swap-number": " Throughput reached 8317 transactions per second.",
}
CONTROL = "control"


def _kinds(kinds: list[str]) -> Column:
    return F.explode(F.array(*[F.lit(k) for k in kinds]))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with what a corruption asks of their episode: its last turn, its first with a number, who opens it."""
    first = turns.groupBy("episode_id").agg(
        F.max("turn_idx").alias("_last"),
        F.coalesce(F.min(F.when(F.col("text").rlike(LEFT + NUMBER + RIGHT), F.col("turn_idx"))), F.lit(0)).alias("_number"),
        F.min_by("speaker", "turn_idx").alias("_opener"),
    )
    return turns.join(_apart(first), "episode_id")


def _corrupted(placed: DataFrame, kinds: list[str]) -> DataFrame:
    """Every episode once for each of some kinds."""
    pattern = LEFT + NUMBER + RIGHT
    each = placed.withColumn("kind", _kinds(kinds))
    k, i, t = F.col("kind"), F.col("turn_idx"), F.col("text")
    second = F.least(F.lit(1), F.col("_last"))
    swapped = F.regexp_replace(t, "^(.*?)" + pattern, "$1" + "8317")
    text = (
        F.when((k == "swap-number") & (i == F.col("_number")),
               F.when(t.rlike(pattern), swapped).otherwise(F.concat(t, F.lit(SAID["swap-number"]))))
        .when(k.isin("fabricate-entity", "claim-authorship") & (i == second),
              F.concat(t, F.when(k == "fabricate-entity", SAID["fabricate-entity"]).otherwise(SAID["claim-authorship"])))
        .when(k.isin("add-honorific", "claim-expertise") & (i == 0),
              F.concat(t, F.when(k == "add-honorific", SAID["add-honorific"]).otherwise(SAID["claim-expertise"])))
        .when((k == "invent-show-name") & (i == 0), F.concat(F.lit(SAID["invent-show-name"]), t))
        .when((k == "address-by-name") & (i == F.col("_last")), F.concat(F.lit(SAID["address-by-name"]), t))
        .otherwise(t)
    )
    speaker = F.when((k == "break-alternation") & (i == 1), F.col("_opener")).otherwise(F.col("speaker"))
    return each.filter((k != "truncate-dialogue") | (i < 3)).select("episode_id", "kind", "turn_idx", speaker.alias("speaker"), text.alias("text"))


def mutate(turns: DataFrame) -> DataFrame:
    """Every episode once as it is and once per corruption, in column ``kind``."""
    return _corrupted(_placed(turns), [CONTROL] + [k for k, _ in MUTATIONS])


def detection(turns: DataFrame, episodes: DataFrame, papers: DataFrame) -> DataFrame:
    """Per episode and corruption: did the named check pass clean, and fail corrupted.

    Each check is run on the episodes as they are and with its own corruption, on no other.
    """
    placed = cut_lineage(_placed(turns))
    named = cut_lineage(papers.join(_apart(episodes.select("paper_id").distinct()), "paper_id", "left_semi"))
    variant = F.concat_ws("|", "episode_id", "kind")
    results = []
    for kind, check in MUTATIONS:
        faulty = _corrupted(placed, [CONTROL, kind]).withColumn("episode_id", variant).drop("kind")
        asked = episodes.withColumn("kind", _kinds([CONTROL, kind])).withColumn("episode_id", variant).drop("kind")
        results.append(CHECK_OF[check](faulty, asked, named).select(
            F.substring_index("episode_id", "|", 1).alias("episode_id"), F.lit(kind).alias("kind"), "check_id",
            (F.substring_index("episode_id", "|", -1) == CONTROL).alias("_control"), "passed"))
    both = reduce(DataFrame.unionByName, results).groupBy("episode_id", "check_id", "kind").agg(
        F.max(F.when(~F.col("_control"), ~F.col("passed"))).alias("detected"), F.max(F.when(F.col("_control"), F.col("passed"))).alias("clean"))
    return both.select("episode_id", "check_id", "kind", "detected", "clean")


def detection_rate(detected: DataFrame) -> DataFrame:
    """Share of faults caught, where the clean episode passed the check."""
    return detected.groupBy("kind", "check_id").agg(
        F.sum(F.col("clean").cast("int")).alias("clean_controls"),
        F.sum((F.col("clean") & F.col("detected")).cast("int")).alias("caught"),
        F.round(F.avg(F.when(F.col("clean"), F.col("detected").cast("int"))), 6).alias("rate"),
    )


def append_turns(base: DataFrame, extra: DataFrame, fmt: str = "dialogue") -> DataFrame:
    """Add a continuation, dropping blank turns and turns out of order.

    Strict alternation keeps the first turn of every run of one speaker, save a
    first run by the speaker who spoke last.
    """
    filled = extra.filter(tx.strip(F.col("text")) != "")
    if fmt != "dialogue":
        kept = filled.filter(F.col("speaker") == "narrator")
    else:
        last = base.groupBy("episode_id").agg(F.max_by("speaker", "turn_idx").alias("_last"))
        spoken = filled.filter(F.col("speaker").isin("host", "guest"))
        runs = sg.neighbour(spoken, ["episode_id"], ["turn_idx"], sg.segment_of(F.col("turn_idx")), {"_before": F.col("speaker")})
        expected = F.when(F.col("_last") == "host", "guest").otherwise("host")
        kept = runs.join(last, "episode_id", "left").filter(
            F.when(F.col("_before").isNull(), F.col("speaker") == expected).otherwise(F.col("_before") != F.col("speaker"))
        ).drop("_before", "_last")
    tail = base.groupBy("episode_id").agg((F.max("turn_idx") + 1).alias("_n"))
    numbered = sg.running_sum(kept, ["episode_id"], ["turn_idx"], sg.segment_of(F.col("turn_idx")), F.lit(1), "_i")
    placed = numbered.join(tail, "episode_id", "left").withColumn(
        "turn_idx", (F.coalesce("_n", F.lit(0)) + F.col("_i")).cast("bigint"))
    cols = ["episode_id", "turn_idx", "speaker", "text"]
    return base.select(*cols).unionByName(placed.select(*cols))


def apply_revisions(turns: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rewrite turns; the last non-blank revision of a turn wins.

    ``revisions``: episode_id, turn_idx, rev_no, text. Revisions of turns that do
    not exist, and blank ones, change nothing.
    """
    text = tx.strip(F.col("text"))
    latest = revisions.withColumn("text", text).filter(F.col("text") != "").groupBy("episode_id", "turn_idx").agg(
        F.max_by("text", "rev_no").alias("_new"), F.min("text").alias("_lo"), F.max("text").alias("_hi"))
    changed = (F.col("_lo") != F.col("text")) | (F.col("_hi") != F.col("text"))
    return turns.join(latest, ["episode_id", "turn_idx"], "left").select(
        "episode_id", "turn_idx", "speaker", F.coalesce("_new", "text").alias("text"),
        F.coalesce(changed, F.lit(False)).alias("revised"),
    )


def revision_notes(claims: DataFrame, turns: DataFrame) -> DataFrame:
    """Failing claims of each existing turn, in order, as one note."""
    what = F.when(F.col("verdict") == "contradicted", "CONTRADICTS THE PAPER").otherwise("NOT IN THE PAPER")
    line = F.concat(what, F.lit(": "), F.col("claim"))
    failing = claims.filter((F.col("verdict") == "contradicted") | ((F.col("verdict") == "unsupported") & F.col("specific")))
    packed = F.array_sort(F.collect_list(F.struct("claim_no", line.alias("l"))))
    return failing.join(turns.select("episode_id", "turn_idx"), ["episode_id", "turn_idx"], "left_semi").groupBy(
        "episode_id", "turn_idx").agg(
        F.array_join(F.transform(packed, lambda e: e["l"]), "\n").alias("note"), F.count("*").alias("claims"))
