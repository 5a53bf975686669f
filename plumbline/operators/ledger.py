"""What has been learned, what is missing, and what to read next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.session import cut_lineage

TITLE_SHARE = 0.6
LINK_WORDS, LINK_SHARE = 8, 0.5


def item_key(c: Column) -> Column:
    return tx.squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", ""))


def merge_learned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by wording: the first date stays, and verified replaces stated.

    Both: paper_id, text, provenance, first_seen, item_no (order met).
    """
    rows = old.withColumn("_wave", F.lit(0)).unionByName(new.withColumn("_wave", F.lit(1)))
    rank = F.struct(F.when(F.col("provenance") == "verified", 0).otherwise(1).alias("p"), "_wave", "first_seen", "item_no")
    return rows.groupBy("paper_id", item_key(F.col("text")).alias("item_key")).agg(
        F.min_by(F.struct("text", "provenance"), rank).alias("b"), F.min("first_seen").alias("first_seen")
    ).select("paper_id", "item_key", "b.text", "b.provenance", "first_seen")


def learned_items(verdicts: DataFrame, key_points: DataFrame) -> DataFrame:
    """Supported claims where an episode was judged, else its key points.

    ``verdicts``: episode_id, claim, verdict. ``key_points``: episode_id, text.
    """
    checked = verdicts.filter(F.col("verdict") == "supported").select("episode_id", F.col("claim").alias("text"), F.lit("verified").alias("provenance"))
    stated = key_points.join(verdicts.select("episode_id").distinct(), "episode_id", "left_anti").select(
        "episode_id", "text", F.lit("stated").alias("provenance"))
    return checked.unionByName(stated)


def merge_coverage(old: DataFrame, new: DataFrame) -> DataFrame:
    """paper_id, contribution, covered: one row per contribution still known of.

    What any episode covered is covered. What is missed comes from the newest
    measurement, or stays as it was where a paper was not measured again.
    """
    covered = old.filter("covered").unionByName(new.filter("covered")).select("paper_id", "contribution").distinct()
    measured = new.select("paper_id").distinct()
    stale = old.filter("not covered").join(measured, "paper_id", "left_anti")
    missed = new.filter("not covered").unionByName(stale).select("paper_id", "contribution").distinct()
    gaps = missed.join(covered, ["paper_id", "contribution"], "left_anti")
    return covered.withColumn("covered", F.lit(True)).unionByName(gaps.withColumn("covered", F.lit(False)))


def link_items(items: DataFrame, turns: DataFrame, timings: DataFrame) -> DataFrame:
    """The earliest turn that holds most of an item's first long words, if half of them.

    ``items``: item_id, episode_id, text.
    """
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z0-9'-]{4,}"), F.lit(0)), 1, LINK_WORDS)
    wanted = items.select("item_id", "episode_id", words.alias("words")).filter(F.size("words") > 0)
    said = turns.select("episode_id", "turn_idx", F.lower("text").alias("said"))
    share = F.size(F.filter("words", lambda w: F.contains(F.col("said"), w))) / F.size("words")
    best = F.min(F.struct((-F.col("share")).alias("s"), "turn_idx"))
    found = wanted.join(said, "episode_id").withColumn("share", share).filter(F.col("share") >= LINK_SHARE)
    linked = found.groupBy("item_id", "episode_id").agg(best.alias("b")).select("item_id", "episode_id", F.col("b.turn_idx").alias("turn_idx"))
    starts = timings.select("episode_id", "turn_idx", F.round("start_ms").cast("bigint").alias("start_ms"))
    return items.select("item_id", "episode_id").join(linked, ["item_id", "episode_id"], "left").join(starts, ["episode_id", "turn_idx"], "left")


def open_gaps(ledger: DataFrame) -> DataFrame:
    return ledger.filter("not covered").select("paper_id", "contribution")


def title_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(tx.title_key(c), " "), lambda w: F.length(w) > 3))


def titles_match(a: Column, b: Column) -> Column:
    wa, wb = title_words(a), title_words(b)
    small = F.least(F.size(wa), F.size(wb))
    return (small > 0) & (F.size(F.array_intersect(wa, wb)) >= TITLE_SHARE * small - 1e-9)


def matching_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of every two distinct titles that name one work.

    The smaller set must leave all but the rarest few of its words in the other,
    so at least one of its rarest is shared: titles meet on those alone.
    ``left``/``right``: title.
    """
    shape = lambda df: df.select("title").distinct().select("title", title_words(F.col("title")).alias("w")).withColumn(
        "n", F.size("w")).filter(F.col("n") > 0)
    l, r = shape(left), shape(right)
    every = l.select(F.explode("w").alias("word")).unionByName(r.select(F.explode("w").alias("word")))
    freq = every.groupBy("word").agg(F.count("*").alias("f"))
    need = F.ceil(F.col("n") * F.lit(TITLE_SHARE) - 1e-9)
    rare = Window.partitionBy("title").orderBy("f", "word")

    def prefix(df):
        words = df.select("title", "n", F.explode("w").alias("word")).join(freq, "word")
        return words.withColumn("_r", F.row_number().over(rare)).filter(F.col("_r") <= F.col("n") - need + 1).select("title", "n", "word")

    def meet(small, large, a, b):
        s = prefix(small).select(F.col("title").alias(a), F.col("n").alias("sn"), "word")
        g = large.select(F.col("title").alias(b), F.col("n").alias("ln"), F.explode("w").alias("word"))
        return s.join(g, "word").filter(F.col("ln") >= F.col("sn")).select("a", "b")

    pairs = meet(l, r, "a", "b").unionByName(meet(r, l, "b", "a")).distinct()
    wa, wb = l.select(F.col("title").alias("a"), F.col("w").alias("wa")), r.select(F.col("title").alias("b"), F.col("w").alias("wb"))
    small = F.least(F.size("wa"), F.size("wb"))
    return pairs.join(wa, "a").join(wb, "b").filter(
        F.size(F.array_intersect("wa", "wb")) >= TITLE_SHARE * small - 1e-9).select("a", "b")


def lead_titles(first_seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """title -> the earlier title that leads its group, as a one-by-one pass would give.

    A title leads when no earlier leader matches it. Each round settles every
    title whose earlier matches are settled. ``first_seen``: title, ord (unique).
    """
    order = first_seen.select("title", "ord")
    back = (
        pairs.join(order.select(F.col("title").alias("a"), F.col("ord").alias("ao")), "a")
        .join(order.select(F.col("title").alias("b"), F.col("ord").alias("bo")), "b")
        .filter(F.col("bo") < F.col("ao")).select(F.col("a").alias("title"), F.col("b").alias("earlier"), F.col("bo").alias("earlier_ord"))
    )
    back = cut_lineage(back)
    state = cut_lineage(order.withColumn("lead", F.lit(None).cast("string")))
    while True:
        known = state.select(F.col("title").alias("earlier"), F.col("lead").alias("elead"))
        view = back.join(known, "earlier").groupBy("title").agg(
            F.min(F.when(F.col("elead").isNull(), F.col("earlier_ord"))).alias("open"),
            F.min(F.when(F.col("elead") == F.col("earlier"), F.struct("earlier_ord", "earlier"))).alias("led"))
        led, free = F.col("led.earlier_ord"), F.col("open")
        # The first leader is final once nothing open stands before it.
        settled = F.when(F.col("lead").isNotNull(), F.col("lead")).when(
            led.isNotNull() & (free.isNull() | (led < free)), F.col("led.earlier")).when(
            led.isNull() & free.isNull(), F.col("title"))
        state = cut_lineage(state.join(view, "title", "left").select("title", "ord", settled.alias("lead")))
        if state.filter(F.col("lead").isNull()).isEmpty():
            return state.select("title", "lead")


def suggest(refs: DataFrame, library: DataFrame, limit: int = 10) -> DataFrame:
    """Works cited by most papers and not yet in the library.

    ``refs``: paper_id, ref_idx, title, year. ``library``: title.
    """
    place = F.struct("paper_id", "ref_idx")
    cited = refs.groupBy("title").agg(F.min(F.struct(place.alias("p"), "year")).alias("m")).select("title", F.col("m.p").alias("ord"), F.col("m.year").alias("year"))
    lead = lead_titles(cited, matching_titles(cited, cited))
    count = refs.select("paper_id", "title").distinct().join(lead, "title").groupBy("lead").agg(F.countDistinct("paper_id").alias("citations"))
    known = matching_titles(cited, library).select(F.col("a").alias("lead")).distinct()
    return (
        count.join(known, "lead", "left_anti").join(cited.select(F.col("title").alias("lead"), "year", "ord"), "lead")
        .orderBy(F.desc("citations"), F.desc(F.coalesce("year", F.lit(0))), "ord").limit(limit)
        .select(F.col("lead").alias("title"), "year", "citations")
    )


def ledger_summary(learned: DataFrame, coverage: DataFrame, studied: DataFrame) -> DataFrame:
    """Papers, episodes, items learned and verified, gaps. ``studied``: paper_id, episode_id."""
    one = lambda df, **aggs: df.agg(*[v.alias(k) for k, v in aggs.items()]).withColumn("_k", F.lit(1))
    a = one(studied, papers=F.countDistinct("paper_id"), episodes=F.count("*"))
    b = one(learned, learned=F.count("*"), verified=F.coalesce(F.sum(F.when(F.col("provenance") == "verified", 1).otherwise(0)), F.lit(0)))
    c = one(open_gaps(coverage), gaps=F.count("*"))
    return a.join(b, "_k").join(c, "_k").drop("_k")
