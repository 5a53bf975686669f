"""Ranking a paper's sections against readers' questions.

A question is asked of one paper, so every join is on the paper (and the word),
and the work grows with the matches rather than with questions times sections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import segments as sg
from plumbline.functions import text as tx

K1, B = 1.5, 0.75
RRF_DAMPING = 60
DENSE_CANDIDATES = 5
CONTEXT_BUDGET = 10_000
SMALL_PAPER = 8_000
FRAMING = r"(?i)^(abstract|\d+\.?\s*)?(introduction|background)?$"
HISTORY_TURNS = 6
OBSERVATION_BUDGET = 18_000
CUT_MARK = "\n[…cut for length]"

DenseScorer = Callable[[DataFrame, DataFrame], DataFrame]


def stable(score: Column) -> Column:
    """Scores are summed in no fixed order, so ranks compare nine decimals."""
    return F.round(score, 9)


def _ids_repeat(papers: DataFrame) -> bool:
    return not papers.groupBy("paper_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def term_counts(papers: DataFrame, text: str = "text") -> DataFrame:
    """paper_id, word, n. A paper's words are counted beside its text and not shuffled, unless ids have several rows."""
    words = tx.terms(F.col(text))
    if _ids_repeat(papers):
        bags = papers.groupBy("paper_id").agg(F.flatten(F.collect_list(words)).alias("words"))
    else:
        bags = papers.select("paper_id", words.alias("words"))
    return bags.select("paper_id", F.inline(tx.tally(F.col("words"))))


def idf_of(total: Column, df: Column) -> Column:
    return F.log(1 + total / (1 + df))


def _idf(papers: DataFrame) -> DataFrame:
    """idf of papers that are one row each, with their sections in the array ``contents``."""
    words = F.flatten(F.transform("contents", lambda c: F.array_distinct(tx.terms(c))))
    bags = papers.select("paper_id", F.size("contents").alias("total"), F.inline(tx.tally(words, "df")))
    return bags.select("paper_id", "word", idf_of(F.col("total"), F.col("df")).alias("idf"))


def idf(sections: DataFrame) -> DataFrame:
    """paper_id, word, idf over the sections of each paper."""
    # A paper's text travels once, and its words are counted in one row, no larger than the text.
    return _idf(sections.select("paper_id", "content").repartition("paper_id").groupBy("paper_id").agg(
        F.collect_list("content").alias("contents")))


def idf_in_texts(papers: DataFrame, cut: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """idf of whole papers, whose texts ``cut`` turns into sections. Nothing of a paper is shuffled, unless ids have several rows."""
    contents = cut(F.col(text))
    if _ids_repeat(papers):
        return idf(papers.select("paper_id", F.explode(contents).alias("content")))
    return _idf(papers.select("paper_id", contents.alias("contents")))


def bm25(sections: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, paper_id, section_idx, score; only sections that match."""
    asked = questions.select(
        "question_id", "paper_id", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("word")
    )
    wanted = asked.groupBy("paper_id").agg(F.collect_set("word").alias("wanted"))
    # Only papers that were asked about are read into words; the words asked for meet
    # a section's own beside its text, so no others are exploded or shuffled.
    bag = sections.join(wanted, "paper_id").select(
        "paper_id", "section_idx", "wanted", tx.terms(F.col("content")).alias("body"), tx.terms(F.col("heading")).alias("head")
    )
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    found = F.transform(F.array_intersect(F.concat("body", "head"), "wanted"), lambda w: F.struct(
        w.alias("word"), times(F.col("body"), w).alias("b"), times(F.col("head"), w).alias("h")))
    paper = Window.partitionBy("paper_id")
    shaped = (
        bag.select("paper_id", "section_idx", F.size("body").alias("len"), found.alias("found"))
        .withColumn("total", F.count("*").over(paper))
        .withColumn("mean", F.greatest(F.lit(1.0), F.sum("len").over(paper) / F.col("total")))
    )
    hits = (
        shaped.select("paper_id", "section_idx", "len", "total", "mean", F.inline("found"))
        .groupBy("paper_id", "word", "section_idx", "len", "total", "mean").agg(F.sum("b").alias("tf"), F.sum("h").alias("hf"))
        .withColumn("idf", idf_of(F.col("total"), F.count(F.when(F.col("tf") > 0, 1)).over(Window.partitionBy("paper_id", "word"))))
    )
    norm = 1 - B + B * F.col("len") / F.col("mean")
    part = F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm) + 2 * F.col("hf"))
    scored = hits.select("paper_id", "word", "section_idx", part.alias("part"))
    return (
        asked.join(scored, ["paper_id", "word"])
        .groupBy("question_id", "paper_id", "section_idx").agg(stable(F.sum("part")).alias("score"))
    )


def rank(scores: DataFrame, keep: Column | None = None) -> DataFrame:
    """Zero-based rank within each question, best first, document order on ties."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "section_idx")
    kept = scores if keep is None else scores.filter(keep)
    return kept.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


def lexical_rank(sections: DataFrame, questions: DataFrame) -> DataFrame:
    return rank(bm25(sections, questions), F.col("score") > 0)


def gate_dense(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Dense candidates at the head of their ranking, or already matched by words."""
    seen = lexical.select("question_id", "section_idx", F.lit(True).alias("_lexical"))
    return (
        dense.join(seen, ["question_id", "section_idx"], "left")
        .filter((F.col("rank") < DENSE_CANDIDATES) | F.col("_lexical")).drop("_lexical")
    )


def fuse(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two rankings; ties keep document order."""
    keys = ["question_id", "paper_id", "section_idx"]
    left = lexical.select(*keys, F.col("rank").alias("l"))
    right = dense.select(*keys, F.col("rank").alias("d"))
    part = lambda c: F.coalesce(1 / (F.lit(RRF_DAMPING) + F.col(c)), F.lit(0.0))
    return rank(left.join(right, keys, "full").select(*keys, stable(part("l") + part("d")).alias("score")))


def rank_sections(
    questions: DataFrame, sections: DataFrame, dense: DenseScorer | None = None,
    require_lexical: bool = True,
) -> DataFrame:
    """Ranked sections per question, with what ranked them.

    ``dense`` scores sections for questions, or returns None where it cannot;
    then words alone rank. With ``require_lexical`` a question no section shares
    a word with yields nothing.
    """
    lexical = lexical_rank(sections, questions)
    matched = lexical.select("question_id").distinct()
    scores = None
    if dense is not None:
        asked = questions.join(matched, "question_id", "left_semi") if require_lexical else questions
        scores = dense(asked, sections)
    if scores is None:
        ranked, method = lexical, "lexical"
    else:
        ranked, method = fuse(lexical, gate_dense(rank(scores), lexical)), "hybrid"
    flag = matched.withColumn("_m", F.lit(True))
    return (
        ranked.join(flag, "question_id", "left")
        .withColumn("lexical_match", F.coalesce("_m", F.lit(False))).drop("_m")
        .withColumn("method", F.lit(method))
    )


def _fold(items: Column, start: Column, budget: int, force_first: bool) -> Column:
    """Walk (idx, len) in order, skipping what does not fit."""

    def step(state, item):
        fits = state["used"] + item["len"] <= budget
        take = (fits | (F.size(state["chosen"]) == 0)) if force_first else (
            fits & ~F.array_contains(state["chosen"], item["idx"])
        )
        return F.when(
            take,
            F.struct(
                (state["used"] + item["len"]).alias("used"),
                F.array_append(state["chosen"], item["idx"]).alias("chosen"),
            ),
        ).otherwise(state)

    return F.aggregate(items, start, step)


def select_context(
    questions: DataFrame, sections: DataFrame, ranked: DataFrame, budget: int = CONTEXT_BUDGET,
    small: int = SMALL_PAPER,
) -> DataFrame:
    """What to send for each question: the picked sections, or the whole paper.

    The arrays folded here hold one paper's sections and no text.
    """
    framing = tx.strip(F.col("heading")).rlike(FRAMING)
    item = F.struct(F.col("section_idx").alias("idx"), F.length("content").cast("bigint").alias("len"))
    block = F.length("heading") + F.length("content") + 4
    paper = sections.groupBy("paper_id").agg(
        F.count("*").alias("total"),
        (F.sum(block) + 2 * (F.count("*") - 1)).alias("whole_chars"),
        F.array_sort(F.collect_list(F.when(framing, item))).alias("frame"),
    )
    size = sections.select("paper_id", "section_idx", F.length("content").cast("bigint").alias("len"),
                           block.alias("block"))
    order = F.array_sort(F.collect_list(F.struct("rank", F.col("section_idx").alias("idx"), "len")))
    walk = (
        ranked.join(size, ["paper_id", "section_idx"]).groupBy("question_id", "paper_id")
        .agg(order.alias("walk"), F.first("method").alias("method"))
    )
    empty = F.struct(F.lit(0).cast("bigint").alias("used"),
                     F.array().cast("array<int>").alias("chosen"))
    # A question with no match falls back to the whole paper.
    base = (
        questions.select("question_id", "paper_id", F.size(tx.terms(F.col("text"))).alias("n_terms"))
        .join(paper, "paper_id").join(walk, ["question_id", "paper_id"], "left")
    )
    first = base.withColumn("picked", _fold(F.coalesce("walk", F.array()), empty, budget, True))
    both = first.withColumn("picked", _fold(F.col("frame"), F.col("picked"), budget, False))
    whole = (
        (F.col("whole_chars") <= small) | (F.col("n_terms") == 0) | F.col("walk").isNull()
        | (F.size("picked.chosen") == F.col("total"))
    )
    none = F.array().cast("array<int>")
    return both.select(
        "question_id", "paper_id", whole.alias("whole"),
        F.when((F.col("whole_chars") <= small) | (F.col("n_terms") == 0) | F.col("walk").isNull(), "lexical")
        .otherwise(F.col("method")).alias("method"),
        F.when(whole, none).otherwise(F.array_sort("picked.chosen")).alias("sections"),
        F.when(whole, F.col("whole_chars")).otherwise(F.col("picked.used")).alias("chars"),
    )


def best_snippet(results: DataFrame, limit: int = 220) -> DataFrame:
    """The sentence of each result that shares most words with its query; earliest wins."""
    words = F.filter(F.array_distinct(F.split(tx.heading_key(F.col("query")), " ")), lambda w: F.length(w) > 2)
    best = tx.let(words, lambda wanted: F.array_max(F.transform(
        tx.sentences_after_mark(F.col("content")),
        lambda s, i: F.struct(
            F.size(F.filter(F.split(tx.heading_key(s), " "), lambda w: F.array_contains(wanted, w))).alias("hits"),
            (-i).alias("back"), s.alias("sentence"),
        ),
    )))["sentence"]
    return results.withColumn("_best", best).withColumn(
        "snippet", tx.clip(tx.squeeze(F.col("_best")), limit)
    ).drop("_best")


def find_phrase(sections: DataFrame, phrases: DataFrame, hits: int = 6, limit: int = 300) -> DataFrame:
    """First sentences of each paper that hold the phrase asked of it."""
    needle = F.lower(tx.strip(F.col("phrase")))
    asked = phrases.withColumn("needle", needle).filter(F.length("needle") >= 2)
    found = F.filter(
        F.transform(tx.sentences_after_mark(F.col("content")), lambda s, i: F.struct(i.alias("pos"), s.alias("s"))),
        lambda e: F.contains(F.lower(e["s"]), F.col("needle")),
    )
    rows = asked.join(sections, "paper_id").select(
        "question_id", "phrase", "section_idx", F.explode(found).alias("hit")
    )
    order = Window.partitionBy("question_id").orderBy("section_idx", "hit.pos")
    return rows.withColumn("hit_no", F.row_number().over(order)).filter(F.col("hit_no") <= hits).select(
        "question_id", "phrase", "section_idx", "hit_no",
        tx.clip(tx.squeeze(F.col("hit.s")), limit).alias("sentence"),
    )


def resolve_heading(sections: DataFrame, asked: DataFrame) -> DataFrame:
    """The section a requested heading means: equal, same words, prefix, then substring."""
    want, have = F.col("want"), F.col("have")
    tier = (
        F.when(F.col("heading") == F.col("asked"), 0).when(have == want, 1)
        .when(have.startswith(want), 2).when(F.contains(have, want), 3)
    )
    pairs = (
        asked.withColumn("want", tx.heading_key(F.col("asked"))).filter(want != "")
        .join(sections.select("paper_id", "section_idx", "heading", tx.heading_key(F.col("heading")).alias("have")), "paper_id")
        .withColumn("tier", tier).filter(F.col("tier").isNotNull())
    )
    best = F.min(F.struct("tier", "section_idx", "heading"))
    return pairs.groupBy("question_id", "asked").agg(best.alias("b")).select(
        "question_id", "asked", "b.tier", "b.section_idx", "b.heading"
    )


def page_slices(texts: DataFrame, key: str, content: str, size: int = 5_000) -> DataFrame:
    """Slices of a long text, each with what remains after it."""
    length = F.length(content)
    start = F.explode(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(size)))
    cut = texts.filter(length > 0).select(key, content, start.alias("start"))
    rest = F.greatest(length - F.col("start") - size, F.lit(0))
    return cut.select(
        key, "start", F.substring(F.col(content), F.col("start") + 1, F.lit(size)).alias("part"),
        rest.alias("remaining"),
        F.when(F.col("start") > 0, "continued").when(rest > 0, "first part").otherwise("whole section").alias("note"),
    )


def history_tail(turns: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """The last turns of each conversation as one labelled text."""
    latest = Window.partitionBy("episode_id").orderBy(F.desc("turn_idx"))
    label = F.when(F.col("speaker") == "host", "READER: ").otherwise("YOU: ")
    tail = turns.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= n)
    lines = F.array_sort(F.collect_list(F.struct("turn_idx", F.concat(label, "text").alias("line"))))
    return tail.groupBy("episode_id").agg(
        F.array_join(F.transform(lines, lambda e: e["line"]), "\n").alias("history"),
        F.count("*").alias("n_turns"),
    )


def fit_history(turns: DataFrame, budget: int = OBSERVATION_BUDGET, floor: int = 400) -> DataFrame:
    """Keep the newest observations whole and cut the older ones.

    Once one is cut nothing is left for the rest, so what remains before a turn
    is the budget less everything newer: a running sum, not a fold.
    """
    back = turns.withColumn("_back", -F.col("turn_idx"))
    summed = sg.running_sum(
        back, ["episode_id"], ["_back"], sg.segment_of(F.col("_back")), F.length("text"), "_newer"
    )
    left = F.greatest(F.lit(0), F.lit(budget) - F.col("_newer"))
    cut = F.length("text") > left
    kept = F.when(
        cut, F.concat(F.substring(F.col("text"), F.lit(1), F.greatest(F.lit(floor), left).cast("int")), F.lit(CUT_MARK))
    ).otherwise(F.col("text"))
    return summed.select("episode_id", "turn_idx", cut.alias("was_cut"), kept.alias("observation"))


def hit_rate(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of questions whose known section was retrieved, per method."""
    hits = retrieved.select("method", "question_id", "section_idx").distinct().withColumn("_hit", F.lit(1))
    methods = retrieved.select("method").distinct()
    # A handful of method names, so pairing them with every question is small.
    asked = gold.withColumn("method", F.explode(F.array(*[F.lit(m) for m in ("lexical", "hybrid")])))
    per = (
        asked.join(methods, "method", "left_semi")
        .join(hits, ["method", "question_id", "section_idx"], "left")
        .groupBy("method", "question_id").agg(F.max(F.coalesce("_hit", F.lit(0))).alias("hit"))
    )
    return per.groupBy("method").agg(
        F.count("*").alias("questions"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("rate")
    )
