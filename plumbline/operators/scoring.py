"""Verdicts, coverage, review rounds, cost and response quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexicons as lx
from plumbline.functions import segments as sg
from plumbline.functions import text as tx


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def join_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts matched to factual claims, which are renumbered from 0 per episode.

    ``claims``: episode_id, claim_no, turn_idx, text, factual. ``verdicts``:
    episode_id, claim_index, verdict, evidence, specific.
    """
    factual = sg.running_sum(
        claims.filter("factual"), ["episode_id"], ["claim_no"], sg.segment_of(F.col("claim_no")), F.lit(1), "claim_index"
    ).withColumn("claim_index", F.col("claim_index").cast("bigint"))
    return factual.join(verdicts, ["episode_id", "claim_index"]).select(
        "episode_id", "claim_index", "turn_idx", F.col("text").alias("claim"), "verdict",
        F.nullif("evidence", F.lit("")).alias("evidence"), "specific",
    )


def must_fix() -> Column:
    verdict, specific = F.col("verdict"), F.col("specific")
    return (verdict == "contradicted") | ((verdict == "unsupported") & specific)


def faithfulness(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Share supported, and share contradicted or specifically unsupported."""
    v = F.col("verdict")
    counted = verdicts.groupBy(*keys).agg(
        F.count("*").alias("claims"), count_if(v == "supported").alias("supported"),
        count_if(v == "unsupported").alias("unsupported"), count_if(v == "contradicted").alias("contradicted"),
        count_if(must_fix()).alias("failures"),
    )
    return counted.withColumn("faithfulness", F.round(share(F.col("supported"), F.col("claims")), 6)).withColumn(
        "hallucination", F.round(share(F.col("failures"), F.col("claims")), 6))


def coverage(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Share of each paper's contributions conveyed, NULL where none is annotated, and which were and were not.

    ``results``: paper_id, contribution, mentioned. A paper's contributions are a short list.
    """
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("contribution"))))
    n = results.groupBy("paper_id").agg(F.count("*").alias("expected"), count_if(F.col("mentioned")).alias("hit"),
                                        listed(F.col("mentioned")).alias("hits"), listed(~F.col("mentioned")).alias("missed"))
    return papers.select("paper_id").join(n, "paper_id", "left").select(
        "paper_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("hit", F.lit(0)).alias("hit"),
        F.round(F.col("hit") / F.col("expected"), 6).alias("coverage"), "hits", "missed",
    )


def failures(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(must_fix())


def best_round(rounds: DataFrame) -> DataFrame:
    """Fewest failures, then most faithful, then earliest. ``improved``: not the first.

    ``rounds``: episode_id, round, failures, faithfulness.
    """
    best = F.min(F.struct("failures", (-F.col("faithfulness")).alias("f"), "round"))
    return rounds.groupBy("episode_id").agg(best.alias("b"), F.min("round").alias("first")).select(
        "episode_id", F.col("b.round").alias("best_round"), F.col("b.failures").alias("failures"),
        (-F.col("b.f")).alias("faithfulness"), (F.col("b.round") > F.col("first")).alias("improved"),
    )


def effective_rounds(rounds: DataFrame, target: float = 0.0) -> DataFrame:
    """Rounds that would have run: up to the first good enough, short of the first idle one.

    Adds to the columns above: hallucination, revised (turns changed).
    """
    good = (F.col("failures") == 0) | (F.col("hallucination") <= target)
    bounds = rounds.groupBy("episode_id").agg(
        F.min("round").alias("_first"), F.min(F.when(good, F.col("round"))).alias("_good"),
    )
    idle = rounds.join(bounds.select("episode_id", "_first"), "episode_id").filter(
        (F.col("round") > F.col("_first")) & (F.col("revised") == 0)).groupBy("episode_id").agg(F.min("round").alias("_idle"))
    return rounds.join(bounds, "episode_id").join(idle, "episode_id", "left").filter(
        (F.col("_good").isNull() | (F.col("round") <= F.col("_good"))) & (F.col("_idle").isNull() | (F.col("round") < F.col("_idle")))
    ).drop("_first", "_good", "_idle")


def review(rounds: DataFrame) -> DataFrame:
    """Before and after: the first round against the one kept."""
    first = F.min(F.struct("round", "failures", "faithfulness"))
    best = F.min(F.struct("failures", (-F.col("faithfulness")).alias("f"), "round"))
    return rounds.groupBy("episode_id").agg(first.alias("a"), best.alias("b"), F.count("*").alias("n")).select(
        "episode_id", F.col("a.faithfulness").alias("faithfulness_before"), (-F.col("b.f")).alias("faithfulness_after"),
        F.col("a.failures").alias("failures_before"), F.col("b.failures").alias("failures_after"),
        (F.col("n") - 1).alias("rounds"), (F.col("b.round") > F.col("a.round")).alias("improved"),
    )


def violations(fixtures: DataFrame, measured: DataFrame) -> DataFrame:
    """Which bounds each fixture broke.

    ``fixtures``: fixture_id, min/max_faithfulness, min/max_errors (NULL: no bound).
    ``measured``: fixture_id, faithfulness, errors.
    """
    f, e = F.col("faithfulness"), F.col("errors")
    broken = F.array_compact(F.array(
        F.when(f < F.col("min_faithfulness"), "faithfulness below minimum"),
        F.when(f > F.col("max_faithfulness"), "faithfulness above maximum"),
        F.when(e < F.col("min_errors"), "too few errors"),
        F.when(e > F.col("max_errors"), "too many errors"),
    ))
    return fixtures.join(measured, "fixture_id", "left").select("fixture_id", broken.alias("violations"))


def judge_variance(runs: DataFrame) -> DataFrame:
    """Mean and spread of repeated judgements. ``runs``: paper_id, generator, run, faithfulness."""
    return runs.groupBy("paper_id", "generator").agg(
        F.count("*").alias("runs"), F.round(F.avg("faithfulness"), 6).alias("mean"),
        F.round(F.max("faithfulness") - F.min("faithfulness"), 6).alias("spread"),
    )


def gap_decides(variance: DataFrame) -> DataFrame:
    """Whether generators of one paper differ by more than the judge does with itself."""
    return variance.groupBy("paper_id").agg(
        F.round(F.max("mean") - F.min("mean"), 6).alias("gap"), F.max("spread").alias("noise")
    ).withColumn("decided", F.col("gap") > F.col("noise"))


def pricing(spark) -> DataFrame:
    return spark.createDataFrame(lx.PRICING, "model string, p_in double, p_out double, p_cache double")


def cost(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Dollars per call; NULL where the model has no price, ``free`` where it runs locally.

    ``usage``: model, provider, input_tokens, output_tokens, cache_read_tokens, any of them NULL.
    """
    fixed = prices is None
    prices = pricing(usage.sparkSession) if fixed else prices
    # The built-in price list has a handful of rows; another's size is Spark's to judge.
    side = F.broadcast(prices) if fixed else prices
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    fresh = F.greatest(F.lit(0), z("input_tokens") - z("cache_read_tokens"))
    usd = (fresh * F.col("p_in") + z("cache_read_tokens") * F.col("p_cache") + z("output_tokens") * F.col("p_out")) / 1e6
    return usage.join(side, "model", "left").withColumn("usd", usd).withColumn(
        "label", F.when(F.col("p_in").isNotNull(), "priced").when(F.col("provider") == "open", "free").otherwise("unknown")
    ).drop("p_in", "p_out", "p_cache")


def leaderboard(runs: DataFrame, scores: DataFrame, covered: DataFrame, checks: DataFrame, costs: DataFrame) -> DataFrame:
    """One row per run with every measure and its failing error checks.

    ``runs``: run_id, paper_id, generator, judge. The rest are keyed by run_id.
    """
    bad = F.when(~F.col("passed") & (F.col("severity") == "error"), F.col("check_id"))
    # As many names as there are checks, so the list is short.
    graded = checks.groupBy("run_id").agg(
        F.round(F.avg(F.col("passed").cast("int")), 6).alias("compliance"), F.count(bad).alias("errors"),
        F.array_join(F.array_sort(F.collect_list(bad)), ",").alias("failing"),
    )
    out = runs
    for side in (scores.select("run_id", "faithfulness", "hallucination"), covered.select("run_id", "coverage"), graded,
                 costs.select("run_id", "usd")):
        out = out.join(side, "run_id", "left")
    return out.withColumn("self_judged", F.col("generator") == F.col("judge"))


def sum_usage(usage: DataFrame, fields: list[str], *keys: str, none_if_unknown: bool = False) -> DataFrame:
    """Tokens per field; unknown counts as 0, or stays NULL when nothing is known."""
    total = lambda c: F.sum(c) if none_if_unknown else F.coalesce(F.sum(c), F.lit(0))
    return usage.groupBy(*keys).agg(*[total(c).alias(c) for c in fields])


def truncated_calls(calls: DataFrame) -> DataFrame:
    """Calls whose server read far fewer tokens than were sent. ``calls``: chars, processed."""
    est = F.ceil(F.col("chars") / 4)
    return calls.withColumn("estimated", est).withColumn("truncated", (
        (F.coalesce("processed", F.lit(0)) > 0) & (est - F.col("processed") >= 500) & (F.col("processed") < 0.7 * est)))


def response_json(c: Column) -> Column:
    """The JSON in a reply: inside a fence, or from the first brace to the last."""
    t = tx.strip(c)
    fenced = F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", tx.strip(fenced)).when(~t.startswith("{") & (braced != ""), braced).otherwise(t)


def triage_responses(log: DataFrame, text: str = "response") -> DataFrame:
    """ok, schema-echo (the schema came back instead of data) or invalid."""
    value = F.try_parse_json(F.col("_json"))
    has = lambda key: F.variant_get(value, f"$.{key}", "variant").isNotNull()
    echo = (F.try_variant_get(value, "$.type", "string") == "object") & (has("properties") | has("required"))
    return log.withColumn("_json", response_json(F.col(text))).withColumn(
        "outcome", F.when(value.isNull(), "invalid").when(F.coalesce(echo, F.lit(False)), "schema-echo").otherwise("ok")
    ).drop("_json")


def attempt_stats(attempts: DataFrame, *keys: str) -> DataFrame:
    """Attempts, rejects, retries and how each call ended. ``attempts``: attempt, rejected."""
    last = F.max_by("rejected", "attempt")
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"), count_if(F.col("rejected")).alias("rejects"),
        (F.count("*") - 1).alias("retries"), F.when(last, "failed").otherwise("ok").alias("outcome"),
    )


# Error patterns in order; the first that matches names the error.
ERROR_RULES = [
    ("no_credit", r"credit balance|insufficient[_ ]quota|billing|payment required|402"),
    ("auth_failed", r"api key|apikey|unauthorized|401|authentication"),
    ("rate_limited", r"rate limit|429|quota"),
    ("provider_unavailable", r"(?<![A-Za-z0-9_])50[0234](?![A-Za-z0-9_])|service unavailable|overloaded|temporarily unavailable"),
    ("provider_unreachable", r"ECONNREFUSED|fetch failed|ENOTFOUND|network"),
    ("voice_missing", r"(?s)^(?=.*piper synthesis failed)(?=.*(unable to find voice|no such file|cannot find|not found|ENOENT))"),
    ("synthesis_failed", r"piper synthesis failed"),
    ("audio_join_failed", r"different audio format|only uncompressed pcm|no audio to join|wave file has no|not a wave"),
    ("unreadable_input", r"Could not extract text|no dialogue turns|not a riff|pdf"),
]
NAMED_ERRORS = {"ContextTruncationError": "context_truncated", "OutputTruncationError": "output_truncated"}


def error_code(message: Column, name: Column | None = None) -> Column:
    code = F.lit("internal")
    for label, pattern in reversed(ERROR_RULES):
        code = F.when(message.rlike("(?i)" + pattern), label).otherwise(code)
    if name is not None:
        for error, label in NAMED_ERRORS.items():
            code = F.when(name == error, label).otherwise(code)
    return code


def classify_errors(log: DataFrame, message: str = "message", name: str | None = None) -> DataFrame:
    return log.withColumn("code", error_code(F.col(message), F.col(name) if name else None))
