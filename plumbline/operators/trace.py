"""Trace spans: forests, roll-ups and logs.

Trees are walked by doubling the jump to an ancestor, so the rounds grow with
the logarithm of the depth and no table of all ancestors is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import segments as sg
from plumbline.session import cut_lineage

PAYLOAD_MAX = 4_000
ROOT = -1


def span_roots(spans: DataFrame) -> DataFrame:
    """Each span's parent, NULL where the parent is absent: those are roots."""
    known = spans.select(F.col("span_id").alias("parent_id"), F.lit(True).alias("_p"))
    return spans.join(known, "parent_id", "left").withColumn("parent_id", F.when(F.col("_p"), F.col("parent_id"))).drop("_p")


def subtree_totals(spans: DataFrame, fields: list[str]) -> DataFrame:
    """Sum of each field over a span and all below it.

    After round k a span holds the sums of everything less than 2^k levels below.
    """
    z = [F.coalesce(F.col(f), F.lit(0)).alias(f) for f in fields]
    state = cut_lineage(span_roots(spans).select("span_id", F.col("parent_id").alias("up"), *z))
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        lifted = state.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("span_id")).agg(*[F.sum(f).alias("_" + f) for f in fields])
        jump = state.select(F.col("span_id").alias("up"), F.col("up").alias("_up2"))
        state = cut_lineage(
            state.join(jump, "up", "left").join(lifted, "span_id", "left").select(
                "span_id", F.col("_up2").alias("up"), *[(F.col(f) + F.coalesce(F.col("_" + f), F.lit(0))).alias(f) for f in fields]))
    return state.drop("up")


def preorder(spans: DataFrame) -> DataFrame:
    """span_id, depth, position: spans as a waterfall lists them, siblings by start.

    A span stands one after its parent, past the subtrees of its earlier siblings;
    those steps are summed up the tree.
    """
    rooted = span_roots(spans).select("span_id", "parent_id", "start")
    size = subtree_totals(rooted.withColumn("size", F.lit(1)), ["size"])
    placed = rooted.join(size, "span_id").withColumn("family", F.coalesce("parent_id", F.lit(ROOT)))
    hour = F.floor(F.col("start").cast("double") / 3600).cast("bigint")
    shifted = sg.running_sum(placed, ["family"], ["start", "span_id"], hour, F.col("size"), "ahead")
    step = F.col("ahead") + F.when(F.col("parent_id").isNull(), 0).otherwise(1)
    state = cut_lineage(shifted.select(
        "span_id", F.col("parent_id").alias("up"), step.alias("position"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth")))
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        jump = state.select(F.col("span_id").alias("up"), F.col("up").alias("_up2"), F.col("position").alias("_p"), F.col("depth").alias("_d"))
        state = cut_lineage(state.join(jump, "up", "left").select(
            "span_id", F.col("_up2").alias("up"),
            (F.col("position") + F.coalesce("_p", F.lit(0))).alias("position"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
    return state.select("span_id", F.col("depth").cast("bigint").alias("depth"), F.col("position").cast("bigint").alias("position"))


def duration_ms(pair: Column) -> Column:
    """[seconds, nanoseconds] as milliseconds."""
    return pair[0] * 1000 + pair[1] / 1_000_000


def call_log(spans: DataFrame, scope: str | None = None) -> DataFrame:
    """Spans that name an operation or are in our scope, in readable columns.

    ``spans``: span_id, name, attributes, duration ([s, ns]), status, message, scope.
    """
    a = lambda k: F.col("attributes")[k]
    ours = a("gen_ai.operation.name").isNotNull()
    if scope is not None:
        ours = ours | F.coalesce(F.col("scope") == scope, F.lit(False))
    failed = F.col("status") == "error"
    return spans.filter(ours).select(
        "span_id", "name", F.coalesce(a("gen_ai.response.model"), a("gen_ai.request.model")).alias("model"),
        F.coalesce(a("gen_ai.usage.input_tokens").cast("bigint"), F.lit(0)).alias("input_tokens"),
        F.coalesce(a("gen_ai.usage.output_tokens").cast("bigint"), F.lit(0)).alias("output_tokens"),
        F.nullif(a("gen_ai.usage.cache_read.input_tokens").cast("bigint"), F.lit(0)).alias("cached_tokens"),
        duration_ms(F.col("duration")).alias("duration_ms"), failed.alias("failed"),
        F.when(failed, F.col("message")).alias("message"))


def span_lines(spans: DataFrame) -> DataFrame:
    """One JSON object per span as it is logged; absent fields are left out.

    ``spans``: span_id, trace_id, parent_id, name, start, duration_ms, status, error, attributes.
    """
    line = F.to_json(F.struct(
        F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"), "name", F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"), F.col("parent_id").alias("parentSpanId"), F.round("duration_ms", 2).alias("durationMs"),
        "status", "error", "attributes"))
    return spans.select("span_id", line.alias("value"))


def truncate_payload(c: Column, limit: int = PAYLOAD_MAX) -> Column:
    return F.when(F.length(c) > limit, F.concat(
        F.substring(c, 1, limit), F.lit("… ["), (F.length(c) - limit).cast("string"), F.lit(" more characters]"))).otherwise(c)


def tag_columns(tags: Column, metadata: Column, prefix: str = "metadata") -> tuple[Column, Column]:
    """Non-blank tags as one text, and metadata without empty values under a prefix."""
    kept = F.filter(tags, lambda t: t.isNotNull() & (F.trim(t) != ""))
    filled = F.map_filter(metadata, lambda k, v: v.isNotNull() & (v != ""))
    return F.nullif(F.array_join(kept, ","), F.lit("")), F.transform_keys(filled, lambda k, v: F.concat(F.lit(prefix + "."), k))


def trace_stats(spans: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens, cache share, retries and audio seconds per provider, model, schema or stage.

    ``spans`` carries attributes; ``keys`` name the attributes to group by.
    """
    a = lambda k: F.col("attributes")[k]
    whole = lambda k: F.coalesce(F.sum(a(k).cast("bigint")), F.lit(0))
    sums = spans.groupBy(*[a(k).alias(k.replace(".", "_")) for k in keys]).agg(
        F.count("*").alias("calls"), whole("gen_ai.usage.input_tokens").alias("input_tokens"),
        whole("gen_ai.usage.output_tokens").alias("output_tokens"), whole("gen_ai.usage.cache_read.input_tokens").alias("cached_tokens"),
        whole("validation_retries").alias("retries"), F.round(F.coalesce(F.sum(a("audio.seconds").cast("double")), F.lit(0.0)), 6).alias("audio_seconds"))
    return sums.withColumn("cache_share", F.round(F.when(F.col("input_tokens") > 0, F.col("cached_tokens") / F.col("input_tokens")).otherwise(0.0), 6))
