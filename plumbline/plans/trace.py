"""Registered trace queries and their SQL."""

from pyspark.sql import functions as F

from plumbline.operators import trace as tr
from plumbline.plans import sqltext as sq
from plumbline.sources import tables as tb


def roots(spark, d):
    return tr.span_roots(tb.spans(spark, d)).select("span_id", "parent_id", F.col("parent_id").isNull().alias("is_root"))


def totals(spark, d):
    t = tr.subtree_totals(tb.spans(spark, d), ["input_tokens", "output_tokens", "cost"])
    return t.withColumn("cost", F.round("cost", 4))


def preorder(spark, d):
    return tr.preorder(tb.spans(spark, d))


def _attributed(spark, d):
    e = F.col("name")
    maps = F.map_filter(F.create_map(
        F.lit("gen_ai.operation.name"), F.when(e.isin("click", "view", "purchase"), F.lit("chat")),
        F.lit("gen_ai.provider.name"), F.when(e == "view", "local").otherwise("hosted"),
        F.lit("gen_ai.request.model"), e, F.lit("gen_ai.response.model"), F.when(e == "click", F.lit("click-dated")),
        F.lit("gen_ai.usage.input_tokens"), F.col("input_tokens").cast("string"), F.lit("gen_ai.usage.output_tokens"), F.col("output_tokens").cast("string"),
        F.lit("gen_ai.usage.cache_read.input_tokens"), F.when(e == "purchase", F.floor(F.col("input_tokens") / 2).cast("string")),
        F.lit("validation_retries"), F.when(e == "error", "1").otherwise("0"), F.lit("audio.seconds"), F.when(e == "view", F.col("duration_ms").cast("string")),
    ), lambda k, v: v.isNotNull())
    return tb.spans(spark, d).withColumn("attributes", maps).withColumn("status", F.when(e == "error", "error").otherwise("ok"))


def log(spark, d):
    s = _attributed(spark, d).withColumn("duration", F.array(F.floor(F.col("duration_ms") / 1000).cast("double"), (F.col("duration_ms") % 1000) * 1_000_000.0))
    s = s.withColumn("message", F.lit("failed")).withColumn("scope", F.when(F.col("name") == "error", "ours"))
    return tr.call_log(s, "ours").withColumn("duration_ms", F.round("duration_ms", 4))


def payload(spark, d):
    return tb.papers(spark, d).select("paper_id", F.md5(tr.truncate_payload(F.col("text"))).alias("payload_md5"))


def tags(spark, d):
    e = tb.table(spark, d, "events")
    t, m = tr.tag_columns(F.array("event_type", F.when(F.col("value") > 50, "large"), F.lit(" ")),
                          F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("z"), F.get_json_object("props", "$.z"), F.lit("blank"), F.lit("")))
    return e.select("event_id", t.alias("tags"), F.array_join(F.map_keys(m), ",").alias("keys"), F.array_join(F.map_values(m), ",").alias("vals"))


def stats(spark, d):
    return tr.trace_stats(_attributed(spark, d), "gen_ai.provider.name", "gen_ai.request.model")


QUERIES = {
    "t1_span_roots": roots, "t2_subtree_totals": totals, "t3_preorder": preorder, "t4_call_log": log,
    "t6_truncate_payload": payload, "t7_tags": tags, "t8_trace_stats": stats,
}

ORACLE = {
    "t1_span_roots": f"WITH {sq.SPANS} SELECT s.span_id, p.span_id AS parent_id, p.span_id IS NULL AS is_root FROM spans s LEFT JOIN spans p ON p.span_id = s.parent_id",
    "t2_subtree_totals": f"""WITH RECURSIVE {sq.SPANS}, up AS (SELECT span_id AS anc, span_id AS id FROM spans UNION ALL SELECT s.parent_id, u.id FROM up u JOIN spans s ON s.span_id = u.anc WHERE s.parent_id IS NOT NULL)
        SELECT anc AS span_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 4) AS cost FROM up JOIN spans ON span_id = id GROUP BY 1""",
    "t3_preorder": f"""WITH RECURSIVE {sq.SPANS}, w AS (SELECT span_id, 0::BIGINT AS depth, [epoch_us(start), span_id] AS path FROM spans WHERE parent_id IS NULL
          UNION ALL SELECT s.span_id, depth + 1, path || [epoch_us(s.start), s.span_id] FROM w JOIN spans s ON s.parent_id = w.span_id)
        SELECT span_id, depth, row_number() OVER (ORDER BY path) - 1 AS position FROM w""",
    "t4_call_log": f"""WITH {sq.SPANS} SELECT span_id, name, CASE WHEN name = 'click' THEN 'click-dated' ELSE name END AS model, input_tokens, output_tokens,
        CASE WHEN name = 'purchase' THEN nullif(input_tokens // 2, 0) END AS cached_tokens, round(duration_ms, 4) AS duration_ms, name = 'error' AS failed,
        CASE WHEN name = 'error' THEN 'failed' END AS message FROM spans WHERE name <> 'signup'""",
    "t6_truncate_payload": "SELECT doc_id AS paper_id, md5(CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || '… [' || (length(text) - 4000) || ' more characters]' ELSE text END) AS payload_md5 FROM documents",
    "t7_tags": "SELECT event_id, event_type || CASE WHEN value > 50 THEN ',large' ELSE '' END AS tags, 'metadata.k' AS keys, json_extract_string(props, '$.k') AS vals FROM events",
    "t8_trace_stats": f"""WITH {sq.SPANS} SELECT CASE WHEN name = 'view' THEN 'local' ELSE 'hosted' END AS gen_ai_provider_name, name AS gen_ai_request_model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens,
        sum(output_tokens)::BIGINT AS output_tokens, coalesce(sum(CASE WHEN name = 'purchase' THEN input_tokens // 2 END), 0)::BIGINT AS cached_tokens, count(*) FILTER (name = 'error') AS retries,
        round(coalesce(sum(CASE WHEN name = 'view' THEN duration_ms END), 0), 6) AS audio_seconds,
        round(coalesce(sum(CASE WHEN name = 'purchase' THEN input_tokens // 2 END), 0) / sum(input_tokens), 6) AS cache_share FROM spans GROUP BY 1, 2""",
}
