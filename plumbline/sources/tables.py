"""The given tables in the shapes the operators take.

One document is one paper; a non-blank line of it is one section, so a paper is
never larger than the row it came from. One conversation is one episode about
the document that has its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.session import cut_lineage, kept_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share a scan that came as too few splits among all cores.

    A large input has splits enough and is left as it is; only a small one, such
    as a single file, is shuffled, and by the key its rows are worked on.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores, key)


def papers(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("paper_id"), "text")


def sections(spark, sf_dir) -> DataFrame:
    """paper_id, section_idx, heading (its first sentence), content."""
    return sections_of(papers(spark, sf_dir))


def contents(text: Column) -> Column:
    """What sections_of has as the contents of one text."""
    return F.filter(tx.lines_of(text), lambda line: line.rlike(r"\S"))


def sections_of(papers: DataFrame) -> DataFrame:
    lines = papers.select(
        "paper_id", F.posexplode(tx.lines_of(F.col("text"))).alias("section_idx", "content")
    )
    return lines.filter(F.col("content").rlike(r"\S")).select(
        "paper_id", "section_idx", F.regexp_extract("content", r"^[^.]*", 0).alias("heading"), "content"
    )


def asked_papers(spark, sf_dir, naming: DataFrame) -> DataFrame:
    """Papers that rows name by ``paper_id``; the others' texts are let go where they are read.

    The papers' ids are written first, so that Spark knows how small they are and need not shuffle the other texts.
    """
    asked = kept_table(naming.select("paper_id").distinct(), "asked")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return texts.join(asked, "paper_id", "left_semi")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows left of a scan dealt out to as many tasks as read it, as they may all lie in one file."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df._jdf.rdd().getNumPartitions())
    return df.repartition(tasks, key)


def asked_sections(spark, sf_dir) -> DataFrame:
    """Sections of the papers that questions ask about, written once, as they are read several times."""
    return spread(cut_lineage(sections_of(asked_papers(spark, sf_dir, questions(spark, sf_dir)))), "paper_id")


def turns(spark, sf_dir) -> DataFrame:
    """episode_id, turn_idx, speaker, text."""
    role = F.col("role")
    speaker = (
        F.when(role == "user", "host").when(role == "assistant", "guest").otherwise("narrator")
    )
    return spread(table(spark, sf_dir, "conversations"), "conv_id").select(
        F.col("conv_id").alias("episode_id"),
        F.col("turn").alias("turn_idx"),
        speaker.alias("speaker"),
        "text",
    )


def episodes(spark, sf_dir) -> DataFrame:
    """episode_id, paper_id, minutes asked for."""
    return (
        table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id")).distinct()
        .withColumn("paper_id", F.col("episode_id"))
        .withColumn("minutes", F.col("episode_id") % 5 + 1)
    )


def questions(spark, sf_dir) -> DataFrame:
    """question_id, paper_id, text: what the reader of a conversation asked."""
    return (
        table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
        .select(
            F.concat_ws("-", "conv_id", "turn").alias("question_id"),
            F.col("conv_id").alias("paper_id"), "text",
        )
    )


def quotes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")


def verdicts(spark, sf_dir) -> DataFrame:
    """Judged claims: a paper is a source, a claim one labelled document of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("source").alias("paper_id"),
        F.col("doc_id").alias("claim_id"),
        F.when(F.col("toxic") == 1, "contradicted")
        .when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("verdict"),
        (F.col("n_chars") > 500).alias("specific"),
    )


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")
    )


def spans(spark, sf_dir) -> DataFrame:
    """Trace spans from events: a quarter of the id is the parent, event 0 the root."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    eid = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        eid.alias("span_id"),
        F.when(eid > 0, F.floor(eid / 4).cast("bigint")).alias("parent_id"),
        F.col("event_type").alias("name"),
        F.col("ts").cast("timestamp").alias("start"),
        F.col("value").alias("duration_ms"),
        k.alias("input_tokens"),
        F.floor("value").cast("bigint").alias("output_tokens"),
        F.col("value").alias("cost"),
        F.col("user_id"),
    )


def job_events(spark, sf_dir) -> DataFrame:
    stage = (
        F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "parsing")
        .when(F.col("event_type") == "click", "scripting").when(F.col("event_type") == "purchase", "done")
        .otherwise("error")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id"), F.col("ts").cast("timestamp").alias("at"), stage.alias("stage"),
        F.get_json_object("props", "$.k").cast("int").alias("percent"), "value",
    )
