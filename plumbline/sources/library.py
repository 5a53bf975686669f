"""Reading and writing the library: records, fixtures, caches and logs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.rows import mapped, rows_of
from plumbline.operators import grounding as gr
from plumbline.session import cut_lineage

ID = r"^[A-Za-z0-9_-]{1,64}$"
HEAVY = ["episode", "citations", "timings", "paper", "concepts", "relations"]
LEDGER_VERSION = 1

TURNS = "ARRAY<STRUCT<speaker STRING, text STRING>>"
EPISODE = f"STRUCT<summary STRING, keyPoints ARRAY<STRING>, turns {TURNS}>"
RECORD = (
    "id STRING, createdAt BIGINT, paperTitle STRING, paperId STRING, minutes DOUBLE, format STRING, provider STRING, model STRING,"
    " turnCount INT, totalMs DOUBLE, hasAudio BOOLEAN, transcriptRecall DOUBLE, summary STRING, keyPoints ARRAY<STRING>,"
    f" episode {EPISODE}, timings ARRAY<STRUCT<turnIndex INT, speaker STRING, startMs DOUBLE, endMs DOUBLE, chunks INT>>"
)
FIXTURE = (
    "id STRING, description STRING, paperId STRING, generator STRUCT<provider STRING, model STRING>,"
    " expectation STRUCT<minFaithfulness DOUBLE, maxFaithfulness DOUBLE, minDeterministicErrors INT, maxDeterministicErrors INT>,"
    f" episode {EPISODE}"
)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Every readable record of a folder of JSON files; broken ones are skipped."""
    return spark.read.schema(RECORD).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def with_defaults(records: DataFrame) -> DataFrame:
    """Fill summary and key points of old records from their episode."""
    return records.withColumn("summary", F.coalesce("summary", "episode.summary", F.lit(""))).withColumn(
        "keyPoints", F.coalesce("keyPoints", "episode.keyPoints", F.array().cast("array<string>")))


def list_library(records: DataFrame) -> DataFrame:
    """The shelf: records that have an id, without their heavy parts, newest first."""
    named = records.filter(F.col("id").isNotNull() & (F.col("id") != ""))
    light = with_defaults(named)
    return light.drop(*[c for c in HEAVY if c in light.columns]).orderBy(F.desc("createdAt"), "id")


def check_id(record_id: str) -> str:
    import re

    if not re.match(ID, record_id):
        raise ValueError(f"not a valid id: {record_id}")
    return record_id


def get_by_id(records: DataFrame, record_id: str) -> DataFrame:
    return with_defaults(records.filter(F.col("id") == check_id(record_id)))


def delete_by_id(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records left after removing the given ids; malformed ids remove nothing."""
    return records.join(ids.filter(F.col("id").rlike(ID)).select("id"), "id", "left_anti")


def _versions(spark: SparkSession, path: str):
    """The file system of a table, and its versions from the oldest: number, name, when it became current (seconds)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return fs, sorted((int(n), v, at) for (n, v), at in ((x.removeprefix("current-").split("."), at) for x, at in found if x.startswith("current-")))


def save_table(df: DataFrame, path: str, kept: int = 2, grace: float = 3600.0) -> None:
    """Replace a table whole: write a new version, then name it the current one.

    A version is a folder of its own; it becomes current with one empty file whose
    name says so, which is there or not. The last ``kept`` versions stay, and any
    that was current within ``grace`` seconds, so a reader that has chosen one can
    finish; a version whose writing failed is never named.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/v-{version}")
    fs, known = _versions(spark, path)
    place = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    number = known[-1][0] + 1 if known else 0
    if not fs.createNewFile(place(f"current-{number:012d}.{version}")):
        raise OSError(f"could not replace {path}")
    for (n, old, _), (*_, replaced) in list(zip(known, known[1:]))[:max(0, len(known) + 1 - kept)]:
        if replaced < time.time() - grace:
            fs.delete(place(f"current-{n:012d}.{old}"), False)
            fs.delete(place(f"v-{old}"), True)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a saved table."""
    _, known = _versions(spark, path)
    if not known:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v-{known[-1][1]}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A saved ledger; one of another version is refused rather than misread."""
    ledger = spark.read.parquet(path)
    if not ledger.filter(F.col("version") != LEDGER_VERSION).isEmpty():
        raise ValueError(f"ledger at {path} has an unsupported version")
    return ledger


class ModelUnavailable(Exception):
    """A model function raises this when the model cannot be reached."""


def cache_key(text: Column, model: str) -> Column:
    """First 32 hex digits of the hash of the model and the whole text."""
    return F.substring(F.sha2(F.concat(F.lit(model + " "), text), 256), 1, 32)


def split_cached(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Each text with its key and its cached vector, NULL on a miss. ``cache``: key, vector."""
    return texts.withColumn("key", cache_key(F.col("text"), model)).join(cache.select("key", "vector"), "key", "left")


def embed_with_cache(
    texts: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, clip: int | None = None
) -> tuple[DataFrame, DataFrame] | None:
    """(texts with vectors, rows to add to the cache), or None when the model cannot embed.

    Each missing text goes to the model once, in Arrow batches; a model that takes
    no more than ``clip`` characters is shown those, under the key of the whole
    text. A model is not available if it says so (``ModelUnavailable``) or answers with too few vectors.
    """
    keyed = split_cached(texts, cache, model)
    missing = keyed.filter(F.col("vector").isNull()).select("key", (F.substring("text", 1, clip) if clip else F.col("text")).alias("text")).dropDuplicates(["key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                got = embed(list(b["text"]))
                ok = len(got) == len(b)
            except ModelUnavailable:
                ok = False
            yield pd.DataFrame({"key": b["key"], "vector": got if ok else [None] * len(b)})

    # Cut here, so a model is asked once whatever is done with its answers.
    fresh = cut_lineage(missing.mapInPandas(run, "key string, vector array<float>"))
    if not fresh.filter(F.col("vector").isNull()).isEmpty():
        return None
    found = keyed.withColumnRenamed("vector", "_hit").join(fresh.withColumnRenamed("vector", "_new"), "key", "left")
    return found.withColumn("vector", F.coalesce("_hit", "_new")).drop("_hit", "_new"), fresh


def read_fixtures(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Captured episodes with their expected bounds, in file order; a broken file is an error."""
    return (
        spark.read.schema(FIXTURE).option("multiLine", one_per_file).option("mode", "FAILFAST").json(path)
        .withColumn("file", F.col("_metadata.file_name")).orderBy("file")
    )


def papers_with_annotations(papers: DataFrame, notes: DataFrame) -> DataFrame:
    """Every paper file with its contributions, none being an empty list.

    ``papers``: file. ``notes``: paper_id, contributions.
    """
    named = papers.withColumn("paper_id", F.lower(F.regexp_replace("file", r"\.[A-Za-z0-9]+$", "")))
    return named.join(notes, "paper_id", "left").withColumn(
        "contributions", F.coalesce("contributions", F.array().cast("array<string>")))


def available(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """Catalogue entries whose file is there."""
    return catalogue.join(files, "paper_id", "left_semi")


def write_span_log(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def export_timings(timings: DataFrame, turns: DataFrame, path: str) -> None:
    """Timings with the text of their turn, as JSON lines."""
    timings.join(turns.select("episode_id", "turn_idx", "text"), ["episode_id", "turn_idx"], "left").withColumn(
        "text", F.coalesce("text", F.lit(""))).write.mode("overwrite").json(path)


def export_eval(leaderboard: DataFrame, path: str) -> None:
    leaderboard.write.mode("overwrite").json(path)


def once_per_key(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], done: DataFrame | None = None) -> DataFrame:
    """Compute once for each key and give it to every row that has the key.

    ``compute`` takes one row per key and returns the key with what it found. Keys
    in ``done`` are left out.
    """
    todo = df if done is None else df.join(done.select(key).distinct(), key, "left_anti")
    return todo.join(compute(todo.dropDuplicates([key])), key, "left")


def backfill_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Section and anchor counts before and after re-parsing: paper_id, sections, anchors."""
    side = lambda df, p: df.select("paper_id", F.col("sections").alias(f"sections_{p}"), F.col("anchors").alias(f"anchors_{p}"))
    return side(before, "before").join(side(after, "after"), "paper_id", "full").fillna(0)


def relocate(evidence: DataFrame, located: DataFrame, columns: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """The new ``columns`` where the evidence was found again, the old ones elsewhere, and whether it was. Both: evidence_id."""
    new = located.select("evidence_id", F.lit(True).alias("moved"), *[F.col(c).alias(f"_{c}") for c in columns])
    return evidence.join(new, "evidence_id", "left").withColumns(
        {c: F.when(F.col("moved"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns} | {"moved": F.coalesce("moved", F.lit(False))}
    ).drop(*[f"_{c}" for c in columns])


def located_in(evidence: DataFrame, sections: DataFrame) -> DataFrame:
    """Which section of a structure holds each piece of evidence: evidence_id, paper_id, heading. Absent where none does.

    ``evidence``: evidence_id, paper_id, text. ``sections``: paper_id, section_idx, heading, content.
    """
    packed = F.array_sort(F.collect_list(F.struct("section_idx", "heading", "content")))
    quotes = evidence.select("paper_id", F.col("evidence_id").alias("quote_id"), "text")
    held = gr.beside(quotes, sections.groupBy("paper_id").agg(packed.alias("sections"))).select("paper_id", "quotes", "sections")

    def rows(batches):
        for paper, quotes, cut in rows_of(batches):
            found = gr.headings_of([q["text"] for q in quotes], [(s["heading"], s["content"]) for s in cut])
            yield from ((q["quote_id"], paper, h) for q, h in zip(quotes, found) if h is not None)

    kind = lambda c: evidence.schema[c].dataType.simpleString()
    return mapped(held, rows, f"evidence_id {kind('evidence_id')}, paper_id {kind('paper_id')}, heading string")


def backfill_beside(held: DataFrame) -> DataFrame:
    """``backfill`` of papers that are one row each, with both structures and the evidence in it; nothing is shuffled.

    ``held``: paper_id, evidence (structs of evidence_id and text), before and after
    (structs of heading and content, in order). Result: paper_id, the counts of
    ``backfill_report``, and found: structs of evidence_id, heading, moved.
    """
    kind = held.schema["evidence"].dataType.elementType["evidence_id"].dataType.simpleString()

    def rows(batches):
        for paper, evidence, *structures in rows_of(batches):
            quotes, cut = [e["text"] for e in evidence], [[(s["heading"], s["content"]) for s in c] for c in structures]
            old, new = (gr.headings_of(quotes, c) for c in cut)
            counts = (x for c, found in zip(cut, (old, new)) for x in (len(c), sum(h is not None for h in found)))
            yield (paper, *counts, [{"evidence_id": e["evidence_id"], "heading": o if n is None else n, "moved": n is not None} for e, o, n in zip(evidence, old, new)])

    return mapped(held.select("paper_id", "evidence", "before", "after"), rows,
                  f"paper_id {held.schema['paper_id'].dataType.simpleString()}, sections_before bigint, anchors_before bigint, sections_after bigint, "
                  f"anchors_after bigint, found array<struct<evidence_id: {kind}, heading: string, moved: boolean>>")


def backfill(evidence: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A structure parsed again and what depends on it looked up again.

    Gives the evidence with its heading (the new one where it was found, else that
    of the earlier parse), and per paper the sections and anchors of both. Both
    structures: paper_id, section_idx, heading, content.
    """
    old, new = (cut_lineage(located_in(evidence, s)) for s in (before, after))
    moved = relocate(evidence.join(old.select("evidence_id", "heading"), "evidence_id", "left"), new, ("heading",))
    side = lambda s, found: s.groupBy("paper_id").agg(F.count("*").alias("sections")).join(found.groupBy("paper_id").agg(F.count("*").alias("anchors")), "paper_id", "left")
    return moved, backfill_report(side(before, old), side(after, new))
