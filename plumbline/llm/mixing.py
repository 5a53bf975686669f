"""Mixing sources to target weights by hash thresholds.

A document's place in its source's queue is a hash of its id, so a budget is a
hash threshold and mixes of growing size are nested. The threshold comes from
histograms: tokens summed by source and hash bucket. Only the bucket that holds
the boundary is refined, into buckets of the next hash digits, until it holds
one hash value. Nothing is sorted and no source meets in one task.

Defined results: a NULL or empty text has size 0 and nothing is taken of it; a
NULL source is a source of its own, last in the order; a NULL ``doc_id`` hashes
as the empty string; rows of equal ``doc_id`` in one source stand at one place,
so an extra copy is taken of all or none; an empty table, or one without a
word, gives targets of 0 and no taken words. Columns other than ``doc_id``,
``source`` and the size are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import keep_table, map_texts

WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size, and so does a document.
REPEATS = 3
#: Hash digits: so many levels of so many hexadecimal digits each.
LEVELS, DIGITS = 5, 3


def _sizes(part, texts: W.Texts) -> dict:
    return {"doc_id": part.column("doc_id"), "source": part.column("source"), "size": W.find_words(texts).count}


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words."""
    kind = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")}
    return map_texts(docs.select("doc_id", "source", "text"), _sizes, f"doc_id {kind['doc_id']}, source {kind['source']}, size bigint")


def targets(per_source: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, weight, target.

    Weights repeat over the sources in code-point order, NULL last; the order is
    over one row per source. A target is ``level * weight``, or ``repeats`` times
    the source where that is less, with the one level that spends all sizes:
    each round caps the sources above the level and raises it for the others.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights)).cast("int") + 1)
    rows = keep_table(per_source.withColumn("weight", weight.cast("bigint")), "mix-sources")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level = 0.0
    while True:
        capped = F.lit(repeats) * F.col("source_size") < F.col("weight") * F.lit(level)
        spent = rows.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size") * repeats)), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("w")).first()
        raised = (total - spent["n"]) / spent["w"] if spent["w"] else level
        if raised <= level:
            break
        level = raised
    return rows.withColumn("target", F.least(F.lit(float(repeats)) * F.col("source_size"), F.col("weight") * F.lit(level)))


def _digits(level: int):
    """The hash digits of a level as a number; all earlier ones name its boundary bucket."""
    return F.conv(F.substring("hash", 1 + level * DIGITS, DIGITS), 16, 10).cast("int")


def _hash(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def thresholds(sized: DataFrame, repeats: int = REPEATS, weights=WEIGHTS) -> DataFrame:
    """One row per source: source_size, target, copies of every document, and the threshold of one more copy.

    ``sized``: source, size, hash. Documents whose hash lies below ``prefix`` are
    taken once more, those at it where ``take``: the longest run of hash places
    whose words fit the rest, and the next place too if that comes nearer.
    """
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    goal = keep_table(goal.withColumn("copies", whole).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-goals")
    state = goal.filter("rest > 0").select("source", "rest", F.lit("").alias("prefix"))
    for level in range(LEVELS):
        # One row per source and bucket: bounded by the sources, whatever the documents.
        inside = sized.join(state, sized["source"].eqNullSafe(state["source"]), "inner").filter(
            F.col("hash").startswith(F.col("prefix"))).select(sized["source"], "rest", "prefix", "size", _digits(level).alias("bucket"))
        histogram = inside.groupBy("source", "rest", "prefix", "bucket").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        summed = histogram.withColumn("upto", F.sum("words").over(run))
        over = summed.filter(F.col("upto") > F.col("rest"))
        boundary = over.groupBy("source", "rest", "prefix").agg(F.min(F.struct("bucket", "words", "upto")).alias("b"))
        digits = F.lpad(F.lower(F.hex("b.bucket")), DIGITS, "0")
        state = keep_table(boundary.select(
            "source", (F.col("rest") - (F.col("b.upto") - F.col("b.words"))).alias("rest"), F.concat("prefix", digits).alias("prefix"),
            F.col("b.words").alias("words")), f"mix-level{level}")
        if level < LEVELS - 1:
            state = state.drop("words")
    # All digits are fixed: one hash value is left, taken if that comes nearer to the budget.
    edge = state.select(F.col("source").alias("_s"), F.col("prefix"), (F.col("words") - F.col("rest") <= F.col("rest")).alias("take"))
    full = goal.join(edge, goal["source"].eqNullSafe(edge["_s"]), "left").select(
        F.col("source").alias("_source"), "source_size", "target", F.col("copies").alias("_copies"), F.col("rest").alias("_rest"),
        F.col("prefix").alias("_prefix"), F.col("take").alias("_take"))
    # A table whose size Spark knows: while it is small, documents are not shuffled by source to meet it.
    return keep_table(full, "mix-thresholds")


def copies(hash_: Column) -> Column:
    """How often a document is taken, beside the threshold row of its source."""
    head = F.substring(hash_, 1, LEVELS * DIGITS)
    extra = F.when(F.col("_rest") <= 0, 0).when(F.col("_prefix").isNull(), 1).when(head < F.col("_prefix"), 1).when(
        (head == F.col("_prefix")) & F.col("_take"), 1).otherwise(0)
    return F.col("_copies") + extra


def _sized(docs: DataFrame) -> DataFrame:
    return keep_table(sizes(docs).withColumn("hash", _hash(F.col("doc_id"))), "mix-sizes")


def mix(docs: DataFrame, repeats: int = REPEATS, weights=WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, source."""
    sized = _sized(docs)
    full = thresholds(sized, repeats, weights)
    joined = sized.join(full, sized["source"].eqNullSafe(full["_source"]), "left")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("hash"))).alias("taken"), "source")


def mixed(docs: DataFrame, repeats: int = REPEATS, weights=WEIGHTS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it. Rows without a word are not taken."""
    full = thresholds(_sized(docs), repeats, weights).select("_source", "_copies", "_rest", "_prefix", "_take")
    held = docs.join(full, docs["source"].eqNullSafe(full["_source"]))
    own = [docs[c] for c in docs.columns]
    taken = held.filter(docs["text"].rlike(r"[^\x20\x09-\x0D]")).select(*own, copies(_hash(docs["doc_id"])).alias("_taken"))
    return taken.withColumn("_pass", F.explode(F.array_repeat(F.lit(1), F.col("_taken").cast("int")))).select(*docs.columns)


def op10(docs: DataFrame) -> DataFrame:
    return mix(docs)


SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
   substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1) AS weight FROM s),
 k AS (SELECT *, row_number() OVER o AS place, sum(source_size) OVER () AS total,
   coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
   sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w WINDOW o AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST)),
 lv AS (SELECT min_by(CAST(total - capped AS DOUBLE) / free, place) AS level FROM k WHERE CAST(3 * source_size AS DOUBLE) >= weight * (CAST(total - capped AS DOUBLE) / free)),
 g AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * coalesce(level, 1e300)) AS target FROM w, lv),
 c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM g),
 x AS (SELECT d.*, source_size, target, copies, target - copies * source_size AS rest,
   sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
   FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
 e AS (SELECT *, min(CASE WHEN upto > rest THEN h END) OVER (PARTITION BY source) AS edge FROM x)
 SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN rest <= 0 THEN 0 WHEN h < edge OR edge IS NULL THEN 1
   WHEN h = edge AND upto - rest <= rest - (upto - own) THEN 1 ELSE 0 END) AS BIGINT) AS taken, source FROM e"""
