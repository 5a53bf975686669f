"""Exact dense scoring: profiles within a paper, and block products over vectors.

Two sets of vectors are compared tile against tile. Every row goes to the tiles
of the other side, Spark shuffles the tiles, and a task multiplies two bounded
blocks and emits only what was asked for: the k best, or what passes a threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx

TILE = 4096
#: Rows of a tile that are multiplied at once.
STRIP = 256
PIVOTS = 32


def letter_profile(c):
    """A deterministic stand-in for an embedding: terms counted by first letter."""
    first = F.transform(tx.terms(c), lambda w: F.ascii(w))
    return tx.let(first, lambda letters: F.transform(
        F.sequence(F.lit(97), F.lit(122)),
        lambda d: F.size(F.filter(letters, lambda a: a == d)).cast("double"),
    ))


def cosine(a, b):
    """Cosine of two arrays in double; a zero vector scores 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def profile_scorer(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """A dense scorer that needs no model: one score per section of the question's paper."""
    q = questions.select("question_id", "paper_id", letter_profile(F.col("text")).alias("q"))
    s = sections.select(
        "paper_id", "section_idx", letter_profile(F.concat_ws(". ", "heading", "content")).alias("s")
    )
    return q.join(s, "paper_id").select(
        "question_id", "paper_id", "section_idx", F.round(cosine(F.col("q"), F.col("s")), 9).alias("score")
    )


def centroids(vectors: DataFrame) -> DataFrame:
    """One query vector per label: the mean of the vectors that carry it."""
    cells = vectors.select("label", F.posexplode("vector").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("label").agg(F.transform(packed, lambda e: e["x"]).alias("vector")).withColumnRenamed(
        "label", "query_id"
    )


def _unit(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _pairs(qid, vid, scores, k) -> pd.DataFrame:
    """All pairs of two blocks, or each query's k best of the block."""
    scores = np.round(scores, 9) + 0.0
    if k is None or scores.shape[1] <= k:
        rows, cols = np.indices(scores.shape).reshape(2, -1)
    else:
        order = np.lexsort((np.broadcast_to(vid, scores.shape), -scores), axis=1)[:, :k]
        rows, cols = np.repeat(np.arange(len(qid)), order.shape[1]), order.reshape(-1)
    return pd.DataFrame({"query_id": qid[rows], "id": vid[cols], "score": scores[rows, cols]})


def _against(queries: DataFrame, vectors: DataFrame, k: int | None) -> DataFrame:
    schema = "query_id bigint, id bigint, score double"
    queries = queries.select(F.col("query_id").cast("bigint"), "vector")
    vectors = vectors.select(F.col("id").cast("bigint"), "vector")
    tiles = lambda n: max(1, math.ceil(n / TILE))
    tq, tv = tiles(queries.count()), tiles(vectors.count())
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qt", F.pmod(F.xxhash64("query_id"), F.lit(tq)).cast("int")).withColumn("vt", spread(tv))
    v = vectors.withColumn("vt", F.pmod(F.xxhash64("id"), F.lit(tv)).cast("int")).withColumn("qt", spread(tq))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return _pairs(a["query_id"].to_numpy(), b["id"].to_numpy(), _unit(a["vector"]) @ _unit(b["vector"]).T, k)

    return q.groupBy("qt", "vt").cogroup(v.groupBy("qt", "vt")).applyInPandas(block, schema)


def cosine_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """One score per query and vector, as an exhaustive flat index gives."""
    return _against(queries, vectors, None)


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each query; each block sends on at most k of its own."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        _against(queries, vectors, k).withColumn("rank", (F.row_number().over(best) - 1).cast("int"))
        .filter(F.col("rank") < k)
    )


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """Every pair of ids a < b whose cosine reaches the threshold, exactly.

    Rows gather around pivots; two pivots are compared only if the angle between
    them, less the two spreads, leaves room for a pair. A pivot that holds many
    rows is cut into tiles of bounded size, so one dense spot is many tasks.
    """
    rows = vectors.select(F.col("id").cast("bigint"), "vector").dropDuplicates(["id"])
    count = rows.count()
    schema = "a bigint, b bigint, score double"
    if count < 2:
        return rows.sparkSession.createDataFrame([], schema)
    # A fixed number of pivots, so this is small whatever the table holds.
    pivots = _unit(rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toPandas()["vector"])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = _unit(b["vector"])
                dots = np.clip(m @ pivots.T, -1, 1)
                near = dots.argmax(axis=1)
                angle = np.arccos(dots[np.arange(len(b)), near])
                yield pd.DataFrame({"id": b["id"], "unit": list(m), "pivot": near.astype("int32"), "angle": angle})

    placed = rows.mapInPandas(assign, "id bigint, unit array<double>, pivot int, angle double")
    spread = {r["pivot"]: (r["n"], r["reach"]) for r in
              placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect()}
    first, tiles = {}, 0
    for p, (n, _) in sorted(spread.items()):
        first[p] = (tiles, max(1, math.ceil(n / TILE)))
        tiles += first[p][1]
    limit = math.acos(max(-1.0, min(1.0, threshold)))
    partners: dict[int, list[int]] = {}
    for p in first:
        ok = []
        for q in first:
            apart = math.acos(max(-1.0, min(1.0, float(pivots[p] @ pivots[q]))))
            if p == q or apart - spread[p][1] - spread[q][1] <= limit + 1e-6:
                ok.extend([first[q][0], first[q][0] + first[q][1] - 1])
        partners[p] = ok
    ranges = F.create_map(*[x for p, r in partners.items() for x in (
        F.lit(p), F.array(*[F.sequence(F.lit(r[i]), F.lit(r[i + 1])) for i in range(0, len(r), 2)]))])
    start = F.create_map(*[x for p, (s, n) in first.items() for x in (F.lit(p), F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")))])
    own = start[F.col("pivot")]
    tiled = placed.withColumn("tile", (own["s"] + F.pmod(F.xxhash64("id"), own["n"])).cast("int"))
    sent = tiled.withColumn("other", F.explode(F.flatten(ranges[F.col("pivot")]))).select(
        "id", "unit", "tile",
        F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"),
    )

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["tile"] == pdf["lo"].iloc[0]]
        right = pdf[pdf["tile"] == pdf["hi"].iloc[0]]
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"a": [], "b": [], "score": []})
        units, others = np.stack(left["unit"].to_numpy()), np.stack(right["unit"].to_numpy()).T
        own, theirs, same = left["id"].to_numpy(), right["id"].to_numpy(), pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        # A strip at a time, so that besides the pairs found no more is held than STRIP rows of scores.
        found = []
        for at in range(0, len(units), STRIP):
            score = np.round(units[at:at + STRIP] @ others, 9) + 0.0
            i, j = np.nonzero(score >= threshold)
            x, y = own[at + i], theirs[j]
            good = x < y if same else x != y
            found.append((np.minimum(x, y)[good], np.maximum(x, y)[good], score[i, j][good]))
        return pd.DataFrame({name: np.concatenate(part) for name, part in zip(("a", "b", "score"), zip(*found))})

    return sent.groupBy("lo", "hi").applyInPandas(block, schema)
