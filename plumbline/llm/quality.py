"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Every token has a fixed sparse random index vector. A token's context vector is
the sum of the index vectors beside it over the whole corpus, whole numbers, so
the order of the sum does not matter. Tokens are hashed to a fixed number of
rows, so the table has one size whatever the vocabulary. A document is pooled
from the context vectors of its tokens, rare ones weighing more, and a network
of two layers scores it; a temperature fitted on documents that training did
not see makes the scores probabilities.

Tokens are runs of letters, digits or other signs. Each run also gives a shape
token (case, length, whether it repeats the run before), pooled by itself.

Labels are learned from a bounded sample (``TRAIN_ROWS``) of the labelled rows
outside the held-out fifth; the context vectors come from all documents.

Defined results: a NULL or empty text is pooled to the zero vector and scored
like any other; a text of any length is read whole; repeated rows score alike;
of several labels of a document the lowest counts, NULL labels are left out;
without labels of both classes every score is the share of label 1 among those
there are, or 0.5; an empty table gives an empty result. Scores read nothing
but ``text``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm import words as W
from plumbline.llm.common import map_texts, pieces

ROWS, SHAPES, DIM, NONZERO, REACH = 8192, 32, 64, 4, 2
TRAIN_ROWS, FOLDS, THRESHOLD = 20_000, 5, 0.3
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 3e-3, 1e-4
#: Tasks of the corpus pass: each lets out one table, so their sum has a bound.
TASKS, BLOCKS = 2048, 16
_CHUNK = 1 << 16

_CLASS = np.zeros(256, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_CLASS[W.WORD] = 3
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def index_vectors(seed: int = 11) -> np.ndarray:
    """A few +1 and -1 in every row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS + SHAPES, DIM), np.int8)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def tokens(texts: W.Texts):
    """Row and shape row of every token, and its text."""
    kind = _CLASS[texts.data]
    n = len(kind)
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n)
    real = kind[start] > 0 if n else np.zeros(0, bool)
    start, end = start[real], end[real]
    words = W.Words(start, end, np.searchsorted(start, texts.offsets))
    hashes = W.hash_words(texts, words)
    capitals = np.zeros(n + 1, np.int64)
    np.cumsum(_CAPITAL[texts.data], out=capitals[1:])
    upper, length = capitals[end] - capitals[start], end - start
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(2 * upper > length, 3, 2)))
    size = np.minimum(np.log2(length).astype(np.int64), 3) if len(length) else length
    again = np.zeros(len(start), np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    return (hashes % np.uint64(ROWS)).astype(np.int64), ROWS + case + 4 * size + 16 * again, words.owner()


def _grouped(ids: np.ndarray, values: np.ndarray):
    """Distinct ids and the sums of their rows."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    at = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[at], np.add.reduceat(values[order], at, axis=0)


def add_contexts(total: np.ndarray, count: np.ndarray, texts: W.Texts, index: np.ndarray) -> None:
    word, shape, owner = tokens(texts)
    for at in range(0, len(word), _CHUNK):
        stop = min(at + _CHUNK, len(word))
        here = np.zeros((stop - at, DIM), np.int32)
        for step in (s for k in range(1, REACH + 1) for s in (-k, k)):
            a, z = max(at, -step), min(stop, len(word) - step)
            if a >= z:
                continue
            near = slice(a + step, z + step)
            vec = index[word[near]] + index[shape[near]]
            here[a - at:z - at] += vec * (owner[near] == owner[a:z])[:, None]
        for ids in (word[at:stop], shape[at:stop]):
            rows, sums = _grouped(ids, here)
            total[rows] += sums
        count += np.bincount(word[at:stop], minlength=len(count)) + np.bincount(shape[at:stop], minlength=len(count))


def corpus_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit context vectors of all rows, and pooling weights, over all documents.

    A task lets out its table in blocks of rows; a block is summed where it meets.
    """
    index, rows = index_vectors(), ROWS + SHAPES
    height = -(-rows // BLOCKS)

    def partial(batches):
        total, count = np.zeros((BLOCKS * height, DIM), np.int64), np.zeros(BLOCKS * height, np.int64)
        for batch in batches:
            for _, texts in pieces(batch):
                add_contexts(total, count, texts, index)
        if count.any():
            both = np.concatenate([total, count[:, None]], axis=1)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "sums": pa.array(
                [both[b * height:(b + 1) * height].tobytes() for b in range(BLOCKS)], pa.binary())})

    def combine(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, sums in zip(batch.column("block").to_pylist(), batch.column("sums")):
                held[b] = held.get(b, 0) + np.frombuffer(sums.as_buffer(), np.int64)
        if held:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(held), pa.int32()), "sums": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    kind = "block int, sums binary"
    parts = docs.select("text").coalesce(TASKS).mapInArrow(partial, kind).repartition(BLOCKS, "block").mapInArrow(combine, kind)
    both = np.zeros((BLOCKS, height * (DIM + 1)), np.int64)
    for row in parts.collect():  # BLOCKS rows
        both[row["block"]] += np.frombuffer(row["sums"], np.int64)
    both = both.reshape(BLOCKS * height, DIM + 1)[:rows]
    total, count = both[:, :DIM].astype(np.float64), both[:, DIM].astype(np.float64)
    vectors = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    weights = np.empty(rows)
    for part in (slice(0, ROWS), slice(ROWS, rows)):
        share = count[part] / max(count[part].sum(), 1)
        weights[part] = 1e-2 / (1e-2 + share) if part.start == 0 else 1.0
    return vectors.astype(np.float32), weights.astype(np.float32)


def pool(texts: W.Texts, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of features for each text: weighted means over its tokens and over their shapes."""
    word, shape, owner = tokens(texts)
    out = np.zeros((len(texts), 2 * DIM))
    for k, ids in enumerate((word, shape)):
        sums, mass = np.zeros((len(texts), DIM)), np.zeros(len(texts))
        for at in range(0, len(ids), _CHUNK):
            i, o = ids[at:at + _CHUNK], owner[at:at + _CHUNK]
            rows = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            sums[o[rows]] += np.add.reduceat(vectors[i] * weights[i][:, None], rows, axis=0)
            mass += np.bincount(o, weights[i], len(texts))
        out[:, k * DIM:(k + 1) * DIM] = sums / np.maximum(mass, 1e-9)[:, None]
    return out


@dataclass
class Network:
    """Two layers, in numpy; ``prior`` is the score where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    prior: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on log loss over four fifths of the rows; the temperature on the rest."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    net = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(np.unique(y)) < 2:
        net.prior = float(np.mean(y)) if len(y) else 0.5
        return net
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    held, own = order[:cut], order[cut:]
    net.mean, net.scale = x[own].mean(0), x[own].std(0) + 1e-3
    z = (x - net.mean) / net.scale
    params = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            hidden = np.tanh(z[batch] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -40, 40)))
            d = (p - y[batch]) / len(batch)
            back = d[:, None] * params[2] * (1 - hidden ** 2)
            grads = [z[batch].T @ back + DECAY * params[0], back.sum(0), hidden.T @ d + DECAY * params[2], np.array([d.sum()])]
            t += 1
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *params[:3], float(params[3][0])
    logits = net.logits(x[held])
    loss = lambda s: np.mean(np.logaddexp(0, logits / s) - y[held] * logits / s)
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, Network]:
    """Context vectors of the corpus, pooling weights, and the network."""
    vectors, weights = corpus_vectors(docs)
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # train_rows rows at most

    def features(part, texts):
        x = pool(texts, vectors, weights).astype(np.float32)
        return {"doc_id": part.column("doc_id").cast(pa.string()), "x": [r.tobytes() for r in x], "y": part.column("quality").cast(pa.int32())}

    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    found = map_texts(one, features, "doc_id string, x binary, y int").toPandas().sort_values("doc_id")
    x = np.array([np.frombuffer(b, np.float32) for b in found["x"]], np.float64).reshape(len(found), 2 * DIM)
    return vectors, weights, train(x, found["y"].to_numpy(np.float64))


def scored(docs: DataFrame, model) -> DataFrame:
    """``docs`` with a ``score``, under a name of its own if that is taken."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    vectors, weights, net = model

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(net.score(pool(texts, vectors, weights)))], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents the classifier does not reject, columns as they were."""
    model = fit(docs, labels)
    vectors, weights, net = model

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch):
                yield part.filter(pa.array(net.score(pool(texts, vectors, weights)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                       F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
