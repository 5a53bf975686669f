"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Hashing every shingle to one of a
few blocks and XOR-ing the hashes of a block gives a sketch in which one
shingle changes one block. Two sets within reach of each other differ in at
most ``t`` shingles, ``t`` fixed per size band, so of ``t + 1`` or more blocks
one is equal in both: documents meet on equal blocks of their band. A second,
bit-wise parity sketch bounds the symmetric difference from below by its
Hamming distance and drops candidates; the rest are verified on the sets.

No pair within a group of candidates is emitted that is not needed. First every
member meets the group's first member. The verified links give components. In
groups that still hold several components, members meet a few pivots of other
components, round by round, as one link joins two whole components. What is
still apart then is compared inside the group, across components, and only what
passes the sketch bound comes out.

Blocks without a shingle are no evidence and emit nothing. A band has a few
blocks more than it needs; a document with more empty blocks than that emits
the blocks of another seed too, and with the last seed its empty ones as well.
Both sides of a pair that a seed may miss have that many empty blocks, so no
link is lost.

Defined results: a NULL or empty text has an empty set and links with nothing;
a text of any length is one set; exact copies of a set share a component by its
digest; rows of one ``doc_id`` are one document with the links of all its texts;
a NULL ``doc_id`` links with nothing and has a NULL component; an empty table
gives an empty result. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.components import connected_components
from plumbline.llm import words as W
from plumbline.llm.common import keep_table, map_texts, pieces

SHINGLE, PERCENT = 4, 85
BAND_RATIO, SEEDS = 1.3, 3
#: Bits of the sketch that joins compare; a larger set also has one of FULL_BITS bits or more per shingle.
SKETCH_BITS, FULL_BITS = 512, 1
#: Rounds of pivots, and pivots of a group in a round; members of a group compared in one task.
ROUNDS, PIVOTS, CHUNK = 1, 3, 2048
#: Bits of the filter for the texts worth fetching; it has a fixed size and only ever lets too much pass.
FILTER_BITS = 1 << 23
_REMEMBERED = 1 << 18


# ---- sets -------------------------------------------------------------------

def sets_of(texts: W.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in order, and where each text's begin."""
    words = W.find_words(texts)
    hashes, count = W.hash_words(texts, words, W.LOWER_VALUE), words.count
    grams, at = W.windows(hashes, words, size)
    owner = words.owner()[at]
    for n in sorted(set(count[count < size].tolist()) - {0}):
        short, at = W.windows(hashes, words, n)
        own = words.owner()[at]
        grams, owner = np.concatenate([grams, short[count[own] == n]]), np.concatenate([owner, own[count[own] == n]])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(grams: np.ndarray, first: np.ndarray):
    """Two digests of each set, and its parity sketch: one bit flipped per shingle."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    with np.errstate(over="ignore"):
        one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.add.at(one, owner, grams)
        np.bitwise_xor.at(two, owner, W.mix(grams + np.uint64(0x5851F42D4C957F2D)))
    bit = _places(grams) & (SKETCH_BITS - 1)
    odd = np.bincount(owner * SKETCH_BITS + bit, minlength=n * SKETCH_BITS) & 1
    sketch = np.packbits(odd.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.uint64) if n else np.zeros((0, SKETCH_BITS // 64), np.uint64)
    return one, two, sketch


def _places(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(17)).astype(np.int64)


def full_sketch(grams: np.ndarray) -> bytes | None:
    """The parity sketch of a set too large for the short one; its size is a power of two, so sketches fold onto each other."""
    if len(grams) <= SKETCH_BITS:
        return None
    bits = 1 << (FULL_BITS * len(grams) - 1).bit_length()
    odd = np.bincount(_places(grams) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Hamming distance of two full sketches, the longer folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


# ---- bands ------------------------------------------------------------------

def reach(size: int, percent: int = PERCENT) -> int:
    """The largest set that can link with one of ``size``."""
    return 100 * size // percent


def differences(size: int, percent: int = PERCENT) -> int:
    """The most shingles in which a linked pair can differ, the smaller of ``size``."""
    return (100 - percent) * size // percent


class Bands:
    """Intervals of the smaller size of a pair. ``lo`` to ``hi`` is the interval, ``top`` the reach of ``hi``."""

    def __init__(self, percent: int):
        self.percent, self.lo = percent, [1]

    def at(self, k: int) -> tuple[int, int, int, int, int]:
        while len(self.lo) < k + 2:
            self.lo.append(max(self.lo[-1] + 1, math.ceil(self.lo[-1] * BAND_RATIO), reach(self.lo[-1], self.percent) + 1))
        hi = self.lo[k + 1] - 1
        t = differences(hi, self.percent)
        spare = 1 if t < 8 else 2
        return self.lo[k], hi, reach(hi, self.percent), t, spare

    def of(self, size: int) -> list[int]:
        """The band of a size, and the one before where it can be the larger of a pair."""
        k = 0
        while self.at(k)[1] < size:
            k += 1
        return [k] + ([k - 1] if k and self.at(k - 1)[2] >= size else [])


def block_keys(grams: np.ndarray, first: np.ndarray, bands: Bands):
    """Join keys of every set: the XOR of each block, named by band, seed and block; and the set of each."""
    sizes = np.diff(first)
    plan = {int(s): bands.of(int(s)) for s in np.unique(sizes[sizes > 0])}
    out_key, out_set = [], []
    for k in sorted({k for ks in plan.values() for k in ks}):
        _, _, _, t, spare = bands.at(k)
        if not t:
            continue  # only equal sets can link
        blocks = t + 1 + spare
        have = np.array([s for s in range(len(sizes)) if sizes[s] and k in plan[int(sizes[s])]], np.int64)
        for seed in range(SEEDS):
            if not len(have):
                break
            n = sizes[have]
            rows = np.repeat(np.arange(len(have)), n)
            own = np.repeat(first[have] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            mixed = W.mix(grams[own] + np.uint64(0xD1B54A32D192ED03 * (seed + 1) & (1 << 64) - 1))
            flat = rows * blocks + (mixed >> np.uint64(33)).astype(np.int64) % blocks
            xor = np.zeros(len(have) * blocks, np.uint64)
            np.bitwise_xor.at(xor, flat, mixed)
            full = np.bincount(flat, minlength=len(have) * blocks) > 0
            empties = (~full).reshape(len(have), blocks).sum(axis=1)
            last = seed == SEEDS - 1
            emit = full | (last & np.repeat(empties > spare, blocks))
            where = np.flatnonzero(emit)
            with np.errstate(over="ignore"):
                name = np.uint64((k * SEEDS + seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + (where % blocks).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                out_key.append(W.mix(xor[where] + W.mix(name)))
            out_set.append(have[where // blocks])
            have = have[empties > spare]
    if not out_key:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_key), np.concatenate(out_set)


# ---- jobs -------------------------------------------------------------------

def signature_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (set digests), k0.. (parity sketch), sketch (the full one of a large set)."""
    names = [f"k{i}" for i in range(SKETCH_BITS // 64)]

    def run(part, texts):
        grams, first = sets_of(texts, size)
        one, two, sketch = signatures(grams, first)
        return {"doc_id": part.column("doc_id"), "n_shingles": np.diff(first), "d1": one.view(np.int64), "d2": two.view(np.int64),
                "sketch": pa.array([full_sketch(grams[a:z]) for a, z in zip(first[:-1], first[1:])], pa.binary())} | {
            k: np.ascontiguousarray(sketch[:, i]).view(np.int64) for i, k in enumerate(names)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, run, f"doc_id {kind}, n_shingles bigint, d1 bigint, d2 bigint, sketch binary, " + ", ".join(f"{k} bigint" for k in names))


def key_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """key, doc_id: one row per block. A copy met again in the same task is left out: its digest links it."""
    def run(batches):
        seen, bands = set(), Bands(percent)
        for batch in batches:
            for part, texts in pieces(batch):
                grams, first = sets_of(texts, size)
                one, two, _ = signatures(grams, first)
                fresh = np.ones(len(one), bool)
                for i, mark in enumerate(zip(one.tolist(), two.tolist())):
                    fresh[i] = mark not in seen
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add(mark)
                keep = np.repeat(fresh, np.diff(first))
                first = np.concatenate(([0], np.cumsum(np.where(fresh, np.diff(first), 0))))
                keys, owner = block_keys(grams[keep], first, bands)
                ids = part.column("doc_id").take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), ids], ["key", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"key bigint, doc_id {kind}")


def candidate_groups(rows: DataFrame) -> DataFrame:
    """grp, doc_id, center: documents of equal blocks, with the first of each group.

    Rows come sorted by key, so a group is read as it streams by. Blocks that
    hold the same documents are one group, told by a digest of the members. A
    group of more than a chunk is named by its key and let out in parts.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        seen: set[int] = set()
        key, held, first = None, [], None  # of the group streaming by; ``first`` once part of it is out

        def name_of(members):
            name = xxhash.xxh3_64_intdigest(repr(members)) - (1 << 63)
            if name in seen:
                return None
            if len(seen) >= _REMEMBERED:
                seen.clear()
            seen.add(name)
            return name

        def close(out):
            members = list(dict.fromkeys(held))
            if first is not None:
                out.append((key, members, first))
            elif len(members) > 1 and (name := name_of(members)) is not None:
                out.append((name, members, members[0]))

        def batch_of(out, ids):
            return pa.RecordBatch.from_arrays([
                pa.array([g for g, m, _ in out for _ in m], pa.int64()), pa.array([d for _, m, _ in out for d in m], ids),
                pa.array([c for _, m, c in out for _ in m], ids)], ["grp", "doc_id", "center"])

        ids = None
        for batch in batches:
            ids, keys = batch.schema.field("doc_id").type, batch.column("key").to_numpy()
            if not len(keys):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            many = set(np.flatnonzero(np.diff(cuts) > 1).tolist())
            docs, out = None, []
            for g in sorted({0, len(cuts) - 2} | many):
                docs = batch.column("doc_id").to_pylist() if docs is None else docs
                if int(keys[cuts[g]]) != key:
                    close(out)
                    key, held, first = int(keys[cuts[g]]), [], None
                held += docs[cuts[g]:cuts[g + 1]]
                if len(held) > CHUNK:
                    first = held[0] if first is None else first
                    close(out)
                    held = []
            if out:
                yield batch_of(out, ids)
        out = []
        close(out)
        if out:
            yield batch_of(out, ids)

    sorted_rows = rows.filter("doc_id IS NOT NULL").repartition(partitions, "key").sortWithinPartitions("key", "doc_id")
    return sorted_rows.mapInArrow(run, f"grp bigint, doc_id {kind}, center {kind}")


def fetch_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the wanted documents.

    A bitmap of fixed size over the wanted ids, combined from the tasks, drops
    most other texts before they are shuffled; the join then decides.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))

    def build(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column("place").to_numpy()] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in ids.select(place.alias("place")).coalesce(8).mapInArrow(build, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    share = docs.sparkSession.sparkContext.broadcast(bits)

    def keep(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            yield batch.filter(pa.array((share.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    maybe = docs.select("doc_id", "text", place.alias("place"))
    return maybe.mapInArrow(keep, maybe.schema).drop("place").join(ids, "doc_id", "left_semi")


def _short(signs: DataFrame) -> list[str]:
    return [c for c in signs.columns if c[0] == "k"]


def bounded(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    short = _short(signs)
    side = lambda s: signs.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in short])
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(may_link(short, percent)).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches):
        for batch in batches:
            x, y = batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()
            most = (100 - percent) * (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) // (100 + percent)
            ok = [not p or not q or bits_apart(p, q) <= m for p, q, m in zip(x, y, most.tolist())]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return near.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def may_link(sketch: list[str], percent: int):
    """Sizes within reach, and no more bits apart than linked sets of these sizes can be."""
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in sketch), F.lit(0))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    # |A xor B| = |A| + |B| - 2 * overlap, and overlap >= percent * (|A| + |B|) / (100 + percent).
    most = F.floor((100 - percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    return (small > 0) & (100 * small >= percent * large) & (apart <= most)


def verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the sets of their texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = keep_table(fetch_texts(docs, ids), "jaccard-texts")
    held = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        last = {}  # sets of the texts seen lately: a center's pairs stand together
        def sets(column):
            out = [None] * len(column)
            for i, t in enumerate(column.to_pylist()):
                if t not in last:
                    if len(last) > 64:
                        last.clear()
                    last[t] = sets_of(W.texts_of(pa.array([t], pa.large_string())), size)[0]
                out[i] = last[t]
            return out

        for batch in batches:
            for part, _ in pieces(batch, "text_a"):
                ok = []
                for x, y in zip(sets(part.column("text_a")), sets(part.column("text_b"))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a = pairs.schema["a"].dataType.simpleString()
    return held.mapInArrow(run, f"a {a}, b {a}")


def open_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """grp, doc_id, component, n (members) of the groups that hold several components."""
    named = groups.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = named.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    return keep_table(named.join(several.select("grp", "n"), "grp"), "jaccard-open")


def at_pivots(members: DataFrame, done: DataFrame, seed: int) -> DataFrame:
    """Unverified pairs (a, b) of members with a few of their group, of other components; pivots follow a hash of the round."""
    ranked = members.groupBy("grp").agg(*[F.min_by(F.struct("doc_id", "component"), F.xxhash64("doc_id", "grp", F.lit(seed * PIVOTS + k))).alias(f"p{k}") for k in range(PIVOTS)])
    met = members.join(ranked, "grp").select("doc_id", "component", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("p")).filter(
        F.col("component") != F.col("p.component"))
    pairs = met.select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def _near(rows: list[dict], names: list[str], percent: int, seen: set):
    """Pairs of one group's members, of different components, that sizes and sketches allow."""
    rows.sort(key=lambda r: r["n_shingles"])
    size = np.array([r["n_shingles"] for r in rows])
    part = [r["component"] for r in rows]
    side = np.array([r["own"] for r in rows])
    bits = np.array([[r[k] for k in names] for r in rows], np.int64).view(np.uint64)
    crossing = len({(r["x"], r["y"]) for r in rows if r["x"] != r["y"]}) > 0
    for i, r in enumerate(rows):
        stop = int(np.searchsorted(size, reach(int(size[i]), percent), "right"))
        if stop <= i + 1:
            continue
        most = (100 - percent) * (size[i] + size[i + 1:stop]) // (100 + percent)
        ok = np.bitwise_count(bits[i + 1:stop] ^ bits[i]).sum(axis=1) <= most
        if crossing:
            ok &= side[i + 1:stop] != side[i]
        for j in (np.flatnonzero(ok) + i + 1).tolist():
            if part[j] == part[i]:
                continue
            pair = (min(r["doc_id"], rows[j]["doc_id"]), max(r["doc_id"], rows[j]["doc_id"]))
            if pair in seen:
                continue
            if len(seen) >= _REMEMBERED:
                seen.clear()
            seen.add(pair)
            if not r["sketch"] or not rows[j]["sketch"] or bits_apart(r["sketch"], rows[j]["sketch"]) <= most[j - i - 1]:
                yield pair


def across(members: DataFrame, signs: DataFrame, percent: int, done: DataFrame) -> DataFrame:
    """Unverified pairs (a, b) of a group whose documents stand in different components and may link.

    Members stream by sorted by group and are compared by their sketches in the
    task, which lets out only the pairs that pass. A group of more than a chunk
    is compared chunk against chunk, in as many tasks.
    """
    names = _short(signs)
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    spread = members.join(signs, "doc_id").withColumn("parts", parts).withColumn(
        "own", F.pmod(F.hash("doc_id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("grp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "component", "n_shingles", "sketch", *names)
    kind = signs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: set = set()
        key, held = None, []
        ids = None

        def out():
            pairs = list(_near(held, names, percent, seen)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], ids) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            ids = batch.schema.field("doc_id").type
            for row in batch.to_pylist():
                here = row["grp"], row["x"], row["y"]
                if here != key and key is not None:
                    yield out()
                    held.clear()
                key = here
                held.append(row)
        if held:
            yield out()

    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = spread.repartition(partitions, "grp", "x", "y").sortWithinPartitions("grp", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")
    return pairs.distinct().join(done, ["a", "b"], "left_anti")


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    docs = docs.select("doc_id", "text")
    signs = keep_table(signature_table(docs, size), "jaccard-signatures")
    alike = ["n_shingles", "d1", "d2"]
    # Copies of a set: one row each set, whatever the copies.
    sets = signs.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*alike).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = keep_table(signs.join(sets.filter("copies > 1"), alike).select("doc_id", "rep").filter("doc_id <> rep").distinct(), "jaccard-copies")
    # A document of several sets keeps its name: its other sets are no copies of the first one's.
    differ = " OR ".join(f"lo_{c} <> hi_{c}" for c in alike)
    several = signs.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(*[f(c).alias(f"{side}_{c}") for c in alike for f, side in ((F.min, "lo"), (F.max, "hi"))]).filter(differ)
    renamed = keep_table(copies.join(several, "doc_id", "left_anti"), "jaccard-renamed")
    found = candidate_groups(key_rows(docs.filter("doc_id IS NOT NULL"), size, percent))
    rep = lambda df, c: df.join(renamed.select(F.col("doc_id").alias(c), F.col("rep").alias("_rep")), c, "left").withColumn(c, F.coalesce("_rep", c)).drop("_rep")
    groups = keep_table(rep(rep(found, "doc_id"), "center").distinct(), "jaccard-groups")
    sketches = signs.drop("d1", "d2").filter("n_shingles > 0 AND doc_id IS NOT NULL")

    ordered = lambda a, b: groups.filter(f"{a} <> {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    done = keep_table(ordered("doc_id", "center"), "jaccard-pairs")
    links = keep_table(verify(keep_table(bounded(done, sketches, percent), "jaccard-near"), docs, size, percent), "jaccard-links")
    edge = lambda df: df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = connected_components(edge(links))
    grouped = groups.select("grp", "doc_id").distinct()
    for k in range(ROUNDS + 1):
        grouped = open_groups(grouped.select("grp", "doc_id"), labels)
        found = at_pivots(grouped, done, k) if k < ROUNDS else across(grouped, sketches, percent, done)
        more = keep_table(found, "jaccard-pairs")
        if more.isEmpty():
            continue
        joined = keep_table(verify(keep_table(bounded(more, sketches, percent), "jaccard-near"), docs, size, percent), "jaccard-links")
        links, done = links.unionByName(joined), done.unionByName(more)
        labels = connected_components(edge(links))
    ties = labels.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(
        copies.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    final = connected_components(ties).withColumnRenamed("node", "doc_id")
    return signs.select("doc_id", "n_shingles").join(final, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id.

    Rows that repeat a kept ``doc_id`` are one document: the first by text stays. Rows without an id stay.
    """
    found = components(docs, size, percent)
    counted = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    kept = counted.filter("doc_id = component_id").select("doc_id", F.col("n").alias("_rows"))
    rows = docs.join(kept, "doc_id")
    once = rows.filter("_rows = 1")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    again = rows.filter("_rows > 1").withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
    return once.unionByName(again).drop("_rows").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def op3(docs: DataFrame) -> DataFrame:
    return components(docs)
