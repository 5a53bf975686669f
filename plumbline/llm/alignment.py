"""Alignment of two tokenizers over the same bytes, by pointer jumping.

Tokens of A and B tile the same byte string. Every token points to the token of
the other tokenizer that reaches farthest to the right of those it overlaps, or
to itself where both end at one byte. Following pointers leads to the last token
of the component, and doubling them (``next = next[next]``) gets every token
there in a logarithm of the longest chain, over all texts of a block at once.
Tokens of one terminal are a group.

No group and no link crosses the place where a unit begins (``units.py``), so each
different unit is aligned once and texts are put together from units.

How often a pair of ids is linked is counted over all texts: a task sums its chunks
of bounded size, chunks are summed by pair, and each chunk gets the counts of its
own pairs back, one row per chunk and pair, however often a text holds the pair.

Defined results: texts that are NULL, empty, or whose bytes a tokenizer does not
give back have no tokens: zeros, and '' as digest; a text of any length is one
chunk of its own where it is longer than a chunk; a NULL ``doc_id`` and repeated
rows are documents like others; an empty table gives no rows. Columns other than
``doc_id`` and ``text`` are not read. A text without a space or line feed is given
to the tokenizers in one go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep_table, pieces
from plumbline.llm.units import LOOKED, ByteTokens, Memory, PieceTokens, blocks, find_units, vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose links are summed together.
CHUNK = 8 << 20
#: A pair of ids in one number.
_SHIFT = 20


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each A and each B token the A token its component ends with, and the rounds taken.

    ``a_end`` and ``b_end`` are ascending ends of tokens that tile the same bytes.
    """
    n = len(a_end)
    to_b, to_a = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    follow = np.concatenate((np.where(b_end[to_b] == a_end, np.arange(n), n + to_b), to_a))
    rounds = 0
    while True:
        twice = follow[follow]
        rounds += 1
        if np.array_equal(twice, follow):
            return follow[:n], follow[n:], rounds
        follow = twice


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B token of every link, in order."""
    a_start = np.concatenate(([0], a_end[:-1]))
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_end, a_end)
    n = high - low + 1
    at = np.repeat(np.arange(len(a_end)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]


class Aligner(Memory):
    """What is known of a unit: whether both tokenizers give its bytes back, tokens and groups, groups as text, pairs of its links."""

    #: Goes before every block, since one tokenizer adds a space to what it is given; its own tokens are dropped.
    HEAD = b" x"

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        self.a, self.b = ByteTokens(a_path, special_as_text=True), PieceTokens(b_path)
        self.names = [[str(i) for i in range(len(t.bytes))] for t in (self.a, self.b)]
        self.counts: list[tuple] = []
        self.groups: list[str] = []
        self.pairs: list[bytes] = []
        self.known = [self.counts, self.groups, self.pairs]

    def learn(self, new: list[bytes]) -> None:
        out = [None] * len(new)
        for block in blocks(new):
            got = self._align([new[i] for i in block])
            if got is None:  # some unit does not come back: look at each by itself
                got = [(self._align([new[i]]) or [((0, 0, 0, 0, 0), "", b"")])[0] for i in block]
            for i, g in zip(block, got):
                out[i] = g
        for held, values in zip(self.known, zip(*out)):
            held += values

    def _align(self, units: list[bytes]):
        raw = b"".join([self.HEAD, *units])
        text, sides = raw.decode(), []
        for tokens in (self.a, self.b):
            ids = tokens.ids([text])[0]
            if b"".join([tokens.bytes[i] for i in ids.tolist()]) != raw:
                return None
            ends = np.cumsum(tokens.lengths[ids])
            skip = np.searchsorted(ends, len(self.HEAD)) + 1
            sides.append((ids[skip:], ends[skip:] - len(self.HEAD)))
        (a, a_end), (b, b_end) = sides
        a_group, b_group, _ = terminals(a_end, b_end)
        at, to = overlaps(a_end, b_end)
        stop = np.cumsum([len(u) for u in units])
        a_stop, b_stop = np.searchsorted(a_end, stop) + 1, np.searchsorted(b_end, stop) + 1
        l_stop = np.searchsorted(at, a_stop)
        g_stop = np.searchsorted(np.unique(a_group), a_stop)
        counts = np.diff(np.column_stack((a_stop, b_stop, g_stop, l_stop)), axis=0, prepend=0)
        packed = (a[at] << _SHIFT | b[to]).tobytes()
        # Tokens by group, A before B, each with the sign that follows it.
        group, side = np.concatenate((a_group, b_group)), np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))
        group, side = group[order], side[order]
        last, turn = np.append(group[1:] != group[:-1], True), np.append(side[1:] != side[:-1], True)
        signs = np.where(last, ";", np.where(turn, "|", ","))
        ids = np.concatenate((a, b))[order]
        shown = [self.names[s][i] + c for s, i, c in zip(side.tolist(), ids.tolist(), signs.tolist())]
        out, t, p = [], 0, 0
        for (n_a, n_b, n_g, n_l), t_stop, p_stop in zip(counts.tolist(), (a_stop + b_stop).tolist(), (8 * l_stop).tolist()):
            out.append(((1, n_a, n_b, n_g, n_l), "".join(shown[t:t_stop])[:-1], packed[p:p_stop]))
            t, p = t_stop, p_stop
        return out


_aligners: dict[tuple, Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker, kept between tasks."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _measure(known: Aligner, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of the texts by number, the first of each text, and whether a text has tokens."""
    units = find_units(texts)
    numbers = known.look_up(texts, units, b" ")
    good = np.array([c[0] for c in known.counts], np.int64)[numbers] if len(numbers) else np.zeros(0, np.int64)
    run = np.concatenate(([0], np.cumsum(good)))
    size = np.diff(units.first)
    return numbers, units.first, (size > 0) & (run[units.first[1:]] - run[units.first[:-1]] == size)


def _digest(known: Aligner, numbers: list[int]) -> str:
    held = hashlib.sha256()
    for low in range(0, len(numbers), LOOKED):
        held.update((";" * bool(low) + ";".join([known.groups[i] for i in numbers[low:low + LOOKED]])).encode())
    return held.hexdigest()


_DOCS = "docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>>"
_PAIRS = "pairs array<struct<at: int, pair: bigint, n: bigint>>"


def chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per chunk of documents: their measures, the pairs linked in them with counts, and which document holds which."""
    def run(batches):
        number, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        ids, measures, digests, held, sizes, size = [], [], [], [], [], 0

        def row():
            units = np.concatenate(held)
            used, local, n = np.unique(units, return_inverse=True, return_counts=True)
            links = np.frombuffer(b"".join([known.pairs[i] for i in used.tolist()]), np.int64)
            of_unit = np.array([len(known.pairs[i]) // 8 for i in used.tolist()], np.int64)
            pair, at = np.unique(links, return_inverse=True)
            total = np.bincount(at, weights=np.repeat(n, of_unit), minlength=len(pair)).astype(np.int64)
            parts = [np.array(sizes, np.uint32), local.astype(np.uint32), of_unit.astype(np.uint32), at.astype(np.uint32)]
            measured = np.concatenate(measures)
            document = pa.StructArray.from_arrays(
                [pa.concat_arrays(ids), *(pa.array(measured[:, k], pa.int64()) for k in range(4)), pa.array(digests, pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            linked = pa.StructArray.from_arrays([pa.array(np.arange(len(pair)), pa.int32()), pa.array(pair, pa.int64()), pa.array(total, pa.int64())], ["at", "pair", "n"])
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([number], pa.int64()), "docs": pa.ListArray.from_arrays(pa.array([0, len(document)], pa.int32()), document),
                "pairs": pa.ListArray.from_arrays(pa.array([0, len(linked)], pa.int32()), linked),
                "lengths": pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), "units": pa.array([squeeze.compress(b"".join(p.tobytes() for p in parts))], pa.binary())})

        for batch in batches:
            for part, texts in pieces(batch):
                known = aligner(a_path, b_path)
                numbers, first, good = _measure(known, texts)
                listed, stop = numbers.tolist(), first.tolist()
                counts = np.array(known.counts, np.int64)[numbers, 1:] if len(numbers) else np.zeros((0, 4), np.int64)
                sums = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(counts, axis=0)))
                measures.append((sums[first[1:]] - sums[first[:-1]]) * good[:, None])
                digests += [_digest(known, listed[s:e]) if g else "" for s, e, g in zip(stop[:-1], stop[1:], good.tolist())]
                held.append(numbers[np.repeat(good, np.diff(first))])
                sizes += (np.diff(first) * good).tolist()
                ids.append(part.column("doc_id").cast(pa.int64()))
                size += len(texts.data)
                if size >= CHUNK:
                    yield row()
                    known.forget()
                    number += 1
                    ids, measures, digests, held, sizes, size = [], [], [], [], [], 0
        if ids:
            yield row()
            known.forget()

    return docs.select("doc_id", "text").mapInArrow(run, f"chunk bigint, {_DOCS}, {_PAIRS}, lengths array<bigint>, units binary")


def pair_counts(chunked: DataFrame) -> DataFrame:
    """pair, links (how many links hold it in all texts), best (no pair of its B id has more)."""
    pairs = chunked.select(F.inline("pairs"))
    counts = keep_table(pairs.groupBy("pair").agg(F.sum("n").alias("links")), "pair-counts")
    b = F.col("pair").bitwiseAND((1 << _SHIFT) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def id_pairs(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a_id, b_id, links, best over all texts: the table that says which ids stand for each other."""
    pairs = pair_counts(keep_table(chunks(docs, a_path or vocabulary(A), b_path or vocabulary(B)), "links"))
    return pairs.select(F.shiftright("pair", _SHIFT).alias("a_id"), F.col("pair").bitwiseAND((1 << _SHIFT) - 1).alias("b_id"), "links", "best")


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id and its groups in order: a (ids), b (ids); an empty list where there are no tokens."""
    a_path, b_path = a_path or vocabulary(A), b_path or vocabulary(B)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch):
                known = aligner(a_path, b_path)
                numbers, first, good = _measure(known, texts)
                for i, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    shown = ";".join([known.groups[u] for u in numbers[s:e].tolist()]) if good[i] else ""
                    groups = [dict(zip("ab", ([int(x) for x in side.split(",")] for side in g.split("|")))) for g in shown.split(";") if g]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part.column("doc_id").slice(i, 1), "groups": pa.array([groups], pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))})
                known.forget()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, groups array<struct<a: array<int>, b: array<int>>>")


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one chunk with the counts of its pairs."""
    raw = zstandard.decompress(left["units"][0].as_py())
    parts, at = [], 0
    for n in left["lengths"][0].as_py():
        parts.append(np.frombuffer(raw, np.uint32, n, 4 * at))
        at += n
    sizes, units, of_unit, pairs = (p.astype(np.int64) for p in parts)
    links, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
    where = right["at"].to_numpy()
    links[where] = right["links"].to_numpy()
    best[where] = right["best"].to_numpy(zero_copy_only=False)
    run = lambda values, n: np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(n)))])
    documents = left["docs"].combine_chunks().flatten()
    columns = {name: documents.field(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    columns |= {"n_best": pa.array(run(run(best[pairs], of_unit)[units], sizes)), "count_sum": pa.array(run(run(links[pairs], of_unit)[units], sizes))}
    return pa.table(columns | {"groups_sha256": documents.field("groups_sha256")})


def measures(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document: tokens, groups, links, and how its links fare in the counts of all texts."""
    chunked = keep_table(chunks(docs, a_path or vocabulary(A), b_path or vocabulary(B)), "links")
    counted = chunked.select("chunk", F.inline("pairs")).join(pair_counts(chunked), "pair").select(F.col("chunk").alias("of_chunk"), "at", "links", "best")
    return chunked.select("chunk", "docs", "lengths", "units").groupBy("chunk").cogroup(counted.groupBy("of_chunk")).applyInArrow(
        _summed, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def op11(docs: DataFrame) -> DataFrame:
    return measures(docs)
