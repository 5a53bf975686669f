"""Packing documents into sequences: reciprocal-capacity classes, a fixed number of pieces to a bin.

A class holds the pieces of length ``capacity / k``, and a bin of the class takes
exactly k of them. A document is cut into pieces of full capacity and, for what
is left, one piece for each power of two in its length, so every piece fills its
slot and every bin its sequence. Each task packs the documents it reads and
shares nothing with others: its sequences are numbered from its own partition.
What is open at a task's end, fewer than k pieces of a class, is closed in
sequences of a power of two of them, which need no padding either.

No table is shuffled, and a task holds fewer than k pieces of each class, without
their tokens.

Defined results: a NULL or empty text is its end id alone, one piece of one token;
a text of any length is cut whole; a NULL ``doc_id`` is kept as it is; repeated
rows and rows of one ``doc_id`` are documents of their own, each with its pieces;
an empty table has no pieces. Columns other than ``doc_id`` and ``text`` are not
read. A text without a space or line feed is given to the tokenizer in one go.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pieces
from plumbline.llm.units import ByteTokens, Packed, blocks, vocabulary

TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 0, 1024


class Encoder(Packed):
    """Packed ids of units."""

    def __init__(self, path: str):
        super().__init__()
        self.tokens = ByteTokens(path, special_as_text=False)
        self.type = np.dtype("<u2" if len(self.tokens.bytes) <= 1 << 16 else "<u4")

    def learn(self, new: list[bytes]) -> None:
        out: list[bytes] = [b""] * len(new)
        held = blocks(new)
        for block, ids in zip(held, self.tokens.ids([b"".join([new[i] for i in block]).decode() for block in held])):
            ends = np.searchsorted(np.cumsum(self.tokens.lengths[ids]), np.cumsum([len(new[i]) for i in block])) + 1
            raw, begin = ids.astype(self.type).tobytes(), 0
            for i, end in zip(block, (ends * self.type.itemsize).tolist()):
                out[i] = raw[begin:end]
                begin = end
        self.packed += out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(sizes: np.ndarray, capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each piece length: the document of each piece, and where in it the piece begins."""
    whole, rest = sizes // capacity, sizes % capacity
    docs = np.repeat(np.arange(len(sizes)), whole)
    out = {capacity: (docs, (np.arange(len(docs)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity)}
    length = capacity // 2
    while length:
        docs = np.flatnonzero(rest & length)
        out[length] = docs, whole[docs] * capacity + rest[docs] // (2 * length) * (2 * length)
        length //= 2
    return out


class Bins:
    """Open pieces of each class of one task, as columns of rows; full bins come out."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity, self.open = first, capacity, {}

    def _numbered(self, table: pa.Table, length: int, per_bin: int) -> pa.Table:
        at = np.arange(table.num_rows)
        out = table.append_column("sequence_id", pa.array(self.next + at // per_bin, pa.int64())).append_column("offset", pa.array(at % per_bin * length, pa.int64()))
        self.next += table.num_rows // per_bin
        return out

    def add(self, length: int, table: pa.Table) -> pa.Table:
        """The pieces that fill whole bins with those held before; the rest is held."""
        if length in self.open:
            table = pa.concat_tables([self.open[length], table])
        per_bin = self.capacity // length
        full = table.num_rows // per_bin * per_bin
        self.open[length] = pa.Table.from_batches(table.slice(full).to_batches(), table.schema)
        return self._numbered(table.slice(0, full), length, per_bin)

    def close(self):
        """What is open, in sequences of a power of two of pieces."""
        for length, table in self.open.items():
            at, take = 0, self.capacity // length
            while take:
                if table.num_rows & take:
                    yield self._numbered(table.slice(at, take), length, take)
                    at += take
                take //= 2


def packed(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves if asked for."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    path = path or vocabulary(TOKENIZER)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bins = Bins(TaskContext.get().partitionId() << 32, capacity)
        for batch in batches:
            for part, texts in pieces(batch):
                values, sizes = encoder(path).encode(texts, end_id)
                values = values.astype("<u4")
                begins = np.cumsum(sizes) - sizes
                for length, (rows, start) in cut(sizes, capacity).items():
                    if len(rows):
                        yield from bins.add(length, columns(part.column("doc_id"), values, sizes, begins, rows, start, length)).to_batches()
        for table in bins.close():
            yield from table.to_batches()

    def columns(doc_ids, values, sizes, begins, rows, start, length):
        at, raw = begins[rows] + start, memoryview(values).cast("B")
        out = {
            "doc_id": doc_ids.take(pa.array(rows)), "start": pa.array(start, pa.int64()), "length": pa.array(np.full(len(rows), length), pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(raw[a:a + 4 * length]) for a in (4 * at).tolist()], pa.int64()), "doc_tokens": pa.array(sizes[rows], pa.int64()),
        }
        if ids:
            own = values[at[:, None] + np.arange(length)].astype(np.int32).ravel()
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * length, pa.int32()), pa.array(own))
        return pa.table(out)

    shown = ", ids array<int>" if ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{shown}, sequence_id bigint, offset bigint")


def sequences(pieces_: DataFrame, pad_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, n_padding, and its ids, filled up unless their number is a power of two.

    A sequence holds at most ``capacity`` tokens, so what meets in a group is bounded.
    """
    run = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    filled = pieces_.groupBy("sequence_id").agg(F.flatten(F.transform(run, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    short = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(capacity - n)
    return filled.select("sequence_id", n.cast("bigint").alias("n_tokens"), short.cast("bigint").alias("n_padding"), F.concat("ids", F.array_repeat(F.lit(pad_id), short)).alias("ids"))


def op13(docs: DataFrame) -> DataFrame:
    return packed(docs, ids=False)
