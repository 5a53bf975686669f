"""Token ids in files: frequency-ranked ids, byte-aligned, with separate control bytes.

An id is replaced by its rank among the ids of the corpus, so common ones take
one byte. Every rank takes one to four bytes; how many is said by two bits in a
separate run of control bytes, four ids to a byte. A reader looks a control byte
up in a table that names the data bytes of its four ids, so a whole block is
decoded with one gather.

A dataset is a folder: ``ranks`` (the id of each rank) and ``shard-n.svb``
files, one per range of ``doc_id`` in ascending order, each a row of blocks.
Texts are tokenised once, after the range shuffle, into provisional shards; the
ids are counted over all of them, and each shard is rewritten with ranks, its
provisional one deleted once the final one is whole.

Defined results: a NULL or empty text is its end id alone; a text of any length
is encoded whole; a NULL ``doc_id`` stands first; repeated rows are documents
of their own, in the order of a hash of their text; an empty table gives a dataset
without shards. ``doc_id`` must be a whole number; columns other than it and
``text`` are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import AtomicFile, exists, keep_table, open_file, pieces, remove
from plumbline.llm.units import Packed
from plumbline.session import fresh_folder

TOKENIZER, END_ID = "word_bpe_49k.json", 2
BLOCK_IDS = 1 << 20
#: Pieces of words a worker remembers the ids of.
REMEMBERED = 300_000
_HEAD = struct.Struct("<4sQQQQ")


# ---- ids --------------------------------------------------------------------

def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabularies lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(Packed):
    """Ids of texts by a tokenizer file whose tokens never span white space.

    Texts are cut at ASCII white space, which this tokenizer drops, and each
    different word, told by its bytes, is encoded once. A new
    word of plain letters, digits and signs is cut into the pre-tokenizer's
    pieces here and each piece given to the model; any other word goes through
    the whole tokenizer.
    """

    find = staticmethod(W.find_words)
    #: Fixed value: the pre-tokenizer's pattern.
    _SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    #: Lines of plain words: each character is its own composed form and has one lower-case character.
    _PLAIN = re.compile("[\n\x21-\x7eÀ-ÖØ-öø-įĲ-ž]*")
    _PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|\n|[^a-zß-öø-ž0-9\n]+")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.size = self.tokenizer.model, self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        steps = json.loads(self.tokenizer.to_str())
        normal, cut = steps["normalizer"] or {}, steps["pre_tokenizer"] or {}
        if [n["type"] for n in normal.get("normalizers", [])] != ["NFC", "Replace", "Lowercase"] or self._SPLIT not in json.dumps(cut, ensure_ascii=False):
            raise ValueError(f"{path} does not drop white space before it cuts words")
        self._level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'HI'[self.type.itemsize > 2]}", *ids)

    def _part(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else self._level.pre_tokenize_str(piece)[0][0]
        got = self._pack([t.id for t in self.model.tokenize(shown)])
        if len(self.parts) < REMEMBERED:
            self.parts[piece] = got
        return got

    def _plain(self, lines: str) -> list[bytes]:
        """The packed ids of each line of plain words."""
        known, out, held = self.parts.get, [], []
        for piece in self._PIECES.findall(lines.lower()):
            if piece == "\n":
                out.append(b"".join(held))
                held.clear()
            else:
                held.append(known(piece) or self._part(piece))
        out.append(b"".join(held))
        return out

    def _words(self, words: list[bytes]) -> list[bytes]:
        lines = b"\n".join(words).decode()
        if "<|" not in lines and self._PLAIN.fullmatch(lines):
            return self._plain(lines)
        if len(words) == 1:
            return [self._pack(self.tokenizer.encode(lines, add_special_tokens=False).ids)]
        half = len(words) // 2
        return self._words(words[:half]) + self._words(words[half:])

    def learn(self, new: list[bytes]) -> None:
        self.packed += self._words(new)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- coding -----------------------------------------------------------------

def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of whole numbers below 2 ** 32; the last four are filled up with zeros."""
    v = np.zeros(-(-len(values) // 4) * 4, "<u4")
    v[:len(values)] = values
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    control = extra[0::4] | extra[1::4] << 2 | extra[2::4] << 4 | extra[3::4] << 6
    used = np.arange(4) <= extra[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each control byte: the length of its data, and the place of each of 16 bytes in it (-1: zero)."""
    length, place = np.zeros(256, np.int64), np.full((256, 16), -1, np.int64)
    for c in range(256):
        at = 0
        for k in range(4):
            n = (c >> 2 * k & 3) + 1
            place[c, 4 * k:4 * k + n] = range(at, at + n)
            at += n
        length[c] = at
    return length, place


LENGTH, PLACE = _tables()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again."""
    c = np.frombuffer(control, np.uint8)
    d = np.append(np.frombuffer(data, np.uint8), np.uint8(0))
    at = np.cumsum(LENGTH[c]) - LENGTH[c]
    where = PLACE[c]
    where = np.where(where < 0, len(d) - 1, where + at[:, None])
    return d[where].view("<u4").reshape(-1)[:n]


def write_block(out, doc_ids: list, counts: list[int], values: np.ndarray) -> None:
    control, data = pack(values)
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    out.write(_HEAD.pack(b"SVB1", len(ids), len(values), len(control), len(data)))
    for part in (valid.tobytes(), ids.tobytes(), np.array(counts, "<u8").tobytes(), control, data):
        out.write(part)


def read_blocks(source):
    """doc_ids, counts, values of each block of an open shard."""
    while head := source.read(_HEAD.size):
        magic, n, n_values, n_control, n_data = _HEAD.unpack(head)
        if magic != b"SVB1":
            raise ValueError("not a token shard")
        valid = np.frombuffer(source.read(n), np.uint8)
        ids = np.frombuffer(source.read(8 * n), "<i8").tolist()
        counts = np.frombuffer(source.read(8 * n), "<u8").astype(np.int64)
        control = source.read(n_control)
        yield [d if v else None for d, v in zip(ids, valid)], counts, unpack(control, source.read(n_data), n_values)


# ---- jobs -------------------------------------------------------------------

def _read_raw(source, kind: np.dtype):
    while head := source.read(24):
        n, size, ids = struct.unpack("<QQQ", head)
        valid = np.frombuffer(source.read(n), np.uint8)
        docs = np.frombuffer(source.read(8 * n), "<i8").tolist()
        counts = np.frombuffer(source.read(8 * n), "<u8").tolist()
        yield [d if v else None for d, v in zip(docs, valid)], counts, np.frombuffer(zstandard.decompress(source.read(size), max_output_size=max(1, ids * kind.itemsize)), kind)


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Write a dataset; its folder, and its shards: shard, start (ids before it), n_docs, n_ids."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    folder = fresh_folder(spark, "tokens")

    def tokenise(batches):
        shard, out, coder = TaskContext.get().partitionId(), None, None
        n_docs = n_ids = pending = 0
        counts = None
        ids, sizes, held = [], [], []  # of the block at hand: document ids, ids of each, arrays of ids

        def flush():
            valid = np.array([d is not None for d in ids], np.uint8).tobytes()
            values = np.concatenate(held)
            counts[:] += np.bincount(values, minlength=coder.size)
            packed = zstandard.ZstdCompressor(level=1).compress(values.tobytes())
            out.write(struct.pack("<QQQ", len(ids), len(packed), sum(sizes)) + valid + np.array([d or 0 for d in ids], "<i8").tobytes() + np.array(sizes, "<u8").tobytes() + packed)
            for x in (ids, sizes, held):
                x.clear()

        for batch in batches:
            for part, texts in pieces(batch):
                if out is None:
                    coder, out = encoder(path), AtomicFile(folder, f"raw-{shard}")
                    counts = np.zeros(coder.size, np.int64)
                values, own = coder.encode(texts, end_id)
                held.append(values)
                sizes += own.tolist()
                ids += part.column("doc_id").to_pylist()
                n_docs, n_ids, pending = n_docs + len(own), n_ids + len(values), pending + len(values)
                if pending >= BLOCK_IDS:
                    flush()
                    pending = 0
        if out is not None:
            if ids:
                flush()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids], "counts": pa.array([counts.tobytes()], pa.binary())})

    mark = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("_mark")]
    ranged = docs.select("doc_id", "text", mark.alias("_mark")).repartitionByRange(*order).sortWithinPartitions(*order).drop("_mark")
    made = keep_table(ranged.mapInArrow(tokenise, "shard int, n_docs bigint, n_ids bigint, counts binary"), "token-shards")

    def total(batches):
        held = None
        for batch in batches:
            for c in batch.column("counts"):
                c = np.frombuffer(c.as_buffer(), np.int64)
                held = c.copy() if held is None else held + c
        if held is not None:
            yield pa.RecordBatch.from_pydict({"counts": pa.array([held.tobytes()], pa.binary())})

    sums = [np.frombuffer(r["counts"], np.int64) for r in made.select("counts").coalesce(16).mapInArrow(total, "counts binary").collect()]
    size = encoder(path).size
    ranked = np.argsort(-sum(sums, np.zeros(size, np.int64)), kind="stable").astype("<u4")
    kind = str(encoder(path).type)
    table = AtomicFile(folder, "ranks")
    table.write(ranked.tobytes())
    table.close()

    start, rows = 0, []
    for r in made.select("shard", "n_docs", "n_ids").orderBy("shard").collect():  # one row per file
        rows.append((r["shard"], start, r["n_docs"], r["n_ids"]))
        start += r["n_ids"]
    schema = "shard int, start bigint, n_docs bigint, n_ids bigint"
    shards = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))

    def recode(batches):
        with open_file(folder, "ranks") as f:
            rank = np.empty(size, np.uint32)
            rank[np.frombuffer(f.read(), "<u4")] = np.arange(size, dtype=np.uint32)
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                if not exists(folder, f"shard-{shard}.svb"):  # else an earlier attempt finished it
                    out = AtomicFile(folder, f"shard-{shard}.svb")
                    with open_file(folder, f"raw-{shard}") as f:
                        for ids, counts, values in _read_raw(f, np.dtype(kind)):
                            write_block(out, ids, counts, rank[values])
                    out.close()
                remove(folder, f"raw-{shard}")
            yield pa.RecordBatch.from_pydict({"shard": batch.column("shard")})

    shards.mapInArrow(recode, "shard int").write.format("noop").mode("overwrite").save()
    return folder, shards


def read_tokens(folder: str, shards: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start, and the ids of each document of a dataset, or their number and checksum."""
    def run(batches):
        with open_file(folder, "ranks") as f:
            ids_of = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
                with open_file(folder, f"shard-{shard}.svb") as f:
                    for docs, counts, values in read_blocks(f):
                        ids = ids_of[values]
                        ends = np.cumsum(counts)
                        begins = ends - counts
                        out = {"doc_id": pa.array(docs, pa.int64()), "start": pa.array(begins + start, pa.int64())}
                        if digest:
                            raw = memoryview(ids.astype("<u4").tobytes())
                            out |= {"n_tokens": pa.array(counts), "ids_crc32": pa.array([zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(begins, ends)], pa.int64())}
                        else:
                            out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:] if len(ends) else 0), pa.int32()), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_pydict(out)
                        start += int(ends[-1]) if len(ends) else 0

    kind = "n_tokens bigint, ids_crc32 bigint" if digest else "ids array<int>"
    return shards.select("shard", "start").mapInArrow(run, f"doc_id bigint, start bigint, {kind}")


def op8(docs: DataFrame) -> DataFrame:
    return read_tokens(*write_tokens(docs), digest=True)
