"""Benchmark decontamination by a hash set of test n-grams.

The windows of the benchmark are held by every task as a hash set, in blocks of
bounded size; a task hashes the windows of its documents from word hashes, and
compares each hit with the window's own words before it counts.

Defined results: a NULL or empty text, of a document or an item, has no words,
is hit by nothing and hits nothing; a text of any length is scanned whole;
repeated documents each have a row; rows of one ``item_id`` are one item, a NULL
one is listed as the empty string; an empty benchmark hits nothing. Columns
other than ``doc_id`` / ``item_id`` and ``text`` are only passed on.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import AtomicFile, map_texts, open_file, pieces
from plumbline.session import fresh_folder

WINDOW = 10
#: Windows a task holds at once, about 100 bytes each; a larger benchmark is more blocks.
BLOCK_WINDOWS = 250_000
_FILTER_BITS = 22


@dataclass
class Block:
    """Windows of some items: by length, sorted hashes; by hash, its words and items."""

    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    seen: dict[int, np.ndarray] = field(default_factory=dict)
    found: dict[tuple[int, int], dict[bytes, set[str]]] = field(default_factory=dict)


def _normal(data: np.ndarray) -> np.ndarray:
    return W.LOWER.astype(np.uint8)[data]


def _key(data: np.ndarray, words: W.Words, i: int, n: int) -> bytes:
    return b" ".join(data[words.start[k]:words.end[k]].tobytes() for k in range(i, i + n))


def make_block(item_ids: list, texts: list) -> Block:
    block, t = Block(), W.texts_of(pa.array(texts, pa.large_string()))
    words = W.find_words(t, W.LETTER)
    hashes, data, owner = W.hash_words(t, words, W.LOWER_VALUE), _normal(t.data), words.owner()
    for n in sorted(set(np.minimum(words.count, WINDOW).tolist()) - {0}):
        grams, at = W.windows(hashes, words, n)
        if n < WINDOW:
            own = words.count[owner[at]] == n
            grams, at = grams[own], at[own]
        for h, i in zip(grams.tolist(), at.tolist()):
            item = "" if item_ids[owner[i]] is None else str(item_ids[owner[i]])
            block.found.setdefault((n, h), {}).setdefault(_key(data, words, i, n), set()).add(item)
        block.hashes[n] = np.unique(grams)
        block.seen[n] = np.zeros(1 << _FILTER_BITS, bool)
        block.seen[n][(block.hashes[n] & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return block


def scan(block: Block, data: np.ndarray, words: W.Words, hashes: np.ndarray, owner: np.ndarray):
    """Mark the words inside occurring windows, and list (text, item) of them."""
    hit, pairs = np.zeros(len(hashes), bool), set()
    for n, known in block.hashes.items():
        grams, at = W.windows(hashes, words, n)
        maybe = np.flatnonzero(block.seen[n][(grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        maybe = maybe[np.isin(grams[maybe], known)]
        for h, i in zip(grams[maybe].tolist(), at[maybe].tolist()):
            items = block.found[n, h].get(_key(data, words, i, n))
            if items:
                hit[i:i + n] = True
                pairs.update((int(owner[i]), item) for item in items)
    return hit, pairs


def store_blocks(benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> tuple[str, int]:
    """Write the windows of a benchmark to the shared folder, in blocks made one at a time."""
    items = benchmark.select("item_id", "text")
    n = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-n // block_windows))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    folder = fresh_folder(benchmark.sparkSession, "benchmark")
    for b in range(blocks):
        rows = items.filter(part == b).collect()
        out = AtomicFile(folder, f"block-{b}")
        out.write(pickle.dumps(make_block([r[0] for r in rows], [r[1] for r in rows])))
        out.close()
    return folder, blocks


_held: tuple = (None, None)


def load_block(folder: str, b: int) -> Block:
    """A block by name; a task keeps the last one it used."""
    global _held
    if _held[0] != (folder, b):
        _held = (None, None)
        with open_file(folder, f"block-{b}") as f:
            _held = ((folder, b), pickle.loads(f.read()))
    return _held[1]


def _scan_texts(folder: str, blocks: int, texts: W.Texts):
    words = W.find_words(texts, W.LETTER)
    hashes, data, owner = W.hash_words(texts, words, W.LOWER_VALUE), _normal(texts.data), words.owner()
    hit, pairs = np.zeros(len(hashes), bool), set()
    for b in range(blocks):
        more, found = scan(load_block(folder, b), data, words, hashes, owner)
        hit |= more
        pairs |= found
    return words, hit, pairs


def contamination(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    folder, blocks = store_blocks(benchmark, block_windows)

    def measure(part, texts):
        words, hit, pairs = _scan_texts(folder, blocks, texts)
        items = [[] for _ in range(len(texts))]
        for text, item in sorted(pairs):
            items[text].append(item)
        n_hit = W.per_text(hit, words.first)
        return {"doc_id": part.column("doc_id"), "n_words": words.count, "n_hit": n_hit, "n_items": pa.array(map(len, items), pa.int64()),
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": n_hit > 0,
                "items": pa.array(items, pa.list_(pa.string()))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), measure,
                     f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without the documents that hold a window, or (``remove='spans'``) with each run of hit words cut out."""
    folder, blocks = store_blocks(benchmark, block_windows)

    def cut(texts: W.Texts, words: W.Words, hit: np.ndarray) -> list[str]:
        out = []
        for k in range(len(texts)):
            at, whole = int(texts.offsets[k]), b""
            own = np.arange(words.first[k], words.first[k + 1])
            runs = np.flatnonzero(np.diff(np.concatenate(([0], hit[own].astype(np.int8), [0]))))
            for a, z in zip(runs[::2], runs[1::2]):
                whole += texts.data[at:words.start[own[a]]].tobytes()
                at = int(words.end[own[z - 1]])
            out.append((whole + texts.data[at:texts.offsets[k + 1]].tobytes()).decode())
        return out

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch):
                words, hit, _ = _scan_texts(folder, blocks, texts)
                bad = W.per_text(hit, words.first) > 0
                if remove == "documents":
                    yield part.filter(pa.array(~bad))
                elif bad.any():
                    clean = pa.array([new if b else old for new, old, b in zip(cut(texts, words, hit), part.column("text").to_pylist(), bad)],
                                     part.column("text").type)
                    yield part.set_column(part.schema.get_field_index("text"), "text", clean)
                else:
                    yield part

    return docs.mapInArrow(run, docs.schema)


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).drop("items")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LIST = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LIST} AS w FROM documents),
 it AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, {_LIST} AS w FROM benchmark) WHERE len(w) > 0),
 iw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM it)),
 dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM
   (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM it) WHERE len(w) >= n)),
 hit AS (SELECT r, i, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
 pos AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
 its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256,
   coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""
