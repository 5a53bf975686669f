"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text, and a cut lies where its lowest bits
are zero. Text of a short period has few hash values and often no such cut, so
every window of ``MOST`` places without one is cut where its hash is least, at
all such places: a period has the same cuts each time. A cut depends on the bytes
near it alone, so an insertion moves the cuts beside it and no others. The unit of comparison is a run of a few chunks
between cuts, or a whole text of fewer chunks, told by a 64-bit digest; runs whose digest occurs twice or more in
the corpus are duplicate, and where they join to a passage of enough words, the
passage is a repeat. A chance equality of digests covers one run, too few words
to count.

Of the places of a run the first (by document, then position) is kept; what the
other runs of a passage cover may be removed.

Defined results: a NULL or empty text has no chunk; a text of any length is cut
whole; a passage repeated inside one document is found like any other; rows of one
``doc_id`` and text are one place, those of one ``doc_id`` and different texts are texts of their own, told by
``text_id``; a NULL ``doc_id`` is a document like others; an empty
table gives an empty result. Columns other than ``doc_id`` and ``text`` are only passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import keep_table, map_texts

#: A cut every 2 ** CUT_BITS bytes on average; chunks in a run; words of the least passage reported.
CUT_BITS, RUN, MIN_WORDS = 4, 4, 28
#: Bytes that a cut looks at; places of a window, a power of two, that holds a cut at least.
REACH, MOST = 16, 32

_GEAR = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: twice the last one plus the byte's value, over the last REACH bytes.

    Bits are taken from the place that exactly these bytes reach.
    """
    value = _GEAR[data]
    total = np.zeros(len(data), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(REACH):
            total[k:] += value[:len(data) - k] << np.uint64(k)
    return total >> np.uint64(REACH - 1)


def _over(combine, values: np.ndarray) -> np.ndarray:
    """``combine`` of each MOST values in a row."""
    k = 1
    while k < MOST:
        values = combine(values[:-k], values[k:])
        k *= 2
    return values


def _least(h: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places where the hash is least in a window whose places all are ``low``: neither a cut nor barred."""
    out = np.zeros(len(h), bool)
    if len(h) < MOST:
        return out
    least = np.where(_over(np.logical_and, low), _over(np.minimum, h), 0)
    # Of the windows around a place, none has a least hash above its own.
    around = np.zeros(len(h) + MOST - 1, h.dtype)
    around[MOST - 1:len(h)] = least
    return low & (_over(np.maximum, around) == h)


def chunks(texts: W.Texts) -> W.Words:
    """Byte spans of the chunks of each text. Cuts lie between characters."""
    n = len(texts.data)
    cut = np.zeros(n + 1, bool)
    starts = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    step, halo = W.SLICE, REACH + MOST
    for at in range(0, n, step):
        a, z = max(0, at - halo), min(n, at + step + MOST)
        # The hash before byte i stands at i - a; a place inside a character has the greatest hash.
        h = np.zeros(z - a, np.uint64)
        h[1:] = gear(texts.data[a:z - 1])
        inside = texts.data[a:z] & 0xC0 == 0x80
        mine = (h & np.uint64((1 << CUT_BITS) - 1) == 0) & ~inside
        # A hash that looks over the start of a text, or of what was read, is no cut of its own.
        near = starts[np.searchsorted(starts, a - REACH, "right"):np.searchsorted(starts, z)]
        barred = np.zeros(z - a, bool)
        barred[:REACH] = True
        for k in range(REACH):
            place = near + k - a
            barred[place[(place >= 0) & (place < z - a)]] = True
        mine &= ~barred
        rank = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rank[inside] = 0xFFFFFFFF
        mine |= _least(rank, ~(mine | barred)) & ~inside
        cut[at:min(n, at + step)] = mine[at - a:at - a + step]
    cut[starts] = True
    cut[n] = False
    at = np.flatnonzero(cut)
    return W.Words(at, np.append(at[1:], n)[:len(at)], np.searchsorted(at, texts.offsets))


def runs(texts: W.Texts):
    """Digest, owner, start, end of every run of chunks; a text of fewer chunks is one run."""
    found = chunks(texts)
    hashes, count, own = W.hash_words(texts, found), found.count, found.owner()
    grams, at = W.windows(hashes, found, RUN)
    last = at + RUN - 1
    for n in range(1, RUN):
        if (count == n).any():
            short, first = W.windows(hashes, found, n)
            whole = count[own[first]] == n
            grams, at, last = np.concatenate([grams, short[whole]]), np.concatenate([at, first[whole]]), np.concatenate([last, first[whole] + n - 1])
    order = np.argsort(at, kind="stable")
    grams, at, last = grams[order], at[order], last[order]
    return grams, own[at], found.start[at], found.end[last]


def run_digests(docs: DataFrame) -> DataFrame:
    """digest of every run of every text."""
    return map_texts(docs.select("text"), lambda part, texts: {"digest": runs(texts)[0].view(np.int64)}, "digest bigint")


def with_text_id(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, text: a text is told by its document, and by a hash of it where a ``doc_id`` has several rows.

    Ids that repeat are counted and written first, so Spark knows the size of
    their table and, where they are few, sends it to the texts, which are not
    shuffled; elsewhere ``text_id`` is 0, which takes no room in what is shuffled.
    """
    many = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_many"), F.lit(True).alias("_again"))
    many = keep_table(many, "repeated-ids", release=True)
    own = F.when(F.col("_again"), F.xxhash64("text")).otherwise(F.lit(0)).cast("bigint")
    return docs.select("doc_id", "text").join(many, F.col("doc_id").eqNullSafe(F.col("_many")), "left").select("doc_id", own.alias("text_id"), "text")


def run_table(told: DataFrame) -> DataFrame:
    """digest, doc_id, text_id, nth: every run, by its number in the text; ``told`` has its ``text_id``."""
    kind = told.schema["doc_id"].dataType.simpleString()

    def fn(part, texts):
        grams, owner, _, _ = runs(texts)
        nth, at = np.arange(len(owner)) - np.searchsorted(owner, owner), pa.array(owner)
        return {"digest": grams.view(np.int64), "doc_id": part.column("doc_id").take(at), "text_id": part.column("text_id").take(at), "nth": nth.astype(np.int32)}

    return map_texts(told, fn, f"digest bigint, doc_id {kind}, text_id bigint, nth int")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_id, start, end (bytes), n_words, removable: passages that occur elsewhere too.

    ``removable`` lists the spans of it that have an earlier place. Digests are
    counted before the shuffle that brings them together; the places of shared
    digests are found by a second reading, joined to them, and so are the first
    places. Each step is written, and what it shuffled let go, before the next.
    """
    shared = keep_table(run_digests(docs).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "shared-runs", release=True)
    told = with_text_id(docs)
    hits = keep_table(run_table(told).join(shared, "digest"), "run-hits", release=True)
    place = F.struct("doc_id", "text_id", "nth")
    first = keep_table(hits.groupBy("digest").agg(F.min(place).alias("first")), "first-places", release=True)
    flags = keep_table(hits.join(first, "digest").select("doc_id", "text_id", "nth", (~place.eqNullSafe(F.col("first"))).alias("later")), "run-flags", release=True)
    # A text's own runs: bounded by its text.
    listed = flags.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("nth", "later")).alias("hits"))
    return _passages(told, listed, min_words)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _joined(start: np.ndarray, end: np.ndarray):
    """First and last index of each group of spans that touch, spans in order."""
    if not len(start):
        return
    new = np.concatenate(([0], np.flatnonzero(start[1:] > end[:-1]) + 1))
    yield from zip(new.tolist(), np.append(new[1:], len(start)).tolist())


def _passages(told: DataFrame, listed: DataFrame, min_words: int) -> DataFrame:
    """Join the shared runs of each text to passages and keep those of enough words."""
    mine = listed.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"), "hits")
    held = told.join(mine, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_id") == F.col("_text"))).select("doc_id", "text_id", "text", F.col("hits.nth").alias("nth"), F.col("hits.later").alias("later"))
    kind = told.schema["doc_id"].dataType.simpleString()

    def fn(part, texts):
        words = W.find_words(texts)
        _, owner, start, end = runs(texts)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = {k: [] for k in ("row", "start", "end", "n_words", "removable")}
        for i, (nth, later) in enumerate(zip(part.column("nth").to_pylist(), part.column("later").to_pylist())):
            nth, later = np.array(nth, np.int64), np.array(later, bool)
            own = nth < first[i + 1] - first[i]
            order = np.argsort(nth[own], kind="stable")
            at, late = nth[own][order] + first[i], later[own][order]
            if not len(at):
                continue
            s, e = start[at], end[at]
            base = int(texts.offsets[i])
            for a, z in _joined(s, e):
                lo, hi = np.searchsorted(words.start, s[a], "left"), np.searchsorted(words.end, e[z - 1], "right")
                if hi - lo >= min_words:
                    x, y = s[a:z][late[a:z]], e[a:z][late[a:z]]
                    cut = [{"start": int(x[b]) - base, "end": int(y[c - 1]) - base} for b, c in _joined(x, y)]
                    for k, v in zip(out, (i, int(s[a]) - base, int(e[z - 1]) - base, int(hi - lo), cut)):
                        out[k].append(v)
        at = pa.array(out["row"], pa.int64())
        return {"doc_id": part.column("doc_id").take(at), "text_id": part.column("text_id").take(at), "start": pa.array(out["start"], pa.int64()),
                "end": pa.array(out["end"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "removable": pa.array(out["removable"], _SPANS)}

    return map_texts(held, fn, f"doc_id {kind}, text_id bigint, start bigint, end bigint, n_words bigint, removable array<struct<start:bigint,end:bigint>>")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with removable passages cut out of their texts."""
    cuts = repeats(docs, min_words).distinct().groupBy(F.col("doc_id").alias("_cut_id"), F.col("text_id").alias("_cut_text")).agg(
        F.sort_array(F.flatten(F.collect_list("removable"))).alias("_cuts"))
    same = docs["doc_id"].eqNullSafe(cuts["_cut_id"]) & ((cuts["_cut_text"] == 0) | (F.xxhash64(docs["text"]) == cuts["_cut_text"]))
    held = docs.join(cuts, same, "left").drop("_cut_id", "_cut_text")
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, cut in enumerate(batch.column("_cuts").to_pylist()):
                if cut:
                    raw, out, at = texts[i].encode(), b"", 0
                    for c in cut:
                        out, at = out + raw[at:c["start"]], c["end"]
                    texts[i] = (out + raw[at:]).decode()
            batch = batch.select(names)
            yield batch.set_column(names.index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    return held.mapInArrow(run, docs.schema)


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, n_passages, n_words, removable_bytes, spans: documents that hold a repeated passage."""
    found = repeats(docs).distinct()
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_passages"), F.sum("n_words").alias("n_words"), F.sum(F.aggregate("removable", F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])).alias("removable_bytes"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"))
