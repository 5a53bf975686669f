"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger stores the measurements
and one bit per failed rule, so a policy (a mask of rules) or an ablation (a
policy without one rule) is bitwise arithmetic on the ledger, never a new scan.

Defined results: a NULL or empty text has no words and all measurements 0, and
so fails ``few_words``; a text of any length is measured whole; repeated rows
each have a ledger row; an empty table gives an empty ledger; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import map_texts

#: Rules by bit. Each is a condition on the measurements that means failure.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 25 * n_words",
    "shouting": "10 * n_capitals > 4 * word_chars",
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that a document must pass.
POLICIES = {"v1": BASE, "v2": tuple(RULES)}

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def _repeats(hashes: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return count[back] > 1


def _measure(part, texts: W.Texts) -> dict:
    words = W.find_words(texts)
    inside = W.WORD[texts.data]
    hashes = W.hash_words(texts, words)
    owner = words.owner()
    triples, at = W.windows(hashes, words, 3)
    again = at[_repeats(W.salted(triples, owner[at]))] if len(at) else at
    hit = np.zeros(len(hashes), bool)
    for k in range(3):
        hit[again + k] = True
    lines = W.find_words(texts, W.LINE)
    word_bytes = np.zeros(len(inside) + 1, np.int64)
    np.cumsum(inside, out=word_bytes[1:])
    full = word_bytes[lines.end] > word_bytes[lines.start]
    line_owner = lines.owner()[full]
    marks = W.salted(W.hash_words(texts, lines)[full], line_owner)
    _, seen = np.unique(marks, return_index=True)
    later = np.ones(len(marks), bool)
    later[seen] = False
    n = len(texts)
    return {
        "doc_id": part.column("doc_id"),
        "n_words": words.count,
        "word_chars": W.per_text(inside & (texts.data & 0xC0 != 0x80), texts.offsets),
        "n_symbols": W.per_text(_SYMBOL[texts.data], texts.offsets),
        "n_dup_lines": np.bincount(line_owner[later], minlength=n),
        "n_repeat_words": W.per_text(hit, words.first),
        "n_lines": np.bincount(line_owner, minlength=n),
        "n_capitals": W.per_text(_CAPITAL[texts.data], texts.offsets),
    }


def failure_bits() -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements, ``failed``: one bit per failed rule, in the order of RULES."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = map_texts(docs.select("doc_id", "text"), _measure, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in _MEASURES))
    return measured.withColumn("failed", failure_bits())


def apply_policy(book: DataFrame, version: str) -> DataFrame:
    """Add ``kept``: no rule of the policy failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(mask(POLICIES[version])) == 0)


def ablations(book: DataFrame, version: str) -> DataFrame:
    """rule, n_failed, n_regained: for each rule of a policy, who fails it and who would be kept without it.

    Documents are counted by failure bits first, at most two to the number of rules of rows.
    """
    rules = POLICIES[version]
    counts = book.groupBy(F.col("failed").bitwiseAND(mask(rules)).alias("bits")).count()
    bit = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).alias("bit")) for r in rules]))
    return counts.select("bits", "count", bit.alias("r")).groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_regained"))


def op4(docs: DataFrame) -> DataFrame:
    book = apply_policy(ledger(docs), "v2")
    base = F.col("failed").bitwiseAND(mask(BASE)) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                       "kept", "n_lines", "n_capitals", "failed")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BITS = " | ".join(f"(CASE WHEN {rule} THEN {1 << k} ELSE 0 END)" for k, rule in enumerate(RULES.values()))
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
 tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
 rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
 ln AS (SELECT r, s FROM (SELECT r, unnest(string_split(t, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
 dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT s) AS n_dup_lines FROM ln GROUP BY r),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
   coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
   CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
 b AS (SELECT *, {_BITS} AS failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {mask(BASE)}) <> 0 AS base_failed,
   (failed & {mask(POLICIES["v2"])}) = 0 AS kept, n_lines, n_capitals, CAST(failed AS INTEGER) AS failed FROM b"""
