"""Text helpers, all as column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import lexicons as lx

MARK = "\u0001"


def let(value: Column, body) -> Column:
    """Compute ``value`` once for a lambda that reads it many times."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Drop whitespace of every kind from both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Turn whitespace runs into one space and trim."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?|\f", "\n")


def lines_of(c: Column) -> Column:
    return F.split(unify_newlines(c), "\n", -1)


def words_of(c: Column) -> Column:
    """Whitespace-separated words."""
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words_of(c))


def at_least_words(n: int) -> str:
    """A pattern of texts with ``n`` words or more, read no further than that."""
    return r"^\s*+(?:\S++\s++){%d}\S" % (n - 1)


def terms(c: Column) -> Column:
    """Content terms of a question or section, duplicates kept."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z0-9-]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(lx.QUESTION_STOP))


def tally(words: Column, name: str = "n") -> Column:
    """Structs of each different word of an array and how often it is there, in order of the words."""
    def runs(s):
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (s[i - 1] != s[i - 2]))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            s[i - 1].alias("word"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).cast("bigint").alias(name))))

    return let(F.array_sort(words), lambda s: F.when(F.size(s) > 0, runs(s)))


def quote_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


def content_words(c: Column) -> Column:
    """Distinct words of a quote that say what it is about."""
    return F.array_distinct(
        F.filter(quote_words(c), lambda w: (F.length(w) > 2) & ~w.isin(lx.QUOTE_STOP))
    )


def normal_text(c: Column) -> Column:
    """Lower case, one space between words, wrapped words rejoined."""
    return squeeze(F.lower(F.regexp_replace(c, r"-[\r\n]+", "")))


def sentences_after_mark(c: Column) -> Column:
    """Split where whitespace follows ``.``, ``!`` or ``?``."""
    return F.split(c, r"(?<=[.!?])\s+", -1)


def sentences_before_capital(c: Column) -> Column:
    """As above, but only where a capital letter follows."""
    return F.split(c, r"(?<=[.!?])\s+(?=[A-Z])", -1)


def spoken_sentences(c: Column) -> Column:
    """Sentences for speech: a terminator with its closing marks, then a gap or the end."""
    marked = F.regexp_replace(c, r"""([.!?][.!?"'’)\]]*)(\s+|$)""", "$1" + MARK)
    return F.filter(F.transform(F.split(marked, MARK, -1), strip), lambda s: s != "")


def title_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "))


def paper_key(title: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(title_key(title), F.lit("")), fallback)


def flatten(c: Column) -> Column:
    """How names and text are compared: lower case, hyphens as spaces."""
    return squeeze(F.regexp_replace(F.lower(c), r"[-‐–]", " "))


def concept_key(c: Column) -> Column:
    """The key two spellings of one idea share."""
    base = squeeze(F.regexp_replace(flatten(c), r"""[“”"'’().,;:]""", ""))
    base = F.regexp_replace(base, r"^the\s+", "")
    return let(base, _singular)


def _singular(base: Column) -> Column:
    """The last word of a name without its plural ending."""
    last = F.substring_index(base, " ", -1)
    size = F.length(base)
    return (
        F.when((F.length(last) > 4) & last.endswith("ies"), F.concat(F.substring(base, F.lit(1), size - 3), F.lit("y")))
        .when((F.length(last) > 3) & last.endswith("s") & ~last.rlike(r"(ss|us|is)$"), F.substring(base, F.lit(1), size - 1))
        .otherwise(base)
    )


def heard_words(c: Column) -> Column:
    """Words as a transcript is compared: letters, digits, apostrophes and hyphens."""
    cleaned = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s'-]", " ")
    return F.filter(F.split(cleaned, r"\s+", -1), lambda w: w != "")


def heading_key(c: Column) -> Column:
    """A heading without its number, for comparing what was asked with what exists."""
    bare = F.regexp_replace(F.lower(c), r"^\s*(\d+(\.\d+)*\.?|[ivx]+\.)\s*", "")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def clip(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last one an ellipsis."""
    return F.when(
        F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))
    ).otherwise(c)


def bare_words(c: Column) -> Column:
    """Letters and digits only, one space between words."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def word_runs(bare: Column, n: int) -> Column:
    """Every run of ``n`` words of a bare text, overlapping."""
    run = r"(?<![^ ])(?=([^ ]+(?: [^ ]+){%d})(?![^ ]))" % (n - 1)
    return F.regexp_extract_all(bare, F.lit(run), F.lit(1))
