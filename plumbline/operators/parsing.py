"""From flattened text to tables: lines, sections, sentences, chunks, references.

A text is one row, so whatever is collected per paper here is no larger than the
row it came from.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import lexicons as lx
from plumbline.functions import segments as sg
from plumbline.functions import text as tx

MAX_SECTION_NUMBER = 20
MAX_PROMPT_CHARS = 120_000
NOISE = r"(?i)^(figure|fig\.?|table|algorithm)\s*\d+(?![A-Za-z0-9_])"
CAPTION = r"(?i)(?<![A-Za-z0-9_])(?:figure|fig\.|table|algorithm)\s*\d+\s*[:.]"
PREAMBLE = "Preamble"


def lines(papers: DataFrame) -> DataFrame:
    """paper_id, line_no, text, at: every line and the offset it starts at."""
    split = papers.select("paper_id", F.posexplode(tx.lines_of(F.col("text"))).alias("line_no", "text"))
    before = Window.partitionBy("paper_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return split.withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("bigint"))


def numbered_lines(text: Column) -> Column:
    """The lines of a text with their numbers, in one array."""
    return F.transform(tx.lines_of(text), lambda t, i: F.struct(i.alias("line_no"), t.alias("text")))


def gathered(lines: DataFrame) -> DataFrame:
    """paper_id, lines: the rows of each paper in one array, as numbered_lines has them."""
    packed = F.array_sort(F.collect_list(F.struct(F.col("line_no").cast("int").alias("line_no"), "text")))
    return lines.groupBy("paper_id").agg(packed.alias("lines"))


def page_spans(pages: DataFrame) -> DataFrame:
    """paper_id, page_key, text -> page number and the span it fills, edge to edge.

    Pages are joined by two characters, which belong to the page that follows.
    """
    seg = sg.segment_of(F.col("page_key"))
    counted = sg.running_sum(pages, ["paper_id"], ["page_key"], seg, F.lit(1), "_n")
    summed = sg.running_sum(counted, ["paper_id"], ["page_key"], seg, F.length("text"), "_len")
    n = F.col("_n")
    return summed.select(
        "paper_id", "page_key", (n + 1).cast("bigint").alias("page"),
        F.when(n == 0, 0).otherwise(F.col("_len") + 2 * (n - 1)).cast("bigint").alias("start"),
        (F.col("_len") + F.length("text") + 2 * n).cast("bigint").alias("end"),
    )


def stitch(items: DataFrame, page_keys: list[str]) -> DataFrame:
    """Join a page's positioned fragments into text.

    ``items``: page keys, item_idx, str, a, b, x, y, width. A moved baseline is a
    new line; on one line the gap in ems decides between nothing, a space or two.
    One page's fragments are folded in order.
    """
    packed = F.array_sort(F.collect_list(F.struct("item_idx", "str", "a", "b", "x", "y", "width")))

    def step(s, i):
        em = F.sqrt(i["a"] * i["a"] + i["b"] * i["b"])
        gap = F.when(s["end"].isNull(), 0.0).otherwise((i["x"] - s["end"]) / F.when(em == 0, 1.0).otherwise(em))
        apart = (F.length(s["text"]) > 0) & ~s["text"].rlike(r"\s$") & ~i["str"].rlike(r"^\s")
        same = s["y"].isNull() | (s["y"] == i["y"])
        sep = F.when(~same, "\n").when(~apart, "").when(gap >= 1, "  ").when(gap >= 0.12, " ").otherwise("")
        return F.struct(
            F.concat(s["text"], sep, i["str"]).alias("text"), i["y"].alias("y"),
            (i["x"] + F.coalesce(i["width"], F.lit(0.0))).alias("end"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("end"))
    return items.groupBy(*page_keys).agg(packed.alias("items")).select(
        *page_keys, F.aggregate("items", start, step)["text"].alias("text")
    )


def heading_norm(c: Column) -> Column:
    bare = F.regexp_replace(tx.strip(c), r"^\d+(\.\d+)*\.?\s*", "")
    return tx.strip(F.lower(F.regexp_replace(bare, r"[:.]+$", "")))


def is_strip_heading(c: Column) -> Column:
    n = heading_norm(c)
    names = "|".join(lx.STRIP_HEADINGS)
    return n.rlike(f"^({names})( .*|s)?$")


def is_structural(c: Column) -> Column:
    return (heading_norm(c) == "abstract") | is_strip_heading(c)


def is_end_matter(c: Column) -> Column:
    return heading_norm(c).rlike(r"^(references|bibliography|appendix|appendices|supplementary)(?![A-Za-z0-9_])")


def heading_shape(c: Column) -> Column:
    """numbered, known, caps or NULL: what a line looks like on its own."""
    return _shape(tx.strip(c))


def _shape(line: Column) -> Column:
    """heading_shape of a line without blank ends."""
    words = F.split(line, r"\s+")
    pattern = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
    rest = F.regexp_extract(line, pattern, 2)
    parts = F.transform(F.split(F.regexp_extract(line, pattern, 1), r"\."), lambda p: p.cast("double"))
    after = F.split(F.regexp_extract(rest, r":\s*(.+)$", 1), r"\s+")
    explained = F.exists(after, lambda w: w.rlike("^[a-z]") & ~F.lower(w).isin(lx.TITLE_SMALL_WORDS))
    numbered = (
        (parts[0] >= 1) & F.forall(parts, lambda p: p <= MAX_SECTION_NUMBER) & rest.rlike("^[A-Z]")
        & rest.rlike("[A-Za-z]{3,}") & ~explained
    )
    alphabetic = F.filter(words, lambda w: w.rlike("^[A-Z&]+[,:]?$"))
    caps = (
        line.rlike(r"^[A-Z][A-Z0-9 :&,-]{2,60}$") & (F.size(words) <= 8) & (F.size(words) > 1)
        & (F.size(alphabetic) >= 2)
        & F.exists(alphabetic, lambda w: F.length(F.regexp_replace(w, "[^A-Za-z0-9_]", "")) >= 4)
    )
    return (
        F.when((line == "") | (F.length(line) > 80) | (F.size(words) > 10), None)
        .when(line.rlike(pattern), F.when(numbered, "numbered"))
        .when(heading_norm(line).isin(lx.KNOWN_HEADINGS) & line.rlike("^[A-Z]"), "known")
        .when(caps, "caps")
    )


def starts_of(lines: Column) -> Column:
    """Numbers of the lines accepted as headings, of one paper's lines from the end of its title.

    Only a line shaped like a heading is looked at closely, and three lines after it.
    Section numbers only go forward, so candidates are folded in order.
    """
    shown = F.filter(
        F.transform(lines, lambda e: F.struct(e["line_no"].alias("line_no"), tx.strip(e["text"]).alias("line"))),
        lambda e: e["line"] != "",
    )
    shaped = tx.let(shown, lambda s: F.transform(
        s, lambda e: F.struct(e["line_no"].alias("line_no"), e["line"].alias("line"), _shape(e["line"]).alias("shape"))))

    def candidate(s, e, k):
        ahead = lambda n: F.get(s, k + n)
        long = lambda n: F.coalesce(ahead(n)["line"].rlike(tx.at_least_words(6)), F.lit(False))
        structural = is_structural(e["line"])
        return F.struct(
            e["line_no"].alias("line_no"), structural.alias("structural"), (e["shape"] == "numbered").alias("numbered"),
            (~structural & ~F.coalesce(ahead(1)["line"].rlike("^[a-z]"), F.lit(False))).alias("free"),
            (F.coalesce(ahead(1)["shape"] == "numbered", F.lit(False)) | long(1) | long(2) | long(3)).alias("prose"),
            F.regexp_extract(e["line"], r"^\d+", 0).try_cast("int").alias("top"),
        )

    def accepted(c):
        by_words = lambda e: e["free"] & ~e["numbered"] & e["prose"]
        numbered = F.filter(c, lambda e: e["free"] & e["numbered"])
        n, u = F.size(numbered), F.size(F.filter(c, by_words))
        fold = F.aggregate(
            numbered, F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("kept")),
            lambda s, e: F.when(
                (e["top"] >= s["last"]) & ((s["last"] == 0) | (e["top"] <= s["last"] + 2)),
                F.struct(e["top"].alias("last"), F.array_append(s["kept"], e["line_no"]).alias("kept")),
            ).otherwise(s),
        )
        number_of = lambda e: e["line_no"]
        return F.when((n > u) | ((n > 0) & (u == 0)), F.concat(
            F.transform(F.filter(c, lambda e: e["structural"]), number_of), fold["kept"])
        ).otherwise(F.transform(F.filter(c, lambda e: e["structural"] | by_words(e)), number_of))

    candidates = lambda s: F.filter(
        F.transform(s, lambda e, k: F.when(e["shape"].isNotNull(), candidate(s, e, k))), lambda e: e.isNotNull())
    return tx.let(shaped, lambda s: tx.let(candidates(s), accepted))


def section_starts(lines: DataFrame, starts_at: DataFrame | None = None) -> DataFrame:
    """paper_id, line_no of every line accepted as a heading.

    ``starts_at`` (paper_id, from_line) says where the title ends.
    """
    if starts_at is not None:
        lines = lines.join(starts_at, "paper_id").filter(F.col("line_no") >= F.col("from_line")).drop("from_line")
    return gathered(lines).select("paper_id", F.explode(starts_of(F.col("lines"))).alias("line_no"))


def clean_text(texts: Column) -> Column:
    """What clean_block leaves of one block's lines, as one text."""
    quiet = F.filter(texts, lambda t: tx.let(tx.strip(t), lambda bare: ~(bare.rlike(NOISE) | bare.rlike(r"^\d+$"))))
    trimmed = F.btrim(F.regexp_replace(F.array_join(quiet, "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\n\x0b\f\r"))
    # Here $ also stands before a last U+0085, U+2028 or U+2029.
    return F.regexp_replace(trimmed, r"[ \t\x0B]+$", "")


def clean_block(lines: DataFrame, block: list[str]) -> DataFrame:
    """Drop captions, page numbers, runs of empty lines and blank ends of each block."""
    bare = tx.strip(F.col("text"))
    quiet = lines.filter(~(bare.rlike(NOISE) | bare.rlike(r"^\d+$")))
    order = Window.partitionBy(*block).orderBy("line_no")
    whole = Window.partitionBy(*block)
    kept = quiet.withColumn("_prev", F.lag("text").over(order)).filter(
        ~((F.col("text") == "") & F.coalesce(F.col("_prev") == "", F.lit(False)))
    ).drop("_prev")
    solid = F.when(F.col("text").rlike(r"\S"), F.col("line_no"))
    ends = kept.withColumn("_lo", F.min(solid).over(whole)).withColumn("_hi", F.max(solid).over(whole))
    trimmed = ends.filter((F.col("line_no") >= F.col("_lo")) & (F.col("line_no") <= F.col("_hi")))
    first, last = F.col("line_no") == F.col("_lo"), F.col("line_no") == F.col("_hi")
    led = F.when(first, F.regexp_replace("text", r"^\s+", "")).otherwise(F.col("text"))
    shifted = trimmed.withColumn("_led", led)
    if "at" in lines.columns:
        shifted = shifted.withColumn("at", F.col("at") + F.length("text") - F.length("_led"))
    return shifted.withColumn(
        "text", F.when(last, F.regexp_replace("_led", r"\s+$", "")).otherwise(F.col("_led"))
    ).drop("_led", "_lo", "_hi")


def sections_of(lines: Column, starts: Column) -> Column:
    """section_idx, heading, content of one paper's lines, cut at the headings ``starts`` numbers."""
    places = lambda rows: tx.let(
        F.transform(rows, lambda e: e["line_no"]), lambda numbers: F.transform(starts, lambda s: F.array_position(numbers, s)))

    def cut(rows, at):
        texts = lambda first, end: F.transform(F.slice(rows, first, end - first), lambda e: e["text"])
        heading = lambda p: F.regexp_replace(tx.strip(F.get(rows, p - 1)["text"]), r"[:.]+$", "")
        return F.transform(F.concat(F.array(F.lit(0).cast("bigint")), at), lambda p, k: F.struct(
            k.alias("section_idx"), F.when(k == 0, PREAMBLE).otherwise(heading(p.cast("int"))).alias("heading"),
            clean_text(texts(p.cast("int") + 1, F.coalesce(F.get(at, k), F.size(rows) + 1).cast("int"))).alias("content"),
        ))

    headed = lambda rows: F.array_sort(F.filter(places(rows), lambda p: p > 0))
    return tx.let(lines, lambda rows: tx.let(headed(rows), lambda at: F.filter(cut(rows, at), lambda s: s["content"] != "")))


def sections(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """paper_id, section_idx, heading, content: blocks between accepted headings."""
    heads = starts.groupBy("paper_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("starts"))
    whole = gathered(lines).join(heads, "paper_id", "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<int>")))
    return whole.select("paper_id", F.inline(sections_of(F.col("lines"), F.col("starts"))))


def _kept(sections: Column) -> Column:
    """The sections of one paper that are the paper, with their kind."""
    end = F.array_min(F.transform(F.filter(sections, lambda s: is_end_matter(s["heading"])), lambda s: s["section_idx"]))
    wanted = lambda end: F.filter(sections, lambda s: (
        (end.isNull() | (s["section_idx"] < end)) & ~is_strip_heading(s["heading"])
        & ((s["heading"] != PREAMBLE) | s["content"].rlike(tx.at_least_words(25)))))
    kind = lambda s: F.when(heading_norm(s["heading"]) == "abstract", "abstract").otherwise("section")
    return F.transform(tx.let(end, wanted), lambda s: F.struct(
        s["section_idx"].alias("section_idx"), s["heading"].alias("heading"), s["content"].alias("content"), kind(s).alias("kind")))


def body_of(sections: Column, lines: Column) -> Column:
    """body_sections of one paper: section_idx, heading, content, kind."""
    listed = lambda rows: F.array_position(F.transform(
        rows, lambda e: e["text"].rlike(r"(?i)^\s*(references|bibliography)\s*$")), F.lit(True)).cast("int")
    texts = lambda rows: tx.let(listed(rows), lambda at: F.transform(
        F.slice(rows, F.lit(1), F.when(at > 0, at - 1).otherwise(F.size(rows))), lambda e: e["text"]))
    whole = lambda rows: F.filter(F.array(F.struct(
        F.lit(0).alias("section_idx"), F.lit("Body").alias("heading"), clean_text(texts(rows)).alias("content"),
        F.lit("section").alias("kind"))), lambda s: s["content"] != "")
    return tx.let(_kept(sections), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(tx.let(lines, whole)))


def body_sections(sections: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """What is the paper: end matter cut, abstract lifted out, thin preamble dropped.

    A paper left with nothing becomes one "Body" of its ``lines`` up to a
    references line. kind is ``abstract`` or ``section``.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col("section_idx").cast("int").alias("section_idx"), "heading", "content")))
    cut = sections.groupBy("paper_id").agg(packed.alias("sections"))
    if lines is None:
        return cut.select("paper_id", F.inline(_kept(F.col("sections"))))
    none = F.array().cast("array<struct<section_idx:int,heading:string,content:string>>")
    rows = F.array().cast("array<struct<line_no:int,text:string>>")
    both = cut.join(gathered(lines), "paper_id", "full")
    return both.select("paper_id", F.inline(body_of(F.coalesce("sections", none), F.coalesce("lines", rows))))


def _cut(text: Column, take) -> Column:
    """A paper cut from the end of its title; ``take`` gives what is asked for of lines and starts."""
    after = lambda rows: tx.let(title_of(rows)["from_line"], lambda first: F.filter(rows, lambda e: e["line_no"] >= first))
    cut = lambda rows: tx.let(after(rows), lambda body: tx.let(starts_of(body), lambda starts: take(body, starts)))
    return tx.let(numbered_lines(text), cut)


def _parsed(papers: DataFrame, take) -> DataFrame:
    """Each paper cut beside its text, so that no line of it is shuffled."""
    return papers.select("paper_id", _cut(F.col("text"), take).alias("found"))


def paper_titles(papers: DataFrame) -> DataFrame:
    """titles of whole papers: paper_id, text."""
    found = papers.filter(F.col("text").isNotNull()).select("paper_id", title_of(numbered_lines(F.col("text"))).alias("t"))
    return found.select("paper_id", "t.title", "t.from_line")


def paper_starts(papers: DataFrame) -> DataFrame:
    """section_starts of whole papers, each from the end of its title."""
    return _parsed(papers, lambda body, starts: starts).select("paper_id", F.explode("found").alias("line_no"))


def paper_sections(papers: DataFrame) -> DataFrame:
    """sections of whole papers, each from the end of its title."""
    return _parsed(papers, sections_of).select("paper_id", F.inline("found"))


def body(text: Column) -> Column:
    """body_sections of a whole paper, from the end of its title, in one array."""
    return _cut(text, lambda rows, starts: body_of(sections_of(rows, starts), rows))


def paper_body(papers: DataFrame) -> DataFrame:
    """body_sections of whole papers, each from the end of its title."""
    return papers.select("paper_id", body(F.col("text")).alias("found")).select("paper_id", F.inline("found"))


def author_like(c: Column) -> Column:
    """A line of names or affiliations, which ends a title."""
    name = r"[A-Z][a-zA-Z.'’-]*"
    return (
        F.contains(c, F.lit("@"))
        | c.rlike("(?i)" + lx.AFFILIATION)
        | c.rlike(r"^[A-Z][a-z]+\s+[A-Z][a-zA-Z.'’-]+\s*,")
        | c.rlike(r",.*,")
        | c.rlike(r"[∗*†‡§¶]|[¹²³⁰-₟]")
        | c.rlike(rf"^{name}(\s+{name}){{0,2}}$")
        | c.rlike(rf"^{name}(\s{name}){{1,2}}(\s{{2,}}{name}(\s{name}){{1,2}})+$")
        | c.rlike(r"[a-z][A-Z]\S*\s(.*\s)?\S*[a-z][A-Z]")
    )


def title_of(lines: Column) -> Column:
    """title, from_line of one paper: the first block that is not a heading or a notice.

    Lines are folded in order: look for the title, skip a notice to the end of its
    sentence, then join the lines the title wraps onto. Lines after it are not looked at.
    """
    def state(phase, skip, title, parts, start):
        return F.struct(phase.alias("phase"), skip.alias("skip"), title.alias("title"), parts.alias("parts"),
                        start.cast("int").alias("start"))

    def step(s, line_no, t):
        keep = lambda **k: state(*[k.get(n, s[n]) for n in ("phase", "skip", "title", "parts", "start")])
        head, blank, stop = _shape(t).isNotNull(), t == "", t.endswith(".")
        wraps = s["title"].rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{lx.TITLE_WRAP_WORDS})$")
        full = (s["parts"] >= 3) | (F.length(s["title"]) >= 250)
        ends = full | blank | head | (~wraps & author_like(t))
        return (
            F.when(s["phase"] == 1, F.when(ends, keep(phase=F.lit(2), start=line_no)).otherwise(
                keep(title=F.concat_ws(" ", s["title"], t), parts=s["parts"] + 1)))
            .when(s["skip"] > 0, keep(skip=F.when(blank | stop, 0).otherwise(s["skip"] - 1)))
            .when((F.length(t) < 4) | head, s)
            .when(t.rlike("(?i)" + "|".join(lx.FRONT_MATTER)), keep(skip=F.when(stop, 0).otherwise(5)))
            .otherwise(keep(phase=F.lit(1), title=t, parts=F.lit(1), start=line_no + 1))
        )

    begin = state(F.lit(0), F.lit(0), F.lit(""), F.lit(0), F.lit(0))
    walk = lambda rows: F.aggregate(rows, begin, lambda s, e: F.when(s["phase"] == 2, s).otherwise(
        tx.let(tx.strip(e["text"]), lambda t: step(s, e["line_no"], t))))
    end = lambda rows, s: F.when(s["phase"] == 1, F.element_at(rows, -1)["line_no"] + 1).otherwise(s["start"])
    return tx.let(lines, lambda rows: tx.let(walk(rows), lambda s: F.struct(
        tx.squeeze(s["title"]).alias("title"), end(rows, s).alias("from_line"))))


def titles(lines: DataFrame) -> DataFrame:
    """paper_id, title, from_line of each paper."""
    found = gathered(lines).select("paper_id", title_of(F.col("lines")).alias("t"))
    return found.select("paper_id", "t.title", "t.from_line")


def word_counts(sections: DataFrame) -> DataFrame:
    return sections.groupBy("paper_id").agg(
        F.sum(tx.word_count(F.col("content"))).alias("word_count"), F.count("*").alias("sections")
    )


def _block(heading: str = "heading", content: str = "content") -> Column:
    return F.concat(F.lit("## "), F.col(heading), F.lit("\n"), F.col(content))


def render(sections: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """The whole paper as one text."""
    packed = F.array_sort(F.collect_list(F.struct("section_idx", _block().alias("b"))))
    body = sections.groupBy("paper_id").agg(F.array_join(F.transform(packed, lambda e: e["b"]), "\n\n").alias("body"))
    if titles is not None:
        body = body.join(titles.select("paper_id", "title"), "paper_id", "left").withColumn(
            "body", F.concat_ws("\n\n", F.when(F.col("title") != "", F.concat(F.lit("# "), "title")), "body")
        )
    return body.select("paper_id", F.col("body").alias("text"))


def prompt(rendered: DataFrame, limit: int = MAX_PROMPT_CHARS) -> DataFrame:
    """What a model is shown of a rendered paper, and whether that is less than all of it."""
    return rendered.select("paper_id", F.substring("text", 1, limit).alias("prompt"), (F.length("text") > limit).alias("truncated"))


def segments(sections: DataFrame) -> DataFrame:
    """Where each section's content lands in the rendered text.

    ``sections`` carries ``at``, the offset its content has in the source.
    """
    before = Window.partitionBy("paper_id").orderBy("section_idx").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.coalesce(F.sum(F.length(_block()) + 2).over(before), F.lit(0))
    start = (lead + F.length("heading") + 4).cast("bigint")
    return sections.select(
        "paper_id", "section_idx", start.alias("from"), (start + F.length("content")).alias("to"), "at", "heading"
    )


def references(papers: DataFrame) -> DataFrame:
    """Entries of each paper's reference list: raw, title, year."""
    marker = r"(?i)\n\s*(?:\d+\.?\s*)?(references|bibliography)\s*\n"
    text = tx.unify_newlines(F.col("text"))
    body = papers.filter(text.rlike(marker)).select(
        "paper_id", F.regexp_replace(text, r"(?is)^.*?\n\s*(?:\d+\.?\s*)?(?:references|bibliography)\s*\n", "").alias("body")
    ).withColumn("body", F.regexp_replace("body", r"(?is)\n\s*appendix(?![A-Za-z0-9_]).*$", ""))
    numbered = F.regexp_extract_all("body", F.lit(r"(?s)\[\d+\]\s*.*?(?=\n?\[\d+\]|$)"), F.lit(0))
    paragraphs = F.filter(
        F.transform(F.split("body", r"\n\s*\n", -1), tx.squeeze), lambda p: F.length(p) > 30
    )
    by_number = F.transform(numbered, lambda e: F.struct(
        F.regexp_extract(e, r"^\[(\d+)\]", 1).cast("int").alias("index"),
        tx.squeeze(F.regexp_replace(e, r"^\[\d+\]\s*", "")).alias("raw")))
    by_gap = F.transform(paragraphs, lambda p: F.struct(F.lit(None).cast("int").alias("index"), p.alias("raw")))
    rows = body.withColumn("entries", F.when(F.size(numbered) >= 3, by_number).otherwise(by_gap)).select(
        "paper_id", F.posexplode("entries").alias("ref_idx", "e")
    ).select("paper_id", "ref_idx", "e.index", "e.raw")
    wanted = rows.filter(F.length("raw") > 20).filter(
        ~F.col("raw").rlike(r"(?i)https?://|available at|(?<![A-Za-z0-9_])(manual|documentation)(?![A-Za-z0-9_])")
    )
    return wanted.select(
        "paper_id", "ref_idx", "index", "raw", reference_title(F.col("raw")).alias("title"),
        F.nullif(F.regexp_extract("raw", r"(?<![A-Za-z0-9_])(?:19|20)\d{2}(?![A-Za-z0-9_])", 0), F.lit("")).cast("int").alias("year"),
    )


def reference_title(raw: Column) -> Column:
    """The longest sentence of an entry that is not a list of initials."""
    parts = F.filter(F.transform(F.split(raw, r"\.\s+", -1), tx.strip), lambda p: p != "")
    initials = lambda p: F.size(F.regexp_extract_all(p, F.lit(r"(?<![A-Za-z0-9_])[A-Z]\."), F.lit(0)))
    good = F.filter(parts, lambda p: (F.size(F.split(p, r"\s+")) >= 3) & (initials(p) < 2))
    best = F.array_max(F.transform(good, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("back"), p.alias("p"))))
    return F.regexp_replace(best["p"], r"[.,;]+$", "")


def caption_pages(pages: DataFrame, first: int = 8) -> DataFrame:
    """The first pages of each paper that carry captions, with the distinct captions."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(CAPTION), F.lit(0)), tx.strip))
    shown = pages.select("paper_id", "page", found.alias("captions")).filter(F.size("captions") > 0)
    order = Window.partitionBy("paper_id").orderBy("page")
    return shown.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= first).drop("_n")


def described(figures: DataFrame) -> DataFrame:
    """Figure descriptions that say something: not empty, not starting with NONE."""
    bare = tx.strip(F.col("description"))
    return figures.filter((bare != "") & ~bare.rlike(r"(?i)^none(?![A-Za-z0-9_])"))


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(tx.spoken_sentences(F.col(text))).alias("sentence_no", "sentence"))


def pack_sentences(pieces: list[str], whole: str, limit: int) -> list[str]:
    """Pack one text's sentences into chunks of at most ``limit`` characters."""
    whole = whole.strip()
    if len(whole) <= limit:
        return [whole] if whole else []
    out, held = [], ""
    for piece in pieces:
        joined = f"{held} {piece}" if held else piece
        if len(joined) <= limit and len(piece) <= limit:
            held = joined
            continue
        if held:
            out.append(held)
        held = piece if len(piece) <= limit else ""
        while not held and len(piece) > limit:
            space = piece.rfind(" ", 0, limit)
            at = space if space > limit * 0.5 else limit
            out.append(piece[:at].strip())
            piece = piece[at:].strip()
            if len(piece) <= limit:
                if piece:
                    out.append(piece)
                break
    return out + ([held] if held else [])


def chunks(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """Texts packed at sentence ends into chunks no longer than ``limit``."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    cut = df.select(key, text, tx.spoken_sentences(F.col(text)).alias("pieces"))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c) for k, t, p in zip(b[key], b[text], b["pieces"])
                    for i, c in enumerate(pack_sentences(list(p), t, limit))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    return cut.mapInPandas(run, f"{key} {kind}, chunk_no int, chunk string")


def digest(sections: DataFrame, titles: DataFrame, opening: int = 700, budget: int = 16_000) -> DataFrame:
    """Title, headings, and section openings until the first that does not fit."""
    order = Window.partitionBy("paper_id").orderBy("section_idx")
    head = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("section_idx", "heading"))),
        lambda e: F.concat(F.lit("- "), e["heading"])), "\n")
    top = sections.groupBy("paper_id").agg(head.alias("heads")).join(titles.select("paper_id", "title"), "paper_id", "left").select(
        "paper_id", F.concat(F.lit("TITLE: "), F.coalesce("title", F.lit("")), F.lit("\n\nSECTION HEADINGS:\n"), "heads").alias("top")
    )
    block = F.concat(
        F.lit("## "), "heading", F.lit("\n"), tx.strip(F.substring("content", 1, opening)),
        F.when(F.length("content") > opening, " …").otherwise(""),
    )
    blocks = (
        sections.select("paper_id", "section_idx", block.alias("block")).join(top, "paper_id")
        .withColumn("used", F.length("top") + F.sum(F.length("block")).over(order))
        .filter(F.col("used") <= budget)
    )
    opened = blocks.groupBy("paper_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "block"))), lambda e: e["block"]), "\n\n").alias("opened"),
        F.count("*").alias("openings"),
    )
    return top.join(opened, "paper_id", "left").select(
        "paper_id", F.coalesce("openings", F.lit(0)).alias("openings"),
        F.concat("top", F.when(F.col("opened").isNotNull(), F.concat(F.lit("\n\nSECTION OPENINGS:\n\n"), "opened")).otherwise("")).alias("digest"),
    )


def outline(sections: DataFrame) -> DataFrame:
    """Headings with their sizes, in order."""
    line = F.concat(F.lit("- "), "heading", F.lit(" ("), F.length("content").cast("string"), F.lit(" characters)"))
    packed = F.array_sort(F.collect_list(F.struct("section_idx", line.alias("l"))))
    return sections.groupBy("paper_id").agg(
        F.array_join(F.transform(packed, lambda e: e["l"]), "\n").alias("outline"), F.count("*").alias("sections")
    )
