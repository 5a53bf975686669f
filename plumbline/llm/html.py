"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores by the elements around
it, a tag scores below zero, and one linear scan finds the run of highest total
score: the content region. Blocks of the region that stand in an element that
never holds content (menu, form, advert and the like) are left out.

Scores are log odds learned from labelled pages: those whose author marked the
content with ``article`` or ``main``. Counts are taken over all pages, without
the blocks that are left out anyway, and the marks are no feature of them, so a page
without marks is read in the same way. On a page with marks, words outside them
score below zero. Features are hashed into a table of fixed size, so none is cut and
the table does not grow with the pages; two features of one place share a score.

An element is left out by its name, by its role, or by a class or id that says so,
with all it holds: a mark inside it counts for nothing, unless it is a menu that is
never closed. Inside a mark only whole class names count, an id counts on plain
containers alone, and on sections only where it names reader comments: ids of
headings, paragraphs and sections are made from what they say.

Defined results: a NULL or empty page has an empty text, as has one without a
word that scores above zero; a page of any length is read whole; repeated rows
each have a text; ties go to the earlier and then the longer region; without labelled
pages the fixed scores alone decide; an empty table gives an empty result.
Columns other than ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import map_texts

#: Elements whose text is no text of the page, read as one lump up to their end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "xmp"}
#: Elements that never hold content.
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "object", "canvas", "head", "label", "datalist"}
#: Words in a class, id or role that say the same of any element.
OUTSIDE_HINTS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "notice", "cookie", "cookies", "consent", "gdpr",
                 "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "popup", "modal", "newsletter", "subscribe", "signup", "comment",
                 "comments", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "skip", "search", "login", "contentinfo", "complementary"}
CONTENT = {"article", "main"}
#: Ids that name reader comments even on a section of the content.
COMMENT_IDS = {"comment", "comments", "disqus", "respond", "replies"}
#: First parts of a name whose header is that of the content.
OF_CONTENT = {"page", "post", "article", "entry", "content", "story", "main", "body", "title"}
#: Elements whose id is made from their words, and those of them that hold others.
TITLED = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "section"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input"}
#: A start tag that ends an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in ("article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul")}
_SCOPE = {"div", "section", "article", "main", "td", "th", "table", "ul", "ol", "dl", "body", "nav", "aside", "footer", "header", "form", "blockquote"}

#: Fixed scores: a word with no element around it, and the least and most a word or a tag can score.
WORD_BASE, WORD_LIMIT, TAG_LEAST, TAG_MOST = 0.5, 3.0, -3.0, -0.02
#: Fixed scores: a word of a block that is left out, the least of such a block, a word of a link, a word outside an author's mark.
OUTSIDE_SCORE, OUTSIDE_LEAST, LINK_SCORE, UNMARKED = -0.25, -0.75, -1.0, -0.5
SMOOTH = 5
#: Places of the table of features, for words and for tags each.
PLACES = 1 << 16

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:-->|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?:$|[\s=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_HINT = re.compile(r"[a-z]+")


def place(feature: str) -> int:
    return zlib.crc32(feature.encode()) % PLACES


@dataclass
class Weights:
    """Log odds of a word by the element features around it, and of a tag by its name, each by its place."""

    word: dict[int, float] = field(default_factory=dict)
    tag: dict[int, float] = field(default_factory=dict)

    def of_word(self, features: list[str]) -> float:
        return sum([self.word.get(place(f), 0.0) for f in features]) if self.word else 0.0

    def of_tag(self, name: str) -> float:
        return min(TAG_MOST, max(TAG_LEAST, self.tag.get(place(name), TAG_MOST)))


_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the end tag of a raw element ends; the end of the page if there is none."""
    m = _RAW_END[name].search(page, at)
    stop = page.find(">", m.end()) if m else -1
    return len(page) if stop < 0 else stop + 1


def events(page: str):
    """The page as a row of ("text", words so far joined), ("open", name, features, outside, outside in content) and ("close", name)."""
    at = 0
    while at < len(page):
        k = page.find("<", at)
        m = _TAG.match(page, k) if k >= 0 else None
        while k >= 0 and m is None:
            k = page.find("<", k + 1)
            m = _TAG.match(page, k) if k >= 0 else None
        if k < 0:
            yield "text", page[at:]
            return
        if k > at:
            yield "text", page[at:k]
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            yield "close", name
            continue
        attributes = m[3] or m[6] or ""
        features, outside, inner = [name], name in OUTSIDE or name in RAW, name in OUTSIDE or name in RAW
        if attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                kind, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                for word in value.split():
                    loose, strict = hinted(name, kind, word)
                    outside, inner = outside or loose, inner or strict
                    if kind != "id":
                        features.append(f".{word}")
            if _HIDDEN.search(attributes):
                outside = inner = True
        if name in RAW:
            at = _raw_end(page, name, at)
            yield "lump", name
        elif name in VOID:
            yield "void", name
        else:
            yield "open", name, features, outside, inner


def hinted(name: str, kind: str, word: str) -> tuple[bool, bool]:
    """Whether a word of a class, id or role leaves an element out: outside a mark, and inside one."""
    if name in ("body", "html", "main"):
        return False, False
    whole, parts = word in OUTSIDE_HINTS, _HINT.findall(word)
    if kind == "id" and name in TITLED:
        told = name == "section" and word in COMMENT_IDS
        return told or whole and name == "section", told
    loose = whole or not OUTSIDE_HINTS.isdisjoint(parts) and name not in TITLED and name != "article" and not (parts[-1] == "header" and parts[0] in OF_CONTENT)
    return loose, whole


def never_closed(rows: list) -> set[int]:
    """Places in the row of elements that are opened and never closed by an end tag of their own."""
    stack, names, out = [], Counter(), set()
    for i, (kind, name, *_) in enumerate(rows):
        if kind == "open":
            stack.append((i, name))
            names[name] += 1
            out.add(i)
        elif kind == "close" and names[name] > 0:
            while stack:
                at, gone = stack.pop()
                names[gone] -= 1
                if gone == name:
                    out.discard(at)
                    break
    return out


@dataclass
class Element:
    name: str
    features: list[str]
    outside: bool
    content: bool
    score: float = 0.0
    open_end: bool = False
    #: Where in the stack the outermost element that is left out stands.
    left_at: int = 0
    above: Element | None = None
    #: Words in it, inside and outside a mark, while weights are learned.
    words: list[int] = field(default_factory=lambda: [0, 0])


def walk(page: str, weights: Weights | None = None):
    """Blocks and tags in page order: ("tag", name, element) and ("block", words, words of links, element)."""
    weights = weights or Weights()
    rows = list(events(page))
    unclosed = never_closed(rows)
    stack, open_names, held = [Element("", [], False, False, WORD_BASE)], Counter(), []

    def pop():
        gone = stack.pop()
        open_names[gone.name] -= 1

    def block():
        if not held:
            return None
        words = entities.unescape("".join(t for t, _ in held)).split()
        links = sum(len(t.split()) for t, link in held if link)
        held.clear()
        # The element of a block is the nearest that is no mere style, unless that is left out.
        depth = len(stack) - 1
        while depth and stack[depth].name in INLINE and not stack[depth].outside:
            depth -= 1
        return ("block", words, min(links, len(words)), stack[depth]) if words else None

    for i, (kind, name, *rest) in enumerate(rows):
        if kind == "text":
            held.append((name, open_names["a"] > 0))
            continue
        if kind == "lump":
            yield "tag", name, stack[-1]
            continue
        if name not in INLINE or kind == "open" and rest[2 if stack[-1].content else 1] or kind == "close" and stack[-1].outside and stack[-1].name == name:
            if (b := block()):
                yield b
        if kind == "void":
            yield "tag", name, stack[-1]
        elif kind == "open":
            ends = CLOSES.get(name)
            if ends:
                depth = len(stack) - 1
                while depth > 0 and stack[depth].name not in _SCOPE and stack[depth].name not in ends:
                    depth -= 1
                if depth > 0 and stack[depth].name in ends:
                    while len(stack) > depth:
                        pop()
            if name in CONTENT and stack[-1].outside and not stack[-1].content:
                # A menu or notice that is never closed does not swallow the content.
                depth = stack[-1].left_at
                if name == "main" or stack[depth].open_end:
                    while len(stack) > depth:
                        pop()
            above = stack[-1]
            outside = above.outside or (rest[2] if above.content else rest[1] or name == "header")
            content = above.content or name in CONTENT and not outside
            element = Element(name, rest[0], outside, content, max(-WORD_LIMIT, min(WORD_LIMIT, above.score + weights.of_word(rest[0]))), i in unclosed,
                              above.left_at if above.outside else len(stack), above)
            yield "tag", name, element
            stack.append(element)
            open_names[name] += 1
        elif open_names[name] > 0:
            while stack[-1].name != name:
                pop()
            yield "tag", name, stack[-1]
            pop()
        else:
            yield "tag", name, stack[-1]
    if (b := block()):
        yield b


def extract(page: str | None, weights: Weights) -> str:
    """The blocks of the best region, joined."""
    rows = list(walk(page or "", weights))
    marked = any(r[-1].content for r in rows)
    best, start, total, best_sum, blocks = (0, 0), 0, 0.0, 0.0, []
    for what, value, *rest in rows:
        element = rest[-1]
        if what == "tag":
            gain = 0.0 if element.content and element.outside else weights.of_tag(value)
        else:
            blocks.append(None if element.outside else value)
            if element.outside:
                # Left out in any case: inside the mark it does not stand between two paragraphs.
                gain = 0.0 if element.content else max(OUTSIDE_LEAST, OUTSIDE_SCORE * len(value))
            elif element.content:
                gain = max(WORD_BASE, element.score) * len(value)
            else:
                each = min(UNMARKED, element.score) if marked else element.score
                gain = each * (len(value) - rest[0]) + min(each, LINK_SCORE) * rest[0]
        if total <= 0 and gain > 0:
            total, start = 0.0, len(blocks) - (what == "block")
        total += gain
        if what == "block" and total > 0 and (total > best_sum or total == best_sum and start == best[0]):
            best, best_sum = (start, len(blocks)), total
        total = max(total, 0.0)
    return " ".join(" ".join(r) for r in blocks[best[0]:best[1]] if r)


def feature_counts(page: str | None) -> Counter:
    """(kind, place of the feature, inside content) of a labelled page: words by the features of all elements around them, and tags."""
    out = Counter()
    rows = list(walk(page or ""))
    if not any(r[-1].content for r in rows):
        return out
    around: dict[int, Element] = {}  # in the order they open
    for what, value, *rest in rows:
        element = rest[-1]
        if element.outside:
            continue
        if what == "tag":
            out["tag", place(value), element.content] += 1
            around[id(element)] = element
        else:
            element.words[not element.content] += len(value)
    for element in reversed(around.values()):
        for k, n in enumerate(element.words):
            if element.above:
                element.above.words[k] += n
            for f in element.features if n else ():
                if f not in CONTENT:
                    out["word", place(f), not k] += n
    return out


def weights_of(counts) -> Weights:
    """Weights from (kind, place, count inside, count outside)."""
    out = Weights()
    for kind, at, n_in, n_out in counts:
        odds = math.log((n_in + SMOOTH) / (n_out + SMOOTH))
        (out.word if kind == "word" else out.tag)[at] = max(-WORD_LIMIT, min(WORD_LIMIT, odds))
    return out


def learn(pages: DataFrame) -> Weights:
    """Weights from all features of all labelled pages; a table of at most twice ``PLACES`` rows comes to the driver."""
    def run(batches):
        held = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                held.update(feature_counts(page))
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.array([k[2] for k in keys], pa.bool_()), pa.array([held[k] for k in keys], pa.int64())], ["kind", "place", "inside", "n"])

    counts = pages.select("html").mapInArrow(run, "kind string, place int, inside boolean, n bigint")
    both = counts.groupBy("kind", "place").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("n_in"),
                                               F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("n_out"))
    return weights_of(both.collect())


def main_texts(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    weights = weights or learn(pages)
    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(part, texts: W.Texts):
        found = [extract(p, weights) for p in part.column("html").to_pylist()]
        return {"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array(map(len, found), pa.int64())}

    return map_texts(pages.select("page_id", "url", "html"), run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint", "html")


def op7(pages: DataFrame) -> DataFrame:
    return main_texts(pages)
