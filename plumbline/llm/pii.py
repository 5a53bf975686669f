"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

The four base kinds are reported as the patterns and checks find them. The other
kinds are weaker proposals, reported when their score, with or without a context
word beside them, reaches the threshold.

Defined results: a NULL or empty text has no spans; a text of any length is
searched whole, in time linear in its length; offsets are code points, ends
exclusive; repeated rows each have a row; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are only passed on.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import words as W
from plumbline.llm.common import map_texts, pieces

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.5
#: Code points on either side of a span in which a context word counts, and what it adds.
REACH, BOOST = 60, 0.35

#: Base kinds. A run that must end in a fixed character is anchored at its start, so no start inside it is tried.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Other kinds: pattern, score without context, context words.
_MORE = {
    "iban": (re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"), 0.8, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    "ssn": (re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), 0.3, ("ssn", "social", "security", "insurance")),
    "local_phone": (re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"), 0.3, ("phone", "tel", "call", "mobile", "fax", "telefon")),
    "secret": (re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:password|token|secret|api_key) ?= ?\"?[A-Za-z0-9_+/-]{8,128}"), 0.7, ("key", "login", "secret")),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an account number: country and check digits moved to the end, letters as 10 to 35."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > free and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                yield start, m.end()
                free = m.end()
        at = text.find("@", max(at + 1, free))


def _ips(text: str):
    for m in _IP.finditer(text):
        # Longer than three digits is over 255 unless it has leading zeros.
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """kind, start, end, score of every span, by start and then kind as listed."""
    if not text:
        return []
    found = []
    has_digit = any(d in text for d in "0123456789")
    if "@" in text:
        found += [("email", *s, 1.0) for s in _emails(text)]
    if has_digit:
        found += [("ip", *s, 1.0) for s in _ips(text)] + [("card", *s, 1.0) for s in _cards(text)]
        if "+" in text:
            found += [("phone", *s, 1.0) for s in _phones(text)]
    base = sorted((s, e) for _, s, e, _ in found)
    ends = [e for _, e in base]
    for kind, (pattern, score, context) in _MORE.items():
        if kind != "secret" and not has_digit or kind == "secret" and "AKIA" not in text and "=" not in text:
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == "iban" and not mod97(m.group().replace(" ", "")):
                continue
            around = f"{text[max(0, s - REACH):s]} {text[e:e + REACH]}".lower()
            sure = score + BOOST * any(re.search(rf"(?<![a-z]){w}(?![a-z])", around) for w in context)
            k = bisect_left(ends, s + 1)
            inside = kind != "secret" and k < len(base) and base[k][0] < e
            if sure >= THRESHOLD and not inside:
                found.append((kind, s, e, round(min(sure, 1.0), 2)))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of kind, start, end, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(part, texts: W.Texts):
        rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)] for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("doc_id"), "spans": pa.array(rows, pa.list_(item))}

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first."""
    def mask(text):
        out, at = [], 0
        for kind, s, e, _ in find(text):
            if s >= at:
                out += [text[at:s], f"[{kind.upper()}]"]
                at = e
        return text if not out else "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            for part, _ in pieces(batch):
                column = part.column("text")
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(map(mask, column.to_pylist()), column.type))

    return docs.mapInArrow(run, docs.schema)


def op2(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part, texts: W.Texts):
        out = {"doc_id": part.column("doc_id")} | {f"n_{k}": [] for k in BASE_KINDS} | {"base_sha256": [], "spans": [], "n_added": []}
        for t in part.column("text").to_pylist():
            found = find(t)
            base = [s for s in found if s[0] in BASE_KINDS]
            for k in BASE_KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            joined = [",".join(f"{k}:{s}:{e}" for k, s, e, _ in x) for x in (base, found)]
            out["base_sha256"].append(hashlib.sha256(joined[0].encode()).hexdigest())
            out["spans"].append(joined[1])
            out["n_added"].append(len(found) - len(base))
        return {k: v if k == "doc_id" else pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items()}

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
                     + ", base_sha256 string, spans string, n_added bigint")
