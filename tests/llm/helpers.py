"""Small tables with the awkward rows every operator must take."""

import random

WORDS = "the of and river stone light paper garden window market signal copper autumn method letter valley engine silver carbon harvest".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.5 else "") for _ in range(n))


def edited(text: str, seed: int, edits: int) -> str:
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
    return " ".join(w)


def rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): near and exact copies, NULLs, empty, short, long and repeated rows."""
    out, k = [], 0

    def add(text, source="s1"):
        nonlocal k
        out.append((k, text, "en", source, None if text is None else len(text)))
        k += 1

    for base in range(6):
        text = prose(base, 40 + 60 * base)
        add(text, f"s{base}")
        for e in range(5):
            add(edited(text, 10 * base + e, e * base // 3), "s1")
    for short in (None, "", "   ", "one", "one two", "One TWO", "one two three", "one two three four", "one two three four five", "a b c d e f g h i", "a b c d e f g h i j"):
        add(short, None)
    add(prose(99, 6000), "big")
    add(edited(prose(99, 6000), 5, 40), "big")
    out += [out[0], out[7], (None, prose(1, 100), None, None, None), (500, None, None, "s2", None)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, more=()):
    return spark.createDataFrame(rows() + list(more), SCHEMA).repartition(5)


def twins(n: int = 1024) -> tuple[str, str]:
    """Two words that a polynomial hash modulo a power of two cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
