"""The Jaccard join against all pairs, and its parts."""

import random
import re

import numpy as np
import pyarrow as pa

from plumbline.llm import jaccard as J
from plumbline.llm import words as W
from tests.llm.helpers import SCHEMA, edited, prose, rows


def brute(table):
    sets = {}
    for doc_id, text, *_ in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = frozenset(" ".join(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([" ".join(w)] if w else [])
        sets.setdefault(doc_id, []).append(s)
    ids = sorted(d for d in sets if d is not None)
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                up[max(ra, rb)] = min(ra, rb)
    return sorted(((d, len(s), find(d) if d is not None else None) for d, ss in sets.items() for s in ss), key=repr)


def check(spark, table):
    got = J.op3(spark.createDataFrame(table, SCHEMA).repartition(4)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(table)


def test_all_pairs(spark):
    check(spark, rows())


def test_short_texts_and_chains(spark):
    """Many small sets near the limit, where blocks are few and often empty, and chains that only meet through others."""
    r, table = random.Random(4), []
    for k in range(160):
        base = prose(k % 9, 9 + k % 23)
        table.append((k, edited(base, k, r.randrange(3)), None, None, None))
    text = prose(77, 120)
    for k in range(160, 185):
        text = edited(text, k, 1)
        table.append((k, text, None, None, None))
    check(spark, table)


def test_large_groups_are_let_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 5)
    base = prose(3, 90)
    check(spark, [(k, edited(base, k, k % 5), None, None, None) for k in range(60)])


def test_what_pivots_leave_is_compared_in_chunks(spark, monkeypatch):
    """Without pivots, links away from a group's first member come from the comparison inside groups."""
    monkeypatch.setattr(J, "ROUNDS", 0)
    monkeypatch.setattr(J, "CHUNK", 7)
    long = prose(8, 1400)
    table = [(k, edited(long, k, 14 + k % 9), None, None, None) for k in range(12)]
    table += [(100 + k, edited(prose(k % 2, 30), k, k % 4), None, None, None) for k in range(60)]
    check(spark, table)


def test_empty_table(spark):
    assert J.op3(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deduplicated_keeps_one_row_each(spark):
    table = rows()
    kept = J.deduplicated(spark.createDataFrame(table, SCHEMA)).collect()
    want = {c for _, _, c in brute(table) if c is not None}
    ids = [k["doc_id"] for k in kept]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_linked_sets_share_a_block():
    """The pigeonhole: sets at the limit of the similarity always meet."""
    rng, bands = np.random.default_rng(0), J.Bands(85)
    for size in [*range(6, 80), 200, 531]:
        for _ in range(6):
            large = int(rng.integers(size, J.reach(size) + 1))
            need = -(-85 * (size + large) // 185)
            if need > size:
                continue
            common = rng.integers(0, 1 << 62, need, dtype=np.uint64)
            a = np.concatenate([common, rng.integers(0, 1 << 62, size - need, dtype=np.uint64)])
            b = np.concatenate([common, rng.integers(0, 1 << 62, large - need, dtype=np.uint64)])
            keys, owner = J.block_keys(np.concatenate([a, b]), np.array([0, size, size + large]), bands)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), (size, large)


def test_sketch_bounds_difference():
    t = W.texts_of(pa.array([prose(1, 300), edited(prose(1, 300), 2, 4)]))
    grams, first = J.sets_of(t, 4)
    _, _, sketch = J.signatures(grams, first)
    a, b = set(grams[:first[1]].tolist()), set(grams[first[1]:].tolist())
    assert sum(bin(int(x)).count("1") for x in sketch[0] ^ sketch[1]) <= len(a ^ b)


def test_rows_without_an_id_hide_no_links(spark):
    """One task meets a row without an id first, then its copy, whose near copies must still be met."""
    table = [(None, prose(40, 90), None, None, None), (7, prose(40, 90), None, None, None), (3, edited(prose(40, 90), 1, 1), None, None, None)]
    got = J.op3(spark.createDataFrame(table, SCHEMA).coalesce(1)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(table)
    assert {c for d, _, c in got if d} == {3}


def test_a_document_of_several_texts_has_the_links_of_all(spark):
    """One text is a copy of another document; near copies of the other texts are linked as well."""
    row = lambda doc_id, text: (doc_id, text, None, None, None)
    one, two, three = prose(50, 80), prose(51, 110), prose(52, 70)
    table = [row(1, one), row(5, one), row(5, two), row(3, edited(two, 2, 2)), row(4, edited(one, 3, 1))]
    table += [row(10, three), row(12, three), row(12, prose(53, 60)), row(11, edited(prose(53, 60), 4, 1)), row(12, ""), row(13, three), row(14, edited(three, 5, 1))]
    check(spark, table)
