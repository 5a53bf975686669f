"""Merkle manifest of a table of documents, by nested-interval labels.

Every node is labelled with its tree and the interval of leaf ranks it covers. A
level joins each run of sixteen nodes into one. Going down again, a node finds
its parent by a containment join on the tree and the bucket of its interval at
the parent's level, and its siblings are the parent's interval less its own: the
members of the run that end before it or begin after it. A leaf so gets the left
and right siblings of each level, which prove it against the root.

Trees are the sources; their roots are the leaves of one more tree. Ranks come from
a range shuffle of digests, positions inside a range, and one row per source and
range, so no source meets in one task. Texts are read once and never shuffled; a
run holds at most sixteen members; each level is a sixteenth of the one below and
is written to the shared folder.

Defined results: a NULL field is ``-`` in a leaf, an empty one ``0:``; a NULL source
is a tree of its own, the first; a NULL ``doc_id`` stands first in its source and is
not tampered with; rows of one ``doc_id`` are leaves of their own, in the order of
their digests; a text of any length is hashed whole; an empty table gives no rows.
Columns other than ``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import keep_table

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields, each with its length in bytes before it."""
    shown = {name: c.cast("string") for name, c in fields.items()}
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown.values()]), 256)


def leaves(docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """tree, digest, of (doc_id; changed: the digest with the tampered fields, where asked for)."""
    fields = {c: F.col(c) for c in FIELDS}
    changed = F.when(where, digest_of(fields | tampered)) if tampered else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))
    return docs.select(tree.alias("tree"), digest_of(fields).alias("digest"), F.struct("doc_id", changed.alias("changed")).alias("of"))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Give each row its rank in its tree as the interval lo, hi, and the size of the tree."""
    by = [F.col("tree"), *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    placed = keep_table(placed, "leaves").withColumn("part", F.shiftright("at", 33))
    ends = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = ends.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    lo = F.col("at") + F.col("shift")
    return placed.join(shift, ["tree", "part"]).select("tree", "size", lo.alias("lo"), (lo + 1).alias("hi"), "digest", "of")


def _bucket(level: int) -> Column:
    """Which node of a level an interval lies in."""
    return F.floor(F.col("lo") / F.lit(FAN_OUT ** level)).cast("bigint")


def grow(rows: DataFrame) -> list[DataFrame]:
    """The levels of all trees, from ranked leaves up. A tree's root is its node on the first level where it has only one."""
    levels = [rows]
    largest = rows.agg(F.max("size")).first()[0] or 0
    while FAN_OUT ** (len(levels) - 1) < largest:
        k = len(levels)
        below = levels[-1].filter(F.col("size") > FAN_OUT ** (k - 1))
        member = F.struct("lo", "hi", "digest", *(["of"] if k == 1 else []))
        runs = below.groupBy("tree", _bucket(k).alias("bucket")).agg(
            F.max("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(member)).alias("run"))
        joined = F.sha2(F.array_join(F.transform("run", lambda m: m["digest"]), ""), 256)
        levels.append(keep_table(runs.select("tree", "size", "lo", "hi", joined.alias("digest"), "run"), "level"))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, digest of each tree's root."""
    tops = [level.filter(F.col("size") <= FAN_OUT ** k).select("tree", "digest") for k, level in enumerate(levels)]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


_STEP = "array<struct<left: string, right: string>>"


def _less(members: str, lo: Column, hi: Column) -> Column:
    """The parent's interval less a node's own: digests before it and after it."""
    def shown(kept):
        return F.array_join(F.transform(kept, lambda m: m["digest"]), "")
    return F.struct(shown(F.filter(members, lambda m: m["hi"] <= lo)).alias("left"), shown(F.filter(members, lambda m: m["lo"] >= hi)).alias("right"))


def proofs(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """Leaves with their way up: tree, digest, of, top (their tree's root), root, path (left and right siblings of each level).

    ``above``: tree, path, root of the trees' roots in a tree of their own.
    """
    def tops(k: int) -> DataFrame:
        rows = levels[k].filter(F.col("size") <= FAN_OUT ** k).withColumn("top", F.col("digest"))
        if above is None:
            return rows.withColumns({"path": F.array().cast(_STEP), "root": F.col("digest")})
        return rows.join(above, "tree")

    at = tops(len(levels) - 1)
    for k in range(len(levels) - 2, 0, -1):
        parent = at.select("tree", _bucket(k + 1).alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("run").alias("members"), "path", "top", "root")
        child = levels[k].filter(F.col("size") > FAN_OUT ** k).withColumn("bucket", _bucket(k + 1))
        inside = child.join(parent, ["tree", "bucket"]).filter("p_lo <= lo AND hi <= p_hi")
        step = _less("members", F.col("lo"), F.col("hi"))
        below = inside.withColumn("path", F.concat(F.array(step), "path")).select("tree", "size", "lo", "hi", "digest", "run", "top", "path", "root")
        at = below.unionByName(tops(k).select(*below.columns))
    names = ["tree", "digest", "of", "top", "path", "root"]
    if len(levels) == 1:
        return at.select(*names)
    # A run of leaves holds them all, so they need not be met again.
    held = at.select("tree", "run", "top", "path", "root", F.explode("run").alias("m")).withColumns({"digest": F.col("m.digest"), "of": F.col("m.of")})
    step = _less("run", F.col("m.lo"), F.col("m.hi"))
    return held.withColumn("path", F.concat(F.array(step), "path")).select(*names).unionByName(tops(0).select(*names))


def _forest(docs: DataFrame, tampered=None, where=None) -> tuple[list[DataFrame], list[DataFrame]]:
    lower = grow(ranked(leaves(docs, tampered, where), [F.col("of.doc_id").asc_nulls_first(), F.col("digest")]))
    sources = roots(lower).select(F.lit("").alias("tree"), "digest", F.col("tree").alias("of"))
    return lower, grow(ranked(sources, [F.col("of")]))


def proven(docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, leaf, changed (the tampered leaf), subroot, root, path of every document."""
    lower, upper = _forest(docs, tampered, where)
    above = keep_table(proofs(upper).select(F.col("of").alias("tree"), "path", "root"), "above")
    return proofs(lower, above).select("of.doc_id", F.col("digest").alias("leaf"), "of.changed", F.col("top").alias("subroot"), "root", "path")


def manifest(docs: DataFrame) -> DataFrame:
    """All nodes: source (NULL in the tree of sources, where ``of_sources`` says so), level, lo, hi, digest."""
    out = None
    for of_sources, levels in zip((False, True), _forest(docs)):
        for k, level in enumerate(levels):
            source = F.lit(None).cast("string") if of_sources else F.when(F.col("tree") != "0", F.substring("tree", 2, 1 << 30))
            rows = level.select(F.lit(of_sources).alias("of_sources"), source.alias("source"), F.lit(k).alias("level"), "lo", "hi", "digest")
            out = rows if out is None else out.unionByName(rows)
    return out


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def op12(docs: DataFrame) -> DataFrame:
    text = {"text": F.translate("text", _UPPER, _LOWER)}
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    rows = proven(docs, text, where).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_tree(name: str, depth: int) -> str:
    """Levels, roots and ways up of the trees in ``name0`` (t, i, n, h, and what else is wanted)."""
    out = []
    for k in range(depth):
        out.append(f"""{name}{k + 1} AS (SELECT t, i // {FAN_OUT} AS i, (any_value(n) + {FAN_OUT - 1}) // {FAN_OUT} AS n, sha256(string_agg(h, '' ORDER BY i)) AS h
   FROM {name}{k} WHERE n > 1 GROUP BY t, i // {FAN_OUT})""")
        out.append(f"""{name}_side{k} AS (SELECT a.t, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
   FROM {name}{k} a JOIN {name}{k} b ON a.t = b.t AND a.i // {FAN_OUT} = b.i // {FAN_OUT} WHERE a.n > 1 GROUP BY a.t, a.i)""")
    tops = " UNION ALL ".join(f"SELECT t, h FROM {name}{k} WHERE n = 1" for k in range(depth + 1))
    out.append(f"{name}_root AS ({tops})")
    pair = ", ".join(f"s{k}.l AS l{k}, s{k}.r AS r{k}" for k in range(depth))
    joins = " ".join(f"LEFT JOIN {name}_side{k} s{k} ON s{k}.t = x.t AND s{k}.i = x.i // {FAN_OUT ** k}" for k in range(depth))
    out.append(f"{name}_way AS (SELECT x.*, {pair} FROM {name}0 x {joins})")
    return ",\n ".join(out)


def _sql_h(fields) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


def _sql_fold_steps(depth: int) -> str:
    """One step a relation, so that no expression holds another twice."""
    shown = ", ".join(f"u.l{k} AS ul{k}, u.r{k} AS ur{k}" for k in range(depth))
    out = [f"f0 AS (SELECT w.*, u.h AS subroot, {shown} FROM d_way w JOIN s_way u ON u.src = w.t)"]
    for n, side in enumerate([f"{p}{{}}{k}".format for p in ("", "u") for k in range(depth)]):
        left, right = side("l"), side("r")
        out.append(f"f{n + 1} AS (SELECT * REPLACE (CASE WHEN {left} IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold) FROM f{n})")
    return ",\n ".join(out)


_DEPTH = 4
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda c, z: {_BIT})), 4294967295)"""
_PROOF = " || ".join(f"coalesce({p}l{k} || {p}r{k}, '')" for p in ("", "u") for k in range(_DEPTH))
SQL = f"""WITH leaf AS (SELECT doc_id, coalesce('1' || source, '0') AS t, {_sql_h(FIELDS)} AS h,
   CASE WHEN {_CRC} % 5 = 0 THEN {_sql_h([*FIELDS[:-1], f"translate(text, '{_UPPER}', '{_LOWER}')"])} END AS changed FROM documents),
 d0 AS (SELECT doc_id, t, h, coalesce(changed, h) AS fold, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM leaf),
 {_sql_tree("d", _DEPTH)},
 s0 AS (SELECT t AS src, '' AS t, h, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM d_root),
 {_sql_tree("s", _DEPTH)},
 {_sql_fold_steps(_DEPTH)}
 SELECT doc_id, f.h AS leaf, subroot, s_root.h AS root, sha256({_PROOF}) AS proof_sha256, fold AS folded_root, fold = s_root.h AS verified FROM f{2 * _DEPTH} f, s_root"""
