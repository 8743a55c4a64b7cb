"""Merkle manifest of a dataset by nested-interval labels.

Every document is a leaf; the leaves of a language, by ascending id, are the ranks 0, 1, ... of its tree. A node of level k carries the
interval of the leaf ranks that it covers, [lo, hi) with lo a multiple of 2 ** k. Nodes are built bottom-up in blocks of
2 ** BITS nodes, so a tree of n leaves takes log(n) / BITS rounds. Ancestors are attached by joins whose bucket is the block of levels
and whose condition is containment; what a node's interval leaves of its parent's is the interval of its sibling.
A path is attached block by block from the top, so a row meets each of its BITS lowest siblings and then one row with the rest of the way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import discard, id_bucket, ranked, written

BITS = 6
NONE, LEFT, RIGHT = 0, 1, 2  # where the sibling is
_STEP = "array<struct<level:int,side:int,digest:binary>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' texts one after the other, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256))


def text_of(d: Column) -> Column:
    """A digest as lower-case hex text."""
    return F.lower(F.hex(d))


def field(c: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def pairs(nodes: Column) -> Column:
    """The next level: every two consecutive digests (or a last single one) become their digest."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1)), lambda i: digest(
        text_of(F.get(nodes, i * 2)), F.coalesce(text_of(F.get(nodes, i * 2 + 1)), F.lit(""))))


def blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, block, size, levels): blocks of 2 ** bits consecutive nodes (tree, place, size of the level, digest), with the digests of the levels above them, up to the one that is single in its tree."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
    df = nodes.groupBy("tree", "size", F.shiftright("place", bits).alias("block")).agg(rows.alias("_0"))
    for k in range(1, bits + 1):  # a level above one that is single does not exist
        df = df.withColumn(f"_{k}", F.when(F.col("size") > 2 ** (k - 1), pairs(F.col(f"_{k - 1}"))))
    return df.select("tree", "size", "block", F.array(*[f"_{k}" for k in range(bits + 1)]).alias("levels"))


def intervals(found: DataFrame, bits: int) -> DataFrame:
    """Nodes of the blocks: tree, block, level (in the block), lo and hi (places of the block's lowest level that the node covers), digest."""
    nodes = found.select("tree", "size", "block", F.posexplode("levels").alias("level", "_d")).select("tree", "size", "block", "level", F.posexplode("_d").alias("_i", "digest"))
    lo = F.expr(f"(shiftleft(block, {bits} - level) + _i) * shiftleft(1L, level)")
    return nodes.select("tree", "block", "level", lo.alias("lo"), F.least(lo + F.expr("shiftleft(1L, level)"), F.col("size")).alias("hi"), "digest")


def siblings(nodes: DataFrame) -> DataFrame:
    """(tree, block, level, lo, hi, side, sibling) of each node that has a parent in its block: the parent contains it, and what its interval leaves of the parent's is the sibling's."""
    parent = nodes.where("level > 0").select("tree", "block", (F.col("level") - 1).alias("_level"), F.col("lo").alias("plo"), F.col("hi").alias("phi"))
    held = nodes.join(parent, ["tree", "block"]).where("level = _level and plo <= lo and hi <= phi")
    two = held.groupBy("tree", "block", "level", "plo", "phi").agg(F.collect_list(F.struct("lo", "hi", "digest")).alias("_c")).withColumn("_x", F.explode("_c"))
    rest_lo = F.when(F.col("_x.lo") > F.col("plo"), F.col("plo")).otherwise(F.col("_x.hi"))  # the difference, empty if the child covers its parent
    rest_hi = F.when(F.col("_x.lo") > F.col("plo"), F.col("_x.lo")).otherwise(F.col("phi"))
    df = two.withColumn("_lo", rest_lo).withColumn("_hi", rest_hi).withColumn("_s", F.get(F.filter("_c", lambda c: (c["lo"] == F.col("_lo")) & (c["hi"] == F.col("_hi"))), F.lit(0)))
    side = F.when(F.col("_lo") >= F.col("_hi"), NONE).when(F.col("_lo") < F.col("_x.lo"), LEFT).otherwise(RIGHT)
    return df.select("tree", "block", "level", "_x.lo", "_x.hi", side.alias("side"), F.col("_s.digest").alias("sibling"))


def built(leaves: DataFrame, bits: int = BITS) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Roots (tree, digest) of the trees of leaves (tree, place, size, digest), and for each round its lowest level and its blocks."""
    cur, rounds, tops = leaves.select("tree", "place", "size", "digest"), [], []
    while True:
        found = written(blocks(cur, bits), "blocks")
        rounds.append((cur.select("tree", "place"), found))
        tops.append(found.where(F.col("size") <= 2 ** bits).select("tree", F.expr("filter(levels, x -> x is not null)").alias("_l")).select("tree", F.element_at(F.element_at("_l", -1), 1).alias("digest")))
        if found.where(F.col("size") > 2 ** bits).isEmpty():
            return reduce(DataFrame.union, tops), rounds
        cur = found.where(F.col("size") > 2 ** bits).select("tree", F.col("block").alias("place"), F.ceil(F.col("size") / 2 ** bits).cast("long").alias("size"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))


def paths(leaves: DataFrame, rounds: list[tuple[DataFrame, DataFrame]], above: DataFrame, bits: int = BITS) -> DataFrame:
    """leaves (tree, place, ...) plus path, the siblings from each leaf to the end, and the other columns of above (tree, path, ...), which goes on from each tree's root.

    Round by round from the top. The blocks of a round are shuffled once, by (tree, block); its nodes, their siblings, the places that they contain and
    the way on from the block all meet there, and a block has at most 2 ** bits places, however large its tree."""
    carried = [c for c in above.columns if c not in ("tree", "path")]
    upper = None
    for base in range(len(rounds) - 1, -1, -1):
        places, found = rounds[base]
        rows = places if base else leaves
        own = [c for c in rows.columns if c not in ("tree", "place")]
        beside = siblings(intervals(found.repartition("tree", "block"), bits)).withColumnsRenamed({"tree": "_t", "block": "_b"})
        rows = rows.withColumn("block", F.shiftright("place", bits))
        held = rows.join(beside, (F.col("tree") == F.col("_t")) & (F.col("block") == F.col("_b")) & (F.col("lo") <= F.col("place")) & (F.col("place") < F.col("hi")), "left")
        step = F.struct((F.col("level") + base * bits).cast("int").alias("level"), "side", F.col("sibling").alias("digest"))
        got = held.groupBy("tree", "block", "place").agg(F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), step))).alias("steps"), *[F.first(c).alias(c) for c in own])
        here = above.join(found.where(F.col("size") <= 2 ** bits).select("tree"), "tree").withColumn("block", F.lit(0).cast("long"))  # trees that end in this round
        upper = here if upper is None else upper.withColumnRenamed("place", "block").unionByName(here)
        upper = got.join(upper, ["tree", "block"]).select("tree", "place", *own, F.concat("steps", "path").alias("path"), *carried)
        if base:
            upper = written(upper, "paths")
    return upper


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, s: F.when(s["side"] == LEFT, digest(text_of(s["digest"]), text_of(acc))).when(
        s["side"] == RIGHT, digest(text_of(acc), text_of(s["digest"]))).otherwise(digest(text_of(acc))))


def proof(path: Column) -> Column:
    """Digest of the siblings one after the other; of nothing, if there is none."""
    return digest(F.array_join(F.transform(F.filter(path, lambda s: s["side"] != NONE), lambda s: text_of(s["digest"])), ""))


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             tampered: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof_sha256, folded_root and verified (hex text; boolean).

    leaf is the digest of `fields`; leaves of a tree (null is a tree of its own and the first of all) ascend by id, nulls first, and rows of one id by their
    leaf; equal rows have places of their own. tampered: columns that take the place of fields before verification, by name. Texts are
    hashed where they lie and are never shuffled; what moves is two digests a row. Extra columns are not carried; an empty table gives an empty result.
    """
    other = {**{c: F.col(c) for c in fields}, **(tampered or {})}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(tree_col)), F.lit("-")).alias("tree"),  # "-" comes before "="
                       digest(*[field(F.col(c)) for c in fields]).alias("digest"), digest(*[field(other[c]) for c in fields]).alias("given"))
    placed = ranked(rows, ["tree"], ["id", "digest"], "place", "size")
    leaves = written(placed, "leaves")
    discard(placed)
    roots, rounds = built(leaves, bits)
    trees = written(ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["tree"], ["name"], "place", "size"), "trees")
    root, over = built(trees, bits)
    all_of = root.select("tree", F.array().cast(_STEP).alias("path"), F.col("digest").alias("root"))
    above = paths(trees.select("tree", "place", "name", F.col("digest").alias("subroot")), over, all_of, bits).select(F.col("name").alias("tree"), "path", "root", "subroot")
    out = paths(leaves.drop("size"), rounds, written(above, "roots"), bits).withColumn("_end", folded(F.col("given"), F.col("path")))
    return out.select(F.col("id").alias(id_col), text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"),
                      text_of(proof(F.col("path"))).alias("proof_sha256"), text_of(F.col("_end")).alias("folded_root"), (F.col("_end") == F.col("root")).alias("verified"))


def query(spark, sf_dir: str) -> DataFrame:
    changed = F.when(id_bucket("doc_id", 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered={"n_chars": changed})


def _sql() -> str:
    value = lambda c: f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')"
    number = lambda c: f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: f"sha256({number('doc_id')} || {value('source')} || {value('lang')} || {number(n)} || {value('text')})"
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295, flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(CAST(doc_id AS VARCHAR), '')])), "
           "lambda c, t: CASE WHEN t >= 0 THEN xor(c, t) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))")
    tree = """node{x} AS (SELECT 0 AS k, {by}, r AS i, {leaf} AS h, count(*) OVER (PARTITION BY {by}) AS n FROM {rows}
  UNION ALL SELECT k + 1, {by}, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM node{x} WHERE n > 1 GROUP BY k, {by}, i // 2)"""
    return f"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf('n_chars')} AS leaf, {leaf(f'(CASE WHEN {crc} % 7 = 0 THEN n_chars + 1 ELSE n_chars END)')} AS given FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM doc),
{tree.format(x='', by='tree', leaf='leaf', rows='leaf')},
sub AS (SELECT tree AS name, h, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS r FROM node WHERE n = 1),
{tree.format(x='2', by='tree', leaf='h', rows='sub')},
step AS (SELECT a.tree, a.k, a.i, CASE WHEN s.h IS NULL THEN 'N' WHEN s.i < a.i THEN 'L' || s.h ELSE 'R' || s.h END AS x
         FROM node a LEFT JOIN node s ON s.tree = a.tree AND s.k = a.k AND s.i = xor(a.i, 1) WHERE a.n > 1),
step2 AS (SELECT a.k, a.i, CASE WHEN s.h IS NULL THEN 'N' WHEN s.i < a.i THEN 'L' || s.h ELSE 'R' || s.h END AS x
          FROM node2 a LEFT JOIN node2 s ON s.k = a.k AND s.i = xor(a.i, 1) WHERE a.n > 1),
low AS (SELECT l.tree, l.r, list(x ORDER BY k) AS p FROM leaf l JOIN step s ON s.tree = l.tree AND s.i = l.r >> s.k GROUP BY l.tree, l.r),
high AS (SELECT sub.name, list(x ORDER BY k) AS p FROM sub JOIN step2 s ON s.i = sub.r >> s.k GROUP BY sub.name),
way AS (SELECT doc_id, leaf, given, sub.h AS subroot, (SELECT h FROM node2 WHERE n = 1) AS root, list_concat(coalesce(low.p, []), coalesce(high.p, [])) AS p
        FROM leaf LEFT JOIN low USING (tree, r) JOIN sub ON sub.name = leaf.tree LEFT JOIN high ON high.name = leaf.tree)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x[2:] for x in p], '')) AS proof_sha256,
  list_reduce(list_prepend(given, p), lambda a, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || a) WHEN 'R' THEN sha256(a || x[2:]) ELSE sha256(a) END) AS folded_root, folded_root = root AS verified
FROM way"""


SQL = _sql()
