"""Embedding near-duplicates by a pivot-permutation index.

Each vector is described by the ordered list of its nearest pivots (reference vectors of its own label, topped up with
random directions). Inverted lists hold the vectors of each pivot; two vectors are candidates if they share at least `least` of their
`depth` nearest pivots, and are verified by their cosine in double precision.

A list that is too long is replaced by the lists of its pivot and one more shared pivot, and these, if need be, by those of
three: as candidates share three pivots, none is lost, and the lists' length grows far more slowly than the corpus. Lists are made of
ids and pivots alone; vectors travel only to lists of two and more. Lists are compared as matrix products, so no pair is ever a row, and what
is too long after three pivots is cut into blocks, of which every pair is compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import connected_components, discard, sampled, spread_join, written

DEPTH, LEAST, LIST = 8, 3, 4096
SAMPLE = 8192  # most vectors that pivots are chosen from, over all labels
#: Pivots of a label: about twice the root of its vectors, within these bounds.
PIVOTS_LOW, PIVOTS_HIGH = 16, 2048
_ROWS = 512  # rows of a list compared at a time


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(label, unit, rep, copies): equal usable vectors of a label once, with the smallest id and the number of rows.

    Unusable are a null label, null and zero vectors, and vectors with a null or non-finite component. Vectors
    of different lengths never meet. -0.0 equals 0.0."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where("label is not null and id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0.0))
    return rows.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def wanted(n, high: int = PIVOTS_HIGH):
    """Pivots of a label of n vectors."""
    return F.greatest(F.lit(PIVOTS_LOW), F.least(F.lit(high), F.floor(2 * F.sqrt(n)))).cast("int")


def choose_pivots(reps: DataFrame, sample: int = SAMPLE, seed: int = 3) -> dict:
    """{(label, dimension): matrix of unit rows}: farthest-first picks, `want` of a label at most, from at most `sample` vectors chosen by a hash over all labels."""
    got: dict = {}
    for r in sampled(reps, sample, seed, key="k").select("label", F.size("v").alias("d"), "v", "want").collect():
        got.setdefault((r.label, r.d), (r.want, []))[1].append(r.v)
    out = {}
    for key, (want, rows) in got.items():
        x = _unit(np.array(sorted(rows)))
        pick, far = [0], x @ x[0]
        while len(pick) < min(want, len(x)):
            pick.append(int(far.argmin()))
            far = np.maximum(far, x @ x[pick[-1]])
        out[key] = x[pick].astype(np.float32)
    return out


def topped_up(own: np.ndarray | None, want: int, d: int, seed: int = 23) -> np.ndarray:
    """`want` pivots: a label's own, then random directions, the same for all labels; so no label is without, however few of its vectors the sample held."""
    more = want - (0 if own is None else len(own))
    if more <= 0:
        return own
    x = np.random.default_rng([seed, d]).normal(size=(more, d))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return x if own is None else np.concatenate([own, x])


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = v / np.abs(v).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def described(reps: DataFrame, pivots: dict, depth: int = DEPTH) -> DataFrame:
    """reps plus `near`: the ordered list of the nearest `depth` pivots, nearest first."""
    columns = [*reps.columns, "near"]

    def near(batches):
        full: dict = {}
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            lists: list = [None] * len(pdf)
            for (label, d), rows in pdf.groupby([pdf["label"], pdf["v"].map(len)]).indices.items():
                want = int(pdf["want"][rows[0]])
                own = pivots.get((label, d))
                p = full.get((d, want)) if own is None else full.get((label, d))
                if p is None:
                    if len(full) > 64:
                        full.clear()
                    p = full[(d, want) if own is None else (label, d)] = topped_up(own, want, d)
                sim = _unit(np.stack(pdf["v"].to_numpy()[rows])).astype(np.float32) @ p.T
                order = np.argsort(-sim, axis=1, kind="stable")[:, :depth]
                for r, o in zip(rows, order, strict=True):
                    lists[r] = o.tolist()
            yield pdf.assign(near=lists)[columns]

    return reps.mapInPandas(near, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reps.schema) + ", near array<int>")


def inverted_lists(desc: DataFrame, least: int = LEAST, size: int = LIST) -> DataFrame:
    """(k, list, own): members of the lists of two and more vectors, where `list` names dimension, pivots, two blocks and label, and own is the member's block.

    Lists of more than `size` members are replaced by lists of one more shared pivot up to `least` pivots, then cut into blocks."""
    key = ["label", "d", "prefix"]
    at = desc.select("k", "label", F.size("v").alias("d"), F.array_sort("near").alias("s"))
    posts = at.select("*", F.posexplode("s").alias("i", "_p")).withColumn("prefix", F.array("_p")).drop("_p")
    parts = []
    for depth in range(1, least + 1):
        posts = written(posts, "postings")
        sizes = written(posts.groupBy(*key).agg(F.count("*").alias("n")).withColumn("m", F.col("n")).where("n > 1"), "lists")
        sized = spread_join(posts, sizes, key, "n").where("m is not null")
        fits = F.lit(True) if depth == least else F.col("m") <= size
        parts.append(sized.where(fits).select("k", *key, F.ceil(F.when(F.col("m") <= size, 1).otherwise(2 * F.col("m") / size)).cast("int").alias("blocks")))
        if depth < least:
            longer = sized.where(F.col("m") > size).where("i + 1 < size(s)")
            longer = longer.select("k", "label", "d", "s", "prefix", F.explode(F.sequence(F.col("i") + 1, F.size("s") - 1)).alias("i"))
            posts = longer.withColumn("prefix", F.concat("prefix", F.array(F.get("s", F.col("i"))))).select("k", "label", "d", "s", "i", "prefix")
    lists = parts[0]
    for p in parts[1:]:
        lists = lists.union(p)
    lists = lists.withColumn("own", F.pmod(F.xxhash64("k", F.lit(17)), F.col("blocks")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.concat_ws(":", "d", F.array_join(F.col("prefix").cast("array<string>"), "."), F.least("own", "other"), F.greatest("own", "other"), F.col("label").cast("string"))
    return lists.select("k", name.alias("list"), "own")


def _marks(near: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    m = np.zeros((len(near), len(pivots)), np.float32)
    m[np.arange(len(near))[:, None], np.searchsorted(pivots, near)] = 1
    return m


def _compare(ua, na, ub, nb, prefix: list[int], same: bool, floor: float, least: int):
    """Links of two blocks of one list: (index in a, index in b) of pairs whose first common pivots are this list's."""
    pivots = np.unique(np.concatenate([na.ravel(), nb.ravel()]))
    ma, mb = _marks(na, pivots), _marks(nb, pivots)
    upto = int(np.searchsorted(pivots, prefix[-1])) + 1
    found = []
    for i in range(0, len(ua), _ROWS):
        for j in range(i if same else 0, len(ub), _ROWS):
            a, b = slice(i, i + _ROWS), slice(j, j + _ROWS)
            ok = ua[a] @ ub[b].T >= floor
            if not ok.any():
                continue
            ok &= (ma[a] @ mb[b].T >= least) & (ma[a, :upto] @ mb[b, :upto].T == len(prefix))
            x, y = np.nonzero(np.triu(ok, 1) if same and i == j else ok)
            found.append((x + i, y + j))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.array([], int), np.array([], int))


def links(desc: DataFrame, floor: float = 0.93, least: int = LEAST, size: int = LIST) -> DataFrame:
    """(kind, k, a, b, n) facts of the links between distinct vectors.

    kind 0: vector k gained n linked rows (copies counted); kind 1: an edge a-b of a spanning forest of a list's
    links. A pair is judged in the list of the first pivots that both hold, so it counts once. Lists are dealt to bins of about
    2 * size members by a hash; a bin is a group.
    """
    lists = written(inverted_lists(desc, least, size), "lists")
    bins = max(1, -(-lists.count() // (2 * size)))
    full = lists.join(desc.select("k", "rep", "copies", "v", "near"), "k").withColumn("_bin", F.pmod(F.xxhash64("list"), F.lit(bins)))
    kind = desc.schema["rep"].dataType.simpleString()

    def judge(pdf):
        rows = []
        pdf = pdf.reset_index(drop=True)
        for name, idx in pdf.groupby("list").indices.items():
            _, prefix, i, j, _ = name.split(":", 4)
            part, same = pdf.iloc[idx], i == j
            a = part if same else part[part["own"] == int(i)]
            b = part if same else part[part["own"] == int(j)]
            if len(part) < 2 or a.empty or b.empty:
                continue
            ua, na = _unit(np.stack(a["v"].to_numpy())), np.stack(a["near"].to_numpy())
            ub, nb = (ua, na) if same else (_unit(np.stack(b["v"].to_numpy())), np.stack(b["near"].to_numpy()))
            x, y = _compare(ua, na, ub, nb, [int(p) for p in prefix.split(".")], same, floor, least)
            if not len(x):
                continue
            for own, at, far, to in ((a, x, b, y), (b, y, a, x)):
                got = np.bincount(at, far["copies"].to_numpy()[to], len(own)).astype(np.int64)
                hit = np.nonzero(got)[0]
                rows += [(0, k, None, None, n) for k, n in zip(own["k"].to_numpy()[hit].tolist(), got[hit].tolist(), strict=True)]
            rows += [(1, None, p, q, 0) for p, q in forest(a["rep"].to_numpy()[x], b["rep"].to_numpy()[y])]
        out = pd.DataFrame(rows, columns=["kind", "k", "a", "b", "n"])
        return out.astype({"kind": "int32", "k": "Int64", "n": "int64"} | ({"a": "Int64", "b": "Int64"} if kind == "bigint" else {}))

    return full.groupBy("_bin").applyInPandas(judge, f"kind int, k bigint, a {kind}, b {kind}, n bigint")


def forest(a, b) -> list[tuple]:
    """(node, root) edges that connect what the pairs connect."""
    root: dict = {}

    def find(r):
        while root.setdefault(r, r) != r:
            root[r] = root[root[r]]
            r = root[r]
        return r

    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
    return [(r, find(r)) for r in root if find(r) != r]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", floor: float = 0.93,
                    depth: int = DEPTH, least: int = LEAST, size: int = LIST, pivots: int = PIVOTS_HIGH) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id, kept (id = component_id).

    Only rows of equal, non-null label are compared. Unusable vectors (see distinct_vectors) link with nothing and
    are their own component; a null id gives n_links 0, a null component_id and kept false. Equal vectors always
    link (cosine 1). Rows that repeat an id count as separate rows. Extra columns are not carried. An empty
    table gives an empty result. Retrieval is approximate: README states the recall measured against brute force.
    """
    found = written(distinct_vectors(vectors, id_col, vec_col, label_col).withColumn("k", F.monotonically_increasing_id()), "vectors")
    in_label = found.groupBy("label", F.size("v").alias("d")).agg(F.count("*").alias("n")).withColumn("want", wanted(F.col("n"), pivots))
    reps = spread_join(found.withColumn("d", F.size("v")), in_label, ["label", "d"], "n").drop("d")
    desc = written(described(reps, choose_pivots(reps), depth), "described")
    facts = written(links(desc, floor, least, size), "links")
    discard(found)
    more = facts.where("kind = 0").groupBy("k").agg(F.sum("n").alias("more"))
    comps = connected_components(facts.where("kind = 1").select("a", "b"))
    of_rep = written(desc.join(more, "k", "left").join(comps, F.col("rep") == F.col("node"), "left").select(
        "label", "v", "copies", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c")), "classes")
    discard(desc, facts)
    v = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    comp = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return spread_join(rows, of_rep, ["label", "v"], "copies").select(
        F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).alias("n_links"), comp.alias("component_id"),
        F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
       AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS n, vec_id AS r FROM embeddings UNION SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT m.vec_id, coalesce(l.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM (SELECT n AS vec_id, min(r) AS component_id FROM reach GROUP BY n) m
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = m.vec_id
"""
