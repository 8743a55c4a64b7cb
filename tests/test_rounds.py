"""Iterative operators in a logarithmic number of rounds: deep forests, cycles, several parents, against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import compact as C
from auditloom.operators import graph as G


def recursive_cuts(edges, threshold):
    kids, cut = {}, {}
    for c, p in edges.items():
        kids.setdefault(p, []).append(c)
    for n in sorted(set(edges) | set(edges.values()), reverse=True):  # children have larger numbers
        cut[n] = n in edges and sum(not cut[k] for k in kids.get(n, [])) > threshold
    return {n for n, c in cut.items() if c}


@pytest.mark.parametrize("seed, near, threshold", [(1, 1, 0), (2, 2, 1), (3, 3, 1), (4, 200, 2), (5, 2, 0)])
def test_segmentation_of_random_forests(spark, seed, near, threshold):
    rng = random.Random(seed)
    edges = {i: rng.randrange(max(0, i - near), i) for i in range(1, 250) if rng.random() > 0.02}
    df = spark.createDataFrame([*edges.items(), *list(edges.items())[:5], (None, 3), (4, None), (7, 7)], "child long, parent long").repartition(3)
    cut = recursive_cuts(edges, threshold)
    found = G.segment_nodes(df, threshold)
    assert {r.node for r in found.collect()} == cut
    want = set()
    for n in set(edges) | set(edges.values()):
        if n not in edges or n in cut:
            want.add((n, n, False))
        if n in edges:
            up = edges[n]
            while up in edges and up not in cut:
                up = edges[up]
            want.add((up, n, n in cut))
    got = [(r.root, r.node, r.is_boundary) for r in G.task_components(df, found).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_path_of_100000_nodes(spark):
    """Each node of the path has one more child, so with no child allowed every second node is cut; rounds are counted."""
    n = 100_000
    path = spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    rounds = []
    real = G.written
    G.written = lambda df, label: rounds.append(label) or real(df, label)
    try:
        found = G.segment_nodes(path, 0)
        assert found.agg(F.count("*"), F.sum(F.col("node") % 2)).first()[:] == (n // 2 - 1, 0)  # the last node is a leaf and stays, the one above it goes
        assert found.agg(F.max("node"), F.min("node")).first()[:] == (n - 2, 2)
        parts = G.task_components(path, spark.createDataFrame([], "node long"))
        assert parts.where("root = 0").count() == n
    finally:
        G.written = real
    assert len(rounds) < 120


def test_cycles_raise(spark):
    loop = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (5, 4), (6, 5)], "child long, parent long")
    for run in (lambda: G.segment_nodes(loop, 0), lambda: G.task_components(loop, spark.createDataFrame([], "node long"))):
        with pytest.raises(ValueError, match="cycle"):
            run()
    assert {(r.root, r.node) for r in G.task_components(loop, spark.createDataFrame([(2,)], "node long")).collect()} == {(2, 2), (2, 3), (2, 1), (4, 4), (4, 5), (4, 6)} | {(2, 2)}
    none = loop.limit(0)
    assert G.segment_nodes(none).count() == 0 and G.task_components(none, none.select(F.col("child").alias("node"))).count() == 0


def fixpoint(labels, forks):
    best = {}
    for t, e, lab, o in labels:
        best[t, e, lab] = min(o, best.get((t, e, lab), o))
    moved = True
    while moved:
        moved = False
        for t, p, c, at in forks:
            for (t2, e, lab), o in list(best.items()):
                if (t2, e) == (t, p) and o < at and at < best.get((t, c, lab), 1 << 60):
                    best[t, c, lab] = at
                    moved = True
    return best


@pytest.mark.parametrize("seed, many", [(1, 0.0), (2, 0.2), (3, 0.6)])
def test_inheritance_against_the_fixpoint(spark, seed, many):
    rng = random.Random(seed)
    forks, labels = [], []
    for t in ("a", "b"):
        for i in range(1, 40):
            for _ in range(1 + (rng.random() < many)):
                forks.append((t, f"p{rng.randrange(max(0, i - 2), i)}", f"p{i}", rng.randrange(5 * i, 5 * i + 40)))
        labels += [(t, f"p{rng.randrange(40)}", rng.choice("xyz"), rng.randrange(0, 200)) for _ in range(12)]
    forks += [("a", "q1", "q2", 3), ("a", "q2", "q1", 5), ("a", "q1", "q1", 9), forks[0]]  # a cycle and a repeated row
    labels += [("a", "q1", "x", 1), ("a", "alone", "x", 4), ("c", "p1", "x", 2), labels[0]]
    got = C.inherit_on_fork(spark.createDataFrame([*labels, ("a", None, "x", 1)], "task_id string, entity string, label string, acquired_order long"), spark.createDataFrame([*forks, ("a", None, "p1", 3)], "task_id string, parent string, child string, order long")).collect()
    assert {(r.task_id, r.entity, r.label): r.acquired_order for r in got} == fixpoint(labels, forks) and len(got) == len(fixpoint(labels, forks))


def test_inheritance_along_a_chain(spark):
    n = 20_000
    forks = spark.range(1, n).select(F.lit("t").alias("task_id"), (F.col("id") - 1).cast("string").alias("parent"), F.col("id").cast("string").alias("child"), (F.col("id") * 2).alias("order"))
    labels = spark.createDataFrame([("t", "0", "x", 1), ("t", "9000", "x", 10 ** 9), ("t", "10000", "y", 20_001), ("t", "5", "z", 13)], "task_id string, entity string, label string, acquired_order long")
    got = {r.label: (r.n, r.o) for r in C.inherit_on_fork(labels, forks).groupBy("label").agg(F.count("*").alias("n"), F.max("acquired_order").alias("o")).collect()}
    assert got == {"x": (n, 2 * n - 2), "y": (n - 10_000, 2 * n - 2), "z": (1, 13)}
    assert C.inherit_on_fork(labels.limit(0), forks).count() == 0 and C.inherit_on_fork(labels, forks.limit(0)).count() == 4


def test_a_long_provenance_is_no_cycle(spark):
    rows = spark.range(1200).select(F.col("id").cast("string").alias("label_id"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("prev_label_ids"))
    near = rows.where("cast(label_id as int) < 25")
    assert C.trace_back(near, near.where("label_id = '24'")).agg(F.max("depth")).first()[0] == 24
    loop = spark.createDataFrame([("a", ["b"]), ("b", ["a"])], "label_id string, prev_label_ids array<string>")
    with pytest.raises(ValueError, match="cycle"):
        C.trace_back(loop, loop)


def test_split_labels_along_a_long_chain_and_in_a_cycle(spark):
    """Task i's root is held by task i - 1; a label of task 0 reaches all, one of the middle those behind it. Tasks x and y are each other's parents."""
    from auditloom.operators import labels as L

    n = 30
    roots = spark.createDataFrame([(f"t{i}", "r") for i in range(n)] + [("x", "q"), ("y", "q"), (None, "r"), ("t1", None)], "task_id string, root string")
    parents = spark.createDataFrame([(f"t{i}", f"t{i - 1}") for i in range(1, n)] + [("x", "y"), ("y", "x"), ("t1", "t0")], "task_id string, parent_task string")
    labels = spark.createDataFrame([("t0", "r", "A"), ("t0", "r", "A"), ("t9", "r", "B"), ("t0", "other", "C"), ("x", "q", "D"), (None, "r", "E")], "task_id string, entity string, label string")
    got = [(r.task_id, r.label) for r in L.inherit_split_labels(labels, roots, parents).collect()]
    want = {(f"t{i}", "A") for i in range(n)} | {(f"t{i}", "B") for i in range(9, n)} | {("t0", "C"), ("x", "D"), ("y", "D"), (None, "E")}
    assert set(got) == want and len(got) == len(want)
