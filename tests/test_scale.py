"""Operators that stand in for sorts and pairs of all rows, against brute force, with ties, nulls, odd types and empty tables."""

import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from auditloom.operators import claims as J
from auditloom.operators import detect as D
from auditloom.operators import graph as G
from auditloom.operators import identity as I
from auditloom.operators import scratch


@pytest.mark.parametrize("kind, make", [("string", str), ("decimal(10,2)", lambda i: Decimal(i)), ("timestamp", None), ("int", int), ("double", float)])
def test_running_totals_of_any_type(spark, kind, make):
    n = 500
    df = spark.range(n).select(F.timestamp_seconds("id").alias("k") if make is None else F.lpad(F.col("id").cast("string"), 4, "0").alias("k") if kind == "string" else F.col("id").cast(kind).alias("k"), (F.col("id") % 7).alias("a"), F.lit(1).alias("b"))
    out = I.running_total(df, "k", ["a", "b"], ["sa", "sb"]).orderBy("k").collect()
    total = 0
    for i, r in enumerate(out):
        total += i % 7
        assert (r.sa, r.sb) == (total, i + 1)
    assert len(out) == n and I.running_total(df.limit(0), "k", "a", "sa").count() == 0


def test_parallelism_follows_the_session(spark):
    """Ranges are as many as the session's shuffle partitions, for running sums, ranks and splits alike, and no range holds most of the rows."""
    from pyspark.sql import Window

    df = spark.range(4000).select("id", F.lit(1).alias("n"), (F.col("id") % 3 == 0).alias("label"))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in (3, 9):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            seen = []
            for module in (I, scratch):
                real = module.written
                module.written = lambda d, label, real=real: seen.append(real(d, label)) or seen[-1]
                try:
                    out = I.running_total(df, "id", "n", "s") if module is I else scratch.ranked(df, ["label"], ["id"], "place", "all")
                    out.count()
                finally:
                    module.written = real
            sizes = [[r["count"] for r in d.groupBy("_part" if "_part" in d.columns else F.shiftright("_at", 33)).count().collect()] for d in seen]
            assert [len(x) for x in sizes] == [parts, parts] and all(max(x) < 2 * 4000 / parts for x in sizes)
            w = Window.partitionBy("label").orderBy("id")
            want = df.withColumn("p", F.row_number().over(w) - 1).join(df.groupBy("label").agg(F.count("*").alias("a")), "label")
            assert out.join(want, ["id", "label"]).where("place <> p or `all` <> a").count() == 0 and out.count() == 4000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_ranks_of_nulls_ties_and_nothing(spark):
    rows = [(None, 3), (None, None), ("a", 1), ("a", 1), ("a", None), ("b", 2)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = sorted((r.g or "", r.v or 0, r.place, r.all) for r in scratch.ranked(df, ["g"], ["v"], "place", "all").collect())
    assert got == [("", 0, 0, 2), ("", 3, 1, 2), ("a", 0, 0, 3), ("a", 1, 1, 3), ("a", 1, 2, 3), ("b", 2, 0, 1)]
    assert sorted(r.place for r in scratch.ranked(df, [], ["v", "g"], "place").collect()) == [0, 1, 2, 3, 4, 5]
    assert scratch.ranked(df.limit(0), ["g"], ["v"], "place").count() == 0


def test_exact_quantiles(spark):
    rng = random.Random(3)
    values = [rng.choice([1.5, 2.0, 7.25, rng.random() * 9]) for _ in range(301)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None]
    r = I.exact_quantiles(df, "v", {"median": 0.5, "q90": 0.9}).first()
    assert abs(r["median"] - statistics.median(known)) < 1e-12
    s, p = sorted(known), 0.9 * (len(known) - 1)
    assert abs(r.q90 - (s[int(p)] + (s[int(p) + 1] - s[int(p)]) * (p - int(p)))) < 1e-9
    assert tuple(I.exact_quantiles(df.limit(0), "v", {"median": 0.5}).first()) == (None,)
    scale = D.robust_scale(df, "v").first()
    assert abs(scale.scale - 1.4826 * statistics.median(abs(v - scale.center) for v in known)) < 1e-9
    assert G.task_size_profile(spark.createDataFrame([(3,), (3,), (501,)], "n_nodes int")).first()["median"] == 3.0


def test_tasks_in_windows_against_brute_force(spark):
    rng = random.Random(5)
    windows = [(str(i), lo, lo + rng.randrange(0, 50)) for i in range(60) for lo in [rng.randrange(0, 400)]] + [("n", None, 5)]
    tasks = [(str(i), lo, lo + rng.randrange(0, 30)) for i in range(80) for lo in [rng.randrange(0, 500)]] + [("a", None, 4), ("b", 3, None), ("same", 10, 10), ("same", 10, 10)]
    t, w = spark.createDataFrame(tasks, "task_id string, lo long, hi long"), spark.createDataFrame(windows, "window_id string, rlo long, rhi long")
    got = sorted((r.task_id, r.lo or 0, r.reason, r.windows) for r in I.filter_tasks_by_windows(t, w, pad=3, offset=7).collect())
    want = []
    for i, lo, hi in tasks:
        n = 0 if lo is None or hi is None else sum(a is not None and lo <= b + 10 and a + 4 <= hi for _, a, b in windows)
        want.append((i, lo or 0, "no_time" if lo is None or hi is None else "kept" if n else "no_overlap", n))
    assert got == sorted(want)
    assert {r.reason for r in I.filter_tasks_by_windows(t, w.limit(0)).collect()} == {"no_time", "no_overlap"}


def test_components_of_chains_stars_and_odd_edges(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (None, 3), (9, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in G.connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {n: find(n) for n in root}


def test_ordered_pairs_pass_missing_times(spark):
    rows = [("p", "a", 1, 1, 0, "x"), ("p", "b", 2, 2, 60_000_000, "x"), ("p", "b", 3, 3, 3_600_000_000, "x"), ("p", "b", 4, 4, None, "y"), ("p", "a", 5, 5, None, "x"), ("p", "b", 6, 6, 5, "x"), ("q", "b", 7, 7, 1, "x")]
    s = spark.createDataFrame(rows, "path_id string, signal string, event_id long, order_index long, us long, process_guid string")
    got = {(r.earlier_id, r.later_id, r.same_process) for r in J.ordered_pairs(s, "a", "b").collect()}
    assert got == {(1, 2, True), (1, 4, False), (1, 6, True), (5, 6, True)}
    assert J.ordered_pairs(s.limit(0), "a", "b").count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(ValueError):
        scratch.scratch_dir(Session)
    t = scratch.written(spark.range(3), "gone")
    scratch.discard(t)
    with pytest.raises(Exception):
        t.count()


def test_shared_tables_are_made_anew_if_gone(spark):
    from auditloom.plans.fixture import once

    made = []
    make = lambda: made.append(1) or spark.range(4)
    first = once(spark, "nowhere", "shared", make)
    assert once(spark, "nowhere", "shared", make) is first and len(made) == 1
    scratch.discard(first)
    assert once(spark, "nowhere", "shared", make).count() == 4 and len(made) == 2
