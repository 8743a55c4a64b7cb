"""Joins of intervals meet distinct spans of time, not rows: many rows of equal times cost what one does, and each row gets its own answer."""

import hashlib

import pytest
from pyspark.sql import functions as F

from auditloom.operators import evaluate as K
from auditloom.operators import identity as I


@pytest.fixture
def met(monkeypatch):
    """Rows that went into interval joins, left and right."""
    sizes, plain = [], I.overlap_join

    def counted(left, right, *args):
        sizes.append((left.count(), right.count()))
        return plain(left, right, *args)

    monkeypatch.setattr(I, "overlap_join", counted)
    monkeypatch.setattr(K, "overlap_join", counted)
    return sizes


def paths(spark):
    return spark.range(200).select(F.concat(F.lit("p"), "id").alias("path_id"), F.lit(1).alias("host"), (F.col("id") % 2 * 90_000).alias("lo"), (F.col("id") % 2 * 90_000 + 100).alias("hi"))


def windows(spark):
    """A hundred windows of one span, a third of them only attempted."""
    return spark.range(100, 200).select(F.concat(F.lit("w"), "id").alias("window_id"), F.lit(1).alias("host"), F.lit(0).alias("rlo"), F.lit(1000).alias("rhi"), F.when(F.col("id") % 3 == 1, "attempted_failed").otherwise("confirmed").alias("status"))


def test_assign_windows_meets_spans(spark, met):
    got = {(r.path_id, r.match, r.window_id, r.ratio, r.near_window) for r in K.assign_windows(paths(spark), windows(spark), 0, 100_000).collect()}
    assert got == {(f"p{i}", "confirmed", "w101", 1.0, None) if i % 2 == 0 else (f"p{i}", "off_window", None, 0.0, "w100") for i in range(200)}
    assert met == [(2, 2)]


def test_time_match_meets_spans(spark, met):
    got = K.time_match(paths(spark).union(paths(spark).limit(1)), windows(spark), 10, 0)
    assert got.count() == 101 * 100 and got.where("strict and loose and not near_miss and overlap = 100").count() == 101 * 100
    assert met == [(2, 1)]


def test_pairs_of_rows_compute_nothing(spark):
    """The ratio is rounded for spans, so the last join of k01 copies values only."""
    from auditloom.plans import registry

    plan = registry.queries()["k01_time_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan.split("Join", 1)[0] and "round(" in plan
    got = K.time_match(paths(spark).withColumn("hi", F.col("hi") + 200), windows(spark).withColumn("rlo", F.lit(200)), places=1)
    assert {(r.overlap, r.ratio) for r in got.collect()} == {(100.0, 0.3)}


def test_merge_broad_techniques_meets_spans(spark, met):
    w = windows(spark)
    broad = w.withColumn("gt_techniques", F.array("window_id"))
    got = {(r.window_id, *r.broad_techniques) for r in K.merge_broad_techniques(w, broad.union(spark.createDataFrame([("a", 1, 0, 999, "confirmed", ["short"])], broad.schema))).collect()}
    assert got == {(f"w{i}", "w100") for i in range(100, 200)} and met == [(1, 2)]


def test_offset_sweep_meets_spans(spark, met):
    w = windows(spark).select("window_id", "rlo", "rhi")
    w = w.union(spark.createDataFrame([("w199", 5000, 6000), ("none", 9000, None)], "window_id string, rlo int, rhi int"))
    hits = spark.createDataFrame([(1, "s1", "o1", 1, "R", 10), (2, "s1", "o2", 1, "R", 20), (3, "s2", "o1", 2, "W", 5500)], "event_id int, subject string, object string, term int, action string, lo int")
    got = {(r.window_id, r.offset): (r.hits, r.subjects, r.objects, r.terms, r.malicious_subjects, r.malicious, len(r.actions)) for r in I.offset_sweep(hits, w, spark.createDataFrame([(0,), (9999,)], "offset int"), spark.createDataFrame([("s1",), ("o1",)], "node_id string")).collect()}
    assert len(got) == 202 and all(got[f"w{i}", 0] == (2, 1, 2, 1, 1, 2, 1) for i in range(100, 199)) and got["w199", 0] == (3, 2, 2, 2, 1, 2, 2)
    assert all(v == (0, 0, 0, 0, 0, 0, 0) for (w, o), v in got.items() if o or w == "none") and met == [(3, 8)]


def test_task_window_diagnosis_meets_spans(spark, met):
    tasks = paths(spark).select(F.col("path_id").alias("task_id"), "lo", "hi", F.lit(9).alias("n_nodes"), F.lit(1).alias("n_boundary"), F.lit(False).alias("shared"))
    more = spark.createDataFrame([("p1", 500, 600, 9, 1, False), ("timeless", None, 5, 9, 1, False)], tasks.schema)
    got = {(r.task_id, r.lo): (r.window_ids, r.attempted_ids, r.cause) for r in I.task_window_diagnosis(tasks.union(more), windows(spark)).collect()}
    ok, tried = [f"w{i}" for i in range(100, 200) if i % 3 != 1], [f"w{i}" for i in range(100, 200) if i % 3 == 1]
    assert len(got) == 202 and got["timeless", None] == ([], [], "unknown") and got["p3", 90_000] == ([], [], "unknown")
    assert got["p0", 0] == got["p1", 500] == got["p1", 90_000] == (ok, tried, None) and met == [(4, 1)]


def test_diagnosis_takes_all_lines_and_whole_windows(spark):
    """No query set of orders, and windows of a day and a half as in the other queries of windows."""
    from auditloom.plans import evidence_plans, registry

    sf = "/root/testdata/sf0.001"
    lines = evidence_plans.line_tasks(spark, sf).select("task_id", "lo").distinct()
    out = registry.queries()["c23_task_window_diagnosis"](spark, sf)
    assert out.count() == lines.count() and out.select("task_id").distinct().count() == lines.select("task_id").distinct().count()
    assert registry.queries()["c23_span_summary"](spark, sf).first()["count"] == lines.where("lo is not null").count()


def test_diagnosis_shuffles_no_lists_of_tasks(spark):
    """Five hundred tasks of times of their own, each within the same fifteen hundred windows: what is shuffled does not hold a list for each."""
    n = 500
    tasks = spark.range(n).selectExpr("concat('t', id) AS task_id", "id AS lo", "id + 7 AS hi", "9 AS n_nodes", "1 AS n_boundary", "false AS shared")
    tasks = tasks.union(tasks.selectExpr("task_id", "lo + 9000", "hi + 9000", "n_nodes", "n_boundary", "shared"))
    held = spark.range(1500).selectExpr("md5(cast(id AS string)) AS window_id", "0L AS rlo", "20000L AS rhi", "if(id % 5 = 0, 'attempted_failed', 'confirmed') AS status")
    sc, limit = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sc.setJobGroup("lists", "lists")
        got = I.task_window_diagnosis(tasks, held).selectExpr("sha2(array_join(window_ids, ' '), 256) AS a", "sha2(array_join(attempted_ids, ' '), 256) AS b").groupBy("a", "b").count().collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    names = [[hashlib.md5(str(i).encode()).hexdigest() for i in range(1500) if (i % 5 == 0) == tried] for tried in (False, True)]
    assert [tuple(r) for r in got] == [(*(hashlib.sha256(" ".join(sorted(x)).encode()).hexdigest() for x in names), 2 * n)]
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup("lists") for s in tracker.getJobInfo(job).stageIds}
    most = max(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages if tracker.getStageInfo(s))
    assert 0 < most < 5_000_000
