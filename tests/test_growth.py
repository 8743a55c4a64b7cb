"""What plans shuffle and where they compute, so that work grows with the input."""

import re

from pyspark.sql import functions as F

from auditloom.operators import claims as J
from auditloom.operators import features as E


def test_terms_shuffle_texts_once(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other word{i % 3}") for i in range(60)], "doc_id int, text string")
    kb = J.kb_index(docs.where("doc_id < 7"), "doc_id", "text")
    queries = J.terms(docs, "doc_id", "text").withColumnRenamed("id", "query")
    assert queries._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    out = J.retrieve_candidates(queries, kb, k=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query" not in plan and out.count() == 180
    same = J.retrieve_candidates(queries, kb, k=3, small=0)  # joined by term instead
    assert sorted((r.query, r.id, round(r.score, 9)) for r in same.collect()) == sorted((r.query, r.id, round(r.score, 9)) for r in out.collect())


def test_bonus_searches_texts_before_pairs_are_formed(spark):
    contexts = spark.createDataFrame([(1, ["recon"], ["host file"], "linux", ["shell exec"], ["shell_exec"])], "query int, families array<string>, semantics array<string>, os string, claim_terms array<string>, behaviors array<string>")
    items = spark.createDataFrame([(5, "T0", "A scan of a linux host: shell"), (6, "T0", None)], "id int, external_id string, text string")
    out = J.compatibility_bonus(spark.createDataFrame([(1, 5), (1, 6)], "query int, id int"), contexts, items)
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert "regexp_extract_all" not in above and "contains" not in above.replace("array_contains", "").lower()
    assert {r.id: round(r.bonus, 6) for r in out.collect()} == {5: round(0.28 + 0.1 + 0.14 + 0.08, 6), 6: 0.0}


def test_copies_are_spread(spark):
    tasks = spark.range(900).selectExpr("concat('t', id) AS task_id", "cast(id % 9 = 0 AS int) AS label", "3 AS n_nodes").coalesce(1)
    out = E.oversample_positives(tasks, tasks.limit(2), 100, 1)
    assert out.count() == 1000 and out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_names_of_copies_are_made_once(spark):
    """Numbers and names come from a broadcast, by the thousand; what is computed for each copy is a hash and one text."""
    tasks = spark.range(4500).selectExpr("concat('t', id) AS task_id", "cast(id % 1500 = 0 AS int) AS label", "3 AS n_nodes")
    out = E.oversample_positives(tasks, tasks.limit(2), 2, 1)
    assert "lpad" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    got = out.collect()
    assert sorted((r.task_id, r.base_id) for r in got) == sorted((f"{t}_aug{str(c).zfill(3)[:3]}", t) for t in ("t0", "t1500", "t3000") for c in range(1, 2252))
    assert {r.prototype for r in got} == {0, 1} and {r.place for r in got} == {0, 1, 2}
    assert E.oversample_positives(tasks, tasks.limit(2), 4501, 0).count() == 0


def test_mappings_are_looked_up_once(spark):
    """What is read twice is written first: plans of priors over validated mappings stay small."""
    from auditloom.plans import registry

    out = registry.queries()["j15_apply_priors"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4


def test_events_are_placed_and_classed_once(spark):
    """Queries of compaction, labels and paths start from one written table whose places come from ranges, and are those of the binding."""
    from auditloom.plans import compact_plans, fixture

    d = "/root/testdata/sf0.001"
    e = compact_plans.events(spark, d)
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "transform" not in plan
    want = fixture.provenance(spark, d)
    assert e.schema.simpleString() == want.schema.simpleString() and e.exceptAll(want).isEmpty() and e.count() == want.count()


def test_tasks_of_an_alias_are_counted_without_copies_of_rows(spark):
    """Lines of an alias and task are one row before tasks are counted; only the subjects' two counts expand."""
    from auditloom.operators import identity as I

    subjects = spark.createDataFrame([("a", 1, "p", "f0"), ("a", 2, "q", None), ("b", 3, None, None)], "alias string, uuid int, path string, file string")
    events = spark.createDataFrame([(1, 60_000_000, "f1"), (1, 120_000_000, "f0"), (2, None, None), (9, 5, "f9")], "uuid int, us long, file string")
    tasks = spark.createDataFrame([(7, 1, True), (7, 2, False), (8, 1, True), (None, 1, False), (9, 3, None)], "task_id int, node_id int, overlaps boolean")
    out = I.alias_width(subjects, events, tasks)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1
    got = {r.alias: (r.uuids, r.paths, r.files, r.first_us, r.last_us, r.tasks, r.outside_tasks) for r in out.collect()}
    assert got == {"a": (2, 2, 2, 60_000_000, 120_000_000, 2, 1), "b": (1, 0, 0, None, None, 1, 0)}


def test_edges_of_a_hub_are_dealt_evenly(spark):
    """Stars around the smallest and the largest node: no task of connected_components reads the edges of a whole star."""
    from auditloom.operators import graph as G

    n, sc, conf = 16_000, spark.sparkContext, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    edges = spark.range(1, n + 1).selectExpr("0L AS a", "id AS b").union(spark.range(1, n + 1).selectExpr(f"{10 * n}L AS a", f"{2 * n} + id AS b"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("hubs", "hubs")
        got = {tuple(r) for r in G.connected_components(edges).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    ids = range(1, n + 1)
    assert got == {(0, 0), (10 * n, 2 * n + 1), *((i, 0) for i in ids), *((2 * n + i, 2 * n + 1) for i in ids)}
    tracker, store, most = sc.statusTracker(), sc._jsc.sc().statusStore(), 0
    for job in tracker.getJobIdsForGroup("hubs"):
        for stage in tracker.getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 1000)
            for i in range(tasks.size()):
                m = tasks.apply(i).taskMetrics()
                most = max(most, m.get().shuffleReadMetrics().recordsRead() if m.isDefined() else 0)
    assert 0 < most < n


def test_hot_rows_are_dealt_by_their_salt(spark):
    from auditloom.operators.scratch import spread_join

    rows = spark.range(1000).selectExpr("id % 3 AS u", "id AS v")
    out = spread_join(rows, rows.groupBy("u").agg(F.max("v").alias("top"), F.count("*").alias("n")), ["u"], "n")
    assert re.search(r"_salt#\d+L? = _salt#\d+L?", out._jdf.queryExecution().optimizedPlan().toString())
