"""Queries of identity resolution, evidence recovery and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import identity as I
from auditloom.plans.fixture import duck, provenance, table
from auditloom.plans.registry import query


def subjects(spark, d):
    """One subject per user of the events: parent by the binding, thread groups of users with equal user_id DIV 20."""
    pe = provenance(spark, d)
    s = pe.groupBy("process_guid", "user_id").agg(F.min("parent_process_guid").alias("parent"), F.min("event_id").alias("ord"), F.min("process_name").alias("name"))
    return s.select(F.col("process_guid").alias("uuid"), "parent", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("cid"), F.lit("0").alias("ppid"),
                    F.floor(F.col("user_id") / 20).cast("string").alias("tgid"), F.lit("/bin").alias("path"), "ord", "user_id", "name")


SUBJECTS = "subj AS (SELECT process_guid AS uuid, min(parent_process_guid) AS parent, 'c' || CAST(user_id AS VARCHAR) AS cid, CAST(user_id // 20 AS VARCHAR) AS tgid, min(event_id) AS ord, user_id FROM pe GROUP BY process_guid, user_id)"


@query("c01_process_alias", duck(f"""WITH {SUBJECTS}, canon AS (SELECT uuid, parent, first_value(uuid) OVER (PARTITION BY parent, tgid ORDER BY ord) AS canonical_id FROM subj)
SELECT c.uuid AS raw_id, c.canonical_id, coalesce(p.canonical_id, c.parent) AS parent_id, s.cid AS pid_id, pp.cid AS pid_parent FROM canon c LEFT JOIN canon p ON p.uuid = c.parent JOIN subj s ON s.uuid = c.uuid LEFT JOIN subj pp ON pp.uuid = c.parent"""))
def c01(spark, d):
    s = subjects(spark, d)
    pid = I.resolve_process_alias(s, "pid").select("raw_id", F.col("canonical_id").alias("pid_id"), F.col("parent_id").alias("pid_parent"))
    return I.resolve_process_alias(s, "thread_group").join(pid, "raw_id")


def raw_events(spark, d):
    return provenance(spark, d).withColumn("subject", F.col("process_guid")).withColumn("object", F.col("object_key"))


@query("c02_apply_alias", duck("SELECT event_id, 'c' || CAST(user_id AS VARCHAR) AS subject, object_key AS object FROM pe"))
def c02(spark, d):
    return I.apply_alias(raw_events(spark, d), I.resolve_process_alias(subjects(spark, d), "pid")).select("event_id", "subject", "object")


@query("c03_node_dimension", duck("SELECT object_key AS uuid, arg_min(object_type, event_id) AS node_type, arg_min(process_name, event_id) AS node_attr FROM pe WHERE object_key IN (SELECT object_key FROM pe WHERE event_type = 'EXEC') GROUP BY object_key"))
def c03(spark, d):
    pe = provenance(spark, d)
    nodes = pe.select(F.col("object_key").alias("uuid"), F.col("object_type").alias("node_type"), F.col("process_name").alias("node_attr"), F.col("event_id").alias("ord"))
    return I.node_dimension(nodes, pe.where("event_type = 'EXEC'").select(F.col("object_key").alias("uuid")))


def scored_tasks(spark, d):
    """Tasks of the orders table: score by price, labels by key."""
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("_aug001")).otherwise("")).alias("task_id"), F.round("o_totalprice", -2).alias("score"),
                    (F.col("o_orderkey") % 3 == 0).cast("int").alias("predicted_label"), (F.col("o_orderkey") % 7 == 0).cast("int").alias("label"))


TASKS = "t AS (SELECT 't' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 5 = 0 THEN '_aug001' ELSE '' END AS task_id, round(o_totalprice, -2) AS score, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS predicted_label, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS label FROM orders)"


@query("c04_select_tasks", f"WITH {TASKS} SELECT task_id, 'p' AS mode FROM t WHERE predicted_label = 1 UNION ALL SELECT task_id, 'g' FROM t WHERE label = 1 AND task_id NOT LIKE '%aug%'")
def c04(spark, d):
    t = scored_tasks(spark, d)
    return I.select_tasks(t, "predicted_positive").select("task_id", F.lit("p").alias("mode")).union(I.select_tasks(t, "ground_truth_positive_base_only").select("task_id", F.lit("g").alias("mode")))


@query("c05_score_percentile", f"""WITH {TASKS}, p AS (SELECT task_id, 100.0 * cume_dist() OVER (ORDER BY score) AS percentile FROM t)
SELECT task_id, round(percentile, 6) AS percentile, CASE WHEN percentile >= 99 THEN 'Critical' WHEN percentile >= 97 THEN 'Significant' ELSE 'Moderate' END AS severity FROM p""")
def c05(spark, d):
    return I.score_percentile(scored_tasks(spark, d)).select("task_id", F.round("percentile", 6).alias("percentile"), "severity")


def seeds(spark, d):
    return subjects(spark, d).where("user_id % 13 = 0").select(F.concat(F.lit("task_"), (F.col("user_id") % 10).cast("string")).alias("task_id"), F.col("uuid").alias("node_id"))


SEEDS = "seed AS (SELECT DISTINCT 'task_' || CAST(user_id % 10 AS VARCHAR) AS task_id, process_guid AS node_id FROM pe WHERE user_id % 13 = 0)"


@query("c06_match_frontier", duck(f"WITH {SEEDS} SELECT DISTINCT s.task_id, e.event_id FROM pe e JOIN seed s ON s.node_id = e.process_guid OR s.node_id = e.object_key"))
def c06(spark, d):
    return I.match_frontier(raw_events(spark, d).drop("task_id"), seeds(spark, d)).select("task_id", "event_id")


@query("c07_recover_evidence", duck(f"""WITH {SEEDS}, m AS (SELECT s.task_id, e.event_id, row_number() OVER (PARTITION BY s.task_id, process_guid, object_key, event_type ORDER BY event_id) AS rn FROM pe e JOIN seed s ON s.node_id = e.process_guid),
r AS (SELECT task_id, event_id, row_number() OVER (PARTITION BY task_id ORDER BY event_id) AS order_index, count(*) OVER (PARTITION BY task_id) AS n FROM m WHERE rn = 1)
SELECT task_id, event_id, order_index, greatest(n - 20, 0) AS dropped FROM r WHERE order_index <= 20"""))
def c07(spark, d):
    e = raw_events(spark, d).select("event_id", "subject", "object", F.col("event_type").alias("action"))
    return I.recover_evidence(e, seeds(spark, d), hops=1, cap=20).select("task_id", "event_id", "order_index", "dropped")


@query("c08_normalize_events", duck("""SELECT 'task_' || right(task_id, 1) || ':' || lpad(CAST(order_index AS VARCHAR), 8, '0') AS event_id, process_guid, process_name, event_type, object_type, object_key, object_class,
  CASE WHEN object_type = 'flow' AND object_class = 'external_ip' THEN 443 WHEN object_type = 'flow' THEN 22 END AS remote_port, CAST(value AS VARCHAR) IS NOT NULL AS has_value FROM pe"""))
def c08(spark, d):
    pe = raw_events(spark, d)
    dim = pe.select(F.col("subject").alias("uuid"), F.lit("process").alias("node_type"), F.col("process_name").alias("node_attr")).distinct()
    m = pe.select("task_id", "order_index", "subject", "object", F.col("event_type").alias("action"), "ts", F.col("object_type").alias("type_hint"), F.lit(None).cast("string").alias("attr_hint"), F.col("props").alias("raw"))
    out = I.normalize_events(m, dim)
    return out.select("event_id", "process_guid", "process_name", "event_type", "object_type", "object_key", "object_class", "remote_port", F.lit(True).alias("has_value"))


@query("c09_parent_process", duck("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'own' ELSE parent_process_guid END AS parent_process_guid FROM pe"))
def c09(spark, d):
    pe = provenance(spark, d).drop("parent_process_guid").withColumn("raw_parent", F.when(F.col("event_id") % 4 == 0, F.lit("own")))
    return I.parent_process(pe, I.resolve_process_alias(subjects(spark, d))).select("event_id", "parent_process_guid")


@query("c10_refresh_placeholders", duck("SELECT event_id, process_name, 'file' AS object_type, CASE WHEN event_id % 2 = 0 THEN '/tmp/z' ELSE object_key END AS object_key, CASE WHEN event_id % 2 = 0 THEN 'temp_file' ELSE object_class END AS object_class FROM pe WHERE object_type = 'file'"))
def c10(spark, d):
    pe = provenance(spark, d).where("object_type = 'file'")
    dim = pe.select(F.col("process_guid").alias("uuid"), F.lit("process").alias("node_type"), F.col("process_name").alias("node_attr")).distinct()
    dim = dim.union(spark.range(1).select(F.lit("obj-7"), F.lit("FileObject"), F.lit("/tmp/z")))
    even = F.col("event_id") % 2 == 0
    blank = pe.withColumn("process_name", F.when(even, F.col("process_guid")).otherwise(F.col("process_name"))).withColumn("object_key", F.when(even, F.lit("obj-7")).otherwise(F.col("object_key")))
    blank = blank.withColumn("object_type", F.when(even, F.lit("object")).otherwise(F.col("object_type"))).withColumn("object_class", F.when(even, F.lit("object")).otherwise(F.col("object_class")))
    return I.refresh_placeholders(blank, dim).select("event_id", "process_name", "object_type", "object_key", "object_class")


@query("c11_entity_index", duck("""SELECT task_id, 'process' AS entity, process_guid AS key, arg_min(process_name, order_index) AS name, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM pe GROUP BY ALL
UNION ALL SELECT task_id, 'object', object_key, arg_min(object_class, order_index), min(us), max(us), count(*) FROM pe GROUP BY task_id, object_key"""))
def c11(spark, d):
    return I.entity_index(provenance(spark, d))


@query("c12_event_index", duck("SELECT task_id, process_guid, row_number() OVER (PARTITION BY task_id, process_guid ORDER BY order_index) AS place, event_id FROM pe"))
def c12(spark, d):
    return I.event_index(provenance(spark, d), "process_guid")


@query("c13_evidence_graph", duck("SELECT task_id, process_guid AS node, event_type, object_key, count(*) AS n FROM pe GROUP BY ALL"))
def c13(spark, d):
    return I.evidence_graph(provenance(spark, d), graph_priors(spark))[0].select("task_id", F.col("process_guid").alias("node"), "event_type", "object_key", "n")


def graph_priors(spark):
    """Task 1 has roots, task 2 a root made by a split, task 3 boundary ids alone."""
    return spark.createDataFrame([("task_1", ["root", "r2"], " ", []), ("task_2", [], "cut", ["b1"]), ("task_3", [], None, ["b2", "b3"])], "task_id string, root_ids array<string>, task_root string, boundary_ids array<string>")


@query("c13_evidence_frontier", duck("""SELECT task_id, CASE task_id WHEN 'task_1' THEN ['root', 'r2'] WHEN 'task_2' THEN ['cut'] ELSE [arg_min(process_guid, order_index)] END AS anchors, CASE task_id WHEN 'task_2' THEN ['b1'] WHEN 'task_3' THEN ['b2', 'b3'] ELSE [] END AS boundary,
 CASE task_id WHEN 'task_2' THEN 'split_root:cut' ELSE '' END AS links FROM pe GROUP BY task_id"""))
def c13_frontier(spark, d):
    f = I.evidence_graph(provenance(spark, d), graph_priors(spark))[1]
    return f.withColumn("links", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["kind"], x["process"])), ","))


@query("c14_priors", duck("""SELECT task_id, round(avg(value), 6) AS task_score, CASE WHEN task_id < 'task_5' THEN count(DISTINCT process_guid) ELSE 0 END AS n_nodes, CASE WHEN task_id > 'task_2' THEN [min(process_guid)] ELSE [] END AS top_processes FROM pe GROUP BY task_id"""))
def c14(spark, d):
    pe = provenance(spark, d)
    t = pe.groupBy("task_id").agg(F.round(F.avg("value"), 6).alias("task_score"))
    meta = pe.where("task_id < 'task_5'").groupBy("task_id").agg(F.count_distinct("process_guid").alias("n_nodes"), F.array(F.min("process_guid")).alias("root_ids"))
    top = pe.where("task_id > 'task_2'").groupBy("task_id").agg(F.array(F.min("process_guid")).alias("top_processes"))
    return I.build_priors(t, meta, top).drop("root_ids")


SEEDS = "s AS (SELECT DISTINCT task_id, process_guid AS node_id FROM pe WHERE user_id % 3 > 0 UNION SELECT DISTINCT task_id, 'ghost' FROM pe), tp AS (SELECT DISTINCT task_id, process_guid AS node_id FROM pe WHERE user_id % 4 = 0 UNION SELECT DISTINCT task_id, 'spirit' FROM pe WHERE task_id < 'task_4')"


def covered(spark, d):
    pe = provenance(spark, d)
    s = pe.where("user_id % 3 > 0").select("task_id", F.col("process_guid").alias("node_id")).union(pe.select("task_id", F.lit("ghost"))).distinct()
    top = pe.where("user_id % 4 = 0").select("task_id", F.col("process_guid").alias("process")).union(pe.where("task_id < 'task_4'").select("task_id", F.lit(" spirit "))).union(pe.select("task_id", F.lit(" ")))
    return I.seed_coverage(s, pe, top)


@query("c15_seed_coverage", duck(f"""WITH {SEEDS} SELECT task_id, count(*) AS seeds, count(*) FILTER (node_id = 'ghost') AS unmapped, (SELECT count(*) FROM tp WHERE tp.task_id = s.task_id AND node_id = 'spirit') AS unmapped_top FROM s GROUP BY task_id"""))
def c15(spark, d):
    return covered(spark, d)[0]


@query("c15_mapped_seeds", duck(f"WITH {SEEDS} SELECT task_id, node_id FROM (SELECT * FROM s UNION SELECT * FROM tp) WHERE node_id NOT IN ('ghost', 'spirit')"))
def c15_mapped(spark, d):
    return covered(spark, d)[1]


@query("c16_canonical_ground_truth", duck("SELECT DISTINCT 'c' || CAST(user_id AS VARCHAR) AS node_id FROM pe WHERE user_id % 9 = 0 UNION SELECT 'stranger'"))
def c16(spark, d):
    gt = subjects(spark, d).where("user_id % 9 = 0").select(F.col("uuid").alias("node_id")).union(spark.range(1).select(F.lit("stranger")))
    return I.canonical_ground_truth(gt, I.resolve_process_alias(subjects(spark, d), "pid"))


@query("c17_object_linked_ground_truth", duck("SELECT process_guid AS subject, event_type, count(*) AS n FROM pe WHERE object_key LIKE '/tmp/%' OR process_guid = 'p3' GROUP BY ALL"))
def c17(spark, d):
    pe = raw_events(spark, d).withColumn("object2", F.col("process_guid"))
    bad = pe.where("object_key like '/tmp/%'").select(F.col("object_key").alias("node_id")).union(spark.range(1).select(F.lit("p3")))
    return I.object_linked_ground_truth(pe, bad)


def order_windows(spark, d):
    """Windows of a day and a half after the dates of orders; tasks are the ship dates of lines."""
    o = table(spark, d, "orders")
    lo = F.col("o_orderdate").cast("timestamp").cast("long")
    return o.select(F.col("o_orderkey").cast("string").alias("window_id"), lo.alias("rlo"), (lo + 129_600).alias("rhi"))


def line_tasks(spark, d):
    lines = table(spark, d, "lineitem")
    lo = F.col("l_shipdate").cast("timestamp").cast("long")
    return lines.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("task_id"), F.when(F.col("l_orderkey") % 11 != 0, lo).alias("lo"), (lo + 3600).alias("hi"))


WINDOWS = "w AS (SELECT CAST(o_orderkey AS VARCHAR) AS window_id, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 AS rlo, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 + 129600 AS rhi FROM orders)"
LINES = "l AS (SELECT l_orderkey || '-' || l_linenumber AS task_id, CASE WHEN l_orderkey % 11 <> 0 THEN epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000000 END AS lo, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000000 + 3600 AS hi FROM lineitem)"


@query("c18_filter_by_windows", f"""WITH {WINDOWS}, {LINES}, p AS (SELECT rlo AS t, 1 AS s, 0 AS e FROM w UNION ALL SELECT rhi + 7200 + 1, 0, 1 FROM w), q AS (SELECT t, sum(sum(s)) OVER (ORDER BY t) AS s, sum(sum(e)) OVER (ORDER BY t) AS e FROM p GROUP BY t)
SELECT l.task_id, CASE WHEN lo IS NULL THEN 'no_time' WHEN coalesce(b.s, 0) - coalesce(a.e, 0) = 0 THEN 'no_overlap' ELSE 'kept' END AS reason, CASE WHEN lo IS NULL THEN 0 ELSE CAST(coalesce(b.s, 0) - coalesce(a.e, 0) AS BIGINT) END AS windows FROM l ASOF LEFT JOIN q b ON b.t <= l.hi ASOF LEFT JOIN q a ON a.t <= l.lo""")
def c18(spark, d):
    return I.filter_tasks_by_windows(line_tasks(spark, d), order_windows(spark, d), pad=3600, offset=3600).select("task_id", "reason", "windows")


@query("c19_parent_task", duck("""WITH b AS (SELECT DISTINCT 'task_' || CAST((user_id + 1) % 10 AS VARCHAR) AS task_id, process_guid AS node_id FROM pe WHERE user_id % 3 = 0), r AS (SELECT task_id, min(process_guid) AS root FROM pe GROUP BY task_id)
SELECT r.task_id, min(b.task_id) AS parent_task FROM r JOIN b ON b.node_id = r.root AND b.task_id <> r.task_id GROUP BY r.task_id"""))
def c19(spark, d):
    pe = provenance(spark, d)
    b = pe.where("user_id % 3 = 0").select(F.concat(F.lit("task_"), ((F.col("user_id") + 1) % 10).cast("string")).alias("task_id"), F.col("process_guid").alias("node_id")).distinct()
    return I.parent_task_map(pe.groupBy("task_id").agg(F.min("process_guid").alias("root")), b)


@query("c20_match_observables", "WITH t AS (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS term FROM benchmark) SELECT doc_id AS event_id, term FROM documents JOIN t ON contains(lower(text), term) WHERE term <> ''")
def c20(spark, d):
    terms = table(spark, d, "benchmark").select(F.split("text", " ")[0].alias("term"))
    return I.match_observables(table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), "text"), terms)


@query("c21_offset_sweep", f"""WITH {WINDOWS}, o AS (SELECT unnest([-86400, 0, 86400]) AS "offset"), h AS (SELECT l_orderkey AS event_id, 's' || l_suppkey AS subject, 'p' || l_partkey AS object, l_linenumber % 5 AS term, l_returnflag AS action, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000000 AS lo FROM lineitem),
 v AS (SELECT * FROM (SELECT * FROM w WHERE CAST(window_id AS BIGINT) % 20 = 0) w CROSS JOIN o), j AS (SELECT v.window_id, v."offset", h.* FROM v JOIN h ON lo BETWEEN rlo + "offset" AND rhi + "offset"),
 g AS (SELECT window_id, "offset", count(*) AS hits, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects, count(DISTINCT term) AS terms, count(DISTINCT subject) FILTER (subject LIKE '%7') AS malicious_subjects, count(DISTINCT subject) FILTER (subject LIKE '%7') + count(DISTINCT object) FILTER (object LIKE '%77') AS malicious FROM j GROUP BY ALL),
 a AS (SELECT window_id, "offset", string_agg(action || '=' || n, ',' ORDER BY n DESC, action) AS actions FROM (SELECT window_id, "offset", action, count(*) AS n FROM j GROUP BY ALL) GROUP BY ALL)
SELECT window_id, "offset", coalesce(hits, 0) AS hits, coalesce(subjects, 0) AS subjects, coalesce(objects, 0) AS objects, coalesce(terms, 0) AS terms, coalesce(malicious_subjects, 0) AS malicious_subjects, coalesce(malicious, 0) AS malicious, coalesce(actions, '') AS actions FROM v LEFT JOIN g USING (window_id, "offset") LEFT JOIN a USING (window_id, "offset")""")
def c21(spark, d):
    """The windows of orders divisible by 20 against all lines."""
    li = table(spark, d, "lineitem")
    subject, thing = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    lines = li.select(F.col("l_orderkey").alias("event_id"), subject.alias("subject"), thing.alias("object"), (F.col("l_linenumber") % 5).alias("term"), F.col("l_returnflag").alias("action"), F.col("l_shipdate").cast("timestamp").cast("long").alias("lo"))
    bad = li.select(subject.alias("node_id")).where("node_id like '%7'").union(li.select(thing.alias("node_id")).where("node_id like '%77'"))
    out = I.offset_sweep(lines, order_windows(spark, d).where("cast(window_id as bigint) % 20 = 0"), spark.createDataFrame([(-86400,), (0,), (86400,)], "offset int"), bad)
    return out.withColumn("actions", F.array_join(F.transform("actions", lambda x: F.concat_ws("=", x["action"], x["n"].cast("string"))), ","))


_HOPS = """e AS (SELECT event_id, 'subject' AS role, process_guid AS node_id, object_key AS other, event_type, us FROM pe UNION ALL SELECT event_id, 'object', object_key, process_guid, event_type, us FROM pe), gt AS (SELECT DISTINCT node_id FROM e WHERE node_id LIKE '/tmp/f1%' OR node_id IN ('p1', 'p2')),
 tk AS (SELECT DISTINCT task_id, process_guid AS node_id FROM pe), mi AS (SELECT * FROM tk WHERE task_id IN (SELECT task_id FROM tk JOIN gt USING (node_id))), ins AS (SELECT DISTINCT mi.task_id, event_id FROM e JOIN mi USING (node_id)), ht AS (SELECT ins.task_id, e.* FROM e JOIN gt USING (node_id) JOIN ins USING (event_id))"""


def onehop(spark, d):
    pe = raw_events(spark, d)
    gt = pe.where("object like '/tmp/f1%'").select(F.col("object").alias("node_id")).union(pe.where("subject in ('p1', 'p2')").select("subject"))
    tasks = provenance(spark, d).select("task_id", F.col("process_guid").alias("node_id")).distinct()
    return I.onehop_ground_truth(pe, tasks, gt)


@query("c22_onehop_ground_truth", duck(f"WITH {_HOPS} SELECT node_id, role, event_type, count(DISTINCT event_id) AS n, min(us) AS first_us, max(us) AS last_us FROM ht GROUP BY ALL"))
def c22(spark, d):
    return onehop(spark, d)[0]


@query("c22_onehop_events", duck(f"WITH {_HOPS} SELECT task_id, event_id, node_id, role, other FROM ht"))
def c22_events(spark, d):
    return onehop(spark, d)[1]


DIAGNOSED = f"""{WINDOWS}, {LINES}, t AS (SELECT DISTINCT task_id, lo, lo + 60 * (CAST(split_part(task_id, '-', 2) AS BIGINT) * 25) AS hi, CAST(split_part(task_id, '-', 1) AS BIGINT) AS o FROM l),
 h AS (SELECT task_id, list(DISTINCT window_id ORDER BY window_id) FILTER (CAST(window_id AS BIGINT) % 3 = 0) AS c, list(DISTINCT window_id ORDER BY window_id) FILTER (CAST(window_id AS BIGINT) % 3 > 0) AS a FROM t JOIN w ON lo <= rhi AND hi >= rlo GROUP BY task_id),
 dg AS (SELECT task_id, coalesce(c, []) AS window_ids, coalesce(a, []) AS attempted_ids, (hi - lo) / 60.0 AS span_min, CASE WHEN o % 40 = 0 THEN 80 ELSE 9 END AS n, o FROM t LEFT JOIN h USING (task_id))"""


def diagnosable(spark, d):
    """All lines as tasks of 25 minutes for each line number."""
    order, line = F.split("task_id", "-")[0].cast("long"), F.split("task_id", "-")[1].cast("long")
    t = line_tasks(spark, d).withColumn("hi", F.col("lo") + 60 * 25 * line).repartition("task_id").distinct()  # dealt once for all that goes by task
    return t.withColumn("n_nodes", F.when(order % 40 == 0, 80).otherwise(9)).withColumn("n_boundary", F.lit(1)).withColumn("shared", order % 7 == 0)


def diagnosed(spark, d):
    """All lines against the windows of all orders, a third of them confirmed."""
    w = order_windows(spark, d).withColumn("status", F.when(F.col("window_id").cast("long") % 3 == 0, "confirmed").otherwise("attempted_failed"))
    return I.task_window_diagnosis(diagnosable(spark, d), w)


@query("c23_task_window_diagnosis", f"""WITH {DIAGNOSED} SELECT task_id, window_ids, attempted_ids, CASE WHEN len(window_ids) > 0 THEN NULL WHEN len(attempted_ids) > 0 THEN 'gt_node_outside_confirmed_windows' WHEN o % 7 = 0 THEN 'shared_gt_node_cross_window'
 WHEN coalesce(span_min, 0) >= 120 OR (span_min >= 60 AND n >= 50) THEN 'long_lived_root_glue' WHEN span_min >= 30 AND n <= 12 THEN 'wide_subject_alias_epoch' ELSE 'unknown' END AS cause FROM dg""")
def c23(spark, d):
    return diagnosed(spark, d).select("task_id", "window_ids", "attempted_ids", "cause")


@query("c23_span_summary", f"WITH {DIAGNOSED} SELECT count(span_min) AS count, CAST(min(span_min) AS DOUBLE) AS smallest, CAST(max(span_min) AS DOUBLE) AS largest, CAST(quantile_cont(span_min, 0.5) AS DOUBLE) AS median, round(CAST(quantile_cont(span_min, 0.9) AS DOUBLE), 6) AS p90 FROM dg")
def c23_span(spark, d):
    return I.numeric_summary(I.with_span(diagnosable(spark, d)), "span_min").withColumn("p90", F.round("p90", 6))


@query("c24_alias_width", """WITH s AS (SELECT o_custkey % 50 AS alias, o_orderkey AS uuid, o_orderpriority AS path, 'f' || o_orderkey % 3 AS file FROM orders), e AS (SELECT DISTINCT l_orderkey AS uuid, epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS us, 'f' || l_linenumber % 5 AS file FROM lineitem),
 k AS (SELECT DISTINCT l_suppkey AS task_id, l_orderkey AS uuid, l_suppkey % 3 = 0 AS meets FROM lineitem), sn AS (SELECT alias, min(us) AS first_us, max(us) AS last_us FROM s JOIN e USING (uuid) GROUP BY alias), fl AS (SELECT alias, count(DISTINCT file) AS files FROM (SELECT alias, file FROM s UNION ALL SELECT alias, e.file FROM s JOIN e USING (uuid)) GROUP BY alias),
 tk AS (SELECT alias, count(DISTINCT task_id) AS tasks, count(DISTINCT task_id) FILTER (NOT meets) AS outside_tasks FROM s JOIN k USING (uuid) GROUP BY alias), x AS (SELECT alias, count(DISTINCT uuid) AS uuids, count(DISTINCT path) AS paths FROM s GROUP BY alias)
SELECT alias, uuids, paths, coalesce(files, 0) AS files, first_us, last_us, coalesce(tasks, 0) AS tasks, coalesce(outside_tasks, 0) AS outside_tasks, list_filter([CASE WHEN uuids >= 8 AND coalesce(last_us - first_us, 0) / 6e7 >= 30 THEN 'uuid_ge_8_and_span_ge_30m' END, CASE WHEN uuids >= 5 AND files >= 2 AND coalesce(last_us - first_us, 0) / 6e7 >= 20 THEN 'uuid_ge_5_file_ge_2_span_ge_20m' END,
 CASE WHEN outside_tasks >= 3 THEN 'hits_ge_3_nonoverlap_tasks' END], lambda z: z IS NOT NULL) AS reasons FROM x LEFT JOIN fl USING (alias) LEFT JOIN sn USING (alias) LEFT JOIN tk USING (alias)""")
def c24(spark, d):
    k = F.col("o_orderkey")
    subjects = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("alias"), k.alias("uuid"), F.col("o_orderpriority").alias("path"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("file"))
    li = table(spark, d, "lineitem")
    events = li.select(F.col("l_orderkey").alias("uuid"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), F.concat(F.lit("f"), (F.col("l_linenumber") % 5).cast("string")).alias("file"))
    tasks = li.select(F.col("l_suppkey").alias("task_id"), F.col("l_orderkey").alias("node_id"), (F.col("l_suppkey") % 3 == 0).alias("overlaps"))
    return I.alias_width(subjects, events, tasks)
