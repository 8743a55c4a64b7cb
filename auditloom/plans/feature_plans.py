"""Queries of features, detection and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.operators import detect as D
from auditloom.operators import features as E
from auditloom.plans.evidence_plans import raw_events
from auditloom.plans.fixture import duck, provenance, table
from auditloom.plans.graph_plans import nodes, task_edges
from auditloom.plans.registry import query

KINDS = ["READ", "WRITE", "EXEC", "SEND"]
ACTIONS = ["READ", "WRITE", "EXEC", "SEND", "RECV"]
DIMS = [f"f{i}" for i in range(4)]
TYPE_ID = "list_position(['READ','WRITE','EXEC','SEND'], event_type)"


def rounded(df, n=6):
    return df.withColumns({c: F.round(c, n) for c, t in df.dtypes if t in ("double", "float")})


def counts(spark, d):
    return E.event_counts(raw_events(spark, d), KINDS)


TASKS = "t AS (SELECT 't' || o_orderkey AS task_id, CAST(o_orderkey % 9 = 0 AS INT) AS label, CAST(o_totalprice > 250000 AS INT) AS predicted_label, round(o_totalprice, -3) AS score, CASE WHEN o_orderkey % 10 <> 0 THEN epoch_us(CAST(o_orderdate AS TIMESTAMP)) END AS first, o_orderkey FROM orders)"


@query("e01_event_counts", duck(f"SELECT CAST({TYPE_ID} AS INT) AS type_id, process_guid AS subject, object_key AS object, count(*) AS n FROM pe WHERE event_type <> 'RECV' GROUP BY ALL"))
def e01(spark, d):
    return counts(spark, d)


@query("e02_collapse_repeated_flows", duck("""WITH f AS (SELECT event_id, lag(object_class) OVER (PARTITION BY task_id ORDER BY order_index) AS before, object_class FROM pe WHERE object_type = 'flow')
SELECT event_id FROM pe WHERE object_type <> 'flow' UNION ALL SELECT event_id FROM f WHERE before IS NULL OR before <> object_class"""))
def e02(spark, d):
    return E.collapse_repeated_flows(provenance(spark, d), "task_id", "order_index", ["object_class"]).select("event_id")


def encoded(spark, d):
    o = raw_events(spark, d).select("object", F.col("object_type").alias("kind"), F.col("object_key").alias("path"), X.flow_endpoints("object_key").alias("f")).distinct()
    return E.encode_events(counts(spark, d), o.select("object", "kind", "path", "f.*"), spark.createDataFrame([("/tmp", 5), ("/etc", 11), ("/etc/cron.d", 12)], "prefix string, code int"), spark.createDataFrame([("csv", 3), ("so", 4)], "ext string, code int"))


ENCODED = f"""enc AS (SELECT process_guid AS subject, object_key AS object, {TYPE_ID} AS type_id, count(*) AS n, CASE object_type WHEN 'file' THEN 2 ELSE 3 END AS kind_code,
 CASE WHEN object_key LIKE '/tmp%' THEN 6 WHEN object_key LIKE '/etc/cron.d%' THEN 13 WHEN object_key LIKE '/etc%' THEN 12 WHEN object_type = 'file' THEN 90 WHEN object_key LIKE '%.5:443' OR object_key LIKE '%.5:22' THEN CASE WHEN object_key LIKE '%8.8.8.%' THEN 3 ELSE 3 END ELSE 4 END AS location,
 CASE WHEN object_key LIKE '%.csv' THEN 4 WHEN object_key LIKE '%.so' THEN 5 WHEN object_type = 'flow' THEN 1 ELSE 0 END AS source, 0 AS target FROM pe WHERE event_type <> 'RECV' GROUP BY ALL)"""


@query("e03_encode_events", duck(f"WITH {ENCODED} SELECT * FROM enc"))
def e03(spark, d):
    return encoded(spark, d)


@query("e04_sequence_features", duck(f"""WITH {ENCODED}, p AS (SELECT DISTINCT process_guid AS subject FROM pe UNION SELECT 'none') SELECT p.subject, round(coalesce(sum(location * n) * 1.0 / sum(n), 0), 6) AS location_mean, coalesce(max(location), 0) * 1.0 AS location_max,
 round(coalesce(stddev_pop(location), 0), 6) AS location_std, count(DISTINCT location) AS location_distinct, round(CASE WHEN count(n) = 0 THEN 0 ELSE ln(1 + count(n)) END, 6) AS log_rows FROM p LEFT JOIN enc ON enc.subject = p.subject GROUP BY p.subject"""))
def e04(spark, d):
    p = raw_events(spark, d).select("subject").union(spark.range(1).select(F.lit("none")))
    return rounded(E.sequence_features(encoded(spark, d), p)).select("subject", "location_mean", "location_max", "location_std", "location_distinct", "log_rows")


def stats(spark, d):
    pe = raw_events(spark, d)
    p = pe.select(F.col("subject").alias("process")).union(spark.range(1).select(F.lit("none"))).distinct()
    return E.process_stats(pe.select("subject", F.col("parent_process_guid").alias("object"), "event_type", "us"), p, ACTIONS, 3600.0)


STATS = """ends AS (SELECT process_guid AS process, 'out' AS dir, event_type, us FROM pe UNION ALL SELECT parent_process_guid, 'in', event_type, us FROM pe WHERE parent_process_guid IS NOT NULL),
 g AS (SELECT *, (us - lag(us) OVER (PARTITION BY process ORDER BY us)) / 1e6 AS gap FROM ends)"""


@query("e05_process_stats", duck(f"""WITH {STATS} SELECT process, count(CASE WHEN dir = 'out' AND event_type = 'READ' THEN 1 END) AS out_read, count(CASE WHEN dir = 'in' AND event_type = 'RECV' THEN 1 END) AS in_recv, round(coalesce(avg(CASE WHEN gap >= 3600 THEN gap END), 0), 6) AS idle_avg,
 coalesce(max(CASE WHEN gap >= 3600 THEN gap END), 0) AS idle_max, coalesce(min(CASE WHEN gap >= 3600 THEN gap END), 0) AS idle_min, round(coalesce(sum(CASE WHEN gap < 3600 THEN gap END), 0), 6) AS active, (max(us) - min(us)) / 1e6 AS lifespan FROM g GROUP BY process UNION ALL SELECT 'none', 0, 0, 0, 0, 0, 0, 0"""))
def e05(spark, d):
    return rounded(stats(spark, d)).select("process", F.col("out_READ").alias("out_read"), F.col("in_RECV").alias("in_recv"), "idle_avg", "idle_max", "idle_min", "active", "lifespan")


@query("e06_process_stats_from_counts", duck("""WITH c AS (SELECT process_guid AS p, 'out' AS dir, event_type FROM pe WHERE event_type <> 'RECV' UNION ALL SELECT object_key, 'in', event_type FROM pe WHERE event_type <> 'RECV')
SELECT p AS process, count(CASE WHEN dir = 'out' AND event_type = 'WRITE' THEN 1 END) AS out_write, count(CASE WHEN dir = 'in' AND event_type = 'EXEC' THEN 1 END) AS in_exec FROM c GROUP BY p"""))
def e06(spark, d):
    return E.process_stats_from_counts(counts(spark, d), KINDS).select("process", F.col("out_WRITE").alias("out_write"), F.col("in_EXEC").alias("in_exec"))


def node_features(spark, d):
    """Four features of each process."""
    pe = provenance(spark, d)
    c = F.col
    return pe.groupBy(c("process_guid").alias("node_id")).agg(F.count("*").cast("double").alias("f0"), F.count(F.when(c("event_type") == "READ", 1)).cast("double").alias("f1"), F.count(F.when(c("object_class") == "temp_file", 1)).cast("double").alias("f2"), F.count_distinct("object_key").cast("double").alias("f3"))


NODES = """nf AS (SELECT process_guid AS node_id, CAST(count(*) AS DOUBLE) AS f0, CAST(count(CASE WHEN event_type = 'READ' THEN 1 END) AS DOUBLE) AS f1, CAST(count(CASE WHEN object_class = 'temp_file' THEN 1 END) AS DOUBLE) AS f2,
 CAST(count(DISTINCT object_key) AS DOUBLE) AS f3 FROM pe GROUP BY process_guid), tn AS (SELECT DISTINCT task_id, process_guid AS node_id FROM pe)"""


@query("e07_normalize", duck(f"""WITH {NODES}, m AS (SELECT min(f3) AS lo, max(f3) AS hi FROM nf) SELECT node_id, round(f0 / sqrt(f0 * f0 + f1 * f1 + f2 * f2), 6) AS f0, round(f1 / sqrt(f0 * f0 + f1 * f1 + f2 * f2), 6) AS f1,
 round(f2 / sqrt(f0 * f0 + f1 * f1 + f2 * f2), 6) AS f2, round((f3 - lo) / (hi - lo), 6) AS f3 FROM nf, m"""))
def e07(spark, d):
    return rounded(E.min_max_columns(E.l2_normalize_rows(node_features(spark, d), DIMS[:3]), ["f3"]))


@query("e08_compose_features", duck("SELECT coalesce(a.id, b.id) AS id, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT process_guid AS id, count(*) AS x FROM pe WHERE user_id % 3 = 0 GROUP BY 1) a FULL JOIN (SELECT process_guid AS id, count(*) AS y FROM pe WHERE user_id % 2 = 0 GROUP BY 1) b ON a.id = b.id"))
def e08(spark, d):
    pe = provenance(spark, d).withColumn("id", F.col("process_guid"))
    return E.compose_features(pe.where("user_id % 3 = 0").groupBy("id").agg(F.count("*").alias("x")), pe.where("user_id % 2 = 0").groupBy("id").agg(F.count("*").alias("y")), "id")


def matrix(spark, d):
    return E.task_feature_matrix(nodes(spark, d), node_features(spark, d), DIMS)


@query("e09_task_feature_matrix", duck(f"""WITH {NODES} SELECT task_id, round(avg(f0), 6) AS f0_mean, max(f0) AS f0_max, round(stddev_pop(f0), 6) AS f0_std, round(avg(f2), 6) AS f2_mean, round(ln(1 + count(*)), 6) AS log_nodes, 1.0 AS active_ratio,
 round(avg((CAST(f0 <> 0 AS INT) + CAST(f1 <> 0 AS INT) + CAST(f2 <> 0 AS INT) + CAST(f3 <> 0 AS INT)) / 4.0), 6) AS nonzero_ratio FROM tn JOIN nf USING (node_id) GROUP BY task_id"""))
def e09(spark, d):
    return rounded(matrix(spark, d)).select("task_id", "f0_mean", "f0_max", "f0_std", "f2_mean", "log_nodes", "active_ratio", "nonzero_ratio")


@query("e10_normal_graph_feature", duck(f"""WITH {NODES}, e AS (SELECT task_id, count(DISTINCT process_guid) AS m FROM pe WHERE parent_process_guid IS NOT NULL GROUP BY task_id), r AS (SELECT task_id, min(node_id) AS root FROM tn GROUP BY task_id)
SELECT r.task_id, any_value(x.f0) AS root_f0, round(avg(nf.f0), 6) AS f0_mean, max(nf.f1) AS f1_max, round(ln(1 + count(*)), 6) AS log_nodes, round(ln(1 + coalesce(any_value(m), 0)), 6) AS log_edges, CAST(r.task_id < 'task_5' AS INT) AS has_root
FROM r JOIN tn USING (task_id) JOIN nf ON nf.node_id = tn.node_id JOIN nf x ON x.node_id = root LEFT JOIN e ON e.task_id = r.task_id GROUP BY r.task_id"""))
def e10(spark, d):
    roots = nodes(spark, d).where("task_id < 'task_5'").groupBy("task_id").agg(F.min("node_id").alias("node_id"))
    out = E.normal_graph_feature(nodes(spark, d), node_features(spark, d), task_edges(spark, d), roots, DIMS)
    return rounded(out).select("task_id", "root_f0", "f0_mean", "f1_max", "log_nodes", "log_edges", "has_root")


@query("e11_benign_prototypes", duck(f"WITH {NODES}, v AS (SELECT tn.task_id, tn.node_id, round(f2, 12) AS f2, round(f1, 12) AS f1 FROM tn JOIN nf USING (node_id)), u AS (SELECT f1, f2, min((task_id, node_id)) AS k, f1 + f2 = 0 AS zero FROM v GROUP BY f1, f2) SELECT k[1] AS task_id, k[2] AS node_id, f1, f2 FROM u ORDER BY zero, k LIMIT 10"))
def e11(spark, d):
    v = nodes(spark, d).join(node_features(spark, d), "node_id").select("task_id", "node_id", "f1", "f2")
    return E.benign_prototypes(v, ["f1", "f2"])


@query("e12_oversample_positives", duck(f"WITH {TASKS}, n AS (SELECT count(*) AS n FROM t) SELECT task_id || '_aug' || lpad(CAST(c AS VARCHAR), 3, '0') AS task_id, task_id AS base_id, label, true AS fits FROM (SELECT *, unnest(range(1, (SELECT n FROM n) // 1000 + 3)) AS c FROM t WHERE label = 1)"))
def e12(spark, d):
    """Which prototype and place a copy gets is a hash's choice, so only their bounds are compared."""
    protos = nodes(spark, d)
    x = E.oversample_positives(labelled_tasks(spark, d).withColumn("n_nodes", F.lit(15)), protos, 1000, 2)
    return x.select("task_id", "base_id", "label", (F.col("prototype").between(0, protos.count() - 1) & F.col("place").between(0, 14)).alias("fits"))


@query("e13_event_action_profile", duck("SELECT process_guid, event_type, n, rank FROM (SELECT process_guid, event_type, count(*) AS n, row_number() OVER (PARTITION BY process_guid ORDER BY count(*) DESC, event_type) AS rank FROM pe GROUP BY process_guid, event_type) WHERE rank <= 3"))
def e13(spark, d):
    return E.event_action_profile(provenance(spark, d), "process_guid", 3)


@query("e14_network_support", duck("""SELECT task_id, a AS external_recv, b AS external_send, c AS internal, e AS external_targets, f AS internal_targets, 'external_recv=' || a || '; external_send=' || b || '; internal=' || c AS summary FROM (SELECT task_id, count(CASE WHEN object_class = 'external_ip' AND event_type = 'RECV' THEN 1 END) AS a,
 count(CASE WHEN object_class = 'external_ip' AND event_type = 'SEND' THEN 1 END) AS b, count(CASE WHEN object_class = 'internal_ip' THEN 1 END) AS c, count(DISTINCT CASE WHEN object_class = 'external_ip' THEN object_key END) AS e, count(DISTINCT CASE WHEN object_class = 'internal_ip' THEN object_key END) AS f FROM pe GROUP BY task_id)"""))
def e14(spark, d):
    return E.network_support(provenance(spark, d))


def labelled_tasks(spark, d):
    """Orders as scored tasks."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.concat(F.lit("t"), k.cast("string")).alias("task_id"), (k % 9 == 0).cast("int").alias("label"), (F.col("o_totalprice") > 250000).cast("int").alias("predicted_label"), F.round("o_totalprice", -3).alias("score"),
                                            F.when(k % 10 != 0, F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("first"), k)




def components() -> list:
    """All components of an embedding, as columns."""
    return [F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)]


@query("f01_task_classifier")
def f01(spark, d):
    e = table(spark, d, "embeddings")
    m = e.select("vec_id", (F.col("label") == 1).cast("int").alias("label"), *components())
    model = D.fit_task_classifier(m, [f"x{i}" for i in range(64)], rounds=5, depth=3)
    return model.transform(m).select("vec_id", "label", F.col("prediction").cast("int").alias("predicted_label"))


@query("f02_late_fusion", f"WITH {TASKS} SELECT task_id, round(0.75 * (score / 600000) + 0.25 * (o_orderkey % 100 / 100.0), 6) AS fused, CAST(0.75 * (score / 600000) + 0.25 * (o_orderkey % 100 / 100.0) >= 0.5 AS INT) AS fused_label FROM t")
def f02(spark, d):
    p, y = D.late_fusion(F.col("score") / 600000, F.col("o_orderkey") % 100 / 100.0)
    return labelled_tasks(spark, d).select("task_id", F.round(p, 6).alias("fused"), y.alias("fused_label"))


@query("f03_stratified_split", f"WITH {TASKS} SELECT label, f AS fold, (count(*) + 4 - f) // 5 AS n FROM t, (SELECT unnest([0, 1, 2, 3, 4]) AS f) GROUP BY label, f")
def f03(spark, d):
    s = D.stratified_split(labelled_tasks(spark, d), 5)
    return s.groupBy("label", "fold").agg(F.count("*").alias("n"))


#: Three requests: folds that fit, folds more than the rarer label has tasks, and tasks of one label.
_SPLITS = [("folds", "true", 5, "stratified_kfold", ""), ("many", "true", 10**9, "stratified_shuffle_split", "kfold_not_feasible_for_class_counts_or_task_count"), ("one", "label = 0", 5, "random_shuffle_fallback", "kfold_requires_stratifiable_labels")]


@query("f03_split_tasks", f"WITH {TASKS}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS request, label, count(*) AS n, '{m}' AS mode, '{w}' AS fallback_reason FROM t WHERE {ok} GROUP BY label" for n, ok, _, m, w in _SPLITS) + """),
 e AS (SELECT *, CASE WHEN request = 'folds' THEN (n + 4) // 5 ELSE round_even(n * 0.2, 0)::BIGINT END AS k FROM c) SELECT request, label, mode, fallback_reason, 'eval' AS part, k AS n FROM e UNION ALL SELECT request, label, mode, fallback_reason, 'train', n - k FROM e""")
def f03_split(spark, d):
    t = labelled_tasks(spark, d)
    parts = [D.split_tasks(t.where(ok), "stratified_kfold", 0.2, folds).groupBy("label", "mode", "fallback_reason", "part").agg(F.count("*").alias("n")).withColumn("request", F.lit(name)) for name, ok, folds, _, _ in _SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f04_temporal_benign_split", f"""WITH {TASKS}, b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY first NULLS LAST, task_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM t)
SELECT task_id, CASE WHEN label <> 0 THEN 'evaluation' WHEN r <= floor(n * 0.70) THEN 'train' WHEN r <= floor(n * 0.70) + floor(n * 0.15) THEN 'validation' ELSE 'evaluation' END AS part FROM b""")
def f04(spark, d):
    return D.temporal_benign_split(labelled_tasks(spark, d)).select("task_id", "part")


@query("f05_fit_prototypes")
def f05(spark, d):
    e = table(spark, d, "embeddings")
    return D.fit_prototypes(e.select(*components()), [f"x{i}" for i in range(64)], 8)


CENTERS = [(0, [0.1, 0.0, -0.1, 0.2]), (1, [-0.2, 0.1, 0.0, 0.0])]


def distances(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("v"))
    return D.prototype_distance(v, spark.createDataFrame(CENTERS, "center int, values array<double>"), "v").drop("v")


DISTANCES = """dist AS (SELECT vec_id, label, least(sqrt(pow(x1 - 0.1, 2) + pow(x2, 2) + pow(x3 + 0.1, 2) + pow(x4 - 0.2, 2)), sqrt(pow(x1 + 0.2, 2) + pow(x2 - 0.1, 2) + pow(x3, 2) + pow(x4, 2))) AS distance
 FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2, CAST(embedding[3] AS DOUBLE) AS x3, CAST(embedding[4] AS DOUBLE) AS x4 FROM embeddings))"""


@query("f06_prototype_distance", f"WITH {DISTANCES} SELECT vec_id, label, round(distance, 6) AS distance FROM dist")
def f06(spark, d):
    return rounded(distances(spark, d))


@query("f07_local_topk_score", f"WITH {DISTANCES} SELECT label, round(avg(distance), 6) AS local_score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance DESC) AS r FROM dist) WHERE r <= 3 GROUP BY label")
def f07(spark, d):
    return rounded(D.local_topk_score(distances(spark, d), 3, "label"))


@query("f08_robust_scale", f"WITH {DISTANCES}, m AS (SELECT median(distance) AS center FROM dist) SELECT round(center, 6) AS center, round(greatest(1.4826 * median(abs(distance - center)), 1e-8), 6) AS scale FROM dist, m GROUP BY center")
def f08(spark, d):
    return rounded(D.robust_scale(distances(spark, d), "distance"))


@query("f09_combine_scores", f"WITH {DISTANCES} SELECT vec_id, round(0.4 * greatest(0, (distance - 0.2) / 0.1) + 0.6 * greatest(0, (distance - 0.3) / 0.2), 6) AS score FROM dist")
def f09(spark, d):
    x = F.col("distance")
    return distances(spark, d).select("vec_id", F.round(D.combine_scores(x, F.lit(0.2), F.lit(0.1), x, F.lit(0.3), F.lit(0.2)), 6).alias("score"))


@query("f10_benign_threshold", f"WITH {TASKS} SELECT round(quantile_cont(score, 0.99), 6) AS threshold FROM t WHERE label = 0")
def f10(spark, d):
    return rounded(D.benign_threshold(labelled_tasks(spark, d).where("label = 0"), "score"))


@query("f11_detect_normal_only")
def f11(spark, d):
    pe = provenance(spark, d)
    day = F.concat("task_id", F.lit("_"), F.dayofyear("ts").cast("string"))
    n = pe.groupBy(day.alias("task_id"), "process_guid").agg(F.count("*").cast("double").alias("f0"), F.avg("value").alias("f1"))
    t = pe.groupBy(day.alias("task_id")).agg(F.max((F.col("user_id") == 77).cast("int")).alias("label"), F.min("us").alias("first"), F.count("*").cast("double").alias("g0"), F.avg("value").alias("g1"))
    return D.detect_normal_only(t, n, ["f0", "f1"], ["g0", "g1"], 8, 4).select("task_id", "label", "part", "flagged")


@query("f12_binary_metrics", f"""WITH {TASKS}, c AS (SELECT sum(CAST(label = 1 AND predicted_label = 1 AS INT)) AS tp, sum(CAST(label = 0 AND predicted_label = 1 AS INT)) AS fp, sum(CAST(label = 1 AND predicted_label = 0 AS INT)) AS fn, sum(CAST(label = 0 AND predicted_label = 0 AS INT)) AS tn FROM t),
 r AS (SELECT label, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM t), pr AS (SELECT score, sum(label) AS p, sum(sum(label)) OVER (ORDER BY score DESC) AS cp, sum(count(*)) OVER (ORDER BY score DESC) AS cn FROM t GROUP BY score)
SELECT tp, fp, fn, tn, round((tp + tn) * 1.0 / (tp + tn + fp + fn), 6) AS accuracy, round((tp * 1.0 / (tp + fp) + tn * 1.0 / (tn + fn)) / 2, 6) AS precision, round((tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp)) / 2, 6) AS recall,
 round((2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fp + fn)) / 2, 6) AS f1, round((SELECT (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) FROM r), 6) AS roc_auc,
 round((SELECT sum(p * 1.0 / (SELECT sum(label) FROM t) * cp / cn) FROM pr), 6) AS average_precision FROM c""")
def f12(spark, d):
    return rounded(D.binary_metrics(labelled_tasks(spark, d)))


@query("f13_score_summary", f"WITH {TASKS} SELECT min(score) AS smallest, max(score) AS largest, median(score) AS median FROM t")
def f13(spark, d):
    return D.score_summary(labelled_tasks(spark, d))


def node_metrics(spark, d):
    from auditloom.operators.graph import graph_metrics

    m = graph_metrics(nodes(spark, d), task_edges(spark, d)).join(node_features(spark, d).select("node_id", F.col("f0").alias("norm")), "node_id")
    return m.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


METRICS = f"""{NODES}, e AS (SELECT DISTINCT task_id, parent_process_guid AS src, process_guid AS dst FROM pe WHERE parent_process_guid IS NOT NULL), o AS (SELECT task_id, src AS node_id, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT task_id, dst AS node_id, count(*) AS n FROM e GROUP BY ALL),
 m AS (SELECT tn.task_id, tn.node_id, f0 AS norm, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree, coalesce(i.n, 0) = 0 AS is_root FROM tn JOIN nf USING (node_id) LEFT JOIN o ON o.task_id = tn.task_id AND o.node_id = tn.node_id LEFT JOIN i ON i.task_id = tn.task_id AND i.node_id = tn.node_id),
 x AS (SELECT *, min(norm) OVER w AS n0, max(norm) OVER w AS n1, min(degree) OVER w AS d0, max(degree) OVER w AS d1, min(out_degree) OVER w AS o0, max(out_degree) OVER w AS o1, min(in_degree) OVER w AS i0, max(in_degree) OVER w AS i1 FROM m WINDOW w AS (PARTITION BY task_id)),
 sc AS (SELECT task_id, node_id, 0.45 * (CASE WHEN n0 = n1 THEN 0.5 ELSE (norm - n0) / (n1 - n0) END) + 0.20 * (CASE WHEN d0 = d1 THEN 0.5 ELSE (degree - d0) * 1.0 / (d1 - d0) END) + 0.15 * (CASE WHEN o0 = o1 THEN 0.5 ELSE (out_degree - o0) * 1.0 / (o1 - o0) END)
 + 0.10 * (CASE WHEN i0 = i1 THEN 0.5 ELSE (in_degree - i0) * 1.0 / (i1 - i0) END) + 0.10 * greatest(CAST(is_root AS DOUBLE), CASE WHEN d0 = d1 THEN 0.5 ELSE (degree - d0) * 1.0 / (d1 - d0) END) AS attribution FROM x)"""


def attributed(spark, d):
    return D.node_attribution(node_metrics(spark, d)).withColumn("attribution", F.round("attribution", 6))


@query("f14_node_attribution", duck(f"WITH {METRICS} SELECT task_id, node_id, round(attribution, 6) AS attribution FROM sc"))
def f14(spark, d):
    return attributed(spark, d).select("task_id", "node_id", "attribution")


@query("f15_top_processes", duck(f"WITH {METRICS}, r AS (SELECT task_id, node_id, row_number() OVER (PARTITION BY task_id ORDER BY round(attribution, 6) DESC, node_id DESC) AS r FROM sc) SELECT task_id, list(node_id ORDER BY r) AS top FROM r WHERE r <= 12 GROUP BY task_id"))
def f15(spark, d):
    return D.top_processes(attributed(spark, d))


@query("f15_top_edges", duck(f"""WITH {METRICS}, r AS (SELECT e.task_id, src, dst, round((round(a.attribution, 6) + round(b.attribution, 6)) / 2, 7) AS score, row_number() OVER (PARTITION BY e.task_id ORDER BY (round(a.attribution, 6) + round(b.attribution, 6)) / 2 DESC, src DESC, dst DESC) AS rank
 FROM e JOIN sc a ON a.task_id = e.task_id AND a.node_id = src JOIN sc b ON b.task_id = e.task_id AND b.node_id = dst) SELECT * FROM r WHERE rank <= 12"""))
def f15e(spark, d):
    return rounded(D.top_edges(task_edges(spark, d), attributed(spark, d)), 7)


def suspicious(spark, d):
    pe = provenance(spark, d)
    return pe.groupBy("task_id").agg(F.round(F.avg("value"), 6).alias("score"), F.array_sort(F.collect_set("process_guid")).alias("process_ids"), F.max("order_index").alias("n")).withColumn("is_suspicious", F.col("task_id") < "task_4").withColumn("threshold", F.lit(None).cast("double"))


SUSPICIOUS = "su AS (SELECT task_id, round(avg(value), 6) AS score, list_sort(list(DISTINCT process_guid)) AS process_ids, task_id < 'task_4' AS is_suspicious FROM pe GROUP BY task_id)"


@query("f16_process_scores", duck(f"""WITH {METRICS}, {SUSPICIOUS}, p AS (SELECT task_id, score, unnest(process_ids) AS process FROM su), a AS (SELECT p.process, p.task_id, coalesce(round(sc.attribution, 6), p.score) AS score FROM p LEFT JOIN sc ON sc.task_id = p.task_id AND sc.node_id = p.process AND p.task_id < 'task_3')
SELECT process, task_id, score FROM (SELECT *, row_number() OVER (PARTITION BY process ORDER BY score DESC, task_id) AS r FROM a) WHERE r = 1"""))
def f16(spark, d):
    return D.process_scores(suspicious(spark, d), attributed(spark, d).where("task_id < 'task_3'"))


@query("f17_raised_alarms", duck(f"WITH {SUSPICIOUS} SELECT task_id, unnest(process_ids) AS process, score FROM su WHERE is_suspicious"))
def f17(spark, d):
    return D.raised_alarms(suspicious(spark, d))


@query("f18_task_export", f"WITH {TASKS} SELECT task_id, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN score END, 0) AS score, label, predicted_label, predicted_label = 1 AS is_suspicious FROM t")
def f18(spark, d):
    t = labelled_tasks(spark, d).withColumn("score", F.when(F.col("o_orderkey") % 4 != 0, F.col("score"))).withColumn("is_suspicious", F.lit(None).cast("boolean"))
    return D.task_export(t)


@query("f19_ground_truth_direct", duck(f"""WITH {METRICS}, y AS (SELECT *, max(norm) OVER w AS n1, max(degree) OVER w AS d1 FROM m WHERE task_id < 'task_3' WINDOW w AS (PARTITION BY task_id))
SELECT task_id, node_id, round(0.45 * norm / n1 + coalesce(0.25 * degree / nullif(d1, 0), 0) + coalesce(0.15 * degree / nullif(d1, 0), 0) + 0.15 * CAST(is_root AS DOUBLE), 6) AS attribution, 1.0 AS task_score FROM y"""))
def f19(spark, d):
    t = suspicious(spark, d).select("task_id", (F.col("task_id") < "task_3").cast("int").alias("label"))
    return rounded(D.ground_truth_direct(t, node_metrics(spark, d))).select("task_id", "node_id", "attribution", "task_score")


@query("f20_alert_threshold", duck(f"WITH {SUSPICIOUS} SELECT min(score) AS threshold FROM su WHERE is_suspicious"))
def f20(spark, d):
    return D.alert_threshold(suspicious(spark, d))
