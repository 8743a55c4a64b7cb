"""Queries of the evaluation. Windows are days and a half after all orders; paths, the query set, are up to a week from shipping of the lines of orders divisible by 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import evaluate as K
from auditloom.plans.compact_plans import events
from auditloom.plans.fixture import duck, table
from auditloom.plans.registry import query


def windows(spark, d):
    k = F.col("o_orderkey")
    lo = F.col("o_orderdate").cast("timestamp").cast("long")
    return table(spark, d, "orders").select(k.cast("string").alias("window_id"), (F.floor(k / 50) % 4).cast("int").alias("host"), lo.alias("rlo"), (lo + 129_600).alias("rhi"), F.when(k % 150 == 0, "attempted_failed").otherwise("confirmed").alias("status"),
                                                                         F.lit("minute_window").alias("precision"), F.array(F.lit("TA0001"), F.concat(F.lit("TA000"), (F.floor(k / 50) % 5 + 1).cast("int").cast("string"))).alias("gt_tactics"), F.array(F.lit("T1105")).alias("gt_techniques"))


def paths(spark, d):
    k = F.col("l_orderkey")
    lo = F.col("l_shipdate").cast("timestamp").cast("long")
    hi = lo + F.when(k % 3 == 0, 0).otherwise(100_000 * F.col("l_linenumber"))
    return table(spark, d, "lineitem").where("l_orderkey % 20 = 0").select(F.concat_ws("-", k.cast("string"), F.col("l_linenumber").cast("string")).alias("path_id"), k.cast("string").alias("task_id"), (k / 20 % 4).cast("int").alias("host"), lo.alias("lo"), hi.alias("hi"),
                                                                          F.when(F.col("l_quantity") > 30, "high").when(F.col("l_quantity") > 15, "medium").otherwise("low").alias("risk_level"), F.col("l_quantity").cast("double").alias("risk_score"), F.when(F.col("l_linenumber") % 2 == 0, F.array((F.col("l_suppkey") % 3).cast("string"), F.lit("p"))).otherwise(F.array((F.col("l_suppkey") % 3).cast("string"))).alias("process_chain"),
                                                                          F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit("b"), F.lit(None))).otherwise(F.array().cast("array<string>")).alias("bridge_objects"),
                                                                          F.array(F.lit("TA0002"), F.concat(F.lit("TA000"), (k / 20 % 3 + 1).cast("int").cast("string"))).alias("tactics"), F.array(F.lit("T1105"), F.lit("T1059")).alias("techniques"), F.array(F.lit("TA0001")).alias("candidate_tactics"))


DATA = """w AS (SELECT CAST(o_orderkey AS VARCHAR) AS window_id, CAST(o_orderkey // 50 % 4 AS INT) AS host, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 AS rlo, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 + 129600 AS rhi, CASE WHEN o_orderkey % 150 = 0 THEN 'attempted_failed' ELSE 'confirmed' END AS status,
 ['TA0001', 'TA000' || CAST(o_orderkey // 50 % 5 + 1 AS VARCHAR)] AS gt_tactics, ['T1105'] AS gt_techniques FROM orders),
p AS (SELECT l_orderkey || '-' || l_linenumber AS path_id, CAST(l_orderkey AS VARCHAR) AS task_id, CAST(l_orderkey // 20 % 4 AS INT) AS host, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000000 AS lo, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000000 + CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 100000 * l_linenumber END AS hi,
 CASE WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 15 THEN 'medium' ELSE 'low' END AS risk_level, CAST(l_quantity AS DOUBLE) AS risk_score, ['TA0002', 'TA000' || CAST(l_orderkey // 20 % 3 + 1 AS VARCHAR)] AS tactics, CAST(l_suppkey AS VARCHAR) AS supp,
 CASE WHEN l_linenumber % 2 = 0 THEN [CAST(l_suppkey % 3 AS VARCHAR), 'p'] ELSE [CAST(l_suppkey % 3 AS VARCHAR)] END AS chain, CASE WHEN l_linenumber % 3 = 0 THEN ['b'] ELSE [] END AS bridged FROM lineitem WHERE l_orderkey % 20 = 0),
m0 AS (SELECT path_id, window_id, status, lo, hi, rlo, rhi, lo >= rlo AND hi <= rhi AS inside, greatest(least(hi, rhi) - greatest(lo, rlo), 0) AS ov FROM p JOIN w ON p.host = w.host AND lo <= rhi + 7200 AND hi >= rlo - 7200),
m1 AS (SELECT *, CASE WHEN lo = hi AND inside AND ov <= 0 THEN 1.0 ELSE ov * 1.0 END AS overlap FROM m0), m2 AS (SELECT *, overlap / greatest(1, hi - lo) AS ratio, (lo + hi) / 2.0 BETWEEN rlo AND rhi AS mid_inside, abs((lo + hi) / 2.0 - (rlo + rhi) / 2.0) AS mid_gap, overlap > 0 OR inside AS loose FROM m1),
m AS (SELECT *, ratio >= 0.8 OR inside AS strict, loose AND (ratio >= 0.5 OR mid_inside OR inside) AS prim FROM m2),
hit AS (SELECT path_id, window_id, ratio, status FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY CASE WHEN status = 'confirmed' THEN 0 ELSE 1 END, ratio DESC, mid_gap, window_id) AS r FROM m WHERE prim) WHERE r = 1),
a AS (SELECT p.path_id, coalesce(hit.status, 'off_window') AS match, window_id, coalesce(ratio, 0) AS ratio, CASE WHEN hit.status IS NULL THEN (SELECT min(window_id) FROM m WHERE m.path_id = p.path_id AND NOT loose) END AS near_window FROM p LEFT JOIN hit USING (path_id))"""


@query("k01_time_match", f"WITH {DATA} SELECT path_id, window_id, overlap, round(ratio, 6) AS ratio, mid_inside, strict, prim AS \"primary\", loose, NOT loose AS near_miss FROM m")
def k01(spark, d):
    return K.time_match(paths(spark, d), windows(spark, d), 0, 7200, places=6).drop("mid_gap")


def assigned(spark, d):
    return K.assign_windows(paths(spark, d), windows(spark, d), 0, 7200)


@query("k02_assign_windows", f"WITH {DATA} SELECT path_id, match, window_id, round(ratio, 6) AS ratio, near_window FROM a")
def k02(spark, d):
    return assigned(spark, d).withColumn("ratio", F.round("ratio", 6))


@query("k03_reattach_continuations", f"""WITH {DATA}, x AS (SELECT a.match, a.window_id, p.* FROM a JOIN p USING (path_id)),
 i AS (SELECT *, unnest(list_concat(list_transform(chain, lambda v: {{'kind': 1, 'item': v}}), list_transform(bridged, lambda v: {{'kind': 0, 'item': v}}))) AS y FROM x),
 c AS (SELECT o.path_id, n.window_id, n.path_id AS anchor, count(DISTINCT CASE WHEN o.y.kind = 1 THEN o.y.item END) AS shared, greatest(least(o.hi, n.hi) - greatest(o.lo, n.lo), 0) AS overlap, greatest(o.lo - w.rhi, 0) AS gap
 FROM i o JOIN i n ON o.host = n.host AND o.task_id = n.task_id AND o.match = 'off_window' AND n.match = 'confirmed' AND o.y = n.y JOIN w ON w.window_id = n.window_id
 WHERE list_has_all(n.tactics, o.tactics) GROUP BY o.path_id, n.window_id, n.path_id, overlap, gap)
 SELECT path_id, window_id, anchor FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY shared DESC, overlap DESC, gap, anchor) AS r FROM c WHERE overlap > 0 OR gap <= 86400) WHERE r = 1""")
def k03(spark, d):
    return K.reattach_continuations(assigned(spark, d), paths(spark, d), windows(spark, d), 86_400)


@query("k04_evaluate", f"""WITH {DATA}, r AS (SELECT a.window_id, a.ratio, p.*, row_number() OVER (PARTITION BY window_id ORDER BY risk_score DESC, ratio DESC, p.path_id) AS r FROM a JOIN p USING (path_id) WHERE match = 'confirmed'),
 g AS (SELECT window_id, count(*) AS split, bool_or(risk_level IN ('high', 'medium')) AS hit, bool_or(risk_level = 'high') AS high, list_distinct(flatten(list(tactics) FILTER (WHERE r <= 5))) AS pt FROM r GROUP BY window_id),
 x AS (SELECT w.*, coalesce(split, 0) AS split, coalesce(hit, false) AS hit, coalesce(high, false) AS high, coalesce(pt, []) AS pt, len(list_intersect(coalesce(pt, []), gt_tactics)) AS tp, len(list_distinct(gt_tactics)) AS ng FROM w LEFT JOIN g USING (window_id) WHERE status = 'confirmed')
SELECT count(*) AS windows, round(avg(CAST(hit AS INT)), 6) AS window_recall, round(avg(CAST(high AS INT)), 6) AS high_recall, round(avg(tp * 1.0 / len(gt_tactics)), 6) AS tactic_recall_macro, round(avg(CASE WHEN split > 0 THEN tp * 1.0 / greatest(len(pt), 1) END), 6) AS tactic_precision_macro,
 round(sum(tp) * 1.0 / sum(len(gt_tactics)), 6) AS tactic_recall_micro, round(avg(split), 6) AS split_mean, quantile_cont(split, 0.5) AS split_median, (SELECT round(avg(CAST(risk_level = 'high' AS INT)), 6) FROM a JOIN p USING (path_id) WHERE match = 'off_window') AS off_window_high_risk_rate,
 (SELECT round(avg(CASE WHEN window_id IN (SELECT window_id FROM a WHERE match = 'attempted_failed') THEN 1 ELSE 0 END), 6) FROM w WHERE status = 'attempted_failed') AS attempt_flag_rate FROM x""")
def k04(spark, d):
    out = K.evaluate(assigned(spark, d), windows(spark, d), paths(spark, d))
    keep = ["windows", "window_recall", "high_recall", "tactic_recall_macro", "tactic_precision_macro", "tactic_recall_micro", "split_mean", "split_median", "off_window_high_risk_rate", "attempt_flag_rate"]
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c in keep])


@query("k05_set_comparison", f"WITH {DATA} SELECT path_id, list_sort(list_filter(list_distinct(tactics), lambda t: t IN ('TA0001', 'TA0002'))) AS overlap, list_sort(list_filter(['TA0001', 'TA0002'], lambda t: NOT list_contains(tactics, t))) AS missed, list_sort(list_filter(list_distinct(tactics), lambda t: t NOT IN ('TA0001', 'TA0002'))) AS extra FROM p")
def k05(spark, d):
    p = paths(spark, d).withColumn("truth", F.array(F.lit("TA0001"), F.lit("TA0002")))
    return K.set_comparison(p, "tactics", "truth").select("path_id", "overlap", "missed", "extra")


@query("k06_shift_windows", f"WITH {DATA} SELECT window_id, rlo + 5400 AS rlo, rhi + 5400 AS rhi FROM w")
def k06(spark, d):
    return K.shift_windows(windows(spark, d), 90).select("window_id", "rlo", "rhi")


@query("k07_merge_broad_techniques", f"""WITH {DATA}, b AS (SELECT host, rlo - 50000 AS rlo, rhi + 40000 AS rhi, window_id AS b, ['T' || window_id] AS t FROM w WHERE status = 'attempted_failed'), j AS (SELECT w.window_id, t, row_number() OVER (PARTITION BY w.window_id ORDER BY least(w.rhi, b.rhi) - greatest(w.rlo, b.rlo) DESC, b) AS r FROM w JOIN b ON w.host = b.host AND w.rlo <= b.rhi AND b.rlo <= w.rhi WHERE w.status = 'confirmed')
SELECT w.window_id, coalesce(t, []) AS broad_techniques FROM w LEFT JOIN j ON j.window_id = w.window_id AND r = 1 WHERE w.status = 'confirmed'""")
def k07(spark, d):
    w = windows(spark, d)
    b = w.where("status = 'attempted_failed'").withColumn("gt_techniques", F.array(F.concat(F.lit("T"), "window_id"))).withColumn("rlo", F.col("rlo") - 50_000).withColumn("rhi", F.col("rhi") + 40_000)
    return K.merge_broad_techniques(w.where("status = 'confirmed'"), b).select("window_id", "broad_techniques")


@query("k08_ground_truth_summary", f"WITH {DATA} SELECT host, count(*) AS windows, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'attempted_failed') AS attempted, list_sort(list_distinct(flatten(list(gt_tactics)))) AS tactics FROM w GROUP BY host")
def k08(spark, d):
    return K.ground_truth_summary(windows(spark, d))


@query("k09_predicted_paths", duck("SELECT process_guid AS path_id, CASE WHEN user_id % 2 = 0 THEN 5 ELSE min(us) // 1000000 END AS lo, CASE WHEN user_id % 2 = 0 THEN 9 ELSE max(us) // 1000000 END AS hi FROM pe GROUP BY process_guid, user_id"))
def k09(spark, d):
    e = events(spark, d)
    even = F.col("user_id") % 2 == 0
    p = e.select(F.col("process_guid").alias("path_id"), F.when(even, 5).cast("long").alias("lo"), F.when(even, 9).cast("long").alias("hi")).distinct()
    return K.predicted_paths(p, e.select(F.col("process_guid").alias("path_id"), "us"))


@query("k10_family_gap", duck("SELECT task_id, object_class AS family, list(event_id ORDER BY event_id)[:12] AS samples, count(*) AS events FROM pe WHERE NOT (task_id < 'task_4' AND object_class = 'temp_file') GROUP BY ALL"))
def k10(spark, d):
    e = events(spark, d).withColumn("family", F.col("object_class"))
    return K.family_gap(e, e.where("task_id < 'task_4'").select("task_id", F.array(F.lit("temp_file")).alias("families")).distinct())


@query("k11_prior_effect", duck("SELECT task_id, ['y'] AS gained, CASE WHEN task_id < 'task_5' THEN ['x'] ELSE [] END AS lost FROM (SELECT DISTINCT task_id FROM pe)"))
def k11(spark, d):
    t = events(spark, d).select("task_id").distinct()
    return K.prior_effect(t.where("task_id < 'task_5'").withColumn("tactics", F.array(F.lit("x"), F.lit("z"))), t.withColumn("tactics", F.when(F.col("task_id") < "task_5", F.array(F.lit("z"), F.lit("y"))).otherwise(F.array(F.lit("y")))))


@query("k12_miss_causes", f"""WITH {DATA}, g AS (SELECT window_id, flatten(list(tactics)) AS t FROM a JOIN p USING (path_id) WHERE match = 'confirmed' GROUP BY window_id), x AS (SELECT window_id, unnest(gt_tactics) AS tactic FROM w WHERE status = 'confirmed')
SELECT window_id, tactic, CASE WHEN t IS NULL THEN 'no_path' WHEN list_contains(t, tactic) THEN 'found' WHEN tactic = 'TA0001' THEN 'not_mapped' ELSE 'not_candidate' END AS cause FROM x LEFT JOIN g USING (window_id)""")
def k12(spark, d):
    return K.miss_causes(windows(spark, d), assigned(spark, d), paths(spark, d))


@query("k13_node_coverage", duck("""WITH ww AS (SELECT 'd' || CAST(us // 86400000000 AS VARCHAR) AS window_id, us // 86400000000 * 86400 AS rlo FROM pe GROUP BY ALL), e AS (SELECT *, us // 1000000 AS lo FROM pe WHERE user_id % 11 = 0)
SELECT window_id, count(event_id) AS events, count(DISTINCT process_guid) AS seeds, count(DISTINCT object_key) AS objects FROM ww LEFT JOIN e ON lo BETWEEN rlo AND rlo + 43200 GROUP BY window_id"""))
def k13(spark, d):
    e = events(spark, d).withColumn("lo", F.floor(F.col("us") / 1_000_000))
    day = F.floor(F.col("us") / 86_400_000_000)
    w = e.select(F.concat(F.lit("d"), day.cast("string")).alias("window_id"), (day * 86_400).alias("rlo"), (day * 86_400 + 43_200).alias("rhi")).distinct()
    return K.node_coverage(e.select("process_guid", "object_key", "lo"), e.where("user_id % 11 = 0").select(F.col("process_guid").alias("node_id")), w)
