"""Queries of the task graphs. Trees: the users of the events (three children each), and region - nation - customer - orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import graph as G
from auditloom.plans.evidence_plans import LINES, line_tasks
from auditloom.plans.fixture import duck, provenance, table
from auditloom.plans.registry import query

TREE = "tree AS (SELECT DISTINCT process_guid AS child, parent_process_guid AS parent FROM pe WHERE parent_process_guid IS NOT NULL)"


def tree(spark, d):
    return provenance(spark, d).where("parent_process_guid is not null").select(F.col("process_guid").alias("child"), F.col("parent_process_guid").alias("parent")).distinct()


def nodes(spark, d):
    return provenance(spark, d).select("task_id", F.col("process_guid").alias("node_id")).distinct()


def task_edges(spark, d):
    return provenance(spark, d).where("parent_process_guid is not null").select("task_id", F.col("parent_process_guid").alias("src"), F.col("process_guid").alias("dst")).distinct()


@query("d01_parent_edges", "SELECT o_custkey AS child, arg_max(o_orderkey % 7, o_orderkey) AS parent FROM orders WHERE o_orderkey % 7 <> o_custkey GROUP BY o_custkey")
def d01(spark, d):
    return G.parent_edges(table(spark, d, "orders").select(F.col("o_custkey").alias("child"), (F.col("o_orderkey") % 7).alias("parent"), F.col("o_orderkey").alias("ord")).withColumn("parent", F.col("parent").cast("string")).withColumn("child", F.col("child").cast("string"))).select(F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent"))


@query("d02_cut_leaf_tasks", duck(f"WITH {TREE} SELECT child, parent FROM tree WHERE child NOT IN (SELECT parent FROM tree)"))
def d02(spark, d):
    return G.cut_leaf_tasks(tree(spark, d)).select("child", "parent")


@query("d03_segment_nodes_all_children", duck(f"WITH {TREE} SELECT parent AS node FROM tree GROUP BY parent HAVING count(*) > 2 AND parent IN (SELECT child FROM tree)"))
def d03_all(spark, d):
    return G.segment_nodes(tree(spark, d), 2, count_segmented=True)


def _by_level() -> str:
    """The fixpoint, level by level from the deepest: the forest of the events has at most six levels."""
    steps = [f"WITH RECURSIVE {TREE}, depth AS (SELECT parent AS node, 0 AS lvl FROM tree WHERE parent NOT IN (SELECT child FROM tree) UNION SELECT child, lvl + 1 FROM depth JOIN tree ON tree.parent = depth.node), c8 AS (SELECT '' AS node WHERE false)"]
    for k in range(7, -1, -1):
        steps.append(f"c{k} AS (SELECT node FROM c{k + 1} UNION ALL SELECT d.node FROM depth d JOIN tree t ON t.parent = d.node WHERE d.lvl = {k} AND d.lvl > 0 AND t.child NOT IN (SELECT node FROM c{k + 1}) GROUP BY d.node HAVING count(*) > 2)")
    return ", ".join(steps)


@query("d03_segment_nodes", duck(_by_level() + " SELECT node FROM c0"))
def d03(spark, d):
    return G.segment_nodes(tree(spark, d), 2)


@query("d04_task_components", duck(f"""WITH RECURSIVE {TREE}, cut AS (SELECT parent AS node FROM tree GROUP BY parent HAVING count(*) > 2 AND parent IN (SELECT child FROM tree)),
 comp AS (SELECT node AS root, node, false AS is_boundary FROM (SELECT parent AS node FROM tree WHERE parent NOT IN (SELECT child FROM tree) UNION SELECT node FROM cut)
 UNION SELECT comp.root, t.child, t.child IN (SELECT node FROM cut) FROM comp JOIN tree t ON t.parent = comp.node WHERE NOT comp.is_boundary) SELECT * FROM comp"""))
def d04(spark, d):
    t = tree(spark, d)
    return G.task_components(t, G.segment_nodes(t, 2, count_segmented=True))


@query("d05_connected_components", """WITH RECURSIVE e AS (SELECT DISTINCT 'o' || CAST(l_orderkey AS VARCHAR) AS a, 's' || CAST(l_suppkey AS VARCHAR) AS b FROM lineitem), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM w GROUP BY a UNION SELECT w.a, min(n.component) FROM r n JOIN w ON w.b = n.node JOIN recurring.r c ON c.node = w.a WHERE n.component < c.component GROUP BY w.a) SELECT node, component FROM r""")
def d05(spark, d):
    return G.connected_components(table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")))


@query("d06_label_tasks", duck("SELECT task_id, count(DISTINCT CASE WHEN user_id % 17 = 0 THEN process_guid END) AS attacknum, CAST(count(DISTINCT CASE WHEN user_id % 17 = 0 THEN process_guid END) > 0 AS INT) AS label FROM pe GROUP BY task_id"))
def d06(spark, d):
    return G.label_tasks(nodes(spark, d), provenance(spark, d).where("user_id % 17 = 0").select(F.col("process_guid").alias("node_id")))


@query("d07_temporal_split", f"""WITH {LINES}, b AS (SELECT CAST(split_part(task_id, '-', 1) AS BIGINT) % 1500 AS task_id, task_id AS branch, min(lo) AS first, max(hi) AS last FROM l GROUP BY l.task_id),
 t AS (SELECT *, max(last) OVER (PARTITION BY task_id ORDER BY first, branch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b WHERE first IS NOT NULL),
 c AS (SELECT *, sum(CASE WHEN before IS NULL OR first - before >= 864000 THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY first, branch) - 1 AS cluster FROM t),
 k AS (SELECT task_id, max(cluster) + 1 AS k FROM c GROUP BY task_id HAVING max(last) - min(first) > 1000000 AND count(*) >= 2 AND max(cluster) >= 1)
SELECT task_id, branch, CAST(cluster AS BIGINT) AS cluster FROM c WHERE task_id IN (SELECT task_id FROM k)
UNION ALL SELECT b.task_id, branch, CAST((row_number() OVER (PARTITION BY b.task_id ORDER BY branch) - 1) % k AS BIGINT) FROM b JOIN k USING (task_id) WHERE first IS NULL""")
def d07(spark, d):
    one = line_tasks(spark, d).groupBy(F.col("task_id").alias("branch")).agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    b = one.select((F.split("branch", "-")[0].cast("long") % 1500).alias("task_id"), "branch", "first", "last")
    return G.temporal_split(b, 1_000_000, 864_000)


@query("d08_node_time_range", duck("SELECT task_id, process_guid, min(us) AS first_us, max(us) AS last_us FROM pe GROUP BY ALL"))
def d08(spark, d):
    return G.node_time_range(provenance(spark, d), "task_id", "process_guid")


@query("d09_segmentation_edges", duck(f"WITH {TREE} SELECT parent, child FROM tree WHERE child <> 'p11'"))
def d09(spark, d):
    t = tree(spark, d)
    messy = t.select(F.concat(F.lit(" "), "parent").alias("parent"), F.when(F.col("child") == "p11", " ").otherwise(F.col("child")).alias("child"))
    return G.segmentation_edges(messy.union(messy))


@query("d10_component_diagnostics", duck(f"""WITH {TREE}, comp AS (SELECT parent AS root, child AS node, child IN (SELECT parent FROM tree) AS is_boundary FROM tree)
SELECT c.root, count(*) AS n_nodes, sum(CAST(is_boundary AS INT)) AS n_boundary, max(k.n) AS root_children, count(*) > 500 AS large, count(*) > 1000 AS huge FROM comp c JOIN (SELECT parent, count(*) AS n FROM tree GROUP BY parent) k ON k.parent = c.root GROUP BY c.root"""))
def d10(spark, d):
    t = tree(spark, d)
    inner = t.select(F.col("parent").alias("child")).distinct().withColumn("b", F.lit(True))
    comp = t.join(inner, "child", "left").select(F.col("parent").alias("root"), F.col("child").alias("node"), F.coalesce("b", F.lit(False)).alias("is_boundary"))
    return G.component_diagnostics(comp, t)


@query("d11_task_size_profile", """WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT count(*) AS tasks, min(n) AS smallest, avg(n) AS mean, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95,
 quantile_cont(n, 0.99) AS p99, max(n) AS largest, sum(CAST(n > 100 AS INT)) AS over_100, sum(CAST(n > 500 AS INT)) AS over_500, sum(CAST(n > 1000 AS INT)) AS over_1000 FROM t""")
def d11(spark, d):
    return G.task_size_profile(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_nodes")))


@query("d12_graph_metrics", duck("""WITH n AS (SELECT DISTINCT task_id, process_guid AS node_id FROM pe), e AS (SELECT DISTINCT task_id, parent_process_guid AS src, process_guid AS dst FROM pe WHERE parent_process_guid IS NOT NULL),
 s AS (SELECT task_id, count(*) AS n FROM n GROUP BY task_id), m AS (SELECT task_id, count(*) AS m FROM e GROUP BY task_id)
SELECT n.task_id, n.node_id, (SELECT count(*) FROM e WHERE e.task_id = n.task_id AND e.src = n.node_id) AS out_degree, (SELECT count(*) FROM e WHERE e.task_id = n.task_id AND e.dst = n.node_id) AS in_degree,
 (SELECT count(*) FROM e WHERE e.task_id = n.task_id AND (e.src = n.node_id OR e.dst = n.node_id)) AS neighbours, coalesce(round(m.m / nullif(s.n * (s.n - 1), 0), 9), 0) AS density,
 (SELECT count(*) FROM e WHERE e.task_id = n.task_id AND e.dst = n.node_id) = 0 AS is_root, (SELECT count(*) FROM e WHERE e.task_id = n.task_id AND e.src = n.node_id) = 0 AS is_leaf FROM n JOIN s USING (task_id) LEFT JOIN m USING (task_id)"""))
def d12(spark, d):
    return G.graph_metrics(nodes(spark, d), task_edges(spark, d)).withColumn("density", F.round("density", 9))


@query("d13_check_graph_meta", duck("""SELECT task_id, CASE task_id WHEN 'task_0' THEN 'no_meta' WHEN 'task_1' THEN 'n_nodes' WHEN 'task_2' THEN 'label' WHEN 'task_3' THEN 'attacknum' WHEN 'task_4' THEN 'n_edges' ELSE 'no_graph' END AS problem
 FROM (SELECT DISTINCT task_id FROM pe WHERE task_id < 'task_5' UNION ALL SELECT 'task_x')"""))
def d13(spark, d):
    """Of ten tasks five differ in one respect each; a sixth has a meta without a label, which fits."""
    n = nodes(spark, d).groupBy("task_id").agg(F.count("*").alias("n_nodes")).withColumn("n_edges", F.lit(1)).withColumn("label", F.lit(1)).withColumn("attacknum", F.lit(0))
    at = lambda t, name, value: F.when(F.col("task_id") == t, value).otherwise(F.col(name))
    meta = n.where("task_id <> 'task_0'").withColumn("n_nodes", at("task_1", "n_nodes", 0)).withColumn("label", F.when(F.col("task_id") != "task_5", at("task_2", "label", 0))).withColumn("attacknum", at("task_3", "attacknum", 9)).withColumn("n_edges", at("task_4", "n_edges", 7))
    return G.check_graph_meta(n, meta.union(spark.range(1).select(F.lit("task_x"), F.lit(1).cast("long"), F.lit(1), F.lit(0), F.lit(0))))


@query("d14_neighbor_mean", duck("""WITH f AS (SELECT task_id, process_guid AS node_id, count(*) * 1.0 AS f0, count(DISTINCT object_key) * 1.0 AS f1 FROM pe GROUP BY ALL), e AS (SELECT DISTINCT task_id, parent_process_guid AS src, process_guid AS dst FROM pe WHERE parent_process_guid IS NOT NULL),
 m AS (SELECT e.task_id, e.dst AS node_id, avg(f.f0) AS f2, avg(f.f1) AS f3 FROM e JOIN f ON f.task_id = e.task_id AND f.node_id = e.src GROUP BY ALL)
SELECT f.task_id, CAST(max(f0) AS DOUBLE) AS f0, CAST(max(f1) AS DOUBLE) AS f1, CAST(max(coalesce(f2, 0)) AS DOUBLE) AS f2, CAST(max(coalesce(f3, 0)) AS DOUBLE) AS f3 FROM f LEFT JOIN m USING (task_id, node_id) GROUP BY f.task_id"""))
def d14(spark, d):
    f = provenance(spark, d).groupBy("task_id", F.col("process_guid").alias("node_id")).agg(F.count("*").cast("double").alias("f0"), F.count_distinct("object_key").cast("double").alias("f1"))
    return G.max_pool(G.neighbor_mean(f, task_edges(spark, d), 1, 2))
