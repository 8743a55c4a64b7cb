"""Queries of path search, scoring, selection and timelines. The events span 30 days, so spans and gaps are days."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import settings as S
from auditloom.operators import compact as C
from auditloom.operators import paths as P
from auditloom.plans.compact_plans import COMPACT, events, labels
from auditloom.plans.fixture import duck, once
from auditloom.plans.label_plans import BEHAVIOUR, BRIDGES, PROCS, behaviours, bridges, bridges_sql
from auditloom.plans.registry import query

DAY = 86_400
SPAN, GAP = 20 * DAY, 10 * DAY


def all_labels(spark, d):
    return behaviours(spark, d).select("task_id", F.col("process_guid").alias("entity"), "label").union(labels(spark, d)[0].select("task_id", "entity", "label")).distinct()


ALL = f"{BEHAVIOUR}, al AS (SELECT task_id, process_guid AS entity, label FROM beh UNION SELECT task_id, entity, label FROM pl)"
STATES = "states AS (SELECT task_id, process_guid, parent_process_guid, min(us) AS first_us, max(us) AS last_us FROM pe GROUP BY ALL)"
EDGES = BRIDGES + f""", {STATES}, ed AS (SELECT c.task_id, c.parent_process_guid AS src, c.process_guid AS dst, 'parent' AS kind, c.first_us AS edge_us, 0.0 AS confidence FROM states c JOIN states p ON p.task_id = c.task_id AND p.process_guid = c.parent_process_guid
 UNION ALL SELECT task_id, src, dst, 'bridge', read_us, confidence FROM br)"""


def states(spark, d):
    return C.process_states(events(spark, d))


def edges(spark, d, limit=S.BRIDGES_PER_OBJECT):
    return P.process_edges(states(spark, d), bridges(spark, d, limit))


@query("i01_process_edges", duck(f"WITH {EDGES} SELECT task_id, src, dst, kind, edge_us, CAST(confidence AS DOUBLE) AS confidence FROM ed"))
def i01(spark, d):
    return edges(spark, d)


@query("i02_seed_processes", duck(f"WITH {ALL} SELECT DISTINCT task_id, entity AS process FROM al WHERE label LIKE 'B\\_%' ESCAPE '\\' OR label IN ('P_WEB_CTX', 'P_REMOTE_CTX', 'P_UNTRUSTED_CTX')"))
def i02(spark, d):
    return P.seed_processes(all_labels(spark, d))


def found(spark, d, limit=S.BRIDGES_PER_OBJECT):
    return once(spark, d, f"chains{limit or ''}", lambda: P.search_paths(edges(spark, d, limit), P.seed_processes(all_labels(spark, d)), S.PATH_DEPTH, SPAN, GAP))


def _levels() -> str:
    """The search level by level up to the default depth."""
    near = f"edge_us >= x[1] AND edge_us - x[2] <= {SPAN * 1_000_000} AND edge_us - x[1] <= {GAP * 1_000_000}"
    deep = [f"l{n} AS (SELECT task_id, list_append(chain, dst) AS chain, min((edge_us, x[2], x[3] + b, x[4] + c)) AS x FROM l{n - 1} JOIN e2 USING (task_id) WHERE src = chain[{n - 1}] AND NOT list_contains(chain, dst) AND {near} GROUP BY ALL)" for n in range(3, S.PATH_DEPTH + 1)]
    return ", ".join(["l2 AS (SELECT task_id, [process, dst] AS chain, min((edge_us, edge_us, b, c)) AS x FROM seeds JOIN e2 USING (task_id) WHERE src = process AND dst <> process GROUP BY ALL)", *deep])


SEARCH = EDGES + ALL.removeprefix(COMPACT) + f""", seeds AS (SELECT DISTINCT task_id, entity AS process FROM al WHERE label LIKE 'B\\_%' ESCAPE '\\' OR label IN ('P_WEB_CTX', 'P_REMOTE_CTX', 'P_UNTRUSTED_CTX')), e2 AS (SELECT task_id, src, dst, edge_us, max(confidence) AS c, max(CAST(kind = 'bridge' AS INT)) AS b FROM ed GROUP BY ALL),
 {_levels()}, found AS (SELECT task_id, chain, x[2] AS start_us, x[1] AS last_us, x[3] AS bridges, CAST(x[4] AS DOUBLE) AS confidence FROM ({" UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(2, S.PATH_DEPTH + 1))}))"""


@query("i03_search_paths", duck(f"WITH {SEARCH} SELECT task_id, chain, start_us, last_us, bridges, round(confidence, 6) AS confidence FROM found"))
def i03(spark, d):
    return found(spark, d).withColumn("confidence", F.round("confidence", 6))


def staged(spark, d):
    return once(spark, d, "stages", lambda: P.path_stages(found(spark, d), all_labels(spark, d)))


def _lists(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _has(labels) -> str:
    return "(" + " AND ".join(f"list_contains(labels, '{x}')" for x in labels) + ")"


#: Stages, ids, scores, support and families of the found paths in DuckDB, one name for each step.
STAGED = SEARCH + f""", stg AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in P.STAGE_OF.items())}) v(label, stage)),
 ps0 AS (SELECT f.task_id, f.chain, any_value(start_us) AS start_us, any_value(last_us) AS last_us, any_value(bridges) AS bridges, any_value(confidence) AS confidence, list(DISTINCT al.label ORDER BY al.label) AS labels, coalesce(list(DISTINCT stage) FILTER (WHERE stage IS NOT NULL), []) AS ss
 FROM (SELECT *, unnest(chain) AS process FROM found) f JOIN al ON al.task_id = f.task_id AND al.entity = process LEFT JOIN stg ON stg.label = al.label GROUP BY f.task_id, f.chain),
 ps AS (SELECT * EXCLUDE ss, list_filter({_lists(P.STAGES)}, lambda x: list_contains(ss, x)) AS stages, list_contains(ss, 'ExecutionWeak') AND NOT list_contains(ss, 'ExecutionStrong') AS weak_only, task_id || ':' || sha1(array_to_string(chain, '>')) AS path_id FROM ps0
 WHERE {" OR ".join("(" + " AND ".join(f"list_contains(ss, '{x}')" for x in g) + ")" for g in P.STAGE_SETS)}),
 tr AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY len(stages) DESC, len(chain), path_id) AS r FROM ps)"""
SCORED = STAGED + f""", pts AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in S.LABEL_SCORES.items())}) v(label, points)), tops AS (SELECT task_id, round(avg(value) / 100, 6) AS task_score, list(DISTINCT process_guid ORDER BY process_guid)[:5] AS top, list(DISTINCT concat_ws('>', parent_process_guid, process_guid) ORDER BY concat_ws('>', parent_process_guid, process_guid))[:5] AS tope, min(us) AS f, max(us) AS l FROM pe GROUP BY task_id),
 sc0 AS (SELECT t.*, coalesce((SELECT sum(points) FROM pts WHERE list_contains(t.labels, pts.label)), 0) + {" + ".join(f"CASE WHEN {' OR '.join(_has(x) for x in sets)} THEN {p} ELSE 0 END" for p, sets in P.COMBOS)}
 + CASE WHEN len(chain) >= 3 AND len(stages) >= 3 THEN 20 ELSE 0 END + 12.0 * len(stages) + 12.0 * confidence + 20.0 * task_score + list_sum(list_transform(chain, lambda x: CASE WHEN list_contains(top, x) THEN greatest(1.0, 11.0 - list_position(top, x)) ELSE 0.0 END))
 + list_sum(list_transform(range(1, len(chain)), lambda i: CASE WHEN list_contains(tope, chain[i] || '>' || chain[i + 1]) THEN greatest(1.0, 11.0 - list_position(tope, chain[i] || '>' || chain[i + 1])) ELSE 0.0 END)) + CASE WHEN start_us >= f AND last_us <= l THEN 8 ELSE -12 END - CASE WHEN weak_only THEN 15 ELSE 0 END - CASE WHEN bridges >= 4 THEN 20 ELSE 0 END AS raw FROM tr t JOIN tops USING (task_id) WHERE r <= 120),
 sco AS (SELECT * EXCLUDE (raw, r), CAST(greatest(0, raw) AS DOUBLE) AS risk_score, CASE WHEN raw >= 80 THEN 'high' WHEN raw >= 50 THEN 'medium' WHEN raw >= 30 THEN 'low' ELSE 'info' END AS risk_level FROM sc0)"""
_OUT = "event_type = 'DELETE' AND object_key LIKE '%/tmp/%'"
#: Some writes to temporary and log files count as deletions here, as the table has none.
_TYPE = "CASE WHEN event_type = 'WRITE' AND event_id % 4 = 1 AND object_class IN ('temp_file', 'log_file') THEN 'DELETE' ELSE event_type END"
SUPPORTED = SCORED + f""", lab AS (SELECT task_id, event_id, list(DISTINCT label ORDER BY label) AS labs FROM beh GROUP BY ALL), xe AS (SELECT e.* EXCLUDE (event_type), {_TYPE} AS event_type, coalesce(labs, []) AS labs FROM pe e LEFT JOIN lab USING (task_id, event_id)), lk AS (SELECT path_id, task_id, unnest(chain) AS process_guid FROM sco),
 sp AS (SELECT path_id, task_id, chain[i] AS src, chain[i + 1] AS dst FROM (SELECT path_id, task_id, chain, unnest(range(1, len(chain))) AS i FROM sco)), pb AS (SELECT path_id, br.* FROM sp JOIN br USING (task_id, src, dst)),
 su AS (SELECT path_id, x.* FROM lk JOIN xe x USING (task_id, process_guid) WHERE len(labs) > 0 UNION SELECT path_id, x.* FROM (SELECT path_id, task_id, unnest([write_event, read_event]) AS event_id FROM pb) q JOIN xe x USING (task_id, event_id)),
 se AS (SELECT path_id, list(event_id ORDER BY order_index, event_id)[:12] AS support_events, list(DISTINCT object_key ORDER BY object_key)[:12] AS support_objects FROM su GROUP BY path_id),
 re AS (SELECT path_id, list(DISTINCT src || '|' || bridge_type || '|' || object_key || '|' || dst ORDER BY src || '|' || bridge_type || '|' || object_key || '|' || dst)[:12] AS relations FROM pb GROUP BY path_id),
 sm AS (SELECT su.*, object_key LIKE '%/tmp/%' OR EXISTS (SELECT 1 FROM pb WHERE pb.path_id = su.path_id AND pb.object_key = su.object_key AND list_has_any(pb.labels, ['O_FILE_DOWNLOADED', 'O_FILE_UPLOADED', 'O_SUSPECT_WRITTEN_EXECUTABLE', 'O_FILE_TEMP'])) AS staged FROM su),
 wk AS (SELECT path_id, count(*) FILTER (process_name IN ('python3', 'bash') OR object_key LIKE '%bash%') AS n, bool_or(staged) AS g FROM sm GROUP BY path_id),
 px AS (SELECT path_id, list(event_id ORDER BY order_index)[:8] AS precursors FROM sm JOIN wk USING (path_id) WHERE n >= 2 AND g AND (process_name IN ('python3', 'bash') OR object_key LIKE '%bash%') GROUP BY path_id),
 cu AS (SELECT DISTINCT lk.path_id, e.event_id, e.order_index, 0 AS p FROM lk JOIN xe e ON e.task_id = lk.task_id AND (e.process_guid = lk.process_guid OR e.parent_process_guid = lk.process_guid) WHERE e.event_type = 'DELETE' AND lk.path_id IN (SELECT path_id FROM sm WHERE staged) AND (e.object_key LIKE '%/tmp/%' OR EXISTS (SELECT 1 FROM sm WHERE staged AND sm.path_id = lk.path_id AND sm.object_key = e.object_key))),
 fu AS (SELECT path_id, list(event_id ORDER BY p, order_index, event_id)[:8] AS followups FROM (SELECT path_id, event_id, order_index, min(p) AS p FROM (SELECT * FROM cu UNION ALL SELECT path_id, event_id, order_index, 2 FROM su WHERE list_has_any(labs, ['B_EXTERNAL_SEND', 'B_LATERAL_CONNECT', 'B_DELETE_LOG']) OR object_class IN ('external_ip', 'internal_ip') OR ({_OUT})) GROUP BY ALL) GROUP BY path_id),
 ct AS (SELECT path_id, list(DISTINCT label ORDER BY label) AS contexts FROM (SELECT path_id, task_id, unnest(list_concat(chain, coalesce(support_objects, []))) AS entity FROM sco LEFT JOIN se USING (path_id)) JOIN (SELECT task_id, entity, label FROM pl UNION ALL SELECT task_id, entity, label FROM ol) USING (task_id, entity) GROUP BY path_id),
 sup AS (SELECT sco.*, coalesce(support_events, []) AS support_events, coalesce(support_objects, []) AS support_objects, coalesce(relations, []) AS relations, coalesce(precursors, []) AS precursors, coalesce(followups, []) AS followups, coalesce(contexts, []) AS contexts,
  CASE {" ".join("WHEN " + " AND ".join("(list_contains(stages, 'ExecutionWeak') OR list_contains(stages, 'ExecutionStrong'))" if n == "Execution" else f"list_contains(stages, '{n}')" for n in need) + f" THEN '{k}'" for k, need in P.CHAIN_KINDS)} ELSE 'generic_path' END AS chain_kind
  FROM sco LEFT JOIN se USING (path_id) LEFT JOIN re USING (path_id) LEFT JOIN px USING (path_id) LEFT JOIN fu USING (path_id) LEFT JOIN ct USING (path_id)),
 fam AS (SELECT *, list_filter([CASE WHEN len(precursors) > 0 THEN 'short_lived_precursor' END, CASE WHEN t LIKE '%/tmp/%' OR list_contains(labels, 'B_EXEC_TEMP') OR list_contains(labels, 'B_EXEC_DOWNLOADED') THEN 'initial_or_drop_exec' END, CASE WHEN list_contains(labels, 'B_EXTERNAL_SEND') OR list_contains(labels, 'B_EXTERNAL_RECV') THEN 'callback_c2' END,
 CASE WHEN list_contains(labels, 'B_LATERAL_CONNECT') THEN 'scan_discovery' END, CASE WHEN list_contains(labels, 'B_DELETE_LOG') THEN 'cleanup_delete' END, CASE WHEN contains(t, 'firefox') THEN 'mail_browser_context_tail' END], lambda x: x IS NOT NULL) AS families FROM (SELECT *, array_to_string(support_objects, ' ') || ' ' || array_to_string(relations, ' ') || CASE WHEN right(path_id, 1) < '8' THEN ' firefox' ELSE '' END AS t FROM sup))"""


@query("i04_path_stages", duck(f"WITH {bridges_sql(None)}{STAGED.removeprefix(BRIDGES)} SELECT task_id, chain, stages, weak_only FROM ps"))
def i04(spark, d):
    """Paths over all bridges, however many an object has; the other queries search over its first twenty."""
    return P.path_stages(found(spark, d, None), all_labels(spark, d)).select("task_id", "chain", "stages", "weak_only")


@query("i05_trim_paths", duck(f"WITH {STAGED} SELECT task_id, path_id FROM tr WHERE r <= 120"))
def i05(spark, d):
    return P.trim_paths(staged(spark, d)).select("task_id", "path_id")


def priors(spark, d):
    e = events(spark, d)
    return e.groupBy("task_id").agg(F.round(F.avg("value") / 100, 6).alias("task_score"), F.slice(F.array_sort(F.collect_set("process_guid")), 1, 5).alias("top_processes"),
                                   F.slice(F.array_sort(F.collect_set(F.concat_ws(">", "parent_process_guid", "process_guid"))), 1, 5).alias("top_edges"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def scored(spark, d):
    return once(spark, d, "scored", lambda: P.score_paths(P.trim_paths(staged(spark, d)), priors(spark, d)))


@query("i06_score_paths", duck(f"WITH {SCORED} SELECT task_id, path_id, round(risk_score, 6) AS risk_score, risk_level FROM sco"))
def i06(spark, d):
    return scored(spark, d).select("task_id", "path_id", F.round("risk_score", 6).alias("risk_score"), "risk_level")


def labelled(spark, d):
    """Events with the behaviours that they show."""
    lab = behaviours(spark, d).groupBy("task_id", "event_id").agg(F.array_sort(F.collect_set("label")).alias("labels_triggered"))
    e = events(spark, d).withColumn("event_type", F.expr(_TYPE)).join(lab, ["task_id", "event_id"], "left")
    return once(spark, d, "labelled", lambda: e.withColumn("labels_triggered", F.coalesce("labels_triggered", F.array().cast("array<string>"))))


def supported(spark, d):
    p, o = labels(spark, d)
    contexts = p.select("task_id", "entity", "label").union(o.select("task_id", "entity", "label")).distinct().toDF("task_id", "holder", "context_id")
    return once(spark, d, "supported", lambda: P.path_support(scored(spark, d), labelled(spark, d), bridges(spark, d), contexts))


@query("i07_path_support", duck(f"WITH {SUPPORTED} SELECT path_id, support_events, support_objects, relations, precursors, followups, contexts, chain_kind FROM sup"))
def i07(spark, d):
    return supported(spark, d).select("path_id", "support_events", "support_objects", "relations", "precursors", "followups", "contexts", "chain_kind")


def tagged(spark, d):
    p = supported(spark, d)
    browser = F.when(F.right("path_id", F.lit(1)) < "8", " firefox").otherwise("")
    text = p.select("path_id", F.concat(F.concat_ws(" ", "support_objects", "relations"), browser).alias("text"))
    return once(spark, d, "families", lambda: P.family_tags(p, text)), text


@query("i08_family_tags", duck(f"WITH {SUPPORTED} SELECT path_id, families FROM fam"))
def i08(spark, d):
    return tagged(spark, d)[0].select("path_id", "families")


#: Markers that the families' text does not have, by the last letter of the path's id.
_MARKED = "CASE WHEN right(path_id, 1) IN ('0', '4', '8', 'c') THEN ' Attachment' WHEN right(path_id, 1) IN ('1', '5', '9', 'd') THEN ' elevate' WHEN right(path_id, 1) IN ('2', '6', 'a', 'e') THEN ' remote_targets=3' ELSE '' END"


@query("i09_truth_hints", duck(f"""WITH {SUPPORTED}, mk AS (SELECT *, lower({_MARKED}) AS m FROM fam) SELECT path_id, list_filter([CASE WHEN contains(m, 'attachment') THEN 'attachment_markers_without_exec_family' END, CASE WHEN contains(m, 'elevate') THEN 'elevate_markers_without_privilege_family' END,
 CASE WHEN contains(m, 'remote_targets=') AND list_contains(families, 'scan_discovery') AND NOT list_contains(families, 'callback_c2') THEN 'external_network_seen_without_callback_family' END, CASE WHEN list_contains(families, 'mail_browser_context_tail') AND NOT list_contains(families, 'short_lived_precursor') THEN 'mail_browser_tail_without_precursor' END], lambda x: x IS NOT NULL) AS hints FROM mk"""))
def i09(spark, d):
    p, text = tagged(spark, d)
    return P.truth_hints(p, text.withColumn("text", F.concat("text", F.expr(_MARKED)))).select("path_id", "hints")


@query("i10_rescue_precursor", duck(f"""WITH {STATES}, ev AS (SELECT task_id, process_guid, event_id FROM pe WHERE object_class = 'temp_file' AND event_type = 'EXEC' AND user_id % 4 = 0), pre AS (SELECT DISTINCT task_id, process_guid FROM ev WHERE task_id <> 'task_4' AND task_id IN (SELECT task_id FROM ev GROUP BY task_id HAVING count(*) >= 2)),
 own AS (SELECT s.* FROM states s JOIN pre USING (task_id, process_guid)),
 x AS (SELECT task_id, process_guid, first_us FROM own UNION SELECT s.task_id, s.process_guid, s.first_us FROM states s JOIN own o ON o.task_id = s.task_id AND o.parent_process_guid = s.parent_process_guid AND abs(s.first_us - o.first_us) <= 3600000000)
 SELECT task_id, list(process_guid ORDER BY first_us, process_guid) AS chain FROM x GROUP BY task_id"""))
def i10(spark, d):
    """Task 4 has a precursor path already, task 6 a path of another family."""
    pre = events(spark, d).where("object_class = 'temp_file' and event_type = 'EXEC' and user_id % 4 = 0").select("task_id", "process_guid", "event_id")
    have = spark.createDataFrame([("task_4", ["callback_c2", "short_lived_precursor"]), ("task_6", ["callback_c2"])], "task_id string, families array<string>")
    return P.rescue_precursor(pre, states(spark, d), have, 3600)


@query("i11_select_paths", duck(f"""WITH {SUPPORTED}, fl AS (SELECT task_id, path_id, risk_score, stages, unnest(families) AS fm FROM fam), fb AS (SELECT *, row_number() OVER (PARTITION BY task_id, fm ORDER BY risk_score DESC, len(stages) DESC, path_id) AS b FROM fl),
 fp AS (SELECT task_id, path_id, min(list_position({_lists(P.FAMILIES)}, fm)) AS p FROM fb WHERE b = 1 GROUP BY ALL) SELECT task_id, path_id, rank FROM (SELECT fam.task_id, fam.path_id, row_number() OVER (PARTITION BY fam.task_id ORDER BY p NULLS LAST, risk_score DESC, len(stages) DESC, fam.path_id) AS rank FROM fam LEFT JOIN fp USING (task_id, path_id)) WHERE rank <= 20"""))
def i11(spark, d):
    return P.select_paths(tagged(spark, d)[0]).select("task_id", "path_id", "rank")


RERANKED = f"""{SUPPORTED}, es AS (SELECT path_id, (max(us) - min(us)) / 6e7 AS span, count(*) AS n FROM (SELECT path_id, task_id, unnest(support_events) AS event_id FROM sup) JOIN pe USING (task_id, event_id) GROUP BY path_id),
 hd AS (SELECT path_id, list(DISTINCT label) AS held FROM (SELECT path_id, task_id, unnest(list_concat(chain, support_objects)) AS entity FROM sup) JOIN al USING (task_id, entity) GROUP BY path_id),
 q0 AS (SELECT sup.*, span, coalesce(n, 0) AS n, list_filter(labels, lambda x: x LIKE 'B\\_%' ESCAPE '\\' OR x IN ('P_UNTRUSTED_CTX', 'P_WEB_CTX', 'P_REMOTE_CTX')) AS ky, coalesce(held, []) AS held, len(support_objects) AS o, len(relations) AS r FROM sup LEFT JOIN es USING (path_id) LEFT JOIN hd USING (path_id)),
 q1 AS (SELECT *, CASE WHEN len(support_events) < 2 OR n < 2 THEN 0 WHEN span <= 5 THEN 2 WHEN span <= 15 THEN 1 WHEN span <= 45 THEN 0 WHEN span <= 90 THEN -1 WHEN span <= 180 THEN -2 ELSE -3 END
  + CASE WHEN len(ky) = 0 THEN 0 WHEN ra >= 0.85 THEN 3 WHEN ra >= 0.6 THEN 1.5 WHEN ra >= 0.35 THEN 0 WHEN ra > 0 THEN -1.5 ELSE -3 END
  + CASE WHEN o = 0 AND r = 0 THEN 0 WHEN o <= 3 AND r >= 1 THEN 1 WHEN o <= 5 AND r >= greatest(1, o // 2) THEN 0.5 WHEN o >= 8 AND r <= 1 THEN -2 WHEN o >= 6 AND r <= 2 THEN -1 WHEN o > 3 * greatest(1, r) THEN -1 ELSE 0 END AS quality FROM (SELECT *, len(list_filter(ky, lambda x: list_contains(held, x))) * 1.0 / len(ky) AS ra FROM q0)),
 rr AS (SELECT *, greatest(0, risk_score + least(4, greatest(-4, quality))) AS risk FROM q1)"""


@query("i12_rerank_paths", duck(f"WITH {RERANKED} SELECT path_id, CAST(quality AS DOUBLE) AS support_quality, round(CAST(risk AS DOUBLE), 6) AS risk_score, CASE WHEN risk >= 80 THEN 'high' WHEN risk >= 50 THEN 'medium' WHEN risk >= 30 THEN 'low' ELSE 'info' END AS risk_level FROM rr"))
def i12(spark, d):
    prov = all_labels(spark, d).withColumnRenamed("entity", "holder")
    return P.rerank_paths(supported(spark, d), prov, events(spark, d)).select("path_id", "support_quality", F.round("risk_score", 6).alias("risk_score"), "risk_level")


@query("i13_path_summaries", duck(f"""WITH {SCORED}, {PROCS} SELECT p.task_id, p.n AS processes, coalesce(s.n, 0) AS suspicious, coalesce(b.n, 0) AS bridges, coalesce(f.n, 0) AS paths, round(coalesce(f.best, 0), 6) AS best_risk FROM (SELECT task_id, count(DISTINCT process_guid) AS n FROM procs GROUP BY 1) p
 LEFT JOIN (SELECT task_id, count(*) AS n FROM seeds GROUP BY 1) s USING (task_id) LEFT JOIN (SELECT task_id, count(*) AS n FROM br GROUP BY 1) b USING (task_id) LEFT JOIN (SELECT task_id, count(*) AS n, max(risk_score) AS best FROM sco GROUP BY 1) f USING (task_id)"""))
def i13(spark, d):
    return P.path_summaries(states(spark, d), all_labels(spark, d), scored(spark, d), bridges(spark, d)).withColumn("best_risk", F.round("best_risk", 6))


@query("i14_timeline", duck(f"""WITH {BRIDGES}{BEHAVIOUR.removeprefix(COMPACT)}, be AS (SELECT DISTINCT task_id, unnest([write_event, read_event]) AS event_id FROM br), trig AS (SELECT task_id, event_id, list(label ORDER BY label) AS labs FROM beh GROUP BY ALL), s AS (SELECT e.task_id || ':' || e.process_guid AS path_id, e.task_id, e.event_id, e.order_index,
 CASE WHEN be.event_id IS NOT NULL THEN 100 ELSE 0 END + CASE WHEN labs IS NULL THEN 0 ELSE 40 + 12 * len(labs) END + CASE WHEN len(list_filter(coalesce(labs, []), lambda x: x LIKE 'B%')) > 0 THEN 20 ELSE 0 END + CASE WHEN event_type <> 'READ' THEN 8 ELSE 0 END
 + CASE WHEN object_class IN ('temp_file', 'credential_file', 'history_file', 'business_file', 'persistence_file', 'external_ip') THEN 8 ELSE 0 END + CASE WHEN object_class = 'temp_file' THEN 10 ELSE 0 END + CASE WHEN object_type = 'flow' THEN 6 ELSE 0 END AS priority FROM pe e LEFT JOIN trig USING (task_id, event_id) LEFT JOIN be USING (task_id, event_id))
SELECT path_id, task_id, event_id, order_index, priority FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY priority DESC, order_index, event_id) AS r FROM s) WHERE r <= 24"""))
def i14(spark, d):
    e = events(spark, d)
    lab = behaviours(spark, d).groupBy("task_id", "event_id").agg(F.array_sort(F.collect_set("label")).alias("labels_triggered"))
    e = e.join(lab, ["task_id", "event_id"], "left").withColumn("labels_triggered", F.coalesce("labels_triggered", F.array().cast("array<string>")))
    one = e.select("task_id", F.concat("task_id", F.lit(":"), "process_guid").alias("path_id"), F.array("process_guid").alias("chain")).distinct()
    return P.timeline(one, e, bridge_events(spark, d))


def bridge_events(spark, d):
    return bridges(spark, d).select("task_id", F.explode(F.array("write_event", "read_event")).alias("event_id"))


DOSSIERS = f"""{SUPPORTED}, be AS (SELECT DISTINCT task_id, unnest([write_event, read_event]) AS event_id FROM br), fl AS (SELECT task_id, path_id, risk_score, stages, unnest(families) AS fm FROM fam), fb AS (SELECT *, row_number() OVER (PARTITION BY task_id, fm ORDER BY risk_score DESC, len(stages) DESC, path_id) AS b FROM fl),
 fp AS (SELECT task_id, path_id, min(list_position({_lists(P.FAMILIES)}, fm)) AS p FROM fb WHERE b = 1 GROUP BY ALL), sel AS (SELECT * FROM (SELECT fam.*, row_number() OVER (PARTITION BY fam.task_id ORDER BY p NULLS LAST, risk_score DESC, len(stages) DESC, fam.path_id) AS rank FROM fam LEFT JOIN fp USING (task_id, path_id)) WHERE rank <= 20),
 ti AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY priority DESC, order_index, event_id) AS r FROM (SELECT s.path_id, e.*, CASE WHEN be.event_id IS NOT NULL THEN 100 ELSE 0 END + CASE WHEN len(labs) > 0 THEN 40 + 12 * len(labs) ELSE 0 END + CASE WHEN len(list_filter(labs, lambda x: x LIKE 'B%')) > 0 THEN 20 ELSE 0 END + CASE WHEN event_type <> 'READ' THEN 8 ELSE 0 END
  + CASE WHEN object_class IN ('temp_file', 'credential_file', 'history_file', 'business_file', 'persistence_file', 'external_ip') THEN 8 ELSE 0 END + CASE WHEN object_class = 'temp_file' THEN 10 ELSE 0 END + CASE WHEN object_type = 'flow' THEN 6 ELSE 0 END AS priority
  FROM (SELECT path_id, task_id, unnest(chain) AS process_guid FROM sel) s JOIN xe e USING (task_id, process_guid) LEFT JOIN be USING (task_id, event_id))),
 tk AS (SELECT * FROM ti WHERE r <= 24), obl AS (SELECT task_id, entity AS object_key, list(label) AS ls FROM ol GROUP BY ALL),
 tx AS (SELECT tk.*, coalesce(ls, []) AS ls, object_key LIKE '/usr/%' OR object_key LIKE '/etc/%' AS sys FROM tk LEFT JOIN obl USING (task_id, object_key)),
 ty AS (SELECT *, list_has_any(ls, ['O_CREDENTIAL', 'O_HISTORY']) OR object_class IN ('credential_file', 'history_file') OR list_has_any(labs, ['B_READ_CRED', 'B_READ_HISTORY']) AS st, list_contains(ls, 'O_BUSINESS_DATA') OR object_class = 'business_file' OR list_contains(labs, 'B_READ_BUSINESS') AS we,
  list_contains(labs, 'B_DELETE_LOG') OR object_class = 'log_file' OR object_key LIKE '%/var/log/%' AS lo, object_key LIKE '%/tmp/%' OR list_has_any(ls, ['O_FILE_TEMP', 'O_FILE_DOWNLOADED']) AS sg FROM tx),
 tc AS (SELECT path_id, object_key, order_index AS o, unnest(list_filter([CASE WHEN sys THEN 'system' END, CASE WHEN st THEN 'strong' END, CASE WHEN we AND NOT st AND NOT sys THEN 'weak' END, CASE WHEN we AND NOT st AND sys THEN 'weak_system' END, CASE WHEN event_type = 'DELETE' AND lo THEN 'log_cleanup' END, CASE WHEN event_type = 'DELETE' AND NOT lo AND sg THEN 'staged_cleanup' END], lambda x: x IS NOT NULL)) AS category FROM ty),
 ob AS (SELECT path_id, category, list(object_key ORDER BY o, object_key)[:4] AS names FROM (SELECT path_id, category, object_key, min(o) AS o FROM tc GROUP BY ALL) GROUP BY ALL)"""


def selected(spark, d):
    return once(spark, d, "selected", lambda: P.select_paths(tagged(spark, d)[0]))


def path_timelines(spark, d, p):
    return P.timeline(p, labelled(spark, d), bridge_events(spark, d))


@query("i15_dossiers", duck(f"""WITH {DOSSIERS}, sv AS (SELECT path_id, list(name ORDER BY i) AS services FROM (SELECT path_id, lower(process_name) AS name, min(i) AS i FROM (SELECT path_id, task_id, chain[i] AS process_guid, i FROM (SELECT *, unnest(range(1, len(chain) + 1)) AS i FROM sel)) JOIN (SELECT DISTINCT task_id, process_guid, process_name FROM pe) USING (task_id, process_guid)
 WHERE process_name LIKE '%d' AND length(process_name) >= 4 GROUP BY ALL) GROUP BY path_id)
SELECT sel.task_id, sel.path_id, risk_level, coalesce(services, []) AS services, (SELECT list(event_id ORDER BY order_index) FROM tk WHERE tk.path_id = sel.path_id) AS events, (SELECT sum(priority)::BIGINT FROM tk WHERE tk.path_id = sel.path_id) AS priority FROM sel LEFT JOIN sv USING (path_id)"""))
def i15(spark, d):
    p = selected(spark, d)
    out = P.dossiers(p, path_timelines(spark, d, p), states(spark, d), labelled(spark, d), labels(spark, d)[1])
    total = F.aggregate(F.transform("timeline", lambda x: x["priority"].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("task_id", "path_id", F.col("path.risk_level").alias("risk_level"), "services", F.col("timeline.event_id").alias("events"), total.alias("priority"))


@query("i15_object_summaries", duck(f"WITH {DOSSIERS} SELECT * FROM ob"))
def i15_objects(spark, d):
    p = selected(spark, d)
    return P.object_summaries(path_timelines(spark, d, p), labelled(spark, d), labels(spark, d)[1])
