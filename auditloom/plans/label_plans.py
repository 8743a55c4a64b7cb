"""Queries of behaviour labels, propagation, bridges and staged objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import settings as S
from auditloom.operators import compact as C
from auditloom.operators import labels as L
from auditloom.plans.compact_plans import COMPACT, compacted, events, labels
from auditloom.plans.fixture import duck, once
from auditloom.plans.registry import query

DAY = 86_400
PROCS = "procs AS (SELECT DISTINCT task_id, process_guid, parent_process_guid, process_name FROM pe)"


def processes(spark, d):
    return events(spark, d).select("task_id", "process_guid", "parent_process_guid", "process_name").distinct()


@query("h01_written_then_executed", duck("SELECT task_id, object_key FROM pe WHERE object_class <> 'system_library' GROUP BY ALL HAVING min(CASE WHEN event_type = 'WRITE' THEN order_index END) < max(CASE WHEN event_type = 'EXEC' THEN order_index END)"))
def h01(spark, d):
    return L.written_then_executed(events(spark, d))


BEHAVIOUR = f"""{COMPACT}, h AS (SELECT e.*, p.process_guid IS NOT NULL AS ctx, o.entity IS NOT NULL AS dl FROM pe e LEFT JOIN (SELECT DISTINCT task_id, entity AS process_guid FROM pl WHERE label IN ('P_WEB_CTX', 'P_REMOTE_CTX')) p USING (task_id, process_guid)
 LEFT JOIN (SELECT task_id, entity FROM ol WHERE label = 'O_FILE_DOWNLOADED') o ON o.task_id = e.task_id AND o.entity = e.object_key),
 beh AS (SELECT task_id, event_id, process_guid, label FROM (SELECT task_id, event_id, process_guid, unnest([CASE WHEN event_type = 'RECV' AND object_class = 'external_ip' THEN 'B_EXTERNAL_RECV' END, CASE WHEN event_type = 'SEND' AND object_class = 'external_ip' THEN 'B_EXTERNAL_SEND' END,
 CASE WHEN event_type = 'EXEC' AND object_class = 'temp_file' THEN 'B_EXEC_TEMP' END, CASE WHEN event_type = 'EXEC' AND dl THEN 'B_EXEC_DOWNLOADED' END, CASE WHEN process_name = 'bash' AND ctx THEN 'B_SHELL_SPAWN' END, CASE WHEN process_name = 'python3' AND ctx THEN 'B_SCRIPT_EXEC' END,
 CASE WHEN process_name = 'python3' THEN 'B_INTERPRETER_LAUNCH' END, CASE WHEN event_type = 'READ' AND object_class = 'credential_file' THEN 'B_READ_CRED' END, CASE WHEN event_type = 'READ' AND object_class = 'history_file' THEN 'B_READ_HISTORY' END,
 CASE WHEN event_type = 'READ' AND object_class = 'business_file' THEN 'B_READ_BUSINESS' END, CASE WHEN event_type = 'WRITE' AND object_class = 'persistence_file' THEN 'B_WRITE_PERSISTENCE' END, CASE WHEN process_name = 'tar' THEN 'B_ARCHIVE_DATA' END,
 CASE WHEN event_type = 'WRITE' AND object_class = 'log_file' THEN 'B_DELETE_LOG' END, CASE WHEN event_type = 'SEND' AND object_class = 'internal_ip' THEN 'B_LATERAL_CONNECT' END, CASE WHEN process_name = 'sshd' AND event_type = 'RECV' THEN 'B_REMOTE_LOGIN_SERVICE' END,
 CASE WHEN event_type = 'READ' AND object_class IN ('credential_file', 'history_file', 'business_file') THEN 'P_HIGH_VALUE_CTX' END]) AS label FROM h) WHERE label IS NOT NULL)"""


def behaviours(spark, d):
    return once(spark, d, "behaviours", lambda: L.behaviour_labels(events(spark, d), *labels(spark, d)))


@query("h02_behaviour_labels", duck(f"WITH {BEHAVIOUR} SELECT event_id, label FROM beh"))
def h02(spark, d):
    return behaviours(spark, d).select("event_id", "label")


@query("h03_mass_file_access", duck("SELECT task_id, process_guid, us - us % 86400000000 AS start_us, count(DISTINCT object_key) AS objects FROM pe WHERE event_type = 'READ' AND object_type = 'file' GROUP BY ALL HAVING count(DISTINCT object_key) >= 2"))
def h03(spark, d):
    return L.mass_file_access(events(spark, d), 2, "1 day")


@query("h04_inherit_split_labels", duck(f"""WITH {COMPACT} SELECT task_id, entity, label FROM pl UNION SELECT 'task_1', 'p2', label FROM pl WHERE task_id = 'task_2' AND entity = 'p2' UNION SELECT 'task_0', 'p2', label FROM pl WHERE task_id = 'task_2' AND entity = 'p2'"""))
def h04(spark, d):
    roots = spark.createDataFrame([("task_1", "p2"), ("task_0", "p2")], "task_id string, root string")
    up = spark.createDataFrame([("task_1", "task_2"), ("task_0", "task_1")], "task_id string, parent_task string")
    return L.inherit_split_labels(labels(spark, d)[0].select("task_id", "entity", "label"), roots, up)


PROPAGATED = f"""{COMPACT}, {PROCS}, dep AS (SELECT * FROM (VALUES ('P_NET_CTX', 2), ('P_WEB_CTX', 2), ('P_REMOTE_CTX', 4), ('P_UNTRUSTED_CTX', 3)) v(label, depth)),
 edge AS (SELECT c.task_id, c.parent_process_guid AS entity, c.process_guid AS child FROM procs c LEFT JOIN procs p ON p.task_id = c.task_id AND p.process_guid = c.parent_process_guid WHERE c.parent_process_guid IS NOT NULL AND (coalesce(p.process_name, '') NOT IN ('nginx', 'sshd') OR c.process_name IN ('bash', 'python3', 'curl', 'app'))),
 prop AS (SELECT task_id, entity, label, 0 AS lvl FROM pl UNION SELECT p.task_id, e.child, p.label, p.lvl + 1 FROM prop p JOIN edge e ON e.task_id = p.task_id AND e.entity = p.entity JOIN dep ON dep.label = p.label WHERE p.lvl < dep.depth)"""


@query("h05_propagate_labels", duck(f"WITH RECURSIVE {PROPAGATED} SELECT DISTINCT task_id, entity, label FROM prop"))
def h05(spark, d):
    return L.propagate_labels(labels(spark, d)[0], processes(spark, d))


@query("h06_child_suspicious", duck(f"WITH {BEHAVIOUR}, {PROCS}, sus AS (SELECT task_id, process_guid FROM beh WHERE label LIKE 'B\\_%' ESCAPE '\\' UNION SELECT task_id, entity FROM pl WHERE label = 'P_UNTRUSTED_CTX') SELECT DISTINCT c.task_id, c.parent_process_guid AS entity, 'A_CHILD_SUSPICIOUS' AS label FROM procs c JOIN sus USING (task_id, process_guid) JOIN procs p ON p.task_id = c.task_id AND p.process_guid = c.parent_process_guid"))
def h06(spark, d):
    own = behaviours(spark, d).select("task_id", F.col("process_guid").alias("entity"), "label").union(labels(spark, d)[0].select("task_id", "entity", "label"))
    return L.child_suspicious(own, processes(spark, d))


def bridges_sql(limit: int | None) -> str:
    """Bridges in DuckDB: the first `limit` of each object, or all."""
    rank = ", row_number() OVER (PARTITION BY w.task_id, w.object_key ORDER BY w.order_index, r.order_index) AS rn" if limit else ""
    return f"""{COMPACT}, allow AS (SELECT task_id, entity AS object_key, list(label ORDER BY label) AS labels FROM ol GROUP BY ALL HAVING bool_or(label IN ('O_FILE_TEMP', 'O_FILE_DOWNLOADED', 'O_PERSISTENCE')) AND NOT bool_or(label IN ('O_CREDENTIAL', 'O_HISTORY', 'O_BUSINESS_DATA', 'O_NET_EXTERNAL'))),
 br0 AS (SELECT w.task_id, w.object_key, w.process_guid AS src, r.process_guid AS dst, w.event_id AS write_event, r.event_id AS read_event, w.us AS write_us, r.us AS read_us, r.event_type AS read_type, a.labels{rank}
 FROM ep w JOIN ep r ON r.task_id = w.task_id AND r.object_key = w.object_key AND r.object_epoch_before = w.object_epoch_after AND r.order_index > w.order_index AND r.process_guid <> w.process_guid AND r.us - w.us BETWEEN 0 AND 86400000000 JOIN allow a ON a.task_id = w.task_id AND a.object_key = w.object_key
 WHERE w.event_type = 'WRITE' AND r.event_type IN ('READ', 'EXEC') AND w.object_class <> 'system_library'),
 br AS (SELECT *, CASE WHEN read_type = 'EXEC' THEN 'write_to_exec' WHEN list_contains(labels, 'O_PERSISTENCE') THEN 'persistence_follow_on' ELSE 'write_to_read' END AS bridge_type,
 CASE WHEN read_type = 'EXEC' AND (list_contains(labels, 'O_FILE_TEMP') OR list_contains(labels, 'O_FILE_DOWNLOADED')) THEN 0.93 WHEN list_contains(labels, 'O_PERSISTENCE') THEN 0.78 ELSE 0.55 END AS confidence FROM br0{f" WHERE rn <= {limit}" if limit else ""})"""


BRIDGES = bridges_sql(20)


def bridges(spark, d, limit=S.BRIDGES_PER_OBJECT):
    return once(spark, d, f"bridges{limit or ''}", lambda: L.bridge_edges(C.semantic_epochs(events(spark, d)), labels(spark, d)[1], DAY, limit))


@query("h07_bridge_edges", duck(f"WITH {BRIDGES} SELECT task_id, object_key, src, dst, write_event, read_event, write_us, read_us, labels, bridge_type, CAST(confidence AS DOUBLE) AS confidence FROM br"))
def h07(spark, d):
    return bridges(spark, d).select("task_id", "object_key", "src", "dst", "write_event", "read_event", "write_us", "read_us", "labels", "bridge_type", "confidence")


@query("h08_bridge_labels", duck(f"WITH {BRIDGES} SELECT DISTINCT task_id, entity, 'A_BRIDGED_BY_SUSPICIOUS_OBJECT' AS label FROM (SELECT task_id, src AS entity FROM br UNION ALL SELECT task_id, dst FROM br)"))
def h08(spark, d):
    return L.bridge_labels(bridges(spark, d))


def staged_source(spark, d):
    """Sends count as chmod here, and objects are files of two hundred sets, so that sequences occur."""
    return events(spark, d).where("event_type <> 'RECV'").withColumn("event_type", F.when(F.col("event_type") == "SEND", "CHMOD").otherwise(F.col("event_type"))).withColumn(
        "object_key", F.concat(F.when(F.col("event_id") % 7 == 0, F.lit("/tmp/s")).otherwise(F.lit("/srv/s")), (F.col("user_id") % 20).cast("string")))


STAGED = f"""e AS (SELECT task_id, event_id, order_index, us, process_name, process_guid, CASE event_type WHEN 'SEND' THEN 'CHMOD' ELSE event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN '/tmp/s' ELSE '/srv/s' END || CAST(user_id % 20 AS VARCHAR) AS object_key FROM pe WHERE event_type <> 'RECV'),
 w AS (SELECT *, last_value(CASE WHEN event_type = 'WRITE' THEN us END IGNORE NULLS) OVER (PARTITION BY task_id, object_key ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wu FROM e),
 s AS (SELECT *, last_value(CASE WHEN event_type = 'WRITE' THEN -1 WHEN event_type = 'CHMOD' AND us - wu BETWEEN 0 AND {DAY * 1_000_000} THEN us END IGNORE NULLS) OVER (PARTITION BY task_id, object_key ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cu FROM w),
 st AS (SELECT DISTINCT task_id, object_key FROM s WHERE object_key LIKE '/tmp/%' OR (event_type = 'EXEC' AND cu >= 0 AND us - cu BETWEEN 0 AND {DAY * 1_000_000}))"""


@query("h09_staged_objects", duck(f"WITH {STAGED} SELECT * FROM st"))
def h09(spark, d):
    return L.staged_objects(staged_source(spark, d), seconds=DAY)


@query("h10_staged_events", duck(f"WITH {STAGED} SELECT task_id, event_id, rank, base, process_name FROM (SELECT e.*, regexp_extract(object_key, '([^/]*)$', 1) AS base, row_number() OVER (PARTITION BY task_id ORDER BY order_index) AS rank FROM e JOIN st USING (task_id, object_key) WHERE event_type = 'EXEC') WHERE rank <= 8"))
def h10(spark, d):
    e = staged_source(spark, d)
    return L.staged_events(e, L.staged_objects(e, seconds=DAY), ["EXEC"])


@query("h11_payload_elevate_events", duck(f"WITH {STAGED} SELECT task_id, event_id, rank FROM (SELECT e.*, row_number() OVER (PARTITION BY task_id ORDER BY order_index) AS rank FROM e JOIN st USING (task_id, object_key) WHERE event_id % 5 = 0 AND object_key NOT LIKE '/tmp/%') WHERE rank <= 8"))
def h11(spark, d):
    e = staged_source(spark, d).withColumn("description", F.when(F.col("event_id") % 5 == 0, F.lit("Runs As Root")))
    return L.payload_elevate_events(e, L.staged_objects(e, seconds=DAY))


@query("h12_precursor_events", duck("""WITH m AS (SELECT *, object_key LIKE '%passwd%' AND task_id < 'task_5' AS s, process_name = 'curl' AS w FROM pe), g AS (SELECT task_id, bool_or(s) AS any_s, sum(CAST(w AS INT)) AS n, bool_or(object_class = 'temp_file') AS staged FROM m GROUP BY task_id)
SELECT task_id, event_id, rank FROM (SELECT m.*, row_number() OVER (PARTITION BY task_id ORDER BY order_index) AS rank FROM m JOIN g USING (task_id) WHERE (any_s AND (s OR w)) OR (NOT any_s AND w AND n >= 2 AND staged)) WHERE rank <= 8"""))
def h12(spark, d):
    e = events(spark, d)
    e = e.withColumn("object_key", F.when((F.col("task_id") < "task_5") | ~F.col("object_key").contains("passwd"), F.col("object_key")).otherwise("/etc/p"))
    return L.precursor_events(e, ["passwd"], ["curl"], F.col("object_class") == "temp_file")
