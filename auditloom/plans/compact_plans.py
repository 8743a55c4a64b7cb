"""Queries of ordered state and compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import compact as C
from auditloom.operators.scratch import written
from auditloom.plans.fixture import duck, once, provenance_once
from auditloom.plans.registry import query

TTL = 7 * 86_400  # the events span 30 days
MUT = "event_type = 'WRITE'"
EXT = "object_class = 'external_ip'"

#: The compaction pipeline in DuckDB, one name for each step.
COMPACT = f"""net AS (SELECT *, max(CASE WHEN event_type = 'RECV' AND {EXT} THEN us END) OVER pb AS last_recv_us, max(CASE WHEN event_type = 'SEND' AND {EXT} THEN us END) OVER pb AS last_connect_us
  FROM pe WINDOW pb AS (PARTITION BY task_id, process_guid ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ol AS (SELECT task_id, object_key AS entity, label, min(order_index) AS acquired_order FROM (
  SELECT task_id, object_key, order_index, CASE object_class WHEN 'external_ip' THEN 'O_NET_EXTERNAL' WHEN 'temp_file' THEN 'O_FILE_TEMP' WHEN 'credential_file' THEN 'O_CREDENTIAL' WHEN 'history_file' THEN 'O_HISTORY'
    WHEN 'business_file' THEN 'O_BUSINESS_DATA' WHEN 'persistence_file' THEN 'O_PERSISTENCE' END AS label FROM net
  UNION ALL SELECT task_id, object_key, order_index, 'O_FILE_DOWNLOADED' FROM net WHERE {MUT} AND ((process_name IN ('curl') AND (us - last_recv_us <= 120000000 OR us - last_connect_us <= 120000000)) OR (object_class = 'temp_file' AND us - last_recv_us <= 120000000)))
  WHERE label IS NOT NULL GROUP BY ALL),
bad AS (SELECT task_id, entity AS object_key, min(acquired_order) AS bad FROM ol WHERE label = 'O_FILE_DOWNLOADED' GROUP BY ALL),
pl AS (SELECT task_id, process_guid AS entity, label, min(order_index) AS acquired_order FROM (
  SELECT task_id, process_guid, order_index, 'P_WEB_CTX' AS label FROM pe WHERE process_name = 'nginx' UNION ALL SELECT task_id, process_guid, order_index, 'P_REMOTE_CTX' FROM pe WHERE process_name = 'sshd'
  UNION ALL SELECT task_id, process_guid, order_index, 'P_NET_CTX' FROM pe WHERE {EXT} UNION ALL SELECT pe.task_id, process_guid, order_index, 'P_UNTRUSTED_CTX' FROM pe LEFT JOIN bad USING (task_id, object_key)
  WHERE (event_type = 'RECV' AND {EXT}) OR (event_type = 'EXEC' AND bad <= order_index)) GROUP BY ALL),
ep AS (SELECT *, sum(CASE WHEN {MUT} THEN 1 ELSE 0 END) OVER ob AS object_epoch_after, sum(CASE WHEN {MUT} THEN 1 ELSE 0 END) OVER ob - CASE WHEN {MUT} THEN 1 ELSE 0 END AS object_epoch_before,
  sum(CASE WHEN event_type = 'EXEC' OR (event_type = 'RECV' AND {EXT}) THEN 1 ELSE 0 END) OVER pb AS process_epoch_after, sum(CASE WHEN event_type = 'EXEC' OR (event_type = 'RECV' AND {EXT}) THEN 1 ELSE 0 END) OVER pb - CASE WHEN event_type = 'EXEC' OR (event_type = 'RECV' AND {EXT}) THEN 1 ELSE 0 END AS process_epoch_before
  FROM pe WINDOW ob AS (PARTITION BY task_id, object_key ORDER BY order_index), pb AS (PARTITION BY task_id, process_guid ORDER BY order_index)),
sig AS (SELECT ep.*, coalesce((SELECT string_agg(label, '|' ORDER BY label) FROM pl WHERE pl.task_id = ep.task_id AND entity = process_guid AND acquired_order <= order_index), '') AS process_signature,
  coalesce((SELECT string_agg(label, '|' ORDER BY label) FROM ol WHERE ol.task_id = ep.task_id AND entity = object_key AND acquired_order <= order_index), '') AS object_signature,
  coalesce((SELECT list(DISTINCT label ORDER BY label) FROM (SELECT * FROM pl UNION ALL SELECT * FROM ol) x WHERE x.task_id = ep.task_id AND acquired_order = order_index), []) AS labels_triggered FROM ep),
fk AS (SELECT *, event_type IN ('EXEC', 'SEND', 'RECV') OR object_class IN ('temp_file', 'credential_file', 'history_file', 'business_file', 'persistence_file', 'external_ip') OR len(labels_triggered) > 0 AS is_force_kept FROM sig),
sk AS (SELECT *, coalesce(NOT is_force_kept AND lag(process_signature) OVER k = process_signature AND lag(object_signature) OVER k = object_signature AND lag(object_epoch_after) OVER k = object_epoch_before AND lag(process_epoch_after) OVER k = process_epoch_before
  AND us - lag(us) OVER k <= {TTL * 1_000_000}, false) AS skipped FROM fk WINDOW k AS (PARTITION BY task_id, process_guid, event_type, object_key, object_class ORDER BY order_index))"""


def events(spark, d):
    return provenance_once(spark, d)


def labels(spark, d):
    o = once(spark, d, "object_labels", lambda: C.object_prelabels(events(spark, d)))
    return once(spark, d, "process_labels", lambda: C.process_prelabels(events(spark, d), o)), o


def compacted(spark, d):
    return C.compacted(events(spark, d), TTL)


@query("g01_process_states", duck("SELECT task_id, process_guid, arg_min(process_name, order_index) AS process_name, min(us) AS first_us, max(us) AS last_us, min(parent_process_guid) AS parent_process_guid, count(*) AS events, list(event_id ORDER BY order_index)[:12] AS evidence FROM pe GROUP BY ALL"))
def g01(spark, d):
    return C.process_states(events(spark, d))


@query("g02_object_states", duck(f"""SELECT task_id, object_key, arg_min(object_class, order_index) AS object_class, arg_min(object_type, order_index) AS object_type, min(us) AS first_us, max(us) AS last_us, count(CASE WHEN event_type = 'READ' THEN 1 END) AS reads,
  count(CASE WHEN {MUT} THEN 1 END) AS writes, count(CASE WHEN event_type = 'EXEC' THEN 1 END) AS executions FROM pe GROUP BY ALL"""))
def g02(spark, d):
    return C.object_states(events(spark, d))


@query("g03_semantic_epochs", duck(f"WITH {COMPACT} SELECT event_id, object_epoch_before, object_epoch_after, process_epoch_before, process_epoch_after FROM ep"))
def g03(spark, d):
    return C.semantic_epochs(events(spark, d)).select("event_id", "object_epoch_before", "object_epoch_after", "process_epoch_before", "process_epoch_after")


@query("g04_recent_network", duck(f"WITH {COMPACT} SELECT event_id, last_recv_us, last_connect_us, coalesce(us - last_recv_us <= 86400000000, false) AS recent_recv, coalesce(us - last_connect_us <= 86400000000, false) AS recent_connect FROM net"))
def g04(spark, d):
    return C.recent_network(events(spark, d), 86_400).select("event_id", "last_recv_us", "last_connect_us", "recent_recv", "recent_connect")


@query("g05_object_prelabels", duck(f"WITH {COMPACT} SELECT * FROM ol"))
def g05(spark, d):
    return labels(spark, d)[1]


@query("g06_process_prelabels", duck(f"WITH {COMPACT} SELECT * FROM pl"))
def g06(spark, d):
    return labels(spark, d)[0]


FORKS = "forks AS (SELECT task_id, parent_process_guid AS parent, process_guid AS child, min(order_index) + 200 AS o FROM pe WHERE parent_process_guid IS NOT NULL GROUP BY ALL)"


def forks(spark, d):
    """Parent edges with a place 200 events after the child's first one as the fork."""
    return events(spark, d).where("parent_process_guid is not null").groupBy("task_id", F.col("parent_process_guid").alias("parent"), F.col("process_guid").alias("child")).agg((F.min("order_index") + 200).alias("order"))


@query("g07_inherit_on_fork", duck(f"""WITH RECURSIVE {COMPACT}, {FORKS}, r AS (SELECT task_id, entity, label, acquired_order FROM pl UNION SELECT r.task_id, f.child, r.label, f.o FROM r JOIN forks f ON f.task_id = r.task_id AND f.parent = r.entity AND r.acquired_order < f.o)
SELECT task_id, entity, label, min(acquired_order) AS acquired_order FROM r GROUP BY ALL"""))
def g07(spark, d):
    return C.inherit_on_fork(labels(spark, d)[0], forks(spark, d))


@query("g08_label_signatures", duck(f"WITH {COMPACT} SELECT event_id, process_signature, object_signature FROM sig"))
def g08(spark, d):
    return C.label_signatures(events(spark, d), *labels(spark, d)).select("event_id", "process_signature", "object_signature")


@query("g09_force_keep", duck(f"WITH {COMPACT} SELECT event_id, labels_triggered, is_force_kept FROM fk"))
def g09(spark, d):
    return C.force_keep(C.triggered(events(spark, d), *labels(spark, d))).select("event_id", "labels_triggered", "is_force_kept")


@query("g10_semantic_skip", duck(f"WITH {COMPACT} SELECT event_id, skipped FROM sk"))
def g10(spark, d):
    return compacted(spark, d).select("event_id", "skipped")


@query("g11_access_records", duck(f"WITH {COMPACT} SELECT event_id, process_signature AS process_signature_before, object_signature AS object_signature_after, object_epoch_before, object_epoch_after FROM sk"))
def g11(spark, d):
    return C.access_records(compacted(spark, d)).select("event_id", "process_signature_before", "object_signature_after", "object_epoch_before", "object_epoch_after")


@query("g12_object_versions", duck(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY task_id, object_key ORDER BY order_index) AS rn FROM pe), v AS (SELECT *, 1 + sum(CASE WHEN {MUT} AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY task_id, object_key ORDER BY order_index) AS version FROM n)
SELECT task_id, object_key, version, min(us) AS first_us, max(us) AS last_us, coalesce(list(DISTINCT process_guid ORDER BY process_guid) FILTER (WHERE {MUT}), []) AS writers, coalesce(list(DISTINCT process_guid ORDER BY process_guid) FILTER (WHERE event_type = 'READ'), []) AS readers,
 coalesce(list(DISTINCT process_guid ORDER BY process_guid) FILTER (WHERE event_type = 'EXEC'), []) AS executors FROM v GROUP BY ALL"""))
def g12(spark, d):
    return C.object_versions(events(spark, d))


def provenance_rows(spark, d):
    p, o = labels(spark, d)
    got = p.join(forks(spark, d).withColumnRenamed("parent", "entity"), ["task_id", "entity"]).where("acquired_order < order").select("task_id", F.col("entity").alias("parent"), "child", "label", "order")
    return C.label_provenance(p, o, got)


PROV = f"""{COMPACT}, {FORKS}, rows0 AS (SELECT task_id, entity AS holder, 'process' AS holder_type, label, 'event' AS source, acquired_order AS order_index, CAST(NULL AS VARCHAR) AS from_holder FROM pl UNION ALL SELECT task_id, entity, 'object', label, 'event', acquired_order, NULL FROM ol
 UNION ALL SELECT pl.task_id, f.child, 'process', pl.label, 'fork', f.o, f.parent FROM pl JOIN forks f ON f.task_id = pl.task_id AND f.parent = pl.entity AND pl.acquired_order < f.o),
 prov AS (SELECT *, task_id || ':L' || lpad(CAST(row_number() OVER (PARTITION BY task_id ORDER BY order_index, holder_type, holder, label, source) AS VARCHAR), 6, '0') AS label_id FROM rows0),
 links AS (SELECT a.label_id, b.label_id AS prev FROM prov a JOIN prov b ON b.task_id = a.task_id AND b.holder = a.from_holder AND b.label = a.label AND b.order_index < a.order_index)"""


@query("g13_label_provenance", duck(f"WITH {PROV} SELECT p.label_id, holder, holder_type, label, source, order_index, coalesce(list(prev ORDER BY prev) FILTER (WHERE prev IS NOT NULL), []) AS prev_label_ids FROM prov p LEFT JOIN links l ON l.label_id = p.label_id GROUP BY ALL"))
def g13(spark, d):
    return provenance_rows(spark, d).select("label_id", "holder", "holder_type", "label", "source", "order_index", "prev_label_ids")


@query("g14_trace_back", duck(f"WITH RECURSIVE {PROV}, r AS (SELECT label_id AS wanted, label_id, 0 AS depth FROM prov WHERE source = 'fork' AND label = 'P_NET_CTX' UNION SELECT r.wanted, l.prev, r.depth + 1 FROM r JOIN links l ON l.label_id = r.label_id) SELECT wanted, label_id, max(depth) AS depth FROM r GROUP BY ALL"))
def g14(spark, d):
    p = written(provenance_rows(spark, d), "provenance")
    return C.trace_back(p, p.where("source = 'fork' and label = 'P_NET_CTX'"))


def retained(spark, d):
    return compacted(spark, d).where("not skipped")


def episode_rows(spark, d):
    return C.episodes(retained(spark, d), minutes=60)


EPISODES = f"""{COMPACT}, epi AS (SELECT task_id, us - us % 3600000000 AS bucket_us, process_guid, event_type, object_type, object_class, object_key, process_signature, object_signature, object_epoch_after, process_epoch_after, count(*) AS n, max(us) AS last_us,
 list(event_id ORDER BY order_index)[:5] AS representatives, bool_or(is_force_kept) AS is_force_kept FROM sk WHERE NOT skipped GROUP BY ALL)"""


@query("g15_episodes", duck(f"WITH {EPISODES} SELECT task_id, bucket_us AS first_us, process_guid, event_type, object_key, object_epoch_after, n, last_us, representatives, is_force_kept FROM epi"))
def g15(spark, d):
    return episode_rows(spark, d).select("task_id", "first_us", "process_guid", "event_type", "object_key", "object_epoch_after", "n", "last_us", "representatives", "is_force_kept")


@query("g16_important_objects", duck(f"WITH {COMPACT} SELECT task_id, process_guid, list(DISTINCT object_key ORDER BY object_key) AS objects FROM fk WHERE len(labels_triggered) > 0 OR object_class IN ('credential_file', 'history_file', 'business_file', 'persistence_file') GROUP BY ALL"))
def g16(spark, d):
    return C.important_objects(C.triggered(events(spark, d), *labels(spark, d)))


@query("g17_compaction_summary", duck(f"WITH {EPISODES}, a AS (SELECT task_id, count(*) AS raw, sum(CAST(NOT skipped AS INT)) AS retained FROM sk GROUP BY task_id), b AS (SELECT task_id, count(*) AS episodes FROM epi GROUP BY task_id) SELECT task_id, sum(raw) AS raw, sum(retained) AS retained, sum(episodes) AS episodes FROM a JOIN b USING (task_id) GROUP BY ROLLUP (task_id)"))
def g17(spark, d):
    return C.compaction_summary(compacted(spark, d), episode_rows(spark, d))
