"""Queries of claims and ATT&CK mapping. Each process of each task is a path here; documents and the benchmark stand for queries and knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.functions import settings as S
from auditloom.operators import claims as J
from auditloom.operators import labels as L
from auditloom.plans.compact_plans import events
from auditloom.plans.fixture import duck, once, table
from auditloom.plans.registry import query

#: Timelines, one text for both engines ({a} and {b} open and close an array). Event types, descriptions, labels and names are varied by ids so that every atom and every gate is met;
#: time runs faster on some paths, so that a path can be a short burst.
_EVENTS = """SELECT task_id || ':' || process_guid AS path_id, event_id, order_index, CASE WHEN user_id % 2 = 0 THEN us {div} 20000 ELSE us {div} 200 END AS us, user_id,
  CASE WHEN event_id % 33 = 9 THEN 'p' || CAST(user_id + 10 AS {text}) ELSE process_guid END AS process_guid, CASE WHEN user_id % 5 = 2 THEN 'firefox' ELSE process_name END AS process_name, object_type,
  CASE WHEN event_id % 31 = 7 THEN 'FORK' WHEN event_id % 33 = 9 THEN 'EXEC' WHEN event_id % 29 = 4 AND user_id % 7 < 3 THEN 'CHANGE_PRINCIPAL' WHEN object_type = 'file' AND event_id % 13 = 3 THEN 'CHMOD' WHEN object_type = 'file' AND event_id % 13 IN (5, 6) THEN 'DELETE'
    WHEN object_type = 'flow' AND event_id % 7 = 1 THEN 'CONNECT' ELSE event_type END AS event_type,
  CASE WHEN event_id % 31 = 7 THEN 'p' || CAST(user_id + 10 AS {text}) WHEN event_id % 33 = 9 THEN '/sbin/procstat' ELSE object_key END AS object_key,
  CASE WHEN event_id % 31 = 7 OR event_id % 33 = 9 THEN 'file' ELSE object_class END AS object_class,
  CASE WHEN event_id % 37 = 1 AND user_id % 4 = 0 THEN 'Uses MProtect' WHEN event_id % 41 = 2 AND user_id % 4 = 1 THEN 'runs sudo' WHEN event_id % 43 = 3 AND user_id % 4 = 2 THEN 'calls setuid' WHEN event_id % 47 = 4 AND user_id % 3 = 0 THEN 'opens attachment'
    WHEN event_id % 53 = 5 AND user_id % 3 = 1 THEN 'runs whoami' WHEN event_id % 23 = 6 AND user_id % 4 = 0 THEN 'starts bash' WHEN event_id % 59 = 7 AND user_id % 6 = 1 THEN 'runs command-not-found' WHEN event_id % 19 = 8 AND user_id % 3 = 0 THEN 'acts as root' ELSE 'touches ' || object_class END AS description
  FROM pe"""
_TIMELINE = f"""SELECT *, CASE WHEN label IS NULL THEN {{none}} ELSE {{a}}label{{b}} END AS labels_triggered, CASE WHEN role IS NULL THEN {{none}} ELSE {{a}}role{{b}} END AS object_labels FROM (
  SELECT *, CASE WHEN event_type = 'READ' AND object_class = 'credential_file' THEN 'B_READ_CRED' WHEN event_type = 'READ' AND object_class = 'history_file' THEN 'B_READ_HISTORY' WHEN event_type = 'READ' AND object_class = 'business_file' THEN 'B_READ_BUSINESS'
    WHEN event_type = 'EXEC' AND object_class = 'temp_file' THEN 'B_EXEC_TEMP' WHEN event_type = 'SEND' AND object_class = 'internal_ip' AND user_id % 3 = 0 THEN 'B_LATERAL_CONNECT' WHEN event_type = 'WRITE' AND object_class = 'log_file' THEN 'B_DELETE_LOG' END AS label,
    CASE WHEN object_class = 'temp_file' THEN 'O_FILE_TEMP' WHEN object_key LIKE '%7' AND user_id % 2 = 1 THEN 'O_FILE_DOWNLOADED' WHEN object_class = 'log_file' THEN 'O_LOG_ARTIFACT' END AS role FROM ({_EVENTS}) x) y"""
_BRIDGES = """SELECT path_id, object_key, {a}'O_FILE_TEMP'{b} AS object_labels, min(CASE WHEN event_type = 'WRITE' THEN event_id END) AS write_event, max(CASE WHEN event_type = 'EXEC' THEN event_id END) AS read_event FROM tl
  WHERE object_class = 'temp_file' AND user_id % 3 = 1 GROUP BY path_id, object_key HAVING min(CASE WHEN event_type = 'WRITE' THEN event_id END) < max(CASE WHEN event_type = 'EXEC' THEN event_id END)"""
_PATHS = """SELECT path_id, CASE user_id % 4 WHEN 0 THEN {a}'mail_browser_context_tail'{b} WHEN 1 THEN {a}'callback_c2', 'cleanup_delete'{b} WHEN 2 THEN {a}'mail_browser_context_tail', 'cleanup_delete'{b} ELSE {none} END AS families,
  CASE WHEN user_id % 3 = 0 THEN {a}'B_SHELL_SPAWN'{b} ELSE {none} END AS labels, CASE WHEN user_id % 5 = 2 THEN {a}'Firefox'{b} WHEN user_id % 5 = 3 THEN {a}'chrome', 'app'{b} ELSE {a}'app'{b} END AS process_names,
  CASE WHEN user_id % 2 = 0 THEN {a}'r'{b} ELSE {none} END AS relations FROM (SELECT DISTINCT path_id, user_id FROM tl) z"""
SPARK = {"a": "array(", "b": ")", "none": "CAST(array() AS ARRAY<STRING>)", "div": "DIV", "text": "STRING"}
DUCK = {"a": "[", "b": "]", "none": "CAST([] AS VARCHAR[])", "div": "//", "text": "VARCHAR"}
TIMELINE = f"tl AS ({_TIMELINE.format(**DUCK)})"


def timeline(spark, d):
    return once(spark, d, "timeline", lambda: spark.sql(_TIMELINE.format(**SPARK).replace("FROM pe)", "FROM {pe})"), pe=events(spark, d)))


def bridges(spark, d):
    return spark.sql(_BRIDGES.format(**SPARK).replace("FROM tl", "FROM {tl}"), tl=timeline(spark, d))


def paths(spark, d):
    return spark.sql(_PATHS.format(**SPARK).replace("FROM tl", "FROM {tl}"), tl=timeline(spark, d))


def likes(col: str, markers) -> str:
    return "(" + " OR ".join(f"contains({col}, '{m}')" for m in markers) + ")"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def has(col: str, values) -> str:
    return f"list_has_any({col}, [{quoted(values)}])"


_D, _K = "lower(description)", "lower(object_key)"
_SERVICE = "((object_key LIKE '/usr/%' OR object_key LIKE '/etc/%') AND object_key NOT LIKE '%/tmp/%')"
_STEP = "BETWEEN 0 AND 600000000"
_LOG = f"({has('labels_triggered', ['B_DELETE_LOG'])} OR {has('object_labels', ['O_LOG_ARTIFACT'])} OR object_class = 'log_file' OR {likes(_K, J.LOGS)})"
_TESTS = {
    "external_recv": "object_class = 'external_ip' AND event_type = 'RECV'", "external_send": "object_class = 'external_ip' AND event_type = 'SEND'", "lateral": has("labels_triggered", ["B_LATERAL_CONNECT"]),
    "scan": has("labels_triggered", ["B_LATERAL_CONNECT"]) + " OR event_type = 'CONNECT'", "internal": "object_class = 'internal_ip' AND event_type IN ('CONNECT', 'SEND', 'RECV')", "exec": has("labels_triggered", ["B_EXEC_TEMP"]),
    "sensitive_strong": has("labels_triggered", ["B_READ_CRED", "B_READ_HISTORY"]), "sensitive_weak": has("labels_triggered", ["B_READ_BUSINESS"]), "recon": likes(_D, J.RECON), "memory": likes(_D, J.MEMORY), "shell": likes(_D, J.SHELL),
    "sudo": likes(_D, ["sudo"]), "switch": likes(_D, J.SWITCH), "attachment": likes(_D, J.ATTACHMENT) + " OR " + likes(_K, J.ATTACHMENT),
    "direct_exec": f"event_type = 'EXEC' AND NOT {_SERVICE} AND (object_key LIKE '%/tmp/%' OR {has('object_labels', L.STAGED_LABELS)})", "staged_chmod": "staged AND event_type = 'CHMOD'", "staged_exec": "staged AND event_type = 'EXEC'",
    "temp_remove": f"event_type = 'DELETE' AND {likes(_K, J.TEMP_NAMES)}", "log_cleanup": f"event_type = 'DELETE' AND {_LOG}",
    "staged_cleanup": f"event_type = 'DELETE' AND NOT {_LOG} AND NOT {_SERVICE} AND (staged OR {has('object_labels', L.STAGED_LABELS)} OR {likes(_K, J.TEMP_STAGING)})",
}
#: Signals in DuckDB: staged keys, the events' own signals, bridges, precursors and elevations.
SIGNALS = f"""{TIMELINE}, bg AS ({_BRIDGES.format(**DUCK)}), pa AS ({_PATHS.format(**DUCK)}),
 sq AS (SELECT *, last_value(CASE WHEN event_type = 'WRITE' THEN us END IGNORE NULLS) OVER w AS wu FROM tl WHERE NOT {_SERVICE} WINDOW w AS (PARTITION BY path_id, object_key ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 sr AS (SELECT *, last_value(CASE WHEN event_type = 'WRITE' THEN -1 WHEN event_type = 'CHMOD' AND us - wu {_STEP} THEN us END IGNORE NULLS) OVER w AS cu FROM sq WINDOW w AS (PARTITION BY path_id, object_key ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 sk AS (SELECT path_id, object_key FROM sr WHERE object_key LIKE '%/tmp/%' OR {has('object_labels', L.STAGED_LABELS)} OR (event_type = 'EXEC' AND cu >= 0 AND us - cu {_STEP}) UNION SELECT path_id, object_key FROM bg),
 te AS (SELECT tl.*, sk.path_id IS NOT NULL AS staged FROM tl LEFT JOIN sk USING (path_id, object_key)),
 own AS (SELECT path_id, event_id, order_index, us, process_guid, unnest(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _TESTS.items())}], lambda x: x IS NOT NULL)) AS signal FROM te),
 pm AS (SELECT *, {likes("text", J.PRECURSORS)} AS s, {likes("text", J.WEAK_PRECURSORS)} AS w FROM (SELECT *, {_K} || ' ' || process_name || ' ' || {_D} AS text FROM te)),
 pg AS (SELECT path_id, bool_or(s) AS any_s, sum(CAST(w AS INT)) AS n, bool_or(staged) AS g FROM pm GROUP BY path_id),
 pre AS (SELECT path_id, event_id, row_number() OVER (PARTITION BY path_id ORDER BY order_index) AS r FROM pm JOIN pg USING (path_id) WHERE (any_s AND (s OR w)) OR (NOT any_s AND w AND n >= 2 AND g)),
 up AS (SELECT path_id, event_id, row_number() OVER (PARTITION BY path_id ORDER BY order_index) AS r FROM te WHERE staged AND object_key NOT LIKE '%/tmp/%' AND {likes(_D, L.ELEVATE)}),
 more AS (SELECT path_id, event_id, 'precursor' AS signal FROM pre WHERE r <= 8 UNION SELECT path_id, event_id, 'payload_elevate' FROM up WHERE r <= 8 UNION SELECT path_id, unnest([write_event, read_event]), 'bridge_exec' FROM bg),
 sg AS (SELECT path_id, signal, event_id, order_index, us, process_guid FROM own UNION ALL SELECT m.path_id, m.signal, m.event_id, order_index, us, process_guid FROM more m JOIN tl USING (path_id, event_id))"""


def signals(spark, d):
    return once(spark, d, "signals", lambda: J.claim_signals(timeline(spark, d), bridges(spark, d)))


@query("j01_claim_signals", duck(f"WITH {SIGNALS} SELECT path_id, signal, event_id FROM sg"))
def j01(spark, d):
    return signals(spark, d).select("path_id", "signal", "event_id")


@query("j02_ordered_pairs", duck(f"WITH {SIGNALS} SELECT a.path_id, a.event_id AS earlier_id, b.event_id AS later_id, a.process_guid = b.process_guid AS same_process FROM sg a JOIN sg b ON a.path_id = b.path_id AND a.signal = 'external_recv' AND b.signal = 'external_send' AND a.order_index < b.order_index AND b.us - a.us BETWEEN 0 AND 600000000"))
def j02(spark, d):
    return J.ordered_pairs(signals(spark, d), "external_recv", "external_send")


def _count(name: str) -> str:
    return f"coalesce(len(s_{name}), 0) > 0"


_STRONG = f"""(h_bridge_exec OR h_attachment OR h_shell OR h_precursor OR {has("labels", J.STRONG_LABELS)} OR {has("families", J.STRONG_FAMILIES)} OR ((h_exec OR {{direct}}) AND {has("families", ["callback_c2", "cleanup_delete"])}))"""
_FLAGS = ", ".join(f"coalesce(bool_or(signal = '{n}'), false) AS h_{n}" for n in ("exec", "direct_exec", "bridge_exec", "attachment", "shell", "precursor", "lateral"))


def context_sql(direct: bool) -> str:
    d = "h_direct_exec" if direct else "false"
    return f"""{SIGNALS}, hs AS (SELECT pa.path_id, {_FLAGS}, count(*) FILTER (signal = 'scan') AS scans, count(*) FILTER (signal = 'external_recv') AS receives FROM pa LEFT JOIN sg USING (path_id) GROUP BY pa.path_id),
 sp AS (SELECT path_id, (max(us) - min(us)) / 1e6 AS span FROM tl GROUP BY path_id),
 c0 AS (SELECT *, {_STRONG.format(direct=d)} AS strong_exec, list_contains(families, 'mail_browser_context_tail') OR len(list_filter(process_names, lambda x: x IN ('Firefox', 'chrome'))) > 0 AS browser_mail FROM pa JOIN hs USING (path_id) JOIN sp USING (path_id)),
 c1 AS (SELECT *, browser_mail AND len(list_filter(process_names, lambda x: x = 'app')) = 0 AS browser_only FROM c0),
 cx AS (SELECT path_id, strong_exec, browser_mail, browser_only, h_shell OR h_precursor OR h_attachment OR ((h_bridge_exec OR {d}) AND NOT browser_only) AS explicit_callback, receives <= 80 AND span <= 150 AS short_burst, scans >= 2 OR (scans > 0 AND h_lateral) AS discovery, len(relations) > 0 AS lineage FROM c1)"""


def context(spark, d, found, direct=False):
    return J.claim_context(timeline(spark, d), found, paths(spark, d), direct)


@query("j01_claim_context", duck(f"WITH {context_sql(False)} SELECT * FROM cx"))
def j01_context(spark, d):
    return context(spark, d, signals(spark, d))


_FREE = "(NOT browser_only OR explicit_callback)"
_WEAK = f"(strong_exec AND (discovery OR {_count('log_cleanup')} OR {_count('staged_cleanup')} OR {_count('staged_chmod')} OR {_count('staged_exec')} OR {_count('bridge_exec')} OR ({_count('external_send')} AND {_FREE})))"


def _when(cond: str, name: str) -> str:
    return f"CASE WHEN {cond} THEN '{name}' END"


def claims_sql(direct: bool) -> str:
    known = "list_concat(coalesce(s_bridge_exec, []), coalesce(s_direct_exec, []))" if direct else "coalesce(s_bridge_exec, [])"
    gate = f"(strong_exec OR browser_mail OR {_count('attachment')} OR len(kn) > 0)" if direct else "true"
    pair = "list_filter(flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: {{'a': x[2], 'b': y[2], 'same': x[4] = y[4], 'ok': x[1] < y[1] AND y[3] - x[3] BETWEEN 0 AND 600000000}}))), lambda p: p.ok)"
    rules = [
        ("untrusted_read", 0.74, gate, ["external_recv"], ["'external_recv'", _when("strong_exec", "exec_context"), _when("NOT strong_exec AND browser_mail", "browser_context")]),
        ("make_mem_exec", 0.77, f"{_count('memory')} AND ({_count('external_recv')} OR {_count('precursor')})", ["memory", "external_recv", "precursor"], ["'mem_exec'", "'precursor_dependency'"]),
        ("make_file_exec", 0.78, _count("staged_chmod"), ["staged_chmod", "staged_exec", "bridge_exec"], ["'chmod_exec'", "'staged_object'"]),
        ("untrusted_file_exec", 0.84, "len(kn) > 0", ["kn", "external_recv"], ["'staged_object'", _when(_count("bridge_exec"), "bridge_exec"), _when(_count("direct_exec") if direct else "false", "direct_staged_exec")]),
        ("attachment_user_exec", 0.82, _count("attachment"), ["attachment", "bridge_exec"], ["'attachment_markers'"]), ("shell_exec", 0.78, _count("shell"), ["shell", "precursor[:4]"], ["'interpreter_exec'"]),
        ("credential_submit", 0.77, "browser_only AND NOT explicit_callback AND short_burst", "sent", ["'browser_form_submit'"]),
        ("cnc_communication", 0.8, f"{_count('external_send')} AND strong_exec AND {_FREE}", ["external_send", "external_recv"], ["'external_c2'"]),
        ("sudo_exec", 0.8, _count("sudo"), ["sudo"], ["'sudo'"]), ("switch_su", 0.8, _count("switch"), ["switch"], ["'identity_switch'"]),
        ("payload_elevate", 0.81, f"{_count('payload_elevate')} AND strong_exec", ["payload_elevate", "staged_exec[:2]", "bridge_exec[:2]"], ["'payload_elevate'"]),
        ("sensitive_read", 0.82, "true", ["rd"], [_when(f"strong_exec AND {_count('sensitive_strong')}", "sensitive_strong_read"), _when(f"{_WEAK} AND {_count('sensitive_weak')}", "sensitive_weak_read")]),
        ("sensitive_command", 0.78, _count("recon"), ["recon"], ["'recon_commands'"]), ("network_service_discovery", 0.82, "discovery", ["scan", "lateral"], ["'scan_burst'"]), ("send_internal", 0.76, _count("internal"), ["internal"], ["'internal_connect'"]),
        ("sensitive_leak", 0.83, "strong_exec AND (len(list_filter(leak, lambda p: p.same)) > 0 OR lineage)", "leak", ["'sensitive_plus_external_send'"]),
        ("clear_logs", 0.82, "strong_exec", ["log_cleanup", "staged_cleanup"], [_when(_count("log_cleanup"), "log_cleanup"), _when(_count("staged_cleanup"), "staged_cleanup")]),
        ("sensitive_temp_rm", 0.78, f"{_count('temp_remove')} AND len(rd) > 0", ["temp_remove", "rd"], ["'temp_cleanup_after_collection'"]), ("untrusted_file_rm", 0.76, f"{_count('temp_remove')} AND {_count('bridge_exec')}", ["temp_remove", "bridge_exec"], ["'cleanup_staged_object'"]),
        ("interpreter_precursor_chain", 0.8, _count("precursor"), ["precursor"], ["'precursor_markers'"]),
    ]

    def evidence(parts) -> str:
        if isinstance(parts, str):
            return f"flatten(list_transform({parts}, lambda p: [p.a, p.b]))"
        return "list_concat(" + ", ".join(f"list_transform(coalesce({x if x in ('kn', 'rd') else 's_' + x}, []), lambda e: e[2])" for x in parts) + ")"

    rows = " UNION ALL ".join(f"SELECT path_id, '{a}' AS behavior, '{J.ATOMS[a][0]}' AS stage, CAST({c} AS DOUBLE) AS confidence, {evidence(ev)} AS ev, list_filter([{', '.join(why)}], lambda x: x IS NOT NULL) AS support FROM r2 WHERE {g}" for a, c, g, ev, why in rules)
    # the first place of each id counts
    once = "list_transform(list_filter(list_transform(range(1, len(ev) + 1), lambda i: CASE WHEN list_position(ev, ev[i]) = i THEN i END), lambda i: i IS NOT NULL), lambda i: ev[i])[:8]"
    lists = ", ".join(f"list((order_index, event_id, us, process_guid) ORDER BY order_index, event_id) FILTER (signal = '{n}') AS s_{n}" for n in J.SIGNALS)
    return f"""{context_sql(direct)}, ls AS (SELECT path_id, {lists} FROM sg GROUP BY path_id),
 r1 AS (SELECT *, {known} AS kn, list_concat(CASE WHEN strong_exec THEN coalesce(s_sensitive_strong, []) ELSE [] END, CASE WHEN {_WEAK} THEN coalesce(s_sensitive_weak, []) ELSE [] END) AS rd, {pair.format(a="coalesce(s_external_recv, [])", b="coalesce(s_external_send, [])")} AS sent FROM ls JOIN cx USING (path_id)),
 r2 AS (SELECT *, {pair.format(a="rd", b="coalesce(s_external_send, [])")} AS leak FROM r1),
 cl AS (SELECT path_id, behavior, stage, confidence, {once} AS evidence, support FROM ({rows}) WHERE len(ev) > 0)"""


CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {J.STAGES.index(s)}, {t!r}, {k!r}::VARCHAR[], {p!r}::VARCHAR[])" for a, (s, t, k, p) in J.ATOMS.items()) + ") v(behavior, stage_order, tactics, techniques, prerequisites))"
CLAIMS = f"{claims_sql(False)}, {CAT}"


def claims(spark, d):
    found = signals(spark, d)
    return once(spark, d, "claims", lambda: J.build_claims(found, context(spark, d, found)))


@query("j03_build_claims", duck(f"WITH {CLAIMS} SELECT * FROM cl"))
def j03(spark, d):
    return claims(spark, d)


@query("j03_build_claims_direct", duck(f"WITH {claims_sql(True)} SELECT * FROM cl"))
def j03_direct(spark, d):
    found = signals(spark, d)
    return J.build_claims(found, context(spark, d, found, True), direct=True)


@query("j04_elevate_fallbacks", duck(f"""WITH {SIGNALS}, x AS (SELECT DISTINCT path_id, process_guid, us FROM sg WHERE signal = 'staged_exec'), pr AS (SELECT DISTINCT t.path_id, t.event_id FROM tl t JOIN x ON x.path_id = t.path_id AND x.process_guid = t.process_guid AND abs(t.us - x.us) <= 300000000 WHERE event_type = 'CHANGE_PRINCIPAL'),
 fk AS (SELECT DISTINCT t.path_id, t.event_id, t.object_key FROM tl t JOIN x ON x.path_id = t.path_id AND x.process_guid = t.process_guid AND t.us - x.us BETWEEN 0 AND 300000000 WHERE event_type IN ('FORK', 'CLONE') AND t.path_id NOT IN (SELECT path_id FROM pr)),
 ch AS (SELECT DISTINCT t.path_id, t.event_id FROM tl t JOIN fk ON fk.path_id = t.path_id AND fk.object_key = t.process_guid JOIN x ON x.path_id = t.path_id AND t.us - x.us BETWEEN 0 AND 300000000 WHERE t.event_type = 'EXEC' AND t.object_key LIKE '%/procstat')
 SELECT path_id, event_id, 'principal' AS kind FROM pr UNION ALL SELECT DISTINCT path_id, event_id, 'fork' FROM fk UNION ALL SELECT path_id, event_id, 'child_exec' FROM ch"""))
def j04(spark, d):
    execs = signals(spark, d).where("signal = 'staged_exec'").select("path_id", "process_guid", "us").distinct()
    return J.elevate_fallbacks(timeline(spark, d), execs)


@query("j05_claim_edges", duck(f"WITH {CLAIMS}, want AS (SELECT path_id, behavior AS dst, unnest(prerequisites) AS src FROM cl JOIN cat USING (behavior)) SELECT w.path_id, w.src, w.dst FROM want w JOIN cl c ON c.path_id = w.path_id AND c.behavior = w.src"))
def j05_edges(spark, d):
    return J.claim_graph(claims(spark, d))[0]


@query("j05_claim_graph", duck(f"""WITH {CLAIMS} SELECT path_id, list(behavior ORDER BY stage_order, confidence DESC, behavior) AS matched, list_filter([{quoted(J.EXPECTED)}], lambda x: NOT list_contains(list(behavior), x)) AS missing,
 list_filter(list_transform([{quoted(J.STAGES)}], lambda s: s || '=' || len(list_filter(list(stage), lambda y: y = s))), lambda z: z NOT LIKE '%=0') AS stages FROM cl JOIN cat USING (behavior) GROUP BY path_id"""))
def j05(spark, d):
    text = F.transform("stage_counts", lambda x: F.concat_ws("=", x["stage"], x["n"].cast("string")))
    return J.claim_graph(claims(spark, d))[1].select("path_id", "matched", "missing", text.alias("stages"))


@query("j06_validate_claims", duck(f"WITH {CLAIMS} SELECT path_id, behavior, list_sort(list_filter(evidence, lambda x: x % 7 <> 0)) AS evidence FROM cl WHERE behavior <> 'clear_logs' AND len(list_filter(evidence, lambda x: x % 7 <> 0)) > 0"))
def j06(spark, d):
    """Of all claims one behaviour has a generic statement, and every seventh event is unknown to the evidence (an invented id)."""
    known = F.transform("evidence", lambda x: F.when(x % 7 == 0, -1 - x).otherwise(x))
    c = claims(spark, d).withColumn("evidence", known).withColumn("statement", F.when(F.col("behavior") == "clear_logs", "Some suspicious activity").otherwise(F.col("behavior")))
    return J.validate_claims(c, timeline(spark, d)).select("path_id", "behavior", "evidence")


@query("j07_merge_claims", duck(f"WITH {CLAIMS}, a AS (SELECT * FROM cl WHERE behavior < 'p'), b AS (SELECT path_id, behavior, confidence + 0.01 AS c, [-1] AS e FROM cl WHERE behavior > 'l') SELECT coalesce(a.path_id, b.path_id) AS path_id, coalesce(a.behavior, b.behavior) AS behavior, round(greatest(confidence, c), 6) AS confidence, list_sort(list_concat(coalesce(evidence, []), coalesce(e, []))) AS evidence FROM a FULL JOIN b ON a.path_id = b.path_id AND a.behavior = b.behavior"))
def j07(spark, d):
    c = claims(spark, d)
    extra = c.where("behavior > 'l'").withColumn("confidence", F.col("confidence") + 0.01).withColumn("evidence", F.array(F.lit(-1).cast("long")))
    return J.merge_claims(c.where("behavior < 'p'"), extra).withColumn("confidence", F.round("confidence", 6))


WORDS = r"""list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"""
KB = rf"""tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({WORDS}) AS term FROM (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM benchmark)) GROUP BY ALL), dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 ww AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) * 1.0 / (1 + df)) + 1) AS w FROM tf JOIN dfq USING (term)), kb AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM ww)"""


@query("j08_kb_index", f"WITH {KB} SELECT id, term, round(weight, 6) AS weight FROM kb")
def j08(spark, d):
    return J.kb_index(table(spark, d, "benchmark"), "item_id", "text").withColumn("weight", F.round("weight", 6))


@query("j09_retrieve_candidates", rf"""WITH {KB}, q AS (SELECT doc_id AS query, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM documents)) GROUP BY ALL), s AS (SELECT query, id, sum(q.tf * weight) AS s FROM q JOIN kb USING (term) GROUP BY ALL)
SELECT query, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query, id, s / max(s) OVER (PARTITION BY query) AS score FROM s)) WHERE rank <= 3""")
def j09(spark, d):
    q = J.terms(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "query")
    return J.retrieve_candidates(q, J.kb_index(table(spark, d, "benchmark"), "item_id", "text"), k=3).withColumn("score", F.round("score", 6))


#: The benchmark as a knowledge base of tactics and techniques: ids by number, and opening words that fit families, systems and claims.
IDS = [*sorted({t for _, ts, _, _ in J.ATOMS.values() for t in ts}), *sorted({k for _, _, ks, _ in J.ATOMS.values() for k in ks}), "TA0003", "TA0043"]
OPENINGS = ["Command and Control over a network protocol ", "Windows registry script execution ", "credential access password ", "linux cron persistence under /etc/ ", "system information discovery host file "]
_KB_ITEMS = "SELECT item_id AS id, {ids} AS external_id, {openings} || text AS text FROM benchmark"
_CONTEXTS = """SELECT path_id AS query, user_id, CASE user_id % 4 WHEN 0 THEN {a}'network_c2', 'recon'{b} WHEN 1 THEN {a}'execution'{b} WHEN 2 THEN {a}'credential', 'file_persistence'{b} ELSE {none} END AS families,
  CASE user_id % 4 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' WHEN 2 THEN 'macos' ELSE 'unknown' END AS os, CASE WHEN user_id % 3 = 0 THEN {a}'host discovery file'{b} ELSE {none} END AS semantics FROM (SELECT DISTINCT path_id, user_id FROM tl) z"""


def kb_items(spark, d):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("item_id") % len(values) + 1).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), pick(IDS).alias("external_id"), F.concat(pick(OPENINGS), "text").alias("text"))


def contexts(spark, d, c):
    by = c.groupBy(F.col("path_id").alias("query")).agg(F.array_sort(F.collect_set("behavior")).alias("behaviors"))
    own = spark.sql(_CONTEXTS.format(**SPARK).replace("FROM tl", "FROM {tl}"), tl=timeline(spark, d))
    return own.join(by, "query").withColumn("claim_terms", F.transform("behaviors", lambda x: F.replace(x, F.lit("_"), F.lit(" "))))




def _tokens(text: str) -> str:
    stop = quoted(X.STOPWORDS)
    return f"list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9_.-]{{2,}}'), lambda z: lower(z)), lambda z: z NOT IN ({stop}))"


def _alike(name: str) -> str:
    return f"len(list_filter({name}, lambda v: list_has_any({_tokens('v')}, toks)))"


_FITS = " + ".join(f"CASE WHEN list_contains(families, '{f}') AND {likes('t', w)} THEN {p} ELSE 0 END" for f, (p, w) in J.FAMILY_WORDS.items())
_SYSTEM = "CASE os " + " ".join(f"WHEN '{o}' THEN CASE WHEN {likes('t', [w for x, ws in J.OS_WORDS.items() if x != o for w in ws])} THEN -{fine} ELSE 0 END + CASE WHEN {likes('t', J.OS_WORDS[o])} THEN 0.14 ELSE 0 END" for o, fine in J.OTHER_OS.items()) + " ELSE 0 END"


def _pick(values) -> str:
    return f"[{quoted(values)}][item_id % {len(values)} + 1]"


@query("j09_ranked_candidates", duck(rf"""WITH {CLAIMS}, items AS ({_KB_ITEMS.format(ids=_pick(IDS), openings=_pick(OPENINGS))}), {KB.replace("item_id AS id", "id").replace("FROM benchmark)) GROUP BY ALL)", "FROM items)) GROUP BY ALL)").replace("FROM benchmark", "FROM items")},
 cx2 AS (SELECT x.*, behaviors, list_transform(behaviors, lambda y: replace(y, '_', ' ')) AS claim_terms FROM ({_CONTEXTS.format(**DUCK)}) x JOIN (SELECT path_id AS query, list(DISTINCT behavior ORDER BY behavior) AS behaviors FROM cl GROUP BY 1) USING (query)),
 qt AS (SELECT query, term, count(*) AS tf FROM (SELECT query, unnest({WORDS}) AS term FROM (SELECT query, regexp_extract_all(array_to_string(list_concat(families, claim_terms), ' '), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM cx2)) GROUP BY ALL),
 dt AS (SELECT query, id, sum(tf * weight) AS s FROM qt JOIN kb USING (term) GROUP BY ALL), sp2 AS (SELECT *, s / max(s) OVER (PARTITION BY query) AS sparse, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS r FROM dt),
 de AS (SELECT query, i.id, list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) AS dense FROM cx2 JOIN embeddings a ON a.vec_id = user_id JOIN embeddings b ON b.label = a.label JOIN items i ON i.id = b.vec_id),
 d2 AS (SELECT *, greatest(0, dense) / max(dense) OVER (PARTITION BY query) AS dn, row_number() OVER (PARTITION BY query ORDER BY dense DESC, id) AS r FROM de),
 po AS (SELECT query, id FROM sp2 WHERE r <= 24 UNION SELECT query, id FROM d2 WHERE r <= 24 UNION SELECT query, id FROM (SELECT query, unnest(behaviors) AS behavior FROM cx2) JOIN cat USING (behavior) JOIN items ON list_contains(list_concat(tactics, techniques), external_id)),
 pr2 AS (SELECT query, external_id, sum(p) AS prior FROM (SELECT query, unnest(tactics) AS external_id, 0.45 AS p FROM (SELECT query, unnest(behaviors) AS behavior FROM cx2) JOIN cat USING (behavior) UNION ALL SELECT query, unnest(techniques), 0.75 FROM (SELECT query, unnest(behaviors) AS behavior FROM cx2) JOIN cat USING (behavior)) GROUP BY ALL),
 bo AS (SELECT *, {_FITS} + 0.1 * {_alike("semantics")} + {_SYSTEM} + least(0.3, 0.08 * {_alike("claim_terms")}) + coalesce(prior, 0) AS bonus FROM (SELECT po.*, cx2.* EXCLUDE (query), external_id, lower(text) AS t, {_tokens("lower(text)")} AS toks FROM po JOIN cx2 USING (query) JOIN items USING (id)) LEFT JOIN pr2 USING (query, external_id)),
 fin AS (SELECT query, id, CAST(0.45 * coalesce(sparse, 0) + 0.55 * coalesce(dn, 0) + bonus AS DOUBLE) AS score FROM bo LEFT JOIN sp2 USING (query, id) LEFT JOIN d2 USING (query, id))
 SELECT query, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM fin WHERE round(score, 9) > 0) WHERE rank <= 12"""))
def j09_ranked(spark, d):
    c = contexts(spark, d, claims(spark, d))
    items, e = kb_items(spark, d), table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    words = c.select("query", F.concat_ws(" ", "families", "claim_terms").alias("text"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = e.withColumn("vv", dot("v", "v"))
    own = e.select(F.col("vec_id").alias("user_id"), F.col("v").alias("a"), F.col("vv").alias("aa"), "label").join(c.select("user_id").distinct(), "user_id")
    near = own.join(e.join(items.select("id"), F.col("id") == F.col("vec_id")).select("id", F.col("v").alias("b"), F.col("vv").alias("bb"), "label"), "label")
    near = c.select("query", "user_id").join(near.select("user_id", "id", (dot("a", "b") / F.sqrt(F.col("aa") * F.col("bb"))).alias("dense")), "user_id").select("query", "id", "dense")
    return J.retrieve_candidates(J.terms(words, "query", "text").withColumnRenamed("id", "query"), J.kb_index(items, "id", "text"), near, contexts=c, candidates=items).withColumn("score", F.round("score", 6))


_LEXEMES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(said, '(^| ){c}( |$)') THEN '{c}' END" for c in ("bash", "sudo", "whoami")) + "], lambda x: x IS NOT NULL)"
_MEANINGS = "list_filter([CASE WHEN contains(said, '/etc/cron') OR contains(said, 'service') THEN 'scheduled task or service artifact' END, CASE WHEN contains(said, '/tmp/') THEN 'temporary executable artifact' END, CASE WHEN contains(said, '/etc/passwd') THEN 'host discovery file' END], lambda x: x IS NOT NULL)"


@query("j10_query_terms", duck(f"""WITH {CLAIMS}, tx AS (SELECT path_id, min(description) FILTER (description LIKE '%s %' AND description NOT LIKE 'touches%') AS a, min(object_key) FILTER (object_key LIKE '/%') AS b FROM tl WHERE event_id % 3 = 0 GROUP BY path_id),
 qa AS (SELECT path_id, list(DISTINCT behavior) AS behaviors, any_value(families) AS families, any_value(lower(concat_ws(' ', a, b))) AS said FROM cl JOIN pa USING (path_id) LEFT JOIN tx USING (path_id) GROUP BY path_id)
 SELECT path_id, list_sort(list_distinct(list_concat(list_transform(families, lambda x: replace(x, '_', ' ')), list_transform(behaviors, lambda x: replace(x, '_', ' ')), {_LEXEMES}, {_MEANINGS}))) AS query_terms FROM qa"""))
def j10(spark, d):
    said = timeline(spark, d).where("event_id % 3 = 0").groupBy("path_id").agg(F.min(F.when(F.col("description").contains("s ") & ~F.col("description").startswith("touches"), F.col("description"))).alias("a"), F.min(F.when(F.col("object_key").startswith("/"), F.col("object_key"))).alias("b"))
    p = claims(spark, d).groupBy("path_id").agg(F.collect_set("behavior").alias("behaviors")).join(paths(spark, d), "path_id").join(said.select("path_id", F.concat_ws(" ", "a", "b").alias("text")), "path_id", "left")
    return J.query_terms(p).select("path_id", "query_terms")


PRIORS = "pt AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', {t!r}, '{x}', {repr(k) if k else 'NULL'})" for b, t, x, k in [(a, sorted(t), t[0], k[0] if k else None) for a, (_, t, k, _) in J.ATOMS.items()] + [(b, *x) for b, x in J.OTHER_BEHAVIORS.items()]) + ") v(behavior, tactics, preferred_tactic, technique))"
#: The claims, and one of remote sends backed by a path's first sends, of which none, one or more reach a web port.
MIXED = f"{CLAIMS}, {PRIORS}, rs AS (SELECT path_id, 'remote_send' AS behavior, 0.7 AS confidence, list(event_id ORDER BY event_id)[:1 + user_id % 6] AS evidence FROM tl WHERE object_key LIKE '%->%' GROUP BY path_id, user_id), ac AS (SELECT path_id, behavior, confidence, evidence FROM cl UNION ALL SELECT path_id, behavior, CAST(confidence AS DOUBLE), evidence FROM rs)"
PRIORED = f"""{MIXED}, we AS (SELECT path_id FROM (SELECT path_id, unnest(evidence) AS event_id FROM rs) JOIN tl USING (path_id, event_id) GROUP BY path_id HAVING count(*) >= 3 AND count(*) FILTER (regexp_extract(object_key, ':(\\d+)$', 1) IN ({quoted(S.WEB_C2_PORTS)})) >= 2),
 cp AS (SELECT ac.path_id, ac.behavior, confidence, tactics, preferred_tactic, CASE WHEN behavior = 'remote_send' AND path_id IN (SELECT path_id FROM we) THEN 'T1071.001' ELSE technique END AS technique FROM ac JOIN pt USING (behavior))"""


def mixed(spark, d):
    return once(spark, d, "mixed", lambda: _mixed(spark, d))


def _mixed(spark, d):
    t = timeline(spark, d)
    sends = t.where("object_key like '%->%'").groupBy("path_id", "user_id").agg(F.array_sort(F.collect_list("event_id")).alias("e"))
    sends = sends.select("path_id", F.lit("remote_send").alias("behavior"), F.lit(0.7).alias("confidence"), F.slice("e", 1, (1 + F.col("user_id") % 6).cast("int")).alias("evidence"))
    return claims(spark, d).select("path_id", "behavior", "confidence", "evidence").unionByName(sends)


def priors(spark, d):
    return once(spark, d, "priors", lambda: J.claim_priors(mixed(spark, d), timeline(spark, d)))


@query("j11_claim_priors", duck(f"WITH {PRIORED} SELECT path_id, behavior, tactics, preferred_tactic, technique FROM cp"))
def j11(spark, d):
    return priors(spark, d).select("path_id", "behavior", "tactics", "preferred_tactic", "technique")


#: Candidates before the priors: an id with a score and its tactics by path; a technique's name differs from its id.
_BASE = "SELECT path_id, attack_id, 0.5 AS score FROM (SELECT DISTINCT path_id FROM cl) x, (SELECT unnest(['TA0040', 'TA0001', 'T1105', 'T1046']) AS attack_id) y"
_AUGMENTED = f"au AS (SELECT path_id, attack_id, CAST(score AS DOUBLE) AS score FROM ({_BASE}) UNION ALL SELECT DISTINCT path_id, attack_id, CAST(score AS DOUBLE) FROM (SELECT path_id, unnest(tactics) AS attack_id, 0.98 AS score FROM cp UNION ALL SELECT path_id, technique, 1.02 FROM cp WHERE technique IS NOT NULL) n WHERE NOT EXISTS (SELECT 1 FROM ({_BASE}) b WHERE b.path_id = n.path_id AND b.attack_id = n.attack_id))"
#: Tactics of the techniques of the catalogue.
OF_TECHNIQUE = {k: sorted({t for _, ts, ks, _ in J.ATOMS.values() if k in ks for t in ts}) for k in sorted({k for _, _, ks, _ in J.ATOMS.values() for k in ks})}
_OF = "ot AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {t!r})" for k, t in OF_TECHNIQUE.items()) + ") v(attack_id, tactic_ids))"


def base_candidates(spark, d):
    known = claims(spark, d).select("path_id").distinct()
    return known.select("path_id", F.explode(F.array(*[F.lit(x) for x in ("TA0040", "TA0001", "T1105", "T1046")])).alias("attack_id"), F.lit(0.5).alias("score"))


def candidates(spark, d):
    """Augmented candidates with names and, for techniques, their tactics."""
    return once(spark, d, "candidates", lambda: _candidates(spark, d))


def _candidates(spark, d):
    of = spark.createDataFrame(list(OF_TECHNIQUE.items()), "attack_id string, tactic_ids array<string>")
    c = J.augment_candidates(base_candidates(spark, d), priors(spark, d)).join(F.broadcast(of), "attack_id", "left")
    return c.withColumn("tactic_ids", F.coalesce("tactic_ids", J.strings([]))).withColumn("name", F.concat(F.lit("Name of "), "attack_id"))


@query("j12_candidates", duck(f"WITH {PRIORED}, {_AUGMENTED} SELECT * FROM au"))
def j12(spark, d):
    return J.augment_candidates(base_candidates(spark, d), priors(spark, d))


_NARROW = f"nw AS (SELECT path_id FROM pa JOIN (SELECT path_id, list(DISTINCT behavior) AS bs FROM cl GROUP BY path_id) USING (path_id) WHERE list_contains(bs, 'credential_submit') AND len(list_filter(bs, lambda x: x NOT IN ({quoted(J.BROWSER_BEHAVIORS)}))) = 0 AND list_contains(families, 'mail_browser_context_tail') AND len(list_filter(process_names, lambda x: x IN ('Firefox', 'chrome'))) > 0)"


@query("j12_pruned_candidates", duck(f"""WITH {PRIORED}, {_AUGMENTED}, {_OF}, {_NARROW.replace("FROM cl GROUP", "FROM (SELECT * FROM cl WHERE behavior IN ('credential_submit', 'untrusted_read', 'clear_logs')) GROUP")}
 SELECT path_id, attack_id FROM au LEFT JOIN ot USING (attack_id) WHERE path_id NOT IN (SELECT path_id FROM nw) OR CASE WHEN attack_id LIKE 'TA%' THEN attack_id IN ({quoted(J.BROWSER_TACTICS)}) ELSE list_has_any(coalesce(tactic_ids, []), [{quoted(J.BROWSER_TACTICS)}]) END"""))
def j12_pruned(spark, d):
    """Claims of three behaviours only, so that paths with little else occur."""
    few = claims(spark, d).where("behavior in ('credential_submit', 'untrusted_read', 'clear_logs')")
    return J.prune_candidates(candidates(spark, d), few, paths(spark, d), tactics_only=False).select("path_id", "attack_id")


MAPPED = "mp AS (SELECT path_id, tactic, behavior, greatest(confidence, 0.72) AS confidence FROM (SELECT ac.path_id, behavior, confidence, unnest(coalesce(cat.tactics, [preferred_tactic])) AS tactic FROM ac JOIN pt USING (behavior) LEFT JOIN cat USING (behavior)))"


@query("j13_map_tactics", duck(f"WITH {MIXED}, {MAPPED} SELECT path_id, tactic, behavior, CAST(confidence AS DOUBLE) AS confidence FROM mp"))
def j13(spark, d):
    return J.map_tactics(mixed(spark, d))


#: Raw mappings of each claim, by turns: right by id; by names; technique alone; a tactic that is not allowed; unknown ids; evidence named by event ids or not at all.
_RAW = """SELECT path_id, behavior AS mapping_id, CASE length(behavior) % 5 WHEN 0 THEN lower(preferred_tactic) WHEN 3 THEN 'TA0040' WHEN 4 THEN 'TA9999' ELSE '' END AS tactic_id, CASE WHEN length(behavior) % 5 = 1 THEN 'NAME of  ' || preferred_tactic ELSE '' END AS tactic,
  CASE length(behavior) % 5 WHEN 2 THEN coalesce(technique, '') WHEN 0 THEN coalesce(technique, 'T1046') ELSE '' END AS technique_id, CASE WHEN length(behavior) % 5 = 4 THEN 'name-of t1105' ELSE '' END AS technique,
  CASE length(path_id || behavior) % 4 WHEN 0 THEN {a}behavior, 'ghost'{b} WHEN 1 THEN {a}CAST(evidence{first} AS {text}), behavior{b} WHEN 2 THEN {a}CAST(evidence{first} AS {text}), '17x'{b} ELSE {a}'ghost', ' '{b} END AS refs, confidence FROM cb"""


def raw_mappings(spark, d):
    cb = priors(spark, d).join(mixed(spark, d).select("path_id", "behavior", "evidence"), ["path_id", "behavior"])
    return spark.sql(_RAW.format(**SPARK, first="[0]").replace("FROM cb", "FROM {cb}"), cb=cb)


VALID = f"""{PRIORED}, {_AUGMENTED}, {_OF}, ca AS (SELECT path_id, attack_id, 'name of ' || lower(replace(attack_id, '.', ' ')) AS name, tactic_ids FROM au LEFT JOIN ot USING (attack_id)), cb AS (SELECT cp.*, evidence FROM cp JOIN ac USING (path_id, behavior)), rw AS ({_RAW.format(**DUCK, first="[1]")}),
 rf AS (SELECT DISTINCT path_id, mapping_id, unnest(refs) AS ref FROM rw), ae AS (SELECT DISTINCT path_id, behavior, CAST(unnest(evidence) AS VARCHAR) AS ref FROM ac),
 rk AS (SELECT rf.*, coalesce(a.behavior, e.behavior) AS behavior, CASE WHEN a.behavior IS NOT NULL THEN 'claim' WHEN e.behavior IS NOT NULL THEN 'event' ELSE 'unknown' END AS kind FROM rf LEFT JOIN (SELECT DISTINCT path_id, behavior FROM ac) a ON a.path_id = rf.path_id AND a.behavior = rf.ref LEFT JOIN ae e ON e.path_id = rf.path_id AND e.ref = rf.ref WHERE trim(rf.ref) <> ''),
 rc AS (SELECT path_id, mapping_id, count(DISTINCT ref) AS raw_refs, count(DISTINCT ref) FILTER (kind = 'claim') AS claim_refs, count(DISTINCT ref) FILTER (kind = 'event') AS event_refs, count(DISTINCT ref) FILTER (kind = 'unknown') AS unknown_refs, count(DISTINCT behavior) FILTER (kind = 'event') AS event_claims, list(DISTINCT behavior) FILTER (behavior IS NOT NULL) AS backs FROM rk GROUP BY ALL),
 m1 AS (SELECT rw.path_id, rw.mapping_id, confidence, coalesce((SELECT attack_id FROM ca WHERE ca.path_id = rw.path_id AND attack_id = upper(tactic_id) AND attack_id LIKE 'TA%'), (SELECT attack_id FROM ca WHERE ca.path_id = rw.path_id AND attack_id LIKE 'TA%' AND name = lower(regexp_replace(tactic, ' +', ' ', 'g')))) AS t,
   coalesce((SELECT attack_id FROM ca WHERE ca.path_id = rw.path_id AND attack_id = technique_id), (SELECT attack_id FROM ca WHERE ca.path_id = rw.path_id AND attack_id NOT LIKE 'TA%' AND name = replace(technique, '-', ' '))) AS k FROM rw),
 m2 AS (SELECT m1.path_id, mapping_id, confidence, k, tactic_ids AS of, coalesce(t, list_filter(tactic_ids, lambda x: list_contains(have, x))[1]) AS t FROM m1 LEFT JOIN ca ON ca.path_id = m1.path_id AND ca.attack_id = k LEFT JOIN (SELECT path_id, list(attack_id) AS have FROM ca GROUP BY path_id) h ON h.path_id = m1.path_id),
 m3 AS (SELECT m2.*, coalesce(backs, []) AS backs, coalesce(raw_refs, 0) AS raw_refs, coalesce(claim_refs, 0) AS claim_refs, coalesce(event_refs, 0) AS event_refs, coalesce(unknown_refs, 0) AS unknown_refs, coalesce(event_claims, 0) AS event_claims FROM m2 LEFT JOIN rc USING (path_id, mapping_id)),
 m4 AS (SELECT *, len(backs) > 0 AND (t IS NOT NULL OR k IS NOT NULL) AND (t IS NULL OR k IS NULL OR list_contains(of, t)) AS fine FROM m3),
 bk AS (SELECT m4.path_id, mapping_id, list(DISTINCT b.behavior ORDER BY b.behavior) AS behaviors FROM (SELECT path_id, mapping_id, t, k, of, unnest(backs) AS behavior FROM m4 WHERE fine) b JOIN m4 USING (path_id, mapping_id) JOIN cp ON cp.path_id = b.path_id AND cp.behavior = b.behavior WHERE CASE WHEN b.t IS NOT NULL THEN list_contains(tactics, b.t) ELSE list_has_any(tactics, b.of) END AND (technique IS NULL OR b.k IS NULL OR technique = b.k) GROUP BY ALL),
 m5 AS (SELECT m4.*, behaviors FROM m4 LEFT JOIN bk USING (path_id, mapping_id)), kp AS (SELECT path_id, t AS tactic_id, k AS technique_id, behaviors, CAST(max(confidence) AS DOUBLE) AS confidence FROM m5 WHERE fine AND behaviors IS NOT NULL GROUP BY ALL)"""


def validated(spark, d):
    return J.validate_mappings(raw_mappings(spark, d), mixed(spark, d), candidates(spark, d), priors(spark, d))


@query("j14_validate_mappings", duck(f"WITH {VALID} SELECT * FROM kp"))
def j14(spark, d):
    return validated(spark, d)[0]


@query("j14_validation_counters", duck(f"""WITH {VALID} SELECT path_id, count(*) AS raw_mappings, sum(raw_refs)::BIGINT AS raw_refs, sum(claim_refs)::BIGINT AS claim_refs, sum(event_refs)::BIGINT AS event_refs, sum(unknown_refs)::BIGINT AS unknown_refs, sum(event_claims)::BIGINT AS event_claims,
 count(*) FILTER (len(backs) = 0 AND raw_refs > 0) AS emptied, count(*) FILTER (fine AND behaviors IS NULL) AS unsupported, (SELECT count(*) FROM kp WHERE kp.path_id = m5.path_id) AS kept FROM m5 GROUP BY path_id"""))
def j14_counters(spark, d):
    return validated(spark, d)[1]


@query("j15_apply_priors", duck(f"""WITH {VALID}, hv AS (SELECT path_id, list(attack_id) AS have FROM ca GROUP BY path_id), pp AS (SELECT path_id, behavior, confidence, CASE WHEN list_contains(have, preferred_tactic) THEN preferred_tactic END AS t, CASE WHEN list_contains(have, technique) THEN technique END AS k FROM cp JOIN hv USING (path_id)),
 st AS (SELECT * FROM kp WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.path_id = kp.path_id AND list_contains(kp.behaviors, pp.behavior) AND (t IS NOT NULL OR k IS NOT NULL) AND (coalesce(t <> tactic_id, false) OR CASE WHEN k IS NOT NULL THEN coalesce(technique_id <> k, false) ELSE technique_id IS NOT NULL END)))
 SELECT * FROM st UNION ALL SELECT path_id, t, k, [behavior], confidence FROM pp WHERE (t IS NOT NULL OR k IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM st WHERE st.path_id = pp.path_id AND st.tactic_id IS NOT DISTINCT FROM t AND st.technique_id IS NOT DISTINCT FROM k AND st.behaviors = [pp.behavior])"""))
def j15_priors(spark, d):
    return J.apply_priors(validated(spark, d)[0], priors(spark, d), candidates(spark, d))


def _fill_sql(fills) -> str:
    out = []
    for tactic, need, more, must, family, sure in fills:
        cond = f"list_contains(have, '{tactic}') AND NOT list_contains(done, '{tactic}') AND {has('bs', need)}" + (f" AND {has('bs', more)}" if must else "") + (f" AND list_contains(families, '{family}') AND NOT list_contains(bs, 'credential_submit')" if family else "")
        out.append(f"SELECT path_id, '{tactic}' AS tactic_id, list_sort(list_filter(bs, lambda x: x IN ({quoted([*need, *more])}))) AS behaviors, {sure} AS confidence FROM fi WHERE {cond}")
    return " UNION ALL ".join(out)


#: Mappings to start from: those of even lengths of the behaviour's name, so that tactics are missing.
_START = "mg AS (SELECT path_id, tactic AS tactic_id, [behavior] AS behaviors, CAST(confidence AS DOUBLE) AS confidence FROM mp WHERE length(behavior) % 2 = 0)"
FILLED = f"""{PRIORED}, {_AUGMENTED}, {MAPPED}, {_START}, fi AS (SELECT pa.path_id, families, bs, have, coalesce(done, []) AS done FROM pa JOIN (SELECT path_id, list(DISTINCT behavior) AS bs FROM cl GROUP BY 1) USING (path_id) JOIN (SELECT path_id, list(attack_id) AS have FROM au GROUP BY 1) USING (path_id) LEFT JOIN (SELECT path_id, list(tactic_id) AS done FROM mg GROUP BY 1) USING (path_id))"""


def started(spark, d):
    return J.map_tactics(mixed(spark, d)).where("length(behavior) % 2 = 0").select("path_id", F.col("tactic").alias("tactic_id"), F.array("behavior").alias("behaviors"), "confidence")


@query("j15_backfill_tactics", duck(f"WITH {FILLED} SELECT * FROM mg UNION ALL ({_fill_sql(J.GENERIC_FILLS)})"))
def j15_backfill(spark, d):
    return J.backfill_tactics(started(spark, d), claims(spark, d), candidates(spark, d), paths(spark, d))


@query("j15_backfill_direct", duck(f"WITH {FILLED} SELECT * FROM mg UNION ALL ({_fill_sql(J.DIRECT_FILLS)})"))
def j15_backfill_direct(spark, d):
    return J.backfill_tactics(started(spark, d), claims(spark, d), candidates(spark, d), paths(spark, d), J.DIRECT_FILLS)


@query("j15_guard_mappings", duck(f"""WITH {MIXED}, {MAPPED}, g0 AS (SELECT path_id, tactic AS tactic_id, [behavior] AS behaviors FROM mp UNION ALL SELECT path_id, x, [behavior] FROM (SELECT *, unnest(['TA0004', 'TA0043']) AS x FROM cl)), gb AS (SELECT path_id, families, coalesce(bs, []) AS bs FROM pa LEFT JOIN (SELECT path_id, list(DISTINCT behavior) AS bs FROM cl GROUP BY 1) USING (path_id))
 SELECT g0.* FROM g0 JOIN gb USING (path_id) WHERE NOT (list_contains(families, 'mail_browser_context_tail') AND tactic_id = 'TA0007' AND list_contains(bs, 'credential_submit') AND list_contains(bs, 'network_service_discovery') AND NOT {has("bs", J.FOLLOW_UP)})
 AND NOT (list_contains(families, 'mail_browser_context_tail') AND tactic_id = 'TA0006' AND behaviors[1] IN ('sensitive_read', 'shell_exec')) AND NOT (tactic_id = 'TA0004' AND behaviors[1] NOT IN ('payload_elevate', 'sudo_exec', 'switch_su'))
 AND NOT (tactic_id = 'TA0043' AND (list_contains(families, 'cleanup_delete') OR ({has("bs", ["cnc_communication", "shell_exec", "payload_elevate"])} AND {has("bs", ["interpreter_precursor_chain", "attachment_user_exec", "sensitive_command"])})))"""))
def j15_guard(spark, d):
    """Mappings of all claims, and for each claim one to privilege escalation and one to reconnaissance."""
    more = claims(spark, d).select("path_id", F.explode(F.array(F.lit("TA0004"), F.lit("TA0043"))).alias("tactic_id"), F.array("behavior").alias("behaviors"))
    m = J.map_tactics(mixed(spark, d)).select("path_id", F.col("tactic").alias("tactic_id"), F.array("behavior").alias("behaviors")).unionByName(more)
    return J.guard_mappings(m, claims(spark, d), paths(spark, d))


@query("j16_evidence_support_rate", duck(f"WITH {MIXED}, {MAPPED}, x AS (SELECT path_id, CASE WHEN length(behavior) % 3 = 0 THEN NULL ELSE behavior END AS behavior FROM mp), y AS (SELECT path_id, CASE WHEN length(behavior) % 4 = 0 THEN 0 ELSE 1 END AS e FROM ac) SELECT coalesce(a.path_id, b.path_id) AS path_id, round((coalesce(a.v, 0) + coalesce(b.v, 0)) / 2, 9) AS rate FROM (SELECT path_id, avg(e) AS v FROM y GROUP BY 1) a FULL JOIN (SELECT path_id, avg(CASE WHEN behavior IS NULL THEN 0 ELSE 1 END) AS v FROM x GROUP BY 1) b ON a.path_id = b.path_id"))
def j16(spark, d):
    """Claims of some names lose their evidence, and mappings of others their claim."""
    c = mixed(spark, d)
    m = J.map_tactics(c).withColumn("behavior", F.when(F.length("behavior") % 3 != 0, F.col("behavior")))
    bare = c.withColumn("evidence", F.when(F.length("behavior") % 4 == 0, F.slice("evidence", 1, 0)).otherwise(F.col("evidence")))
    return J.evidence_support_rate(bare, m).withColumn("rate", F.round("rate", 9))


@query("j17_indicators", duck(f"WITH {TIMELINE} SELECT DISTINCT path_id, 'path' AS kind, object_key AS value FROM tl WHERE object_key LIKE '/%' UNION SELECT DISTINCT path_id, 'ip', unnest(regexp_extract_all(object_key, '\\d+\\.\\d+\\.\\d+\\.\\d+')) FROM tl WHERE object_key NOT LIKE '/%'"))
def j17(spark, d):
    return J.indicators(timeline(spark, d))
