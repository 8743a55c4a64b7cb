"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.plans.fixture import duck, provenance, table
from auditloom.plans.registry import query


@query("b01_unwrap_scalar", "SELECT event_id, json_extract_string(props, '$.k') AS unwrapped, coalesce(nullif(trim(event_type), ''), 'x') AS first_text FROM events")
def b01(spark, d):
    e = table(spark, d, "events")
    union = F.concat(F.lit('{"long":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return e.select("event_id", X.unwrap_scalar(union).alias("unwrapped"), X.first_non_empty(F.lit("  "), "event_type", F.lit("x")).alias("first_text"))


@query("b02_normalize_action", "SELECT event_id, upper(event_type) AS action FROM events")
def b02(spark, d):
    return table(spark, d, "events").select("event_id", X.normalize_action(F.concat(F.lit("EVENT_"), "event_type")).alias("action"))


@query("b03_epoch_seconds", "SELECT event_id, epoch_us(ts) // 1000000 AS from_us, epoch_us(ts) // 1000000 AS from_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS printed FROM events")
def b03(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    us = X.to_epoch_seconds(F.unix_micros("ts").cast("string"))
    return e.select("event_id", F.floor(us).alias("from_us"), F.floor(X.to_epoch_seconds(F.col("ts").cast("string"))).alias("from_text"), X.format_seconds(us).alias("printed"))


@query("b04_node_type", """SELECT DISTINCT event_type, CASE event_type WHEN 'view' THEN 'process' WHEN 'click' THEN 'flow' WHEN 'purchase' THEN 'file' WHEN 'signup' THEN 'pipe' ELSE 'error' END AS node_type FROM events""")
def b04(spark, d):
    name = F.create_map(*[F.lit(x) for x in ("view", "Subject", "click", "NetFlowObject", "purchase", "SrcSinkObject", "signup", "UnnamedPipeObject", "error", "error")])
    return table(spark, d, "events").select("event_type", X.normalize_node_type(name[F.col("event_type")]).alias("node_type")).distinct()


@query("b05_render_node", duck("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN process_name WHEN event_id % 3 = 1 THEN object_key ELSE process_guid END AS node FROM pe"))
def b05(spark, d):
    m = F.col("event_id") % 3
    return provenance(spark, d).select("event_id", X.render_node(F.when(m == 0, F.col("process_name")), F.when(m == 1, F.col("object_key")).otherwise(" "), F.col("process_guid")).alias("node"))


@query("b06_event_type", "SELECT event_id, CASE event_type WHEN 'view' THEN 'EXEC' WHEN 'click' THEN 'SEND' WHEN 'purchase' THEN 'FORK' WHEN 'signup' THEN 'UNKNOWN' ELSE 'ERROR' END AS kind FROM events")
def b06(spark, d):
    raw = F.create_map(*[F.lit(x) for x in ("view", "execute", "click", "SendMsg", "purchase", "FORK_WITH_SHARED_OPEN_FILE", "signup", " ", "error", "error")])
    return table(spark, d, "events").select("event_id", X.normalize_event_type(raw[F.col("event_type")]).alias("kind"))


@query("b07_process_parts", duck("SELECT event_id, process_name AS name, '/usr/bin/' || process_name AS exe, '/usr/bin/' || process_name || ' -c ' || object_key AS cmdline FROM pe"))
def b07(spark, d):
    attr = F.concat(F.lit("/usr/bin/"), "process_name", F.lit(" -c "), "object_key")
    return provenance(spark, d).select("event_id", X.process_name(attr).alias("name"), X.process_exe(attr).alias("exe"), X.process_cmdline(attr).alias("cmdline"))


@query("b08_object_key", duck("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN object_key ELSE CAST(event_id AS VARCHAR) END AS key,
  CASE WHEN object_key LIKE '%->%' THEN object_key ELSE regexp_extract(object_key, '([^/]*)$', 1) END AS name FROM pe"""))
def b08(spark, d):
    return provenance(spark, d).select("event_id", X.object_key(F.when(F.col("event_id") % 2 == 0, F.col("object_key")), F.col("event_id")).alias("key"), X.object_name("object_key").alias("name"))


@query("b09_flow_endpoints", duck(r"""SELECT event_id, nullif(regexp_extract(object_key, '^(.*):(\d+)->(.*):(\d+)$', 1), '') AS local_ip, try_cast(nullif(regexp_extract(object_key, '^(.*):(\d+)->(.*):(\d+)$', 2), '') AS INT) AS local_port,
  nullif(regexp_extract(object_key, '^(.*):(\d+)->(.*):(\d+)$', 3), '') AS remote_ip, try_cast(nullif(regexp_extract(object_key, '^(.*):(\d+)->(.*):(\d+)$', 4), '') AS INT) AS remote_port FROM pe"""))
def b09(spark, d):
    return provenance(spark, d).select("event_id", X.flow_endpoints("object_key").alias("f")).select("event_id", "f.*")


@query("b10_event_result", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS result FROM events")
def b10(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"result":" ","errno":'), F.get_json_object("props", "$.k"), F.lit("}"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", X.event_result(raw).alias("result"))


@query("b11_directions", duck("""SELECT DISTINCT event_type, object_type, 'P_TO_O' AS syscall, CASE WHEN event_type IN ('READ', 'EXEC', 'RECV') THEN 'O_TO_P' ELSE 'P_TO_O' END AS flow FROM pe"""))
def b11(spark, d):
    return provenance(spark, d).select("event_type", "object_type", X.syscall_direction(F.col("event_type"), F.col("object_type")).alias("syscall"),
                                       X.semantic_flow_direction(F.col("event_type"), F.col("object_type")).alias("flow")).distinct()


@query("b12_internal_ip", """SELECT c_custkey, c_custkey % 256 IN (10, 127) OR (c_custkey % 256 = 172 AND c_custkey // 256 % 256 BETWEEN 16 AND 31) OR (c_custkey % 256 = 192 AND c_custkey // 256 % 256 = 168) AS internal,
  NOT (c_custkey % 256 IN (10, 127) OR (c_custkey % 256 = 172 AND c_custkey // 256 % 256 BETWEEN 16 AND 31) OR (c_custkey % 256 = 192 AND c_custkey // 256 % 256 = 168)) AS outside FROM customer""")
def b12(spark, d):
    k = F.col("c_custkey")
    ip = F.concat_ws(".", (k % 256).cast("string"), (F.floor(k / 256) % 256).cast("string"), F.lit("7"), F.lit("9"))
    return table(spark, d, "customer").select(k, X.is_internal_ip(ip).alias("internal"), X.is_external_ip(ip).alias("outside"))


@query("b13_download_hint", "SELECT doc_id, lower(text) LIKE '%http://%' OR lower(text) LIKE '%https://%' OR lower(text) LIKE '%ftp://%' OR lower(text) LIKE '%-o%' AS hint FROM documents")
def b13(spark, d):
    return table(spark, d, "documents").select("doc_id", X.has_download_hint("text").alias("hint"))


@query("b14_paths", r"SELECT page_id, regexp_replace(trim(url), '[\\/]+', '/', 'g') AS path, regexp_extract(regexp_replace(regexp_replace(trim(url), '[\\/]+', '/', 'g'), '/+$', ''), '([^/]*)$', 1) AS base FROM pages")
def b14(spark, d):
    return table(spark, d, "pages").select("page_id", X.normalize_path("url").alias("path"), X.basename("url").alias("base"))


@query("b15_process_type", duck("""SELECT process_name, CASE process_name WHEN 'bash' THEN 'shell' WHEN 'python3' THEN 'interpreter' WHEN 'curl' THEN 'downloader' WHEN 'tar' THEN 'archive_tool' WHEN 'nginx' THEN 'web_service'
  WHEN 'sshd' THEN 'remote_service' ELSE 'binary' END AS process_type, count(*) AS n FROM pe GROUP BY ALL"""))
def b15(spark, d):
    pe = provenance(spark, d)
    return pe.groupBy("process_name", X.classify_process_type(F.col("process_name"), F.concat(F.lit("/bin/"), "process_name")).alias("process_type")).agg(F.count("*").alias("n"))


@query("b16_object_class", duck("SELECT object_key, object_class, count(*) AS n FROM pe GROUP BY ALL"))
def b16(spark, d):
    return provenance(spark, d).groupBy("object_key", "object_class").agg(F.count("*").alias("n"))


@query("b17_business_file", duck("SELECT DISTINCT object_key, object_key LIKE '%.csv' AS business FROM pe"))
def b17(spark, d):
    return provenance(spark, d).select("object_key", X.matches_business_file("object_key").alias("business")).distinct()


@query("b18_path_markers", """SELECT page_id, lower(url) LIKE '%upload%' OR lower(url) LIKE '%wwwroot%' OR lower(url) LIKE '%webapps%' OR lower(url) LIKE '%htdocs%' AS upload, page_id % 2 = 0 AS web FROM pages""")
def b18(spark, d):
    web = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("/var\\\\WWW/")).otherwise(F.lit("/home/")), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", X.contains_upload_marker("url").alias("upload"), X.under_web_root(web).alias("web"))


@query("b19_path_predicates", duck("SELECT DISTINCT object_key, object_key LIKE '%/tmp/%' AS temp, object_key LIKE '/usr/%' OR object_key LIKE '/etc/%' AS service, false AS placeholder FROM pe"))
def b19(spark, d):
    k = "object_key"
    return provenance(spark, d).select(k, X.is_temp_exec_path(k).alias("temp"), X.is_system_service_key(k).alias("service"), X.is_placeholder_key(k).alias("placeholder")).distinct()


@query("b20_cmd_path", duck("SELECT event_id, CASE WHEN object_type = 'file' THEN lower(object_key) ELSE '' END AS path FROM pe"))
def b20(spark, d):
    return provenance(spark, d).select("event_id", X.extract_cmd_path(F.concat(F.lit(" '"), "object_key", F.lit("' --x"))).alias("path"))


@query("b21_port_class", "SELECT o_orderkey, CASE WHEN o_orderkey % 65536 < 1024 THEN 0 WHEN o_orderkey % 65536 < 49152 THEN 1 ELSE 2 END AS port_class FROM orders")
def b21(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.port_class(F.col("o_orderkey") % 65536).alias("port_class"))


@query("b22_address_distance", duck(r"""SELECT DISTINCT object_key, CASE WHEN object_key LIKE '%->8.8.8.%' THEN 4 ELSE 4 END AS distance,
  CASE WHEN object_key LIKE '%->8.8.8.%' THEN 7 ELSE 7 END AS no_address, CASE WHEN split_part(split_part(object_key, '->', 2), ':', 1) = '10.0.0.5' THEN 4
  WHEN split_part(split_part(split_part(object_key, '->', 2), ':', 1), '.', 4) <> '5' THEN 4 WHEN object_key LIKE '%->8.8.8.%' THEN 3 ELSE 3 END AS last_octet FROM pe WHERE object_type = 'flow'"""))
def b22(spark, d):
    f = X.flow_endpoints("object_key")
    df = provenance(spark, d).where("object_type = 'flow'").select("object_key", f.alias("f"))
    return df.select("object_key", X.address_distance(F.col("f.local_ip"), F.col("f.local_ip")).alias("distance"), X.address_distance(F.col("f.local_ip"), F.lit("pipe")).alias("no_address"),
                     X.address_distance(F.col("f.local_ip"), F.col("f.remote_ip")).alias("last_octet")).distinct()


_PREFIXES = [("/tmp", 5), ("/home", 7), ("/home/u/Documents", 9), ("/etc", 11), ("/usr/lib", 13)]


@query("b23_path_prefix_code", duck("""SELECT DISTINCT object_key, CASE WHEN object_key LIKE '/tmp%' THEN 6 WHEN object_key LIKE '/home/u/Documents%' THEN 10 WHEN object_key LIKE '/home%' THEN 8
  WHEN object_key LIKE '/etc%' THEN 12 WHEN object_key LIKE '/usr/lib%' THEN 14 ELSE 90 END AS code FROM pe WHERE object_type = 'file'"""))
def b23(spark, d):
    from auditloom.operators.features import path_prefix_codes

    keys = provenance(spark, d).where("object_type = 'file'").select("object_key").distinct()
    return path_prefix_codes(keys, spark.createDataFrame(_PREFIXES, "prefix string, code int"), "object_key").select("object_key", "code")


@query("b24_file_type", duck("""SELECT DISTINCT object_key, CASE WHEN object_key LIKE '%.csv' THEN 'csv' WHEN object_key LIKE '%.so' THEN 'so' WHEN object_key LIKE '%.bash_history' THEN 'bash_history' ELSE '' END AS ext FROM pe WHERE object_type = 'file'"""))
def b24(spark, d):
    return provenance(spark, d).where("object_type = 'file'").select("object_key", X.file_extension("object_key").alias("ext")).distinct()


@query("b25_bands", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 >= 99 THEN 'Critical' WHEN l_quantity * 2 >= 97 THEN 'Significant' WHEN l_quantity * 2 >= 95 THEN 'Moderate' WHEN l_quantity * 2 >= 90 THEN 'Minor' ELSE 'Negligible' END AS severity,
  CASE WHEN l_quantity * 2 >= 80 THEN 'high' WHEN l_quantity * 2 >= 50 THEN 'medium' WHEN l_quantity * 2 >= 30 THEN 'low' ELSE 'info' END AS risk, CASE WHEN l_quantity < 1 THEN '<1m' WHEN l_quantity < 5 THEN '<5m' WHEN l_quantity < 15 THEN '<15m' WHEN l_quantity < 60 THEN '<60m' ELSE '>=60m' END AS bin FROM lineitem""")
def b25(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.severity(q * 2).alias("severity"), X.risk_level(q * 2).alias("risk"), X.time_bin(q * 60).alias("bin"))


@query("b26_attack_ids", """SELECT o_orderkey, 'T' || CAST(1000 + o_orderkey % 9000 AS VARCHAR) || '.001' AS attack_id, ['T' || CAST(1000 + o_orderkey % 9000 AS VARCHAR) || '.001', 'T1059'] AS ids, ['EXECUTION', 'LATERAL_MOVEMENT'] AS tactics FROM orders""")
def b26(spark, d):
    i = F.concat(F.lit("t"), (1000 + F.col("o_orderkey") % 9000).cast("string"), F.lit("/001"))
    text = F.concat(F.lit("saw "), F.upper(i), F.lit(" then T1059 and again "), F.upper(i), F.lit("."))
    return table(spark, d, "orders").select("o_orderkey", X.canonical_attack_id(i).alias("attack_id"), X.extract_attack_ids(text).alias("ids"), X.split_tactics(F.lit("TA0002; lateral movement, execution")).alias("tactics"))


@query("b27_window_status", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'attempted_failed' WHEN o_orderkey % 3 = 1 THEN 'confirmed' ELSE 'insufficient' END AS status,
  CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS n_confirmed, CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 0 END AS n_attempted FROM orders""")
def b27(spark, d):
    m = F.col("o_orderkey") % 3
    ids = F.when(m == 0, F.array(F.lit("T1068"))).when(m == 1, F.array(F.lit("T1059"), F.lit("T1068"))).otherwise(F.array().cast("array<string>"))
    s = X.window_status(ids, F.lit("T1059 worked; T1068 was attempted"))
    return table(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.status", F.size("s.confirmed").alias("n_confirmed"), F.size("s.attempted").alias("n_attempted"))


@query("b28_chain_tags", """SELECT doc_id, list_filter([CASE WHEN t LIKE '%firefox%' OR t LIKE '%browser%' THEN 'browser_compromise' END, CASE WHEN t LIKE '%phishing%' OR t LIKE '%nasa.ng%' THEN 'phishing_link' END,
  CASE WHEN t LIKE '%tcexec%' OR t LIKE '%xlsm%' THEN 'phishing_attachment' END, CASE WHEN t LIKE '%shell%' OR t LIKE '%sh %' OR t LIKE '%bash%' OR t LIKE '%execfile%' THEN 'shell' END,
  CASE WHEN t LIKE '%callback%' OR t LIKE '%operator console%' OR t LIKE '%c2%' OR t LIKE '%drakon%' THEN 'callback' END, CASE WHEN t LIKE '%scan%' OR t LIKE '%netrecon%' THEN 'scan' END,
  CASE WHEN t LIKE '%rm %' OR t LIKE '%file deletion%' THEN 'cleanup' END], lambda x: x IS NOT NULL) AS tags FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def b28(spark, d):
    return table(spark, d, "documents").select("doc_id", X.tags("text", X.CHAIN_TAGS).alias("tags"))


@query("b29_action_allowed", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS kept, CASE WHEN event_type = 'view' THEN 'view' END AS strict FROM events")
def b29(spark, d):
    raw = F.concat(F.lit("EVENT_"), F.upper("event_type"))
    return table(spark, d, "events").select("event_id", X.action_allowed(raw, ["view", "click", "other"]).alias("kept"), X.action_allowed(raw, ["view"]).alias("strict"))


@query("b30_kb_tokens", """SELECT item_id, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.-]{2,}'), lambda x: lower(x))),
  lambda x: x NOT IN ('the','and','for','with','from','that','this','was','were','are','not','its','into','onto'))) AS tokens, trim(regexp_replace(lower(trim(text)), '[^a-z0-9]+', ' ', 'g')) AS name FROM benchmark""")
def b30(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.kb_tokens("text").alias("tokens"), X.normalize_name("text").alias("name"))


@query("b31_task_ids", "SELECT o_orderkey, 'task_' || CAST(o_orderkey AS VARCHAR) AS base, o_orderkey % 2 = 0 AS augmented FROM orders")
def b31(spark, d):
    t = F.concat(F.lit("task_"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("_aug007")).otherwise(F.lit("")))
    return table(spark, d, "orders").select("o_orderkey", X.base_task_id(t).alias("base"), X.is_augmented_task(t).alias("augmented"))


@query("b32_path_texts", duck("""SELECT DISTINCT object_key, CASE WHEN object_key LIKE '/etc/%' OR object_key LIKE '%bash%' THEN 'linux' ELSE 'unknown' END AS os, list_filter([CASE WHEN object_key LIKE '/etc/cron%' THEN 'scheduled task or service artifact' END,
  CASE WHEN object_key LIKE '/tmp/%' THEN 'temporary executable artifact' END, CASE WHEN object_key LIKE '/etc/passwd' THEN 'host discovery file' END], lambda x: x IS NOT NULL) AS semantics,
  ['credential', 'execution', 'network_c2'] AS families, ['curl', 'run.sh'] AS commands FROM pe WHERE object_type = 'file'"""))
def b32(spark, d):
    k = "object_key"
    return provenance(spark, d).where("object_type = 'file'").select(k, X.os_hint(k).alias("os"), X.path_semantics(k).alias("semantics"), X.action_families(F.array(F.lit("FORK"), F.lit("CONNECT")), F.lit("stole a Password")).alias("families"),
                                                                     X.command_lexemes(F.lit("run curl then run.sh and more")).alias("commands")).distinct()



