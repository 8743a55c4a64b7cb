"""Queries of sources and sinks: records of each kind are rendered from the events, written as files where files are read, and parsed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditloom.operators.scratch import scratch_dir
from auditloom.plans.fixture import duck, provenance, table
from auditloom.plans.registry import query
from auditloom.sources import logs as A

PRE = "com.bbn.tc.schema.avro.cdm18."


def written_text(df, label: str, **options) -> str:
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).text(path)
    return path


def fmt(pattern: str, *cols):
    return F.format_string(pattern, *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])


def cdm_lines(spark, d):
    """One event line for each event, with other text around some, and bad lines."""
    e = provenance(spark, d).withColumn("nanos", (F.col("us") * 1000).cast("string"))
    line = fmt('{"datum":{"' + PRE + 'Event":{"type":"EVENT_%s","timestampNanos":%s,"subject":{"' + PRE + 'UUID":"%s"},"predicateObject":{"' + PRE + 'UUID":{"string":"%s"}},"predicateObjectPath":{"string":"%s"}}}}', "event_type", "nanos", "process_guid", "event_id", "object_key")
    return e.select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("noise "), line, F.lit(" tail"))).when(F.col("event_id") % 97 == 1, F.substring(line, 1, 90)).otherwise(line).alias("line"))


@query("a01_read_log_lines", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def a01(spark, d):
    path = written_text(cdm_lines(spark, d).select("line"), "log", compression="gzip")
    return A.read_log_lines(spark, path, numbered=True).agg(F.count("*").alias("n"), F.count_distinct("raw_log_id").alias("ids"))


@query("a02_filter_host_lines", "SELECT event_id FROM events WHERE user_id % 10 = 3")
def a02(spark, d):
    lines = table(spark, d, "events").select("event_id", fmt("x SYSclient000%s y", F.col("user_id") % 10).alias("line"))
    return A.filter_host_lines(lines, "SysClient0003").select("event_id")


@query("a03_json_fragment", "SELECT event_id, event_id % 97 <> 1 OR event_id % 5 = 0 AS fine FROM events")
def a03(spark, d):
    return cdm_lines(spark, d).select("event_id", A.extract_json_fragment("line").isNotNull().alias("fine"))


@query("a04_cdm_events", duck("SELECT process_guid AS subject, CAST(event_id AS VARCHAR) AS object, event_type AS action, us // 1000000 AS seconds, object_key AS hint FROM pe WHERE event_id % 97 <> 1 OR event_id % 5 = 0"))
def a04(spark, d):
    return A.cdm_events(cdm_lines(spark, d))


@query("a05_cdm_subjects", duck("SELECT DISTINCT process_guid AS uuid, coalesce(parent_process_guid, '') AS parent FROM pe"))
def a05(spark, d):
    s = provenance(spark, d).select("process_guid", "parent_process_guid").distinct()
    line = F.when(F.col("parent_process_guid").isNull(), fmt('{"datum":{"' + PRE + 'Subject":{"uuid":"%s"}}}', "process_guid")).otherwise(fmt('{"datum":{"' + PRE + 'Subject":{"uuid":{"string":"%s"},"parentSubject":{"' + PRE + 'UUID":"%s"}}}}', "process_guid", "parent_process_guid"))
    return A.cdm_subjects(s.select(line.alias("line")))


@query("a06_cdm_nodes", duck("SELECT DISTINCT object_key AS uuid, object_type AS node_type, CASE WHEN object_type = 'file' THEN object_key ELSE '1.2.3.4:5->' || right(object_key, 5) END AS node_attr FROM pe UNION SELECT DISTINCT process_guid, 'process', process_name || ' -x' FROM pe"))
def a06(spark, d):
    e = provenance(spark, d)
    o = e.select("object_type", "object_key").distinct()
    file = fmt('{"datum":{"' + PRE + 'FileObject":{"uuid":"%s","baseObject":{"properties":{"map":{"filename":"%s"}}}}}}', "object_key", "object_key")
    flow = fmt('{"datum":{"' + PRE + 'NetFlowObject":{"uuid":"%s","localAddress":"1.2.3.4","localPort":5,"remoteAddress":{"string":"%s"}}}}', "object_key", F.expr("right(object_key, 5)"))
    s = e.select(fmt('{"datum":{"' + PRE + 'Subject":{"uuid":"%s","cid":7,"properties":{"map":{"cmdLine":"%s -x"}}}}}', "process_guid", "process_name").alias("line")).distinct()
    return A.cdm_nodes(o.select(F.when(F.col("object_type") == "file", file).otherwise(flow).alias("line")).union(s))


def ecar_lines(spark, d):
    e = provenance(spark, d)
    return e.select(F.concat(F.lit("x: "), fmt('{"action":"%s","object":"%s","actorID":"%s","objectId":"%s","timestamp":"%s","properties":{"file_path":"%s"}}', "event_type", F.upper("object_type"), "process_guid", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "object_key")).alias("line"))


@query("a07_ecar_events", duck("SELECT process_guid AS subject, CAST(event_id AS VARCHAR) AS object, event_type AS action, us // 1000000 AS seconds, object_type AS kind FROM pe"))
def a07(spark, d):
    return A.ecar_events(ecar_lines(spark, d))


@query("a07_ecar_nodes", duck("SELECT CAST(event_id AS VARCHAR) AS uuid, object_type AS node_type, object_key AS node_attr FROM pe"))
def a07n(spark, d):
    return A.ecar_nodes(ecar_lines(spark, d))


@query("a08_etw_events", duck("""SELECT 'proc::' || user_id AS subject, CASE WHEN event_type IN ('SEND', 'RECV') THEN 'flow::' || event_type || '::10.0.0.5:4000->9.9.9.9:443' WHEN event_type = 'EXEC' THEN 'file::' || object_key ELSE 'file::' || object_key END AS object, CASE event_type WHEN 'EXEC' THEN 'LOAD' ELSE event_type END AS action,
 CAST(event_id AS DOUBLE) AS seconds, object_type AS kind, CASE event_type WHEN 'RECV' THEN '10.0.0.5:4000' WHEN 'SEND' THEN '9.9.9.9:443' END AS remote FROM pe"""))
def a08(spark, d):
    return A.etw_events(etw_lines(spark, d))


def etw_lines(spark, d):
    name = F.create_map(*[F.lit(x) for x in ("READ", "FileIO/Read", "WRITE", "FileIO/Write", "EXEC", "Image/Load", "SEND", "TcpIp/Send", "RECV", "TcpIp/Recv")])
    line = fmt('{"EventName":"%s","MSec":"%s","PID":"%s","PName":"%s","FileName":"%s","saddr":"10.0.0.5","sport":4000,"daddr":"9.9.9.9","dport":443}', name[F.col("event_type")], F.col("event_id") * 1000, "user_id", "process_name", "object_key")
    return provenance(spark, d).select(line.alias("line"))


@query("a08_etw_nodes", duck("""SELECT 'proc::' || user_id AS uuid, 'process' AS node_type, process_name AS node_attr FROM pe
UNION ALL SELECT CASE WHEN object_type = 'flow' THEN 'flow::' || event_type || '::10.0.0.5:4000->9.9.9.9:443' ELSE 'file::' || object_key END, object_type, CASE WHEN object_type = 'flow' THEN '10.0.0.5:4000->9.9.9.9:443' ELSE object_key END FROM pe"""))
def a08n(spark, d):
    return A.etw_nodes(etw_lines(spark, d))


@query("a09_triples", duck("""SELECT '<urn:event:' || event_id || '> <urn:p:subject> <urn:node:' || process_guid || '> .' AS value FROM pe UNION ALL SELECT '<urn:event:' || event_id || '> <urn:p:object> <urn:node:' || process_name || '> .' FROM pe UNION ALL SELECT '<urn:event:' || event_id || '> <urn:p:action> "' || event_type || '" .' FROM pe"""))
def a09(spark, d):
    return A.triples(provenance(spark, d).select("event_id", F.col("process_guid").alias("subject"), F.col("process_name").alias("object"), F.col("event_type").alias("action")))


@query("a11_read_id_list", duck("SELECT DISTINCT process_guid AS node_id FROM pe"))
def a11(spark, d):
    return A.read_id_list(spark, written_text(provenance(spark, d).select(F.concat(F.lit(" "), "process_guid", F.when(F.col("event_id") % 2 == 0, F.lit("\n\n")).otherwise(F.lit("")))), "ids"))


@query("a12_typed_ground_truth", duck("SELECT DISTINCT object_key AS node_id, 'file' AS entity_type FROM pe WHERE object_type = 'file'"))
def a12(spark, d):
    path = f"{scratch_dir(spark)}/gt-{uuid.uuid4().hex}"
    provenance(spark, d).select(F.col("object_key").alias("uuid"), F.when(F.col("object_type") == "file", "File").otherwise("other").alias("type")).write.csv(path, header=True)
    return A.read_typed_ground_truth(spark, path)


@query("a13_read_gt_windows", "SELECT CAST(o_orderkey AS VARCHAR) AS window_id, 'confirmed' AS status, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 AS \"start\", ['EXECUTION'] AS gt_tactics FROM orders")
def a13(spark, d):
    o = table(spark, d, "orders")
    one = fmt('{"windows":[{"window_id":"%s","host":"h","status":"confirmed","start_time":"%s","confirmed_tactics":["TA0002"]}]}', "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    inner = F.regexp_extract(one, r"^\{.windows.:\[(.*)\]\}$", 1)
    path = documents(o.select(F.floor(F.col("o_orderkey") / 4000).alias("part"), inner.alias("one")), "windows", '{"windows":[', "]}")
    return A.read_gt_windows(spark, path, "h").select("window_id", "status", F.col("start").cast("long").alias("start"), "gt_tactics")


def documents(rows, label: str, head: str, tail: str) -> str:
    """A folder with one JSON document for each `part`, a list of its rows (column one), as a reader of whole documents expects them; parts are of bounded size."""
    path = f"{scratch_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    doc = rows.groupBy("part").agg(F.concat(F.lit(head), F.concat_ws(",", F.collect_list("one")), F.lit(tail)).alias("value"))
    doc.write.partitionBy("part").text(path)
    return path


@query("a10_read_stix", """SELECT 'T' || (1000 + item_id) AS external_id, 'technique' AS object_type, 'Name ' || item_id AS name, text AS description, [CASE item_id % 3 WHEN 0 THEN 'TA0001' WHEN 1 THEN 'TA9000' ELSE 'TA0002' END] AS tactic_ids FROM benchmark WHERE item_id % 7 <> 0 AND item_id % 5 <> 4
UNION ALL SELECT DISTINCT 'TA9000', 'tactic', 'Made up', 'A tactic of its own', ['TA9000'] FROM benchmark""")
def a10(spark, d):
    """A bundle of the benchmark's items as techniques (every seventh revoked, every fifth of another kind) and one tactic of its own."""
    b = table(spark, d, "benchmark")
    phase = F.element_at(F.array(F.lit("initial-access"), F.lit("made-up"), F.lit("execution")), (F.col("item_id") % 3 + 1).cast("int"))
    refs = lambda id_: F.array(F.struct(F.lit("other").alias("source_name"), F.lit("X-1").alias("external_id")), F.struct(F.lit("mitre-attack").alias("source_name"), id_.alias("external_id")))
    item = F.struct(F.when(F.col("item_id") % 5 == 4, "malware").otherwise("attack-pattern").alias("type"), F.concat(F.lit("Name "), F.col("item_id").cast("string")).alias("name"), F.col("text").alias("description"), (F.col("item_id") % 7 == 0).alias("revoked"),
                    refs(F.concat(F.lit("T"), (1000 + F.col("item_id")).cast("string"))).alias("external_references"), F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), phase.alias("phase_name"))).alias("kill_chain_phases"))
    own = F.struct(F.lit("x-mitre-tactic").alias("type"), F.lit("Made up").alias("name"), F.lit("A tactic of its own").alias("description"), F.lit("made-up").alias("x_mitre_shortname"), refs(F.lit("TA9000")).alias("external_references"))
    first = b.agg(F.min("item_id").alias("item_id")).where("item_id is not null").select(F.lit(-1).cast("long").alias("part"), F.to_json(own).alias("one"))
    rows = b.select(F.floor(F.col("item_id") / 100).alias("part"), F.to_json(item).alias("one")).union(first)
    return A.read_stix(spark, documents(rows, "bundle", '{"objects":[', "]}"))


@query("a14_gt_markdown", "SELECT 'h' || CAST(o_custkey % 3 AS VARCHAR) AS host, strftime(o_orderdate, '%Y-%m-%d') AS day, '10:05' AS from_time, '11:00' AS to_time, ['T1105'] AS attack_ids FROM orders")
def a14(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.concat(F.lit("## H"), (F.col("o_custkey") % 3).cast("string")).alias("h"), fmt("| %s 10:05-11:00 | T1105 |", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("r"))
    lines = o.select("file", F.posexplode(F.array("h", F.lit("| time | ids |"), "r")).alias("number", "line"))
    return A.parse_gt_markdown(lines).drop("window_id")


@query("a15_write_outputs", duck("SELECT task_id, count(*) AS n FROM pe GROUP BY task_id"))
def a15(spark, d):
    path = f"{scratch_dir(spark)}/out-{uuid.uuid4().hex}"
    A.write_outputs(provenance(spark, d).select("task_id", "event_id", "event_type"), path, "json")
    return spark.read.schema("event_id long, event_type string, task_id string").json(path).groupBy("task_id").agg(F.count("*").alias("n"))


@query("a16_export_embeddings", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS emb_0, CAST(embedding[64] AS DOUBLE) AS emb_63, 0.0 AS emb_64 FROM embeddings")
def a16(spark, d):
    return A.export_embeddings(table(spark, d, "embeddings"), "vec_id", "embedding", 65).select("vec_id", "emb_0", "emb_63", "emb_64")


@query("a17_read_code_table", "SELECT p_name AS key, p_partkey AS code FROM part")
def a17(spark, d):
    return A.read_code_table(spark, written_text(table(spark, d, "part").select(F.concat_ws("#", "p_name", F.col("p_partkey").cast("string"))), "codes")).withColumn("code", F.col("code").cast("long"))
