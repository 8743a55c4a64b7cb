"""Raw audit logs as DataFrames, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions import scalars as X

CDM = "com.bbn.tc.schema.avro.cdm18."


def read_log_lines(spark: SparkSession, path: str, host: str | None = None, numbered: bool = False) -> DataFrame:
    """(file, line): all lines below a path, plain or gzip. A host SysClientNNNN keeps files whose name holds its digits.

    With `numbered`, raw_log_id is `file:number`; numbers follow the order of the lines and cost a sort for each file."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    digits = "".join(c for c in host or "" if c.isdigit())
    if digits:
        lines = lines.where(F.regexp_extract("file", "([^/]*)$", 1).contains(digits))
    if numbered:
        n = F.row_number().over(Window.partitionBy("file").orderBy("_at"))
        lines = lines.withColumn("_at", F.monotonically_increasing_id()).withColumn("raw_log_id", F.concat_ws(":", F.regexp_extract("file", "([^/]*)$", 1), n.cast("string"))).drop("_at")
    return lines


def filter_host_lines(lines: DataFrame, host: str, col: str = "line") -> DataFrame:
    """Lines that hold the host's name in any case; null lines go."""
    return lines.where(F.lower(col).contains(host.lower()))


def extract_json_fragment(line: Column | str) -> Column:
    """The line as JSON text if it is an object, else its widest {...} part if that is one, else null."""
    t = X.text(line)
    part = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t).when((part != "") & F.try_parse_json(part).isNotNull(), part)


def _json(c: Column, *path: str) -> Column:
    return F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path))


def _scalar(c: Column, *path: str) -> Column:
    return X.blank_to_null(X.unwrap_scalar(_json(c, *path)))


def cdm_events(lines: DataFrame, col: str = "line") -> DataFrame:
    """(subject, object, action, seconds, hint) of CDM18 events; lines of other records, and events without an end, are dropped. A text filter keeps other lines from being parsed."""
    e = _json(extract_json_fragment(col), "datum", CDM + "Event")
    df = lines.where(F.col(col).contains(CDM + "Event")).withColumn("_e", e).where("_e is not null")
    v = F.col("_e")
    stamp = F.coalesce(*[X.blank_to_null(_json(v, k)) for k in ("timestampNanos", "timestampMicros", "timestampMillis", "timestamp")])
    return df.select(_scalar(v, "subject", CDM + "UUID").alias("subject"), _scalar(v, "predicateObject", CDM + "UUID").alias("object"), X.normalize_action(F.coalesce(_json(v, "type"), F.lit("EVENT_OTHER"))).alias("action"),
                     F.floor(X.to_epoch_seconds(stamp)).alias("seconds"), X.first_non_empty(_scalar(v, "predicateObjectPath"), _scalar(v, "predicateObject2Path")).alias("hint")).where("subject is not null and object is not null")


def cdm_subjects(lines: DataFrame, col: str = "line") -> DataFrame:
    """(uuid, parent): subjects, with an empty parent if there is none."""
    df = lines.where(F.col(col).contains(CDM + "Subject")).withColumn("_s", _json(extract_json_fragment(col), "datum", CDM + "Subject")).where("_s is not null")
    v = F.col("_s")
    return df.select(X.first_non_empty(_scalar(v, "uuid")).alias("uuid"), X.first_non_empty(_scalar(v, "parentSubject", CDM + "UUID"), _scalar(v, "parentSubject")).alias("parent")).where("uuid <> ''")


def cdm_nodes(lines: DataFrame, col: str = "line") -> DataFrame:
    """(uuid, node_type, node_attr) of every record with a uuid but events; the attribute is the first useful field of its kind."""
    datum = F.from_json(_json(extract_json_fragment(col), "datum"), "map<string,string>")
    df = lines.select(F.explode(F.map_entries(datum)).alias("x")).where(~F.col("x.key").endswith(".Event")).select(F.regexp_extract("x.key", r"([^.]*)$", 1).alias("branch"), F.col("x.value").alias("v"))
    v, p = F.col("v"), ["properties", "map"]
    base = ["baseObject", "properties", "map"]
    subject = X.first_non_empty(_scalar(v, "cmdLine"), _scalar(v, *p, "cmdLine"), _scalar(v, *p, "path"), _scalar(v, "path"), _scalar(v, "name"), _scalar(v, *p, "name"), _scalar(v, "cid"))
    file = X.first_non_empty(_scalar(v, "path"), _scalar(v, "filename"), _scalar(v, *base, "filename"), _scalar(v, *p, "filename"), _scalar(v, *base, "path"), _scalar(v, *p, "path"), _scalar(v, "fileDescriptor"), _scalar(v, "type"))
    end = lambda a, b: F.concat_ws(":", _scalar(v, a), _scalar(v, b))
    flow = F.concat(end("localAddress", "localPort"), F.lit("->"), end("remoteAddress", "remotePort"))
    other = X.first_non_empty(_scalar(v, "key"), _scalar(v, "hostName"), _scalar(v, "username"), _scalar(v, "name"), _scalar(v, "type"))
    b = F.col("branch")
    attr = F.when(b == "Subject", subject).when(b.contains("File"), file).when(b.contains("NetFlow"), flow).otherwise(other)
    return df.select(X.first_non_empty(_scalar(v, "uuid")).alias("uuid"), X.normalize_node_type(b).alias("node_type"), attr.alias("node_attr")).where("uuid <> ''")


def ecar_events(lines: DataFrame, col: str = "line") -> DataFrame:
    """(subject, object, action, seconds, kind) of flat eCAR records, also wrapped in other text; fields by their aliases."""
    df = lines.withColumn("_j", extract_json_fragment(col)).where("_j is not null")
    v = F.col("_j")
    pick = lambda *names: F.coalesce(*[X.blank_to_null(_json(v, n)) for n in names])
    return df.select(pick("actorID", "actorId", "subjectID").alias("subject"), pick("objectID", "objectId").alias("object"), X.normalize_action(F.coalesce(pick("action"), F.lit("OTHER"))).alias("action"),
                     F.floor(X.to_epoch_seconds(pick("timestamp", "timestamp_ms"))).alias("seconds"), X.normalize_node_type(pick("object")).alias("kind")).where("subject is not null and object is not null")


def ecar_nodes(lines: DataFrame, col: str = "line") -> DataFrame:
    """(uuid, node_type, node_attr) of the objects of eCAR records."""
    v = F.col("_j")
    df = lines.withColumn("_j", extract_json_fragment(col)).where("_j is not null")
    attr = X.first_non_empty(_json(v, "properties", "command_line"), _json(v, "properties", "file_path"), _json(v, "properties", "image_path"), _json(v, "properties", "key"), F.concat(
        _json(v, "properties", "src_ip"), F.lit(":"), _json(v, "properties", "src_port"), F.lit("->"), _json(v, "properties", "dest_ip"), F.lit(":"), _json(v, "properties", "dest_port")))
    return df.select(X.first_non_empty(_json(v, "objectID"), _json(v, "objectId")).alias("uuid"), X.normalize_node_type(_json(v, "object")).alias("node_type"), attr.alias("node_attr")).where("uuid <> ''")


#: Windows event names by substring, in the order in which they are tried: (substring, action, kind). Fixed values.
ETW_ACTIONS = [("fileio/write", "WRITE", "file"), ("fileio/read", "READ", "file"), ("fileio/create", "CREATE", "file"), ("fileio/delete", "DELETE", "file"), ("fileio/rename", "RENAME", "file"), ("tcpip/recv", "RECV", "flow"), ("tcpip/send", "SEND", "flow"),
               ("tcpip/connect", "CONNECT", "flow"), ("process/start", "FORK", "process"), ("image/load", "LOAD", "file")]


def _etw(lines: DataFrame, col: str) -> DataFrame:
    """Fields of Windows trace records: v, action, kind, subject, object, src and dst."""
    df = lines.withColumn("_j", extract_json_fragment(col)).where("_j is not null")
    v, name = F.col("_j"), F.lower(F.coalesce(_json(F.col("_j"), "EventName"), F.lit("")))
    action = X.cases([(name.contains(m), a) for m, a, _ in ETW_ACTIONS], F.lit("OTHER"))
    kind = X.cases([(name.contains(m), k) for m, _, k in ETW_ACTIONS], F.lit("object"))
    src, dst = F.concat_ws(":", _pick(v, "saddr", "SrcAddr"), _pick(v, "sport", "SrcPort")), F.concat_ws(":", _pick(v, "daddr", "DstAddr"), _pick(v, "dport", "DstPort"))
    obj = F.when(kind == "file", F.concat(F.lit("file::"), _pick(v, "FileName", "OpenPath", "Path"))).when(kind == "flow", F.concat(F.lit("flow::"), action, F.lit("::"), src, F.lit("->"), dst)).when(kind == "process", F.concat(F.lit("proc::"), _pick(v, "ChildPID", "ProcessID")))
    return df.select(v.alias("v"), action.alias("action"), kind.alias("kind"), F.concat(F.lit("proc::"), _pick(v, "PID", "ProcessId")).alias("subject"), obj.alias("object"), src.alias("src"), dst.alias("dst"))


def _pick(v: Column, *names: str) -> Column:
    return F.coalesce(*[X.blank_to_null(_json(v, n)) for n in names])


def etw_events(lines: DataFrame, col: str = "line") -> DataFrame:
    """(subject, object, action, seconds, kind) of Windows trace records: `proc::pid`, `file::path` and `flow::action::source->destination`; the remote side is the source of a receive."""
    remote = F.when(F.col("action") == "RECV", F.col("src")).otherwise(F.col("dst"))
    seconds = _pick(F.col("v"), "MSec", "TimeStampRelativeMSec").try_cast("double") / 1000
    return _etw(lines, col).select("subject", "object", "action", seconds.alias("seconds"), "kind", F.when(F.col("kind") == "flow", remote).alias("remote")).where("subject is not null and object is not null")


def etw_nodes(lines: DataFrame, col: str = "line") -> DataFrame:
    """(uuid, node_type, node_attr) of both ends of Windows trace records of a known action, with the ids of etw_events.

    The attribute is the process's name, else its id; the file's path; the flow's ends. An object without an id leaves its subject."""
    df, v = _etw(lines, col).where("kind <> 'object' and subject is not null"), F.col("v")
    number = lambda c: F.substring_index(c, "::", -1)
    name = F.coalesce(_pick(v, "PName", "ProcessName", "ImageFileName", "ImageName"), number(F.col("subject")))
    kind = F.col("kind")
    attr = F.when(kind == "process", F.coalesce(_pick(v, "ImageName", "ProcessName", "TargetProcessName", "NewProcessName"), number(F.col("object")))).when(kind == "file", _pick(v, "FileName", "OpenPath", "Path")).otherwise(F.concat("src", F.lit("->"), "dst"))
    known = F.col("object").isNotNull() & ((kind != "flow") | (F.concat("src", "dst") != ""))
    node = lambda i, t, a: F.struct(i.alias("uuid"), t.alias("node_type"), a.alias("node_attr"))
    ends = F.array(node(F.col("subject"), F.lit("process"), name), F.when(known, node(F.col("object"), kind, attr)))
    return df.select(F.explode(F.array_compact(ends)).alias("n")).select("n.*")


def triples(events: DataFrame) -> DataFrame:
    """N-Triples lines (column value) of events (event_id, subject, object, action); write them with `.write.text`."""
    e = F.concat(F.lit("<urn:event:"), F.col("event_id").cast("string"), F.lit(">"))
    line = lambda p, o: F.concat(e, F.lit(f" <urn:p:{p}> "), o, F.lit(" ."))
    iri = lambda c: F.concat(F.lit("<urn:node:"), F.url_encode(c), F.lit(">"))
    return events.select(F.explode(F.array(line("subject", iri(F.col("subject"))), line("object", iri(F.col("object"))), line("action", F.concat(F.lit('"'), F.col("action"), F.lit('"'))))).alias("value"))


#: Tactics of public ATT&CK phase names. Fixed values.
PHASES = {"initial-access": "TA0001", "execution": "TA0002", "persistence": "TA0003", "privilege-escalation": "TA0004", "defense-evasion": "TA0005", "credential-access": "TA0006", "discovery": "TA0007", "lateral-movement": "TA0008",
          "collection": "TA0009", "exfiltration": "TA0010", "command-and-control": "TA0011", "impact": "TA0040", "resource-development": "TA0042", "reconnaissance": "TA0043"}


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    """(external_id, object_type, name, description, tactic_ids) of the tactics and techniques of a STIX bundle; phases resolve by the bundle's own tactics, else by the public names."""
    schema = "objects array<struct<type:string,name:string,description:string,x_mitre_shortname:string,revoked:boolean,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<phase_name:string>>>>"
    o = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*").where("type in ('x-mitre-tactic', 'attack-pattern') and not coalesce(revoked, false)")
    o = o.withColumn("external_id", F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")[0]["external_id"])
    own = o.where("type = 'x-mitre-tactic'").select(F.col("x_mitre_shortname").alias("phase"), F.col("external_id").alias("_t"))
    names = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    t = o.where("type = 'attack-pattern'").select("external_id", F.explode("kill_chain_phases.phase_name").alias("phase")).join(F.broadcast(own), "phase", "left").select("external_id", F.coalesce("_t", names[F.col("phase")]).alias("_t")).groupBy("external_id").agg(F.array_sort(F.collect_set("_t")).alias("tactic_ids"))
    return o.join(t, "external_id", "left").select("external_id", F.when(F.col("type") == "attack-pattern", "technique").otherwise("tactic").alias("object_type"), "name", "description", F.coalesce("tactic_ids", F.array("external_id")).alias("tactic_ids"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank lines as node_id."""
    return spark.read.text(path).select(F.trim("value").alias("node_id")).where("node_id <> ''").distinct()


def read_typed_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, entity_type) of a CSV with a header: uuid and type; types outside subject, file and netflow are dropped."""
    return spark.read.schema("node_id string, entity_type string").csv(path, header=True).select(F.trim("node_id").alias("node_id"), F.lower(F.trim("entity_type")).alias("entity_type")).where("node_id <> '' and entity_type in ('subject', 'file', 'netflow')").distinct()


def read_gt_windows(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    """(window_id, host, status, precision, start, end, techniques, tactics) of a JSON list of attack windows."""
    schema = "windows array<struct<window_id:string,host:string,status:string,time_precision:string,start_time:string,end_time:string,confirmed_techniques:array<string>,confirmed_tactics:array<string>>>"
    w = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("windows").alias("w")).select("w.*")
    w = w.select("window_id", "host", "status", F.col("time_precision").alias("precision"), F.try_to_timestamp("start_time").alias("start"), F.try_to_timestamp("end_time").alias("end"), F.col("confirmed_techniques").alias("gt_techniques"), F.transform("confirmed_tactics", X.canonical_tactic).alias("gt_tactics"))
    return w.where(F.col("host") == host) if host else w


def parse_gt_markdown(lines: DataFrame) -> DataFrame:
    """Windows of markdown tables below host headings: lines (file, number, line) -> window_id, host, day, from_time, to_time, attack_ids.

    The heading is carried down by number; a row counts if a cell holds `yyyy-MM-dd HH:mm[-HH:mm]`. The id is host, time and the row's place within the host."""
    w = Window.partitionBy("file").orderBy("number")
    heading = F.regexp_extract("line", r"^#+\s*(\S+)", 1)
    df = lines.withColumn("host", F.last(F.when(heading != "", F.lower(heading)), ignorenulls=True).over(w)).where(F.col("line").startswith("|") & F.col("host").isNotNull())
    when = r"(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2})(?:\s*-\s*(\d{2}:\d{2}))?"
    df = df.where(F.col("line").rlike(when)).select("host", "file", "number", F.regexp_extract("line", when, 1).alias("day"), F.regexp_extract("line", when, 2).alias("from_time"), F.regexp_extract("line", when, 3).alias("_to"), X.extract_attack_ids("line").alias("attack_ids"))
    n = F.row_number().over(Window.partitionBy("host").orderBy("file", "number"))
    return df.withColumn("to_time", F.when(F.col("_to") != "", F.col("_to")).otherwise(F.col("from_time"))).withColumn("window_id", F.concat_ws("_", "host", F.regexp_replace("day", "-", ""), F.regexp_replace("from_time", ":", ""), n.cast("string"))).select("window_id", "host", "day", "from_time", "to_time", "attack_ids")


def write_outputs(df: DataFrame, path: str, fmt: str = "parquet", by: str = "task_id") -> None:
    """One folder for each task, whatever the number of tasks."""
    df.write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def export_embeddings(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """Wide table (id, emb_0 ..), zero where a vector is short; write it ordered by id as CSV."""
    return vectors.select(F.col(id_col), *[F.coalesce(F.get(F.col(vec_col), F.lit(i)).cast("double"), F.lit(0.0)).alias(f"emb_{i}") for i in range(dims)])


def read_code_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, code) of `key#code` lines."""
    parts = F.split(F.trim("value"), "#")
    return spark.read.text(path).where("value like '%#%'").select(parts[0].alias("key"), parts[1].try_cast("int").alias("code"))
