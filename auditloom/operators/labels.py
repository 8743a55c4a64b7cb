"""Behaviour labels, their propagation, bridges between processes, and staged objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.functions import settings as S
from auditloom.operators.compact import by_object, by_process, optional
from auditloom.operators.scratch import written


def written_then_executed(access: DataFrame) -> DataFrame:
    """Objects (task_id, object_key) written, created or renamed and executed, loaded or mapped later; system files do not count."""
    t = F.col("event_type")
    ends = access.where(~F.col("object_class").isin("system_library", "system_resource")).groupBy("task_id", "object_key").agg(
        F.min(F.when(t.isin(S.BRIDGE_WRITES), F.col("order_index"))).alias("_w"), F.max(F.when(t.isin(S.EXECUTIONS), F.col("order_index"))).alias("_x"))
    return ends.where("_w < _x").select("task_id", "object_key")


def behaviour_labels(events: DataFrame, process_labels: DataFrame, object_labels: DataFrame) -> DataFrame:
    """(task_id, event_id, process_guid, label): behaviours of each event by the final labels of its ends. process_labels and object_labels are (task_id, entity, label)."""
    p = process_labels.groupBy("task_id", F.col("entity").alias("process_guid")).agg(F.collect_set("label").alias("_p"))
    o = object_labels.groupBy("task_id", F.col("entity").alias("object_key")).agg(F.collect_set("label").alias("_o"))
    df = events.join(p, ["task_id", "process_guid"], "left").join(o, ["task_id", "object_key"], "left")
    t, c, name, cmd = F.col("event_type"), F.col("object_class"), F.lower("process_name"), F.lower(X.text(optional(events, "process_cmdline")))

    def has(col: str, *labels: str) -> Column:
        return F.coalesce(F.arrays_overlap(F.col(col), F.array(*[F.lit(x) for x in labels])), F.lit(False))

    context = has("_p", "P_WEB_CTX", "P_REMOTE_CTX", "P_SUSPECT_CTRL_CTX")
    group = S.PROCESS_TYPES
    port = F.col("remote_port") if "remote_port" in events.columns else X.flow_endpoints("object_key")["remote_port"]
    rules = {
        "B_EXTERNAL_RECV": (t == "RECV") & (c == "external_ip"), "B_EXTERNAL_SEND": (t == "SEND") & (c == "external_ip"), "B_EXEC_TEMP": (t == "EXEC") & (c == "temp_file"),
        "B_EXEC_DOWNLOADED": t.isin("EXEC", "LOAD") & has("_o", "O_FILE_DOWNLOADED"), "B_EXEC_UPLOADED": t.isin("EXEC", "LOAD") & has("_o", "O_FILE_UPLOADED"),
        "B_EXEC_SUSPECT_WRITTEN": t.isin("EXEC", "LOAD") & has("_o", "O_SUSPECT_WRITTEN_EXECUTABLE"),
        "B_SHELL_SPAWN": name.isin(group["shell"]) & (context | X.contains_any(cmd, [" -c ", "curl", "wget", "nc ", "socat", "/tmp/", "/dev/shm/"])),
        "B_SCRIPT_EXEC": name.isin(group["interpreter"]) & (context | X.contains_any(cmd, ["http://", "https://", "/tmp/", "/dev/shm/", "-c "])),
        "B_INTERPRETER_LAUNCH": name.isin(group["interpreter"]), "B_READ_CRED": (t == "READ") & (c == "credential_file"), "B_READ_HISTORY": (t == "READ") & (c == "history_file"),
        "B_READ_BUSINESS": (t == "READ") & (c == "business_file"), "B_WRITE_PERSISTENCE": t.isin(S.BRIDGE_WRITES) & (c == "persistence_file"),
        "B_WRITE_PRIV_CONFIG": t.isin("WRITE", "CHMOD", "CHOWN") & (c == "privilege_file"), "B_ARCHIVE_DATA": name.isin(group["archive_tool"]) | (c == "archive_file"),
        "B_DELETE_LOG": t.isin("DELETE", "RENAME", "WRITE") & (c == "log_file"), "B_LATERAL_CONNECT": t.isin("CONNECT", "SEND") & (c == "internal_ip") & port.isin(S.LATERAL_PORTS),
        "B_REMOTE_LOGIN_SERVICE": name.isin(group["remote_service"]) & t.isin("ACCEPT", "RECV"), "B_WEB_WRITE": t.isin("WRITE", "CREATE") & F.lower("object_key").contains("upload"),
        "P_HIGH_VALUE_CTX": (t == "READ") & c.isin("credential_file", "history_file", "business_file"),
    }
    return df.select("task_id", "event_id", "process_guid", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))).alias("label"))


def mass_file_access(events: DataFrame, n: int = 100, window: str = "1 minute") -> DataFrame:
    """(task_id, process_guid, start_us, objects): windows in which a process read at least n distinct sensitive or user files."""
    e = events.where("event_type = 'READ' and object_type = 'file'")
    w = F.window(F.timestamp_micros("us"), window)
    return e.groupBy("task_id", "process_guid", w.alias("w")).agg(F.count_distinct("object_key").alias("objects")).where(F.col("objects") >= n).select("task_id", "process_guid", F.unix_micros("w.start").alias("start_us"), "objects")


def inherit_split_labels(labels: DataFrame, roots: DataFrame, parent_map: DataFrame) -> DataFrame:
    """labels (task_id, entity, label) with those that a split task's root held in its parent task, parents first.

    Only labels that are new in a round go on, so rounds are at most the longest chain of parent tasks; in a cycle of parents labels go round once. Rows that repeat
    count once, null tasks and roots inherit nothing, and an empty table gives an empty result."""
    key = ["task_id", "entity", "label"]
    link = written(roots.select("task_id", F.col("root").alias("entity")).join(parent_map.select("task_id", "parent_task"), "task_id").distinct(), "split")
    new = written(labels.select(*key).distinct(), "split")
    out = new
    while not new.isEmpty():
        got = link.join(new.withColumnRenamed("task_id", "parent_task"), ["parent_task", "entity"]).select(*key).distinct()
        new = written(got.join(out, key, "left_anti"), "split")
        out = out.union(new)
    return out


def propagate_labels(labels: DataFrame, processes: DataFrame) -> DataFrame:
    """labels (task_id, entity, label) with status labels of ancestors, as deep as each label goes, counted from its first holders.

    processes (task_id, process_guid, parent_process_guid, process_name). A common daemon passes labels only to shells,
    interpreters, downloaders, network tools and unknown binaries. One join for each level; there are four at most."""
    depth = F.create_map(*[F.lit(x) for kv in S.STATUS_DEPTHS.items() for x in kv])
    kind = X.classify_process_type(F.col("process_name"), optional(processes, "process_exe"))
    child = processes.select("task_id", F.col("parent_process_guid").alias("entity"), F.col("process_guid").alias("child"), kind.alias("_kind"))
    name = processes.select("task_id", F.col("process_guid").alias("entity"), F.lower("process_name").alias("_name"))
    edge = child.join(name, ["task_id", "entity"], "left").where(~F.coalesce(F.col("_name").isin(S.PROCESS_TYPES["common_daemon"]), F.lit(False)) | F.col("_kind").isin(S.DAEMON_CHILD_TYPES)).select("task_id", "entity", "child")
    base = labels.select("task_id", "entity", "label").distinct()
    level = base.where(F.col("label").isin(list(S.STATUS_DEPTHS)))
    out = base
    for k in range(1, max(S.STATUS_DEPTHS.values()) + 1):
        level = level.where(depth[F.col("label")] >= k).join(edge, ["task_id", "entity"]).select("task_id", F.col("child").alias("entity"), "label").distinct()
        out = out.union(level)
    return out.distinct()


def child_suspicious(labels: DataFrame, processes: DataFrame) -> DataFrame:
    """Parents (task_id, entity, label A_CHILD_SUSPICIOUS) of a process with a behaviour, untrusted or suspect label."""
    bad = labels.where(F.col("label").startswith("B_") | F.col("label").isin("P_UNTRUSTED_CTX", "P_SUSPECT_CTRL_CTX")).select("task_id", F.col("entity").alias("process_guid")).distinct()
    kids = processes.join(bad, ["task_id", "process_guid"], "left_semi")
    known = processes.select("task_id", F.col("process_guid").alias("parent_process_guid"))
    return kids.join(known, ["task_id", "parent_process_guid"], "left_semi").select("task_id", F.col("parent_process_guid").alias("entity"), F.lit("A_CHILD_SUSPICIOUS").alias("label")).distinct()


ALLOWED_BRIDGES = ["O_FILE_TEMP", "O_FILE_DOWNLOADED", "O_FILE_UPLOADED", "O_SUSPECT_WRITTEN_EXECUTABLE", "O_ARCHIVE", "O_PERSISTENCE", "O_PRIV_CONFIG"]
DENIED_BRIDGES = ["O_CREDENTIAL", "O_HISTORY", "O_BUSINESS_DATA", "O_NET_EXTERNAL", "O_NET_INTERNAL", "O_AUTH_CONFIG", "O_SECURITY_LOG"]


def bridge_edges(access: DataFrame, object_labels: DataFrame, gap_seconds: int = S.BRIDGE_GAP_SECONDS, limit: int | None = S.BRIDGES_PER_OBJECT) -> DataFrame:
    """Writes followed by a read or execution of the same version of the object by another process within the gap; a missing time passes.

    Only objects with an allowed label, without a denied one and of no system class take part; the first `limit` bridges of
    each object count, by write and then read, or all (None). Versions (the epochs) are join keys, so an object's accesses meet version by version,
    and as each write begins a version there are no more bridges than reads.
    """
    lab = object_labels.groupBy("task_id", F.col("entity").alias("object_key")).agg(F.collect_set("label").alias("labels"))
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    lab = lab.where(F.arrays_overlap("labels", arr(ALLOWED_BRIDGES)) & ~F.arrays_overlap("labels", arr(DENIED_BRIDGES)))
    a = access.where(~F.col("object_class").isin(S.DENIED_BRIDGE_CLASSES))
    w = a.where(F.col("event_type").isin(S.BRIDGE_WRITES)).select("task_id", "object_key", F.col("object_epoch_after").alias("epoch"), F.col("process_guid").alias("src"), F.col("event_id").alias("write_event"), F.col("order_index").alias("write_order"), F.col("us").alias("write_us"))
    r = a.where(F.col("event_type").isin(S.BRIDGE_READS)).select("task_id", "object_key", F.col("object_epoch_before").alias("epoch"), F.col("process_guid").alias("dst"), F.col("event_id").alias("read_event"), F.col("order_index").alias("read_order"), F.col("us").alias("read_us"), F.col("event_type").alias("read_type"))
    gap = F.col("read_us") - F.col("write_us")
    near = F.coalesce(gap.between(0, gap_seconds * 1_000_000), F.lit(True))
    pairs = w.join(r, ["task_id", "object_key", "epoch"]).where((F.col("read_order") > F.col("write_order")) & (F.col("src") != F.col("dst")) & near)
    pairs = pairs.join(lab, ["task_id", "object_key"]).drop("epoch")
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("task_id", "object_key").orderBy("write_order", "read_order"))
        pairs = pairs.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")
    return bridge_kinds(pairs)


def bridge_kinds(bridges: DataFrame) -> DataFrame:
    """bridges (read_type, labels of the object) plus bridge_type and confidence, with the labels in order."""
    own = lambda *v: F.arrays_overlap("labels", F.array(*[F.lit(x) for x in v]))
    executed = F.col("read_type").isin(S.EXECUTIONS)
    kind = X.cases([(executed, "write_to_exec"), (own("O_PERSISTENCE"), "persistence_follow_on"), (own("O_ARCHIVE"), "archive_follow_on")], F.lit("write_to_read"))
    sure = X.cases([(executed & own("O_FILE_TEMP", "O_FILE_DOWNLOADED", "O_FILE_UPLOADED", "O_SUSPECT_WRITTEN_EXECUTABLE"), 0.93), (own("O_PERSISTENCE", "O_PRIV_CONFIG"), 0.78), (own("O_ARCHIVE"), 0.66)], F.lit(0.55))
    return bridges.withColumn("bridge_type", kind).withColumn("confidence", sure).withColumn("labels", F.array_sort("labels"))


def bridge_labels(bridges: DataFrame) -> DataFrame:
    """Both ends of every bridge as (task_id, entity, label)."""
    return bridges.select("task_id", F.explode(F.array("src", "dst")).alias("entity"), F.lit("A_BRIDGED_BY_SUSPICIOUS_OBJECT").alias("label")).distinct()


STAGED_LABELS = ["O_FILE_DOWNLOADED", "O_FILE_UPLOADED", "O_SUSPECT_WRITTEN_EXECUTABLE", "O_FILE_TEMP"]
WRITES, CHMODS = ["WRITE", "CREATE", "TRUNCATE", "RENAME"], ["CHMOD", "MODIFY_FILE_ATTRIBUTES"]


def staged_objects(events: DataFrame, object_labels: DataFrame | None = None, seconds: int = 600) -> DataFrame:
    """Objects (task_id, object_key) under temporary paths, with a staged label, or written, made executable and executed within `seconds` at each step; a new write starts over."""
    e = events.where((X.text("object_key") != "") & ~X.is_placeholder_key("object_key") & ~X.is_system_service_key("object_key"))
    t, us = F.col("event_type"), F.col("us")
    write = F.last(F.when(t.isin(WRITES), us), ignorenulls=True).over(by_object(Window.unboundedPreceding, -1))
    e = e.withColumn("_w", write)
    good = t.isin(CHMODS) & (us - F.col("_w")).between(0, seconds * 1_000_000)
    # the last write or fitting chmod before: only after a chmod is the object ready
    step = F.last(F.when(t.isin(WRITES), F.struct(F.lit(False).alias("ok"), us.alias("us"))).when(good, F.struct(F.lit(True).alias("ok"), us.alias("us"))), ignorenulls=True).over(by_object(Window.unboundedPreceding, -1))
    e = e.withColumn("_s", step)
    run = t.isin(S.EXECUTIONS) & F.col("_s.ok") & (us - F.col("_s.us")).between(0, seconds * 1_000_000)
    out = e.where(F.coalesce(run, F.lit(False)) | X.is_temp_exec_path("object_key")).select("task_id", "object_key")
    if object_labels is not None:
        out = out.union(object_labels.where(F.col("label").isin(STAGED_LABELS)).select("task_id", F.col("entity").alias("object_key")).join(e.select("task_id", "object_key").distinct(), ["task_id", "object_key"], "left_semi"))
    return out.distinct()


def staged_events(events: DataFrame, staged: DataFrame, kinds: list[str], limit: int = 8) -> DataFrame:
    """The first `limit` events of the given kinds on staged objects of each task: (task_id, event_id, rank, base, process_name)."""
    e = events.where(F.col("event_type").isin(kinds)).join(staged, ["task_id", "object_key"], "left_semi")
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("order_index"))).where(F.col("rank") <= limit)
    return e.select("task_id", "event_id", "rank", X.basename("object_key").alias("base"), "process_name")


ELEVATE = ["elevate", "root privileges", "as root", "root access"]


def payload_elevate_events(events: DataFrame, staged: DataFrame, limit: int = 8) -> DataFrame:
    """First events of each task whose text speaks of elevation on a staged object, or that clone one; temporary paths do not count."""
    text = F.lower(F.concat_ws(" ", optional(events, "description"), "object_key", "process_name", optional(events, "process_cmdline")))
    hit = X.contains_any(text, ELEVATE) | (F.col("event_type") == "CLONE")
    e = events.where(hit & ~X.is_temp_exec_path("object_key")).join(staged, ["task_id", "object_key"], "left_semi")
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("order_index"))).where(F.col("rank") <= limit).select("task_id", "event_id", "rank")


def precursor_events(events: DataFrame, strong: list[str], weak: list[str], staging: Column, limit: int = 8) -> DataFrame:
    """First events with a strong marker (and then weak ones too), else weak ones if a task has two or more and shows staging. Markers are sought in the object key and name of the process."""
    text = F.lower(F.concat_ws(" ", "object_key", "process_name"))
    df = events.withColumn("_s", X.contains_any(text, strong)).withColumn("_w", X.contains_any(text, weak)).withColumn("_g", staging)
    per = df.groupBy("task_id").agg(F.bool_or("_s").alias("_any"), F.sum(F.col("_w").cast("int")).alias("_n"), F.bool_or("_g").alias("_staged"))
    df = df.join(per, "task_id").where((F.col("_any") & (F.col("_s") | F.col("_w"))) | (~F.col("_any") & F.col("_w") & (F.col("_n") >= 2) & F.col("_staged")))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("order_index"))).where(F.col("rank") <= limit).select("task_id", "event_id", "rank")


def previous_contact(events: DataFrame) -> DataFrame:
    """events plus the last network end that the process touched before."""
    last = F.last(F.when(F.col("object_type") == "flow", F.col("object_key")), ignorenulls=True).over(by_process(Window.unboundedPreceding, -1))
    return events.withColumn("last_contact", last)
