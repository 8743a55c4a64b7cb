"""Behaviour claims of paths and their mapping to ATT&CK, the deterministic way.

Timelines are (path_id, event_id, order_index, us, process_guid, process_name, event_type, object_type, object_class, object_key, description,
labels_triggered, object_labels), in order of time. A behaviour is claimed once for each path at most, so its name is the claim's id there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.functions import settings as S
from auditloom.operators import labels as L
from auditloom.operators.identity import overlap_join
from auditloom.operators.scratch import written

#: atom: (stage, tactics, techniques, prerequisite atoms). Fixed values.
ATOMS = {
    "untrusted_read": ("Initial Compromise", ["TA0001"], [], []),
    "make_mem_exec": ("Initial Compromise", ["TA0002"], [], ["untrusted_read"]),
    "make_file_exec": ("Initial Compromise", ["TA0002"], [], ["untrusted_read"]),
    "untrusted_file_exec": ("Initial Compromise", ["TA0002", "TA0011"], ["T1105"], ["untrusted_read", "make_file_exec", "attachment_user_exec"]),
    "attachment_user_exec": ("Initial Compromise", ["TA0001", "TA0002"], ["T1566.001", "T1566.002", "T1204.002"], ["untrusted_read"]),
    "shell_exec": ("Establish Foothold", ["TA0002"], ["T1059"], ["untrusted_file_exec", "attachment_user_exec", "interpreter_precursor_chain"]),
    "cnc_communication": ("Establish Foothold", ["TA0011"], ["T1071.001"], ["untrusted_file_exec", "attachment_user_exec", "shell_exec", "interpreter_precursor_chain"]),
    "sudo_exec": ("Privilege Escalation", ["TA0004"], [], ["shell_exec"]),
    "switch_su": ("Privilege Escalation", ["TA0004"], [], ["shell_exec"]),
    "payload_elevate": ("Privilege Escalation", ["TA0004"], [], ["untrusted_file_exec", "make_file_exec", "attachment_user_exec", "shell_exec"]),
    "credential_submit": ("Internal Recon", ["TA0006"], [], ["untrusted_read"]),
    "sensitive_read": ("Internal Recon", ["TA0006", "TA0009"], ["T1552.003", "T1005"], ["untrusted_file_exec", "shell_exec", "interpreter_precursor_chain"]),
    "sensitive_command": ("Internal Recon", ["TA0007"], [], ["untrusted_file_exec", "shell_exec", "interpreter_precursor_chain"]),
    "network_service_discovery": ("Internal Recon", ["TA0007"], ["T1046"], ["shell_exec", "cnc_communication", "attachment_user_exec"]),
    "send_internal": ("Move Laterally", ["TA0008"], [], ["shell_exec", "cnc_communication"]),
    "sensitive_leak": ("Complete Mission", ["TA0010", "TA0011"], ["T1041"], ["sensitive_read", "cnc_communication"]),
    "clear_logs": ("Cleanup Tracks", ["TA0005"], ["T1070.004"], ["shell_exec", "cnc_communication"]),
    "sensitive_temp_rm": ("Cleanup Tracks", ["TA0005"], ["T1070.004"], ["sensitive_read"]),
    "untrusted_file_rm": ("Cleanup Tracks", ["TA0005"], ["T1070.004"], ["untrusted_file_exec"]),
    "interpreter_precursor_chain": ("Establish Foothold", ["TA0002", "TA0001"], ["T1059"], ["attachment_user_exec", "make_file_exec", "untrusted_read"]),
}
STAGES = ["Initial Compromise", "Establish Foothold", "Privilege Escalation", "Internal Recon", "Move Laterally", "Complete Mission", "Cleanup Tracks"]
#: Behaviours that are no atoms, of other sources of claims: (allowed tactics, preferred tactic, preferred technique). Fixed values.
OTHER_BEHAVIORS = {
    "download_and_exec": (["TA0002", "TA0011"], "TA0011", "T1105"), "credential_read": (["TA0006", "TA0009"], "TA0006", None), "business_data_access": (["TA0009", "TA0010"], "TA0009", "T1005"),
    "persistence_change": (["TA0003", "TA0005"], "TA0003", None), "log_deletion": (["TA0005"], "TA0005", "T1070.004"), "remote_send": (["TA0010", "TA0011"], "TA0011", None),
    "lateral_connect": (["TA0008"], "TA0008", None), "remote_service_entry": (["TA0001"], "TA0001", None), "execution_chain": (["TA0002"], "TA0002", None),
}
EXPECTED = ["network_service_discovery", "clear_logs", "attachment_user_exec", "interpreter_precursor_chain"]
# Markers of signals; fixed values.
RECON = ["whoami", "hostname", "uname", "ifconfig", "ip addr", "netstat", "ss ", "ps ", "id "]
MEMORY = ["mprotect", "mem exec", "virtualalloc"]
ATTACHMENT = ["tcexec", "pine", "rimapd", "attachment", "mail"]
SHELL = ["bash", "sh ", "python", "perl", "php", "tcexec", "command-not-found"]
SWITCH = [" setuid", " su ", "switch user"]
BROWSERS = ["firefox", "chrome", "chromium", "edge", "safari", "thunderbird", "outlook", "mail", "fluxbox"]
DELETES = ["DELETE", "UNLINK", "RENAME"]
LOGS = ["/var/log/", ".log", "lastlog", "wtmp", "btmp", "utmp", "messages", "secure"]
TEMP_NAMES, TEMP_STAGING = ["/tmp/", "temp", "gtcache", "ztmp"], ["/tmp/", "/var/tmp/", "/dev/shm/", "ztmp", "gtcache"]
PRECURSORS, WEAK_PRECURSORS = ["tcexec", "command-not-found", "/dev/pts/3"], ["python3", "bash", "chmod"]
EXEC_LABELS = ["B_EXEC_SUSPECT_WRITTEN", "B_EXEC_DOWNLOADED", "B_EXEC_UPLOADED", "B_EXEC_TEMP"]
STRONG_LABELS = ["A_BRIDGED_BY_SUSPICIOUS_OBJECT", *EXEC_LABELS, "B_SHELL_SPAWN", "B_SCRIPT_EXEC"]
STRONG_FAMILIES = ["short_lived_precursor", "attachment_or_tcexec_exec", "initial_or_drop_exec"]
ELEVATION_HELPERS = ["procstat"]
BURST_RECEIVES, BURST_SECONDS, PAIR_MINUTES, FALLBACK_SECONDS = 80, 150, 10, 300


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if len(values) else F.array().cast("array<string>")


def catalogue(spark) -> DataFrame:
    """The atoms as a table of a fixed size."""
    rows = [(a, s, STAGES.index(s), t, k, p) for a, (s, t, k, p) in ATOMS.items()]
    return spark.createDataFrame(rows, "behavior string, stage string, stage_order int, tactics array<string>, techniques array<string>, prerequisites array<string>")


def holds_any(col: str, labels) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(col), strings(labels)), F.lit(False))


def staged_keys(timeline: DataFrame, bridges: DataFrame) -> DataFrame:
    """(path_id, object_key): objects that the path stages for execution, by place, label or sequence (see labels.staged_objects), and by a bridge with a staged label."""
    t = timeline.withColumn("task_id", F.col("path_id"))
    labelled = t.select("task_id", F.col("object_key").alias("entity"), F.explode("object_labels").alias("label"))
    own = L.staged_objects(t, labelled).select(F.col("task_id").alias("path_id"), "object_key")
    return own.union(bridges.where(holds_any("object_labels", L.STAGED_LABELS)).select("path_id", "object_key")).distinct()


def signal_tests() -> dict[str, Column]:
    """Signals that an event of a timeline with `on_staged` (its object is staged on the path) shows by itself; one event may show several."""
    t, c, k, d = F.col("event_type"), F.col("object_class"), F.lower(X.text("object_key")), F.lower(X.text("description"))

    def has(*labels: str) -> Column:
        return holds_any("labels_triggered", labels)

    real = ~X.is_placeholder_key("object_key")
    staged_role = holds_any("object_labels", L.STAGED_LABELS)
    log = has("B_DELETE_LOG", "O_LOG_ARTIFACT") | holds_any("object_labels", ["B_DELETE_LOG", "O_LOG_ARTIFACT"]) | (c == "log_file") | X.contains_any(k, LOGS)
    service = X.is_system_service_key("object_key")
    return {
        "external_recv": has("B_EXTERNAL_RECV") | ((c == "external_ip") & (t == "RECV")),
        "external_send": has("B_EXTERNAL_SEND") | ((c == "external_ip") & (t == "SEND")),
        "lateral": has("B_LATERAL_CONNECT"),
        "scan": has("B_LATERAL_CONNECT") | ((t == "CONNECT") & c.isin("external_ip", "internal_ip")),
        "internal": (c == "internal_ip") & t.isin("CONNECT", "SEND", "RECV"),
        "exec": has(*EXEC_LABELS),
        "sensitive_strong": (t == "READ") & has("B_READ_CRED", "B_READ_HISTORY"),
        "sensitive_weak": (t == "READ") & has("B_READ_BUSINESS", "B_MASS_FILE_ACCESS") & (k != "") & ~service,
        "recon": X.contains_any(d, RECON), "memory": X.contains_any(d, MEMORY), "shell": X.contains_any(d, SHELL), "sudo": d.contains("sudo"), "switch": X.contains_any(d, SWITCH),
        "attachment": X.contains_any(d, ATTACHMENT) | X.contains_any(k, ATTACHMENT),
        "direct_exec": t.isin("EXEC", "LOAD") & real & ~service & (X.is_temp_exec_path("object_key") | staged_role | has(*L.STAGED_LABELS)),
        "staged_chmod": F.col("on_staged") & (t.isin(L.CHMODS) | d.contains("chmod")),
        "staged_exec": F.col("on_staged") & t.isin(S.EXECUTIONS),
        "temp_remove": t.isin(DELETES) & X.contains_any(k, TEMP_NAMES),
        "log_cleanup": t.isin(DELETES) & real & log,
        "staged_cleanup": t.isin(DELETES) & real & ~log & ~service & (F.col("on_staged") | staged_role | X.contains_any(k, TEMP_STAGING)),
    }


def claim_signals(timeline: DataFrame, bridges: DataFrame) -> DataFrame:
    """(path_id, signal, event_id, order_index, us, process_guid): one row for each signal of each event.

    bridges: (path_id, object_key, object_labels, write_event, read_event). Beside the events' own signals these are `bridge_exec` (both
    ends of a bridge over a staged object), `precursor` and `payload_elevate`. Staged objects are joined on path and key, never listed in a row.
    """
    keys = staged_keys(timeline, bridges).withColumn("on_staged", F.lit(True))
    t = timeline.join(keys, ["path_id", "object_key"], "left").withColumn("on_staged", F.coalesce("on_staged", F.lit(False)))
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in signal_tests().items()]))
    columns = ["path_id", "signal", "event_id", "order_index", "us", "process_guid"]
    own = t.select("path_id", F.explode(names).alias("signal"), "event_id", "order_index", "us", "process_guid")
    as_task = t.withColumn("task_id", F.col("path_id")).withColumn("process_name", F.concat_ws(" ", "process_name", "description"))
    pre = L.precursor_events(as_task, PRECURSORS, WEAK_PRECURSORS, F.col("on_staged")).withColumn("signal", F.lit("precursor"))
    up = L.payload_elevate_events(as_task, keys.withColumnRenamed("path_id", "task_id")).withColumn("signal", F.lit("payload_elevate"))
    over = bridges.where(holds_any("object_labels", L.STAGED_LABELS)).select(F.col("path_id").alias("task_id"), F.explode(F.array("write_event", "read_event")).alias("event_id"), F.lit("bridge_exec").alias("signal"))
    more = pre.select("task_id", "event_id", "signal").unionByName(up.select("task_id", "event_id", "signal")).unionByName(over.distinct())
    at = timeline.select("path_id", "event_id", "order_index", "us", "process_guid")
    return own.unionByName(more.withColumnRenamed("task_id", "path_id").join(at, ["path_id", "event_id"]).select(*columns))


def claim_context(timeline: DataFrame, signals: DataFrame, paths: DataFrame, direct: bool = False) -> DataFrame:
    """One row for each path of `paths` (path_id, families, labels, process_names, relations): the flags that gate claims.

    strong_exec, browser_mail, browser_only, explicit_callback, short_burst, discovery, lineage. direct: executions of staged files count without a bridge."""
    has = {n: F.bool_or(F.col("signal") == n).alias(f"has_{n}") for n in ("exec", "direct_exec", "bridge_exec", "attachment", "shell", "precursor", "lateral")}
    n = signals.groupBy("path_id").agg(*has.values(), F.count_if(F.col("signal") == "scan").alias("scans"), F.count_if(F.col("signal") == "external_recv").alias("receives"))
    text = F.lower(F.concat_ws(" ", X.text("description"), X.text("object_key")))
    span = timeline.groupBy("path_id").agg(((F.max("us") - F.min("us")) / 1e6).alias("_span"), F.bool_or(text.contains("browser")).alias("_browser"))
    df = paths.join(n, "path_id", "left").join(span, "path_id", "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(f"has_{name}"), F.lit(False))

    names = F.filter(F.transform("process_names", lambda x: F.lower(x)), lambda x: x != "")
    browser = F.transform(names, lambda x: X.contains_any(x, BROWSERS))
    ran = flag("exec") | flag("direct_exec") if direct else flag("exec")
    known = flag("bridge_exec") | flag("direct_exec") if direct else flag("bridge_exec")
    strong = flag("bridge_exec") | flag("attachment") | flag("shell") | flag("precursor") | holds_any("labels", STRONG_LABELS) | holds_any("families", STRONG_FAMILIES) | (ran & holds_any("families", ["callback_c2", "cleanup_delete"]))
    mail = F.array_contains("families", "mail_browser_context_tail") | F.exists(browser, lambda x: x) | F.coalesce("_browser", F.lit(False))
    only = mail & (F.size(names) > 0) & F.forall(browser, lambda x: x)
    scans = F.coalesce("scans", F.lit(0))
    out = df.withColumn("strong_exec", strong).withColumn("browser_mail", mail).withColumn("browser_only", only)
    return out.select("path_id", "strong_exec", "browser_mail", "browser_only", (flag("shell") | flag("precursor") | flag("attachment") | (known & ~F.col("browser_only"))).alias("explicit_callback"),
                      ((F.coalesce("receives", F.lit(0)) <= BURST_RECEIVES) & (F.coalesce("_span", F.lit(0.0)) <= BURST_SECONDS)).alias("short_burst"),
                      ((scans >= 2) | ((scans > 0) & flag("lateral"))).alias("discovery"), (F.size("relations") > 0).alias("lineage"))


def ordered_pairs(signals: DataFrame, earlier: str, later: str, minutes: float = PAIR_MINUTES) -> DataFrame:
    """(path_id, earlier_id, later_id, same_process) of signal pairs in order and within the time; a missing time passes.

    Timed signals meet by path and time bucket, so a long path compares neighbours in time, not all with all."""
    reach = int(minutes * 60_000_000)
    a = signals.where(F.col("signal") == earlier).select("path_id", F.col("event_id").alias("earlier_id"), F.col("order_index").alias("_a"), F.col("us").alias("lo"), F.col("process_guid").alias("_ap"))
    b = signals.where(F.col("signal") == later).select("path_id", F.col("event_id").alias("later_id"), F.col("order_index").alias("_b"), F.col("us").alias("rlo"), F.col("process_guid").alias("_bp"))
    timed = overlap_join(a.withColumn("hi", F.col("lo") + reach), b.withColumn("rhi", F.col("rlo")), ["path_id"], max(1, reach)).drop("hi", "rhi")
    untimed = a.where("lo is null").join(b, "path_id").unionByName(a.where("lo is not null").join(b.where("rlo is null"), "path_id"))
    return timed.unionByName(untimed).where(F.col("_a") < F.col("_b")).select("path_id", "earlier_id", "later_id", (F.col("_ap") == F.col("_bp")).alias("same_process"))


SIGNALS = ["external_recv", "external_send", "lateral", "scan", "internal", "exec", "sensitive_strong", "sensitive_weak", "recon", "memory", "shell", "sudo", "switch", "attachment", "direct_exec", "staged_chmod",
           "staged_exec", "temp_remove", "log_cleanup", "staged_cleanup", "bridge_exec", "precursor", "payload_elevate"]


def signal_lists(signals: DataFrame, most: int) -> DataFrame:
    """One row for each path: for each signal the array of its first `most` events (order_index, event_id, us, process_guid); ranks are cut before rows are gathered."""
    item = F.struct("order_index", "event_id", "us", "process_guid")
    w = Window.partitionBy("path_id", "signal").orderBy("order_index", "event_id")
    first = signals.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return first.groupBy("path_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("signal") == n, item))).alias(n) for n in SIGNALS])


def pair_facts(signals: DataFrame, earlier: str, later: str, most: int, minutes: float = PAIR_MINUTES) -> DataFrame:
    """(path_id, same, ids) of the paths with an ordered_pairs pair of the two signals: whether any pair is of one process, and the first `most` distinct
    event ids of the pairs, in order of the earlier event, then of the later.

    All events are judged, but no pair is formed beyond those that the ids come from: along a path whose times do not fall, the nearest later event decides
    whether an event has a pair, so a running look-ahead answers. Paths whose times do fall somewhere are answered from their pairs. A missing time passes.
    """
    rows = signals.where(F.col("signal").isin(earlier, later)).select("path_id", "event_id", "order_index", "us", "process_guid", (F.col("signal") == later).alias("_is_later"))
    return _facts(rows, most, int(minutes * 60_000_000))


def pair_columns(signals: DataFrame, kinds: dict[str, tuple[str, str]], most: int, minutes: float = PAIR_MINUTES) -> DataFrame:
    """(path_id, a struct of same and ids for each kind): pair_facts of several pairs of signals, earlier and later, at once; a path without pairs of a kind has null there."""
    takes = F.array_compact(F.array(*[F.when(F.col("signal").isin(a, b), F.struct(F.lit(k).alias("kind"), (F.col("signal") == b).alias("_is_later"))) for k, (a, b) in kinds.items()]))
    rows = signals.where(F.col("signal").isin([x for pair in kinds.values() for x in pair])).withColumn("_x", F.explode(takes))
    rows = rows.select(F.struct("path_id", "_x.kind").alias("path_id"), "event_id", "order_index", "us", "process_guid", "_x._is_later")
    facts = _facts(rows, most, int(minutes * 60_000_000)).select("path_id.path_id", "path_id.kind", F.struct("same", "ids").alias("_f"))
    return facts.groupBy("path_id").agg(*[F.first(F.when(F.col("kind") == k, F.col("_f")), ignorenulls=True).alias(k) for k in kinds])


def _facts(both: DataFrame, most: int, reach: int) -> DataFrame:
    """pair_facts of rows (path_id of any type, event_id, order_index, us, process_guid, _is_later)."""
    seen = Window.partitionBy("path_id").orderBy("order_index", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    falls = both.withColumn("_falls", F.col("us") < F.max("us").over(seen)).groupBy("path_id").agg(F.bool_or(F.coalesce("_falls", F.lit(False))).alias("_falls"))
    even, uneven = (both.join(falls.where(c), "path_id", "left_semi") for c in (~F.col("_falls"), F.col("_falls")))

    # paths in order of time: look ahead from each event, events of one place excluded
    ahead = Window.orderBy(F.desc("order_index")).rangeBetween(Window.unboundedPreceding, -1)
    on_path, on_process = ahead.partitionBy("path_id"), ahead.partitionBy("path_id", "process_guid")
    timed, untimed = F.col("_is_later") & F.col("us").isNotNull(), F.col("_is_later") & F.col("us").isNull()

    def met(w) -> Column:
        near = F.min(F.when(timed, F.col("us"))).over(w)
        return (near.isNotNull() & F.coalesce(near - F.col("us") <= reach, F.lit(True))) | F.coalesce(F.bool_or(untimed).over(w), F.lit(False))

    looked = even.withColumn("_met", met(on_path)).withColumn("_same", F.col("process_guid").isNotNull() & met(on_process))
    for kind, which in (("_timed", timed), ("_untimed", untimed)):  # how many later events come after this one: the place of the next, counted from the end
        looked = looked.withColumn(kind, F.coalesce(F.count_if(which).over(on_path), F.lit(0)))
    e = looked.where(~F.col("_is_later") & F.col("_met"))
    same = e.groupBy("path_id").agg(F.bool_or("_same").alias("same"))
    first = e.withColumn("_e", F.row_number().over(Window.partitionBy("path_id").orderBy("order_index", "event_id"))).where(F.col("_e") <= most)
    from_end = Window.partitionBy("path_id", F.col("us").isNull()).orderBy(F.desc("order_index"), F.desc("event_id"))
    lat = even.where("_is_later").select("path_id", F.col("us").isNotNull().alias("_kind"), F.row_number().over(from_end).alias("_k"), F.col("event_id").alias("_later"), F.col("order_index").alias("_lo"), F.col("us").alias("_lus"))

    def numbers(kind: str, is_timed: bool) -> Column:
        """Places from the end of the next 2 * most later events of a kind."""
        ks = F.sequence(F.greatest(F.lit(1), F.col(kind) - 2 * most + 1), F.col(kind))
        return F.when(F.col(kind) > 0, F.transform(ks, lambda k: F.struct(F.lit(is_timed).alias("_kind"), k.cast("int").alias("_k")))).otherwise(F.array().cast("array<struct<_kind:boolean,_k:int>>"))

    near = first.select("path_id", "event_id", "order_index", "us", "_e", F.explode(F.concat(numbers("_timed", True), numbers("_untimed", False))).alias("x")).select("*", "x.*").drop("x").join(lat, ["path_id", "_kind", "_k"])
    near = near.where(F.coalesce(F.col("_lus") - F.col("us") <= reach, F.lit(True))).select("path_id", "_e", "event_id", "_later", "_lo")

    # other paths: their pairs
    pairs = ordered_pairs(uneven.withColumn("signal", F.when(F.col("_is_later"), "later").otherwise("earlier")), "earlier", "later", reach / 60_000_000)
    at = uneven.select("path_id", "event_id", "order_index", "_is_later")
    pairs = pairs.join(at.where("not _is_later").select("path_id", F.col("event_id").alias("earlier_id"), F.col("order_index").alias("_eo")), ["path_id", "earlier_id"]).join(
        at.where("_is_later").select("path_id", F.col("event_id").alias("later_id"), F.col("order_index").alias("_lo")), ["path_id", "later_id"])
    same = same.unionByName(pairs.groupBy("path_id").agg(F.bool_or(F.coalesce("same_process", F.lit(False))).alias("same")))
    few = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("path_id", "_eo", "earlier_id").orderBy("_lo", "later_id"))).where(F.col("_r") <= 2 * most)
    few = few.withColumn("_e", F.dense_rank().over(Window.partitionBy("path_id").orderBy("_eo", "earlier_id"))).where(F.col("_e") <= most)
    rows = near.unionByName(few.select("path_id", "_e", F.col("earlier_id").alias("event_id"), F.col("later_id").alias("_later"), "_lo"))

    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_e", "_lo", "_later", "event_id"))), lambda p: F.array(p["event_id"], p["_later"])))
    return same.join(rows.groupBy("path_id").agg(F.slice(F.array_distinct(flat), 1, most).alias("ids")), "path_id")


def build_claims(signals: DataFrame, context: DataFrame, most: int = 8, direct: bool = False, elevations: DataFrame | None = None) -> DataFrame:
    """(path_id, behavior, stage, confidence, evidence, support): the claims whose signals and gates hold; evidence are event ids in the order in which a claim names its signals, `most` at most.

    signals and context of claim_signals and claim_context. Gates and pairs are judged on all events; what is cut is the evidence of a finished claim. It is
    drawn from the first events of each signal, enough of them that a shared event never leaves it short, and from pair_facts. Paths without a signal claim nothing. direct: hosts on which executions of staged files count without a bridge and reads must have a context; there
    elevations (path_id, event_id) of elevate_fallbacks stand in where no payload is elevated by its text.
    """
    kept = 4 * most  # evidence names three lists at most
    df = signal_lists(signals, kept).join(context, "path_id")
    kinds = {"_sent": ("external_recv", "external_send"), "_strong": ("sensitive_strong", "external_send"), "_weak": ("sensitive_weak", "external_send")}
    df = df.join(written(pair_columns(signals, kinds, 2 * most), "pairs"), "path_id", "left")
    if elevations is not None:
        at = elevations.join(signals.select("path_id", "event_id", "order_index", "us", "process_guid").distinct(), ["path_id", "event_id"], "left")
        w = Window.partitionBy("path_id").orderBy("order_index", "event_id")
        at = at.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= kept)
        more = at.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "event_id", "us", "process_guid"))).alias("_more"))
        df = df.join(more, "path_id", "left").withColumn("payload_elevate", F.when(F.size("payload_elevate") > 0, F.col("payload_elevate")).otherwise(F.coalesce("_more", F.col("payload_elevate"))))

    def some(name: str) -> Column:
        return F.size(name) > 0

    def ids(*parts) -> Column:
        lists = [F.slice(p[0], 1, p[1]) if isinstance(p, tuple) else F.col(p) if isinstance(p, str) else p for p in parts]
        return F.concat(*[F.transform(x, lambda e: e["event_id"]) for x in lists])

    c, none = F.col, F.slice(F.col("exec"), 1, 0)
    free = ~c("browser_only") | c("explicit_callback")
    direct_exec = c("direct_exec") if direct else none
    no_ids = F.slice(F.transform(none, lambda e: e["event_id"]), 1, 0)
    df = df.withColumn("_known", F.concat(c("bridge_exec"), direct_exec))
    staged_lineage = some("staged_chmod") | some("staged_exec") | some("bridge_exec")
    weak_ok = c("strong_exec") & (c("discovery") | some("log_cleanup") | some("staged_cleanup") | staged_lineage | (some("external_send") & free))
    df = df.withColumn("_read", F.concat(F.when(c("strong_exec"), c("sensitive_strong")).otherwise(none), F.when(weak_ok, c("sensitive_weak")).otherwise(none)))
    leaks = [(c("strong_exec"), "_strong"), (weak_ok, "_weak")]  # pairs count for the kinds of reads that the path's gates let in
    leak_same = F.coalesce(F.greatest(*[gate & c(f"{n}.same") for gate, n in leaks]), F.lit(False))
    leak_ids = F.concat(*[F.when(gate, F.coalesce(f"{n}.ids", no_ids)).otherwise(no_ids) for gate, n in leaks])
    read_ok = c("strong_exec") | c("browser_mail") | some("attachment") | some("_known") if direct else F.lit(True)
    cleanup = c("strong_exec")
    rules = [  # atom, confidence, gate, evidence, support
        ("untrusted_read", 0.74, read_ok, ids("external_recv"), {"external_recv": F.lit(True), "exec_context": c("strong_exec"), "browser_context": ~c("strong_exec") & c("browser_mail")}),
        ("make_mem_exec", 0.77, some("memory") & (some("external_recv") | some("precursor")), ids("memory", "external_recv", "precursor"), {"mem_exec": F.lit(True), "precursor_dependency": F.lit(True)}),
        ("make_file_exec", 0.78, some("staged_chmod"), ids("staged_chmod", "staged_exec", "bridge_exec"), {"chmod_exec": F.lit(True), "staged_object": F.lit(True)}),
        ("untrusted_file_exec", 0.84, some("_known"), ids("_known", "external_recv"), {"staged_object": F.lit(True), "bridge_exec": some("bridge_exec"), "direct_staged_exec": F.size(direct_exec) > 0}),
        ("attachment_user_exec", 0.82, some("attachment"), ids("attachment", "bridge_exec"), {"attachment_markers": F.lit(True)}),
        ("shell_exec", 0.78, some("shell"), ids("shell", ("precursor", 4)), {"interpreter_exec": F.lit(True)}),
        ("credential_submit", 0.77, c("browser_only") & ~c("explicit_callback") & c("short_burst"), F.coalesce("_sent.ids", no_ids), {"browser_form_submit": F.lit(True)}),
        ("cnc_communication", 0.8, some("external_send") & c("strong_exec") & free, ids("external_send", "external_recv"), {"external_c2": F.lit(True)}),
        ("sudo_exec", 0.8, some("sudo"), ids("sudo"), {"sudo": F.lit(True)}),
        ("switch_su", 0.8, some("switch"), ids("switch"), {"identity_switch": F.lit(True)}),
        ("payload_elevate", 0.81, some("payload_elevate") & c("strong_exec"), ids("payload_elevate", ("staged_exec", 2), ("bridge_exec", 2)), {"payload_elevate": F.lit(True)}),
        ("sensitive_read", 0.82, F.lit(True), ids("_read"), {"sensitive_strong_read": c("strong_exec") & some("sensitive_strong"), "sensitive_weak_read": weak_ok & some("sensitive_weak")}),
        ("sensitive_command", 0.78, some("recon"), ids("recon"), {"recon_commands": F.lit(True)}),
        ("network_service_discovery", 0.82, c("discovery"), ids("scan", "lateral"), {"scan_burst": F.lit(True)}),
        ("send_internal", 0.76, some("internal"), ids("internal"), {"internal_connect": F.lit(True)}),
        ("sensitive_leak", 0.83, c("strong_exec") & (leak_same | c("lineage")), leak_ids, {"sensitive_plus_external_send": F.lit(True)}),
        ("clear_logs", 0.82, cleanup, ids("log_cleanup", "staged_cleanup"), {"log_cleanup": some("log_cleanup"), "staged_cleanup": some("staged_cleanup")}),
        ("sensitive_temp_rm", 0.78, some("temp_remove") & some("_read"), ids("temp_remove", "_read"), {"temp_cleanup_after_collection": F.lit(True)}),
        ("untrusted_file_rm", 0.76, some("temp_remove") & some("bridge_exec"), ids("temp_remove", "bridge_exec"), {"cleanup_staged_object": F.lit(True)}),
        ("interpreter_precursor_chain", 0.8, some("precursor"), ids("precursor"), {"precursor_markers": F.lit(True)}),
    ]
    made = [F.when(gate, F.struct(F.lit(atom).alias("behavior"), F.lit(ATOMS[atom][0]).alias("stage"), F.lit(sure).alias("confidence"), F.slice(F.array_distinct(ev), 1, most).alias("evidence"),
                                  F.array_compact(F.array(*[F.when(on, F.lit(n)) for n, on in why.items()])).alias("support"))) for atom, sure, gate, ev, why in rules]
    out = df.select("path_id", F.explode(F.array_compact(F.array(*made))).alias("x")).select("path_id", "x.*")
    return out.where(F.size("evidence") > 0)


def elevate_fallbacks(timeline: DataFrame, staged_execs: DataFrame, seconds: int = FALLBACK_SECONDS) -> DataFrame:
    """(path_id, event_id, kind) of events that elevate a staged payload without saying so: a change of principal within `seconds` of a staged execution (path_id, process_guid, us) of
    the same process (principal), children that such a process forks within `seconds` after it (fork), and helper programs that these children execute within `seconds` (child_exec).

    Where a path shows a principal change, its children do not count. Times meet by process and time bucket."""
    reach = seconds * 1_000_000
    ex = staged_execs.where("us is not null").select("path_id", "process_guid", (F.col("us") - reach).alias("rlo"), (F.col("us") + reach).alias("rhi"), F.col("us").alias("_at"))
    points = timeline.where("us is not null").select("path_id", "process_guid", "event_id", "event_type", "object_key", F.col("us").alias("lo"), F.col("us").alias("hi"))
    near = overlap_join(points.where(F.col("event_type").isin("CHANGE_PRINCIPAL", "FORK", "CLONE")), ex, ["path_id", "process_guid"], reach)
    principal = near.where("event_type = 'CHANGE_PRINCIPAL'").select("path_id", "event_id").distinct()
    forks = near.where(F.col("event_type").isin("FORK", "CLONE") & (F.col("lo") >= F.col("_at")) & (F.col("object_key") != "")).join(principal.select("path_id").distinct(), "path_id", "left_anti")
    children = forks.select("path_id", F.col("object_key").alias("process_guid")).distinct()
    helpers = points.where((F.col("event_type") == "EXEC") & X.basename(F.lower("object_key")).isin(ELEVATION_HELPERS)).join(children, ["path_id", "process_guid"], "left_semi")
    ran = overlap_join(helpers.drop("process_guid"), ex.drop("process_guid"), ["path_id"], reach).where(F.col("lo") >= F.col("_at"))
    kinds = [(principal, "principal"), (forks.select("path_id", "event_id").distinct(), "fork"), (ran.select("path_id", "event_id").distinct(), "child_exec")]
    return reduce(DataFrame.union, [df.select("path_id", "event_id", F.lit(k).alias("kind")) for df, k in kinds])


def claim_graph(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (path_id, src, dst) from each claim's prerequisites that are claimed too, and diagnostics (path_id, matched in order of stage, confidence and name; missing of the expected atoms; stage_counts)."""
    cat = F.broadcast(catalogue(claims.sparkSession).select("behavior", "stage_order", "prerequisites"))
    c = claims.select("path_id", "behavior", "stage", "confidence").distinct().join(cat, "behavior")
    want = c.select("path_id", F.col("behavior").alias("dst"), F.explode("prerequisites").alias("src"))
    edges = want.join(c.select("path_id", F.col("behavior").alias("src")), ["path_id", "src"]).select("path_id", "src", "dst")
    ordered = F.array_sort(F.collect_set(F.struct("stage_order", (-F.col("confidence")).alias("c"), "behavior", "stage")))
    got = c.groupBy("path_id").agg(ordered.alias("_o")).withColumn("matched", F.col("_o.behavior"))
    missing = F.filter(strings(EXPECTED), lambda x: ~F.array_contains("matched", x))
    counts = F.filter(F.transform(strings(STAGES), lambda s: F.struct(s.alias("stage"), F.size(F.filter("_o", lambda x: x["stage"] == s)).alias("n"))), lambda x: x["n"] > 0)
    return edges, got.select("path_id", "matched", missing.alias("missing"), counts.alias("stage_counts"))


GENERIC = ["suspicious activity", "malicious behavior", "unknown activity"]


def validate_claims(claims: DataFrame, timeline: DataFrame) -> DataFrame:
    """claims (path_id, behavior, statement, evidence) with the evidence that exists in the path; those without any, without a statement or with a generic one go."""
    ev = claims.select("path_id", "behavior", F.explode("evidence").alias("event_id")).join(timeline.select("path_id", "event_id"), ["path_id", "event_id"], "left_semi").groupBy("path_id", "behavior").agg(F.array_sort(F.collect_set("event_id")).alias("evidence"))
    text = F.lower(X.text("statement"))
    return claims.drop("evidence").where((text != "") & ~X.contains_any(text, GENERIC)).join(ev, ["path_id", "behavior"])


def merge_claims(rules: DataFrame, extra: DataFrame) -> DataFrame:
    """Claims of both by behaviour: larger confidence, evidence of either."""
    b = extra.select("path_id", "behavior", F.col("confidence").alias("_c"), F.col("evidence").alias("_e"))
    none = F.array().cast(rules.schema["evidence"].dataType)
    return rules.select("path_id", "behavior", "confidence", "evidence").join(b, ["path_id", "behavior"], "full").select("path_id", "behavior", F.greatest("confidence", "_c").alias("confidence"), F.array_sort(F.array_union(F.coalesce("evidence", none), F.coalesce("_e", none))).alias("evidence"))


def terms(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf): words of two characters and more of any script, and pairs of neighbours, in lower case.

    Each text goes once to where its terms are counted, and what is later grouped by `id` stays there."""
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    d = docs.select(F.col(id_col).alias("id"), text).repartition("id").select("id", w.alias("_w"))
    pairs = F.transform(F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), lambda x, i: F.concat(F.get("_w", i), F.lit(" "), x))
    return d.select("id", F.explode(F.concat("_w", F.when(F.size("_w") > 1, pairs).otherwise(strings([])))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def kb_index(candidates: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, weight): TF-IDF with idf = ln((1 + n) / (1 + df)) + 1 and rows of length 1."""
    tf = terms(candidates, id_col, text)
    df = tf.groupBy("term").agg(F.count("*").alias("_df"))
    n = candidates.agg(F.count("*").alias("_n"))
    w = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("_w", F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1))  # one row
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    return w.join(norm, "id").select("id", "term", (F.col("_w") / F.col("_l")).alias("weight"))


#: Words in a candidate's text that fit a path's action family, and the points they give; words that hint at an operating system. Fixed values.
FAMILY_WORDS = {
    "network_c2": (0.28, ["command and control", "remote", "connection", "network", "protocol", "tunnel", "service"]),
    "execution": (0.26, ["execution", "script", "interpreter", "process", "shell", "command"]),
    "file_persistence": (0.28, ["persistence", "startup", "profile", "service", "scheduled task", "cron", "systemd"]),
    "recon": (0.28, ["discovery", "enumeration", "scan", "system information", "network service", "file and directory"]),
    "credential": (0.28, ["credential", "password", "token", "authentication"]),
}
OS_WORDS = {"windows": ["registry", "regsvr32", "rundll32", "powershell", "cmd.exe", "schtasks"], "macos": ["applescript", "launch agent", "launchd", "osascript", "mach-o"], "linux": ["bash", "cron", "systemd", "service", "/etc/", "linux"]}
OTHER_OS = {"linux": 0.45, "windows": 0.35, "macos": 0.35}
SMALL_INDEX = 2_000_000  # rows of a knowledge-base index up to which it is broadcast


def compatibility_bonus(pool: DataFrame, contexts: DataFrame, candidates: DataFrame) -> DataFrame:
    """pool (query, id) plus bonus: how well a candidate (id, external_id, text) fits a query's families, object semantics, operating system, claims and behaviours.

    contexts: (query, families, semantics, os, claim_terms, behaviors), arrays but for os. Texts are searched and cut into words once for each candidate and query, not for each pair."""
    cat = catalogue(pool.sparkSession).select("behavior", "tactics", "techniques")
    prior = contexts.select("query", F.explode("behaviors").alias("behavior")).join(F.broadcast(cat), "behavior")
    weights = prior.select("query", F.explode(F.concat(F.transform("tactics", lambda x: F.struct(x.alias("external_id"), F.lit(0.45).alias("p"))), F.transform("techniques", lambda x: F.struct(x.alias("external_id"), F.lit(0.75).alias("p"))))).alias("x"))
    weights = weights.select("query", "x.*").groupBy("query", "external_id").agg(F.sum("p").alias("_prior"))
    t = F.lower("text")
    fits = F.struct(*[F.when(X.contains_any(t, words), p).otherwise(0.0).alias(f) for f, (p, words) in FAMILY_WORDS.items()])
    points = []
    for own, fine in OTHER_OS.items():
        foreign = [w for o, ws in OS_WORDS.items() if o != own for w in ws]
        points.append((F.when(X.contains_any(t, foreign), -fine).otherwise(0.0) + F.when(X.contains_any(t, OS_WORDS[own]), 0.14).otherwise(0.0)).alias(own))
    texts = candidates.select("id", "external_id", fits.alias("_fits"), F.struct(*points).alias("_system"), X.kb_tokens(t).alias("_words"))
    said = {name: F.transform(name, X.kb_tokens) for name in ("semantics", "claim_terms")}
    asked = contexts.select("query", "families", "os", said["semantics"].alias("_semantics"), said["claim_terms"].alias("_claims"))
    df = pool.join(asked, "query").join(texts, "id").join(weights, ["query", "external_id"], "left")
    fit = sum((F.when(F.array_contains("families", f), F.col(f"_fits.{f}")).otherwise(0.0) for f in FAMILY_WORDS), F.lit(0.0))
    alike = lambda name: F.size(F.filter(name, lambda x: F.arrays_overlap(x, F.col("_words"))))
    system = F.lit(0.0)
    for own in OTHER_OS:
        system = F.when(F.col("os") == own, F.col(f"_system.{own}")).otherwise(system)
    bonus = fit + 0.10 * alike("_semantics") + system + F.least(F.lit(0.30), 0.08 * alike("_claims")) + F.coalesce("_prior", F.lit(0.0))
    return df.select(*pool.columns, bonus.alias("bonus"))


def prior_candidates(contexts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, id) of the candidates that the query's behaviours name."""
    cat = catalogue(contexts.sparkSession).select("behavior", F.explode(F.concat("tactics", "techniques")).alias("external_id"))
    return contexts.select("query", F.explode("behaviors").alias("behavior")).join(F.broadcast(cat), "behavior").join(candidates.select("id", "external_id"), "external_id").select("query", "id").distinct()


def best_of(df: DataFrame, score: str, k: int) -> DataFrame:
    """The k rows of each query with the largest score, ties by id; null scores come last."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(score), "id"))).where(F.col("_r") <= k).drop("_r")


def retrieve_candidates(queries: DataFrame, index: DataFrame, dense: DataFrame | None = None, k: int = 12, pool: int = 24, sparse_weight: float = 0.45, dense_weight: float = 0.55,
                        contexts: DataFrame | None = None, candidates: DataFrame | None = None, small: int = SMALL_INDEX) -> DataFrame:
    """(query, id, score, rank): the k best candidates of each query by the weighted sum of sparse and dense similarity, each divided by the query's best, and the compatibility bonus.

    queries: (query, term, tf); index of kb_index; dense (query, id, dense), all candidates of a query. The pool are the best `pool` of either similarity and, with contexts and
    candidates, those that a query's behaviours name; only scores above 0 count. Tactics are ranked by a call of their own with k = 8. An index of up to `small` rows is
    broadcast, so a term of every query shuffles nothing; a larger one is joined by term. Without dense similarities the sparse one counts whole.
    """
    held = F.broadcast(index) if index.limit(small + 1).count() <= small else index
    dot = queries.join(held, "term").groupBy("query", "id").agg(F.sum(F.col("tf") * F.col("weight")).alias("_s"))
    dot = dot.withColumn("sparse", F.col("_s") / F.max("_s").over(Window.partitionBy("query")))
    if dense is None and contexts is None:  # the pool has its similarities
        return _top(best_of(dot, "_s", pool).na.fill(0.0, ["sparse"]).withColumn("score", F.col("sparse")), k)
    both = best_of(dot, "_s", pool).select("query", "id")
    if dense is not None:
        dense = dense.withColumn("_d", F.greatest(F.lit(0.0), F.col("dense")) / F.max("dense").over(Window.partitionBy("query")))
        both = both.union(best_of(dense, "dense", pool).select("query", "id"))
    if contexts is not None:
        both = both.union(prior_candidates(contexts, candidates))
    both = both.distinct().join(dot.select("query", "id", "sparse"), ["query", "id"], "left").na.fill(0.0, ["sparse"])
    score = F.col("sparse")
    if dense is not None:
        both = both.join(dense.select("query", "id", F.coalesce("_d", F.lit(0.0)).alias("_d")), ["query", "id"], "left").na.fill(0.0, ["_d"])
        score = sparse_weight * F.col("sparse") + dense_weight * F.col("_d")
    if contexts is not None:
        both = compatibility_bonus(both, contexts, candidates)
        score = score + F.col("bonus")
    return _top(both.withColumn("score", score), k)


def _top(scored: DataFrame, k: int) -> DataFrame:
    """The k best scored rows of each query with a score above 0."""
    both = scored.where(F.round("score", 9) > 0)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))).where(F.col("rank") <= k).select("query", "id", "score", "rank")


def query_terms(paths: DataFrame) -> DataFrame:
    """paths (families, behaviors, text) plus query_terms: sorted distinct families, behaviours, command names and object meanings."""
    plain = lambda c: F.transform(c, lambda x: F.replace(x, F.lit("_"), F.lit(" ")))
    return paths.withColumn("query_terms", F.array_sort(F.array_distinct(F.concat(plain("families"), plain("behaviors"), X.command_lexemes("text"), X.path_semantics("text")))))


def prior_table(spark) -> DataFrame:
    """(behavior, tactics allowed, preferred_tactic, technique) of all known behaviours, a table of a fixed size."""
    rows = [(a, sorted(t), t[0], k[0] if k else None) for a, (_, t, k, _) in ATOMS.items()] + [(b, *x) for b, x in OTHER_BEHAVIORS.items()]
    return spark.createDataFrame(rows, "behavior string, tactics array<string>, preferred_tactic string, technique string")


def claim_priors(claims: DataFrame, timeline: DataFrame | None = None) -> DataFrame:
    """(path_id, behavior, confidence, tactics, preferred_tactic, technique): allowed and preferred mapping of each claim of a known behaviour.

    With the timeline, a remote_send of three evidence events and more, two of them to web ports, becomes command and control over web protocols."""
    out = claims.select("path_id", "behavior", "confidence").join(F.broadcast(prior_table(claims.sparkSession)), "behavior").select("path_id", "behavior", "confidence", "tactics", "preferred_tactic", "technique")
    if timeline is None:
        return out
    ev = claims.where("behavior = 'remote_send'").select("path_id", F.explode("evidence").alias("event_id")).join(timeline.select("path_id", "event_id", "object_key"), ["path_id", "event_id"])
    port = F.regexp_extract("object_key", r"->.*:(\d+)$", 1)
    web = ev.groupBy("path_id").agg(F.count("*").alias("_n"), F.count_if(port.isin([str(p) for p in S.WEB_C2_PORTS])).alias("_web")).where("_n >= 3 and _web >= 2").select("path_id", F.lit("remote_send").alias("behavior"), F.lit(True).alias("_c2"))
    return out.join(web, ["path_id", "behavior"], "left").withColumn("preferred_tactic", F.when(F.col("_c2"), "TA0011").otherwise(F.col("preferred_tactic"))).withColumn(
        "technique", F.when(F.col("_c2"), "T1071.001").otherwise(F.col("technique"))).drop("_c2")


def augment_candidates(candidates: DataFrame, priors: DataFrame) -> DataFrame:
    """Candidates (path_id, attack_id, score) with the allowed tactics (0.98) and the preferred technique (1.02) of each claim, where they are not candidates yet."""
    tactics = priors.select("path_id", F.explode("tactics").alias("attack_id"), F.lit(0.98).alias("score"))
    extra = tactics.union(priors.where("technique is not null").select("path_id", "technique", F.lit(1.02))).distinct()
    return candidates.select("path_id", "attack_id", "score").union(extra.join(candidates, ["path_id", "attack_id"], "left_anti").select("path_id", "attack_id", "score"))


BROWSER_TACTICS = ["TA0001", "TA0002", "TA0006"]
BROWSER_BEHAVIORS = ["credential_submit", "untrusted_read", "untrusted_file_exec"]


def prune_candidates(candidates: DataFrame, claims: DataFrame, paths: DataFrame, tactics_only: bool = True) -> DataFrame:
    """Candidates (path_id, attack_id, tactic_ids, score) in scope: tactics only, unless told otherwise, and on paths (path_id, families, process_names) where a browser submits credentials and little else
    happens only those of three tactics."""
    behaviors = claims.groupBy("path_id").agg(F.collect_set("behavior").alias("_b"))
    browser = F.exists("process_names", lambda x: X.contains_any(F.lower(x), BROWSERS))
    narrow = F.array_contains("_b", "credential_submit") & (F.size(F.array_except("_b", strings(BROWSER_BEHAVIORS))) == 0) & F.array_contains("families", "mail_browser_context_tail") & browser
    held = paths.join(behaviors, "path_id").where(narrow).select("path_id", F.lit(True).alias("_narrow"))
    tactic = F.col("attack_id").startswith("TA")
    df = candidates.where(tactic) if tactics_only else candidates
    fits = F.when(tactic, F.col("attack_id").isin(BROWSER_TACTICS)).otherwise(holds_any("tactic_ids", BROWSER_TACTICS))
    return df.join(held, "path_id", "left").where(F.col("_narrow").isNull() | fits).select(*candidates.columns)


def map_tactics(claims: DataFrame, least: float = 0.72) -> DataFrame:
    """(path_id, tactic, behavior, confidence): a mapping of each claim to each tactic of its behaviour (the preferred one of behaviours that are no atoms), no less sure than `least`."""
    cat = F.broadcast(catalogue(claims.sparkSession).select("behavior", F.col("tactics").alias("_all")))
    x = claim_priors(claims).join(cat, "behavior", "left").withColumn("_t", F.coalesce("_all", F.array("preferred_tactic")))
    return x.select("path_id", F.explode("_t").alias("tactic"), "behavior", F.greatest("confidence", F.lit(least)).alias("confidence")).groupBy("path_id", "tactic", "behavior").agg(F.max("confidence").alias("confidence"))


COUNTERS = ["raw_mappings", "raw_refs", "claim_refs", "event_refs", "unknown_refs", "event_claims", "emptied", "unsupported", "kept"]


def validate_mappings(raw: DataFrame, claims: DataFrame, candidates: DataFrame, priors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings that hold (path_id, tactic_id, technique_id, behaviors, confidence), and counters of each path (COUNTERS).

    raw: (path_id, mapping_id, tactic_id, tactic, technique_id, technique, refs, confidence). refs name claims by behaviour or by the event ids of their evidence. Tactic and technique are looked up among
    the path's candidates (path_id, attack_id, name, tactic_ids) by id, else by name; a missing tactic is the first of the technique's that is a candidate. A technique must belong to the
    tactic, and only claims whose priors allow the tactic and do not prefer another technique support a mapping. Of equal mappings the surest stays.
    """
    refs = raw.select("path_id", "mapping_id", F.explode(F.array_distinct("refs")).alias("ref")).where("trim(ref) <> ''")
    known = claims.select("path_id", "behavior").distinct()
    of_event = claims.select("path_id", "behavior", F.explode("evidence").alias("_e")).select("path_id", F.col("_e").cast("string").alias("ref"), F.col("behavior").alias("_of_event")).distinct()
    hit = refs.join(known.select("path_id", F.col("behavior").alias("ref"), F.col("behavior").alias("_named")), ["path_id", "ref"], "left").join(of_event, ["path_id", "ref"], "left")
    hit = hit.withColumn("behavior", F.coalesce("_named", "_of_event")).withColumn("_kind", F.when(F.col("_named").isNotNull(), "claim").when(F.col("_of_event").isNotNull(), "event").otherwise("unknown"))
    counted = hit.groupBy("path_id", "mapping_id").agg(*[F.count_distinct(F.when(F.col("_kind") == k, F.col("ref"))).alias(f"{k}_refs") for k in ("claim", "event", "unknown")],
                                                       F.count_distinct("ref").alias("raw_refs"), F.array_sort(F.collect_set("behavior")).alias("_claims"),
                                                       F.count_distinct(F.when(F.col("_kind") == "event", F.col("behavior"))).alias("event_claims"))
    c = candidates.select("path_id", "attack_id", X.normalize_name("name").alias("_name"), "tactic_ids")
    tac, tec = c.where(F.col("attack_id").startswith("TA")), c.where(~F.col("attack_id").startswith("TA"))
    by_name = lambda df, alias: df.where("_name <> ''").groupBy("path_id", "_name").agg(F.min("attack_id").alias(alias))
    m = raw.withColumn("_tid", F.upper(F.trim("tactic_id"))).withColumn("_kid", F.replace(F.upper(F.trim("technique_id")), F.lit("/"), F.lit("."))).withColumn("_tn", X.normalize_name("tactic")).withColumn("_kn", X.normalize_name("technique"))
    m = m.join(tac.select("path_id", F.col("attack_id").alias("_tid"), F.col("attack_id").alias("_t1")), ["path_id", "_tid"], "left").join(by_name(tac, "_t2").withColumnRenamed("_name", "_tn"), ["path_id", "_tn"], "left")
    m = m.join(tec.select("path_id", F.col("attack_id").alias("_kid"), F.col("attack_id").alias("_k1")), ["path_id", "_kid"], "left").join(by_name(tec, "_k2").withColumnRenamed("_name", "_kn"), ["path_id", "_kn"], "left")
    m = m.withColumn("technique_", F.coalesce("_k1", "_k2")).join(tec.select("path_id", F.col("attack_id").alias("technique_"), F.col("tactic_ids").alias("_of")), ["path_id", "technique_"], "left")
    have = tac.groupBy("path_id").agg(F.collect_set("attack_id").alias("_have"))
    m = m.join(have, "path_id", "left").withColumn("tactic_", F.coalesce("_t1", "_t2", F.get(F.filter("_of", lambda x: F.array_contains("_have", x)), F.lit(0))))
    m = m.join(counted, ["path_id", "mapping_id"], "left").withColumn("_claims", F.coalesce("_claims", strings([])))
    fine = (F.size("_claims") > 0) & (F.col("tactic_").isNotNull() | F.col("technique_").isNotNull()) & (F.col("tactic_").isNull() | F.col("technique_").isNull() | F.array_contains("_of", F.col("tactic_")))
    m = written(m.withColumn("_fine", F.coalesce(fine, F.lit(False))), "looked-up")  # read twice
    backing = m.where("_fine").select("path_id", "mapping_id", "tactic_", "technique_", "_of", F.explode("_claims").alias("behavior")).join(priors.select("path_id", "behavior", "tactics", F.col("technique").alias("_want")), ["path_id", "behavior"], "left")
    tactic_ok = F.col("tactics").isNull() | F.when(F.col("tactic_").isNotNull(), F.array_contains("tactics", F.col("tactic_"))).otherwise((F.size("_of") == 0) | F.arrays_overlap("tactics", "_of"))
    technique_ok = F.col("_want").isNull() | F.col("technique_").isNull() | (F.col("_want") == F.col("technique_"))
    backed = backing.where(tactic_ok & technique_ok).groupBy("path_id", "mapping_id").agg(F.array_sort(F.collect_set("behavior")).alias("behaviors"))
    done = m.join(backed, ["path_id", "mapping_id"], "left")
    kept = done.where("_fine and behaviors is not null").groupBy("path_id", F.col("tactic_").alias("tactic_id"), F.col("technique_").alias("technique_id"), "behaviors").agg(F.max("confidence").alias("confidence"))
    count = {"raw_mappings": F.count("*"), **{n: F.sum(F.coalesce(n, F.lit(0))) for n in ("raw_refs", "claim_refs", "event_refs", "unknown_refs", "event_claims")},
             "emptied": F.count_if((F.size("_claims") == 0) & (F.coalesce("raw_refs", F.lit(0)) > 0)), "unsupported": F.count_if(F.col("_fine") & F.col("behaviors").isNull())}
    summary = done.groupBy("path_id").agg(*[v.cast("long").alias(n) for n, v in count.items()]).join(kept.groupBy("path_id").agg(F.count("*").alias("kept")), "path_id", "left").na.fill(0, ["kept"])
    return kept, summary.select("path_id", *COUNTERS)


def apply_priors(mappings: DataFrame, priors: DataFrame, candidates: DataFrame) -> DataFrame:
    """mappings (path_id, tactic_id, technique_id, behaviors, confidence) without those at odds with the prior of one of their claims, and a mapping for each prior whose tactic or technique is a candidate (path_id, attack_id)."""
    have = candidates.groupBy("path_id").agg(F.collect_set("attack_id").alias("_have"))
    p = priors.join(have, "path_id").withColumn("_t", F.when(F.array_contains("_have", F.col("preferred_tactic")), F.col("preferred_tactic"))).withColumn("_k", F.when(F.array_contains("_have", F.col("technique")), F.col("technique"))).where("_t is not null or _k is not null")
    m = written(mappings.withColumn("_id", F.xxhash64("path_id", "tactic_id", "technique_id", "behaviors")), "mappings")  # read twice
    clash = m.select("path_id", "_id", "tactic_id", "technique_id", F.explode("behaviors").alias("behavior")).join(p.select("path_id", "behavior", "_t", "_k"), ["path_id", "behavior"])
    odd = ((F.col("_t") != F.col("tactic_id")) | F.when(F.col("_k").isNotNull(), F.col("technique_id") != F.col("_k")).otherwise(F.col("technique_id").isNotNull()))
    clash = clash.where(F.coalesce(F.col("_t") != F.col("tactic_id"), F.lit(False)) | F.coalesce(odd, F.lit(False))).select("path_id", "_id").distinct()
    stay = m.join(clash, ["path_id", "_id"], "left_anti").select("path_id", "tactic_id", "technique_id", "behaviors", "confidence")
    new = p.select("path_id", F.col("_t").alias("tactic_id"), F.col("_k").alias("technique_id"), F.array("behavior").alias("behaviors"), "confidence")
    both = stay.withColumn("_new", F.lit(0)).union(new.withColumn("_new", F.lit(1)))
    first = Window.partitionBy("path_id", "tactic_id", "technique_id", "behaviors").orderBy("_new", F.desc("confidence"))
    return both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_new")


CLEANUP = ["clear_logs", "sensitive_temp_rm", "untrusted_file_rm"]
EXECUTION = ["attachment_user_exec", "make_file_exec", "untrusted_file_exec", "interpreter_precursor_chain", "shell_exec"]
#: Backfills: tactic, behaviours of which one is needed, further behaviours whose claims back it too, whether one of those is needed, family needed or none, confidence. Fixed values.
GENERIC_FILLS = [("TA0005", CLEANUP, [], False, None, 0.78), ("TA0009", ["sensitive_read"], EXECUTION, True, None, 0.76), ("TA0007", ["network_service_discovery"], CLEANUP, True, "cleanup_delete", 0.77)]
#: The same for hosts with sparse evidence, applied before.
DIRECT_FILLS = [("TA0001", ["untrusted_file_exec", "attachment_user_exec", "untrusted_read", "make_file_exec"], [], False, None, 0.78), ("TA0007", ["network_service_discovery"], [], False, None, 0.8),
                ("TA0005", CLEANUP, [], False, None, 0.8), ("TA0004", ["payload_elevate", "sudo_exec", "switch_su"], [], False, None, 0.79)]


def backfill_tactics(mappings: DataFrame, claims: DataFrame, candidates: DataFrame, paths: DataFrame, fills: list = GENERIC_FILLS) -> DataFrame:
    """mappings (path_id, tactic_id, behaviors, confidence) and, for each fill whose tactic is a candidate (path_id, attack_id) of the path (path_id, families) and not mapped yet, one backed by its claims.

    A discovery fill that needs a family does not hold where credentials are submitted."""
    b = claims.groupBy("path_id").agg(F.collect_set("behavior").alias("_b"))
    have = candidates.groupBy("path_id").agg(F.collect_set("attack_id").alias("_have"))
    done = mappings.groupBy("path_id").agg(F.collect_set("tactic_id").alias("_done"))
    df = paths.select("path_id", "families").join(b, "path_id").join(have, "path_id").join(done, "path_id", "left").withColumn("_done", F.coalesce("_done", strings([])))
    made = []
    for tactic, need, more, must, family, sure in fills:
        ok = F.array_contains("_have", tactic) & ~F.array_contains("_done", tactic) & holds_any("_b", need)
        ok = ok & holds_any("_b", more) if must else ok
        ok = ok & F.array_contains("families", family) & ~F.array_contains("_b", "credential_submit") if family else ok
        made.append(F.when(ok, F.struct(F.lit(tactic).alias("tactic_id"), F.array_sort(F.array_intersect("_b", strings([*need, *more]))).alias("behaviors"), F.lit(sure).alias("confidence"))))
    new = df.select("path_id", F.explode(F.array_compact(F.array(*made))).alias("x")).select("path_id", "x.*")
    return mappings.select("path_id", "tactic_id", "behaviors", "confidence").union(new)


FOLLOW_UP = ["shell_exec", "interpreter_precursor_chain", "cnc_communication", "payload_elevate", "sensitive_command"]


def guard_mappings(mappings: DataFrame, claims: DataFrame, paths: DataFrame) -> DataFrame:
    """mappings (path_id, tactic_id, behaviors, ...) without what their path's context speaks against.

    In a mail or browser tail: discovery beside submitted credentials without a stronger follow-up, and credential access backed by sensitive reads and shells alone. Everywhere: privilege escalation
    without an elevation, and reconnaissance on paths that clean up or show a strong compromise with a precursor."""
    b = claims.groupBy("path_id").agg(F.collect_set("behavior").alias("_b"))
    df = mappings.join(paths.select("path_id", "families"), "path_id", "left").join(b, "path_id", "left").withColumn("_b", F.coalesce("_b", strings([]))).withColumn("families", F.coalesce("families", strings([])))
    t, tail = F.col("tactic_id"), F.array_contains("families", "mail_browser_context_tail")
    drops = [
        tail & (t == "TA0007") & F.array_contains("_b", "credential_submit") & F.array_contains("_b", "network_service_discovery") & ~holds_any("_b", FOLLOW_UP),
        tail & (t == "TA0006") & ~F.array_contains("behaviors", "credential_submit") & (F.size(F.array_except("behaviors", strings(["sensitive_read", "shell_exec"]))) == 0),
        (t == "TA0004") & ~holds_any("behaviors", ["payload_elevate", "sudo_exec", "switch_su"]),
        (t == "TA0043") & (F.array_contains("families", "cleanup_delete") | (holds_any("_b", ["cnc_communication", "shell_exec", "payload_elevate"]) & holds_any("_b", ["interpreter_precursor_chain", "attachment_user_exec", "sensitive_command"]))),
    ]
    return df.where(~F.coalesce(reduce(lambda x, y: x | y, drops), F.lit(False))).select(*mappings.columns)


def evidence_support_rate(claims: DataFrame, mappings: DataFrame) -> DataFrame:
    """(path_id, rate): mean of the share of claims with evidence and the share of mappings (column behavior) with a claim; a side without rows counts as 0."""
    a = claims.groupBy("path_id").agg(F.avg((F.size("evidence") > 0).cast("double")).alias("_a"))
    b = mappings.groupBy("path_id").agg(F.avg(F.col("behavior").isNotNull().cast("double")).alias("_b"))
    return a.join(b, "path_id", "full").select("path_id", ((F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / 2).alias("rate"))


def indicators(timeline: DataFrame) -> DataFrame:
    """(path_id, kind, value): distinct addresses and paths of each path."""
    ips = F.transform(F.regexp_extract_all("object_key", F.lit(r"\d{1,3}(?:\.\d{1,3}){3}"), F.lit(0)), lambda x: F.struct(F.lit("ip").alias("kind"), x.alias("value")))
    path = F.when(F.col("object_key").startswith("/"), F.array(F.struct(F.lit("path").alias("kind"), F.col("object_key").alias("value"))))
    return timeline.select("path_id", F.explode(F.coalesce(path, ips)).alias("x")).select("path_id", "x.*").distinct()
