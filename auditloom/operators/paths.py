"""Candidate paths: search, scoring, support, families, selection and timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.functions import settings as S
from auditloom.operators import labels as L
from auditloom.operators.claims import DELETES, ELEVATION_HELPERS, LOGS, PRECURSORS, WEAK_PRECURSORS
from auditloom.operators.scratch import written

STAGES = ["Entry", "ExecutionWeak", "ExecutionStrong", "TargetAccess", "FollowUp"]
#: Stage of each process label; labels without one count for none. Fixed values.
STAGE_OF = {
    "P_WEB_CTX": "Entry", "P_REMOTE_CTX": "Entry", "P_NET_CTX": "Entry", "P_UNTRUSTED_CTX": "Entry", "P_HIGH_VALUE_CTX": "TargetAccess", "P_SUSPECT_CTRL_CTX": "ExecutionWeak",
    "B_EXTERNAL_RECV": "Entry", "B_EXTERNAL_SEND": "FollowUp", "B_EXEC_TEMP": "ExecutionStrong", "B_EXEC_DOWNLOADED": "ExecutionStrong", "B_EXEC_UPLOADED": "ExecutionStrong",
    "B_EXEC_SUSPECT_WRITTEN": "ExecutionStrong", "B_SHELL_SPAWN": "ExecutionWeak", "B_SCRIPT_EXEC": "ExecutionWeak", "B_INTERPRETER_LAUNCH": "ExecutionWeak", "B_READ_CRED": "TargetAccess",
    "B_READ_HISTORY": "TargetAccess", "B_READ_BUSINESS": "TargetAccess", "B_MASS_FILE_ACCESS": "TargetAccess", "B_WRITE_PERSISTENCE": "FollowUp", "B_WRITE_PRIV_CONFIG": "TargetAccess",
    "B_ARCHIVE_DATA": "FollowUp", "B_DELETE_LOG": "FollowUp", "B_LATERAL_CONNECT": "FollowUp", "B_REMOTE_LOGIN_SERVICE": "Entry", "B_WEB_WRITE": "Entry",
}
#: A path is a candidate if its stages hold one of these sets. Fixed values.
STAGE_SETS = [["Entry", "ExecutionStrong", "TargetAccess"], ["Entry", "ExecutionStrong", "FollowUp"], ["ExecutionStrong", "TargetAccess", "FollowUp"], ["Entry", "ExecutionWeak", "TargetAccess"],
              ["Entry", "ExecutionWeak", "FollowUp"], ["Entry", "ExecutionWeak"], ["Entry", "TargetAccess"], ["ExecutionWeak", "FollowUp"]]
FAMILIES = ["short_lived_precursor", "attachment_or_tcexec_exec", "initial_or_drop_exec", "privilege_escalation_followup", "callback_c2", "scan_discovery", "cleanup_delete", "mail_browser_context_tail"]


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if len(values) else F.array().cast("array<string>")


def holds(col: str, *labels: str) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(col, x) for x in labels])


def holds_any(col: str, *labels: str) -> Column:
    return F.arrays_overlap(F.col(col), strings(labels))


def process_edges(states: DataFrame, bridges: DataFrame) -> DataFrame:
    """(task_id, src, dst, kind, edge_us, confidence): parent to child at the child's start, where both are known, and bridges at their read."""
    known = states.select("task_id", F.col("process_guid").alias("src"))
    tree = states.where("parent_process_guid is not null").select("task_id", F.col("parent_process_guid").alias("src"), F.col("process_guid").alias("dst"), F.lit("parent").alias("kind"), F.col("first_us").alias("edge_us"), F.lit(0.0).alias("confidence"))
    tree = tree.join(known, ["task_id", "src"], "left_semi")
    over = bridges.select("task_id", "src", "dst", F.lit("bridge").alias("kind"), F.coalesce("read_us", "write_us").alias("edge_us"), "confidence")
    return tree.unionByName(over)


def seed_processes(labels: DataFrame) -> DataFrame:
    """(task_id, process): holders of a behaviour or of a web, remote, untrusted or suspect context."""
    hit = F.col("label").startswith("B_") | F.col("label").isin("P_WEB_CTX", "P_REMOTE_CTX", "P_UNTRUSTED_CTX", "P_SUSPECT_CTRL_CTX")
    return labels.where(hit).select("task_id", F.col("entity").alias("process")).distinct()


def search_paths(edges: DataFrame, seeds: DataFrame, max_depth: int = S.PATH_DEPTH, span_seconds: int = S.PATH_SPAN_SECONDS, gap_seconds: int = S.PATH_GAP_SECONDS) -> DataFrame:
    """(task_id, chain, start_us, last_us, bridges, confidence): simple chains of 2 to max_depth processes from the seeds.

    An edge's time must not lie before the last one, nor after it by more than the gap or after the chain's first by more than
    the span; a missing time passes. One row for each chain, with the earliest last edge. A join for each step, pruned
    as it goes; steps are written, so a long search survives lost executors. All chains are wanted, so the result grows with
    the fan-out to the power of max_depth - 1; span and gap are what bounds it. Hub processes are split: chains that end in
    one meet its edges in as many parts as it has thousands of edges.
    """
    e = written(edges.groupBy("task_id", "src", "dst", "edge_us").agg(F.max("confidence").alias("c"), F.max((F.col("kind") == "bridge").cast("int")).alias("b")), "paths")
    span, gap = span_seconds * 1_000_000, gap_seconds * 1_000_000
    fan = e.groupBy("task_id", "src").agg(F.ceil(F.count("*") / 1000).cast("int").alias("_parts"))
    e = e.join(fan, ["task_id", "src"]).withColumn("_part", F.pmod(F.xxhash64("dst", "edge_us"), F.col("_parts")).cast("int")).drop("_parts")
    fan = fan.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    level = seeds.select("task_id", F.array("process").alias("chain"), F.lit(None).cast("bigint").alias("start_us"), F.lit(None).cast("bigint").alias("last_us"), F.lit(0).alias("bridges"), F.lit(0.0).alias("confidence"))
    parts = []
    for _ in range(max_depth - 1):
        nxt = level.withColumn("src", F.element_at("chain", -1)).join(fan, ["task_id", "src"]).join(e, ["task_id", "src", "_part"])
        t = F.col("edge_us")
        ok = F.coalesce(t >= F.col("last_us"), F.lit(True)) & F.coalesce(t - F.col("start_us") <= span, F.lit(True)) & F.coalesce(t - F.col("last_us") <= gap, F.lit(True))
        nxt = nxt.where(~F.array_contains("chain", F.col("dst")) & ok)
        nxt = nxt.select("task_id", F.concat("chain", F.array("dst")).alias("chain"), F.coalesce("start_us", t).alias("start_us"), F.coalesce(t, "last_us").alias("last_us"), (F.col("bridges") + F.col("b")).alias("bridges"), (F.col("confidence") + F.col("c")).alias("confidence"))
        best = F.struct("last_us", "start_us", "bridges", "confidence")
        level = written(nxt.groupBy("task_id", "chain").agg(F.min(best).alias("x")).select("task_id", "chain", "x.*"), "paths").select("task_id", "chain", "start_us", "last_us", "bridges", "confidence")
        parts.append(level)
    return reduce(DataFrame.union, parts)


def path_stages(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """paths plus labels (sorted) and stages (in order) of their processes, of those that are candidates, and weak_only."""
    stage = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])
    lab = labels.select("task_id", F.col("entity").alias("process"), "label").distinct()
    by = paths.select("task_id", "chain", F.explode("chain").alias("process")).join(lab, ["task_id", "process"]).groupBy("task_id", "chain").agg(
        F.array_sort(F.collect_set("label")).alias("labels"), F.collect_set(stage[F.col("label")]).alias("_s"))
    df = paths.join(by, ["task_id", "chain"]).withColumn("stages", F.filter(strings(STAGES), lambda s: F.array_contains("_s", s))).drop("_s")
    fits = X.any_of(F.size(F.array_except(strings(g), F.col("stages"))) == 0 for g in STAGE_SETS)
    weak = holds("stages", "ExecutionWeak") & ~holds("stages", "ExecutionStrong")
    return df.where(fits).withColumn("weak_only", weak).withColumn("path_id", F.concat("task_id", F.lit(":"), F.sha1(F.concat_ws(">", "chain"))))


def trim_paths(paths: DataFrame, limit: int = 120) -> DataFrame:
    """The first `limit` paths of each task by more stages, shorter chain and id."""
    w = Window.partitionBy("task_id").orderBy(F.desc(F.size("stages")), F.size("chain"), "path_id")
    return paths.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


#: Points of label combinations: (points, sets one of which must be held). Fixed values.
COMBOS = [(30, [("B_EXTERNAL_RECV", "B_EXEC_TEMP"), ("B_EXTERNAL_RECV", "B_EXEC_DOWNLOADED")]), (20, [("B_EXTERNAL_RECV", "B_SHELL_SPAWN")]),
          (30, [("B_EXEC_DOWNLOADED", "B_READ_CRED"), ("B_EXEC_SUSPECT_WRITTEN", "B_READ_CRED")]), (40, [("B_READ_CRED", "B_EXTERNAL_SEND"), ("B_READ_BUSINESS", "B_EXTERNAL_SEND")]),
          (45, [("B_EXEC_DOWNLOADED", "B_WRITE_PERSISTENCE"), ("B_EXEC_SUSPECT_WRITTEN", "B_WRITE_PERSISTENCE")]), (30, [("B_EXEC_DOWNLOADED", "B_LATERAL_CONNECT"), ("B_EXEC_SUSPECT_WRITTEN", "B_LATERAL_CONNECT")])]


def score_paths(paths: DataFrame, priors: DataFrame) -> DataFrame:
    """paths plus risk_score and risk_level. priors: (task_id, task_score, top_processes, top_edges as `src>dst`, first_us, last_us), ordered best first."""
    points = F.create_map(*[F.lit(x) for k, v in S.LABEL_SCORES.items() for x in (k, float(v))])
    label = F.aggregate(F.transform("labels", lambda x: F.coalesce(points[x], F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    combo = sum((F.when(X.any_of(holds("labels", *s) for s in sets), float(p)).otherwise(0.0) for p, sets in COMBOS), F.lit(0.0))
    combo = combo + F.when((F.size("chain") >= 3) & (F.size("stages") >= 3), 20.0).otherwise(0.0)
    df = paths.join(priors.select("task_id", "task_score", "top_processes", "top_edges", F.col("first_us").alias("_f"), F.col("last_us").alias("_l")), "task_id", "left")

    def ranked(items: Column, top: str) -> Column:
        place = F.transform(items, lambda x: F.array_position(F.col(top), x).cast("double"))
        return F.aggregate(place, F.lit(0.0), lambda a, r: a + F.when(r > 0, F.greatest(F.lit(1.0), 11.0 - r)).otherwise(0.0))

    steps = F.transform(F.slice("chain", 2, F.size("chain") - 1), lambda x, i: F.concat(F.element_at("chain", i + 1), F.lit(">"), x))
    time = F.when(F.col("_f").isNull() | F.col("_l").isNull() | F.col("start_us").isNull() | F.col("last_us").isNull(), 0.0).when((F.col("start_us") >= F.col("_f")) & (F.col("last_us") <= F.col("_l")), 8.0).otherwise(-12.0)
    prior = F.coalesce(F.col("task_score"), F.lit(0.0)) * 20.0 + F.coalesce(ranked(F.col("chain"), "top_processes"), F.lit(0.0)) + F.coalesce(ranked(steps, "top_edges"), F.lit(0.0)) + time
    fine = F.when(F.col("weak_only"), 15.0).otherwise(0.0) + F.when(F.col("bridges") >= 4, 20.0).otherwise(0.0) + F.when((F.size("stages") == 1) & holds_any("labels", "B_READ_CRED", "B_READ_HISTORY", "B_READ_BUSINESS"), 20.0).otherwise(0.0)
    score = F.greatest(F.lit(0.0), label + combo + 12.0 * F.size("stages") + 12.0 * F.col("confidence") + prior - fine)
    return df.withColumn("risk_score", score).withColumn("risk_level", X.risk_level(F.col("risk_score"))).drop("task_score", "top_processes", "top_edges", "_f", "_l")


#: Kinds of chains: the stages that a path must hold (Execution: either of the two), tried in order. Fixed values.
CHAIN_KINDS = [("entry_exec_access_followup", ["Entry", "Execution", "TargetAccess", "FollowUp"]), ("entry_exec_access", ["Entry", "Execution", "TargetAccess"]), ("entry_collection_exfil", ["Entry", "TargetAccess", "FollowUp"]),
               ("entry_exec", ["Entry", "Execution"]), ("collection_followup", ["TargetAccess", "FollowUp"])]
FOLLOW_UP_LABELS = ["B_EXTERNAL_SEND", "B_LATERAL_CONNECT", "B_DELETE_LOG"]


def chain_kind(stages: str) -> Column:
    """The first kind of CHAIN_KINDS whose stages the path has all of, else generic_path; null or no stages are a generic path."""
    run = F.array_contains(stages, "ExecutionWeak") | F.array_contains(stages, "ExecutionStrong")
    holds_all = lambda need: reduce(lambda x, y: x & y, [run if n == "Execution" else F.array_contains(stages, n) for n in need])
    return X.cases([(holds_all(need), kind) for kind, need in CHAIN_KINDS], F.lit("generic_path"))


def first_of(rows: DataFrame, value: str, order: list, limit: int, out: str) -> DataFrame:
    """(path_id, out): the first `limit` values of each path in order; the others are cut before any are gathered."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("path_id").orderBy(*order))).where(F.col("_r") <= limit)
    return ranked.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("_r", value))).alias("_x")).select("path_id", F.col(f"_x.{value}").alias(out))


def support_rows(paths: DataFrame, events: DataFrame, bridges: DataFrame) -> DataFrame:
    """path_id with each event that supports it: labelled events of its processes and the ends of bridges between its neighbours."""
    link = paths.select("path_id", "task_id", F.explode("chain").alias("process_guid"))
    own = link.join(events.where(F.size("labels_triggered") > 0), ["task_id", "process_guid"])
    ends = path_bridges(paths, bridges).select("path_id", "task_id", F.explode(F.array("write_event", "read_event")).alias("event_id")).distinct()
    return own.unionByName(ends.join(events, ["task_id", "event_id"])).dropDuplicates(["path_id", "event_id"])


def path_bridges(paths: DataFrame, bridges: DataFrame) -> DataFrame:
    """Bridges between neighbours of each path's chain, with the path's id; a bridge that serves two steps comes twice, chains of one process have none."""
    steps = paths.select("path_id", "task_id", F.explode(F.transform(F.slice("chain", 2, F.size("chain") - 1), lambda x, i: F.struct(F.element_at("chain", i + 1).alias("src"), x.alias("dst")))).alias("s")).select("path_id", "task_id", "s.*")
    return steps.join(bridges, ["task_id", "src", "dst"])


def path_support(paths: DataFrame, events: DataFrame, bridges: DataFrame, contexts: DataFrame | None = None, limit: int = 12, ids: int = 8) -> DataFrame:
    """paths plus support_events, support_objects and relations (the first `limit` of each), precursors and followups (the first `ids` events of each), contexts and chain_kind.

    events: normalized events with labels_triggered; contexts (task_id, holder, context_id). Precursors are sought among the supporting events. Follow-ups are, first, deletions of staged
    or temporary objects by the path's processes or their children and helper programs, then sends, lateral connections, deleted logs and other network events among the supporting ones.
    """
    rows = written(support_rows(paths, events, bridges), "support")
    over = path_bridges(paths, bridges)
    ev = first_of(rows, "event_id", ["order_index", "event_id"], limit, "support_events")
    obj = first_of(rows.select("path_id", "object_key").where("object_key <> ''").distinct(), "object_key", ["object_key"], limit, "support_objects")
    rel = first_of(over.select("path_id", F.concat_ws("|", "src", "bridge_type", "object_key", "dst").alias("relation")).distinct(), "relation", ["relation"], limit, "relations")
    staged = over.where(holds_any("labels", *L.STAGED_LABELS)).select("path_id", "object_key").distinct().withColumn("on_staged", F.lit(True))
    temp = X.is_temp_exec_path("object_key")
    marked = rows.join(staged, ["path_id", "object_key"], "left").withColumn("on_staged", F.coalesce("on_staged", F.lit(False)) | (temp & ~X.is_placeholder_key("object_key")))
    pre = L.precursor_events(marked.withColumn("task_id", F.col("path_id")), PRECURSORS, WEAK_PRECURSORS, F.col("on_staged"), ids).select(F.col("task_id").alias("path_id"), "event_id", "rank")
    pre = first_of(pre, "event_id", ["rank"], ids, "precursors")
    link = paths.select("path_id", "task_id", F.explode("chain").alias("process_guid"))
    gone = events.where(F.col("event_type").isin(DELETES) & (F.col("object_key") != "") & ~X.is_placeholder_key("object_key"))
    by_child = link.withColumnRenamed("process_guid", "parent_process_guid").join(gone, ["task_id", "parent_process_guid"])
    held = marked.where("on_staged").select("path_id", "object_key").distinct().withColumn("_held", F.lit(True))
    clean = link.join(gone, ["task_id", "process_guid"]).select("path_id", "event_id", "order_index", "object_key").unionByName(by_child.select("path_id", "event_id", "order_index", "object_key")).join(held, ["path_id", "object_key"], "left")
    clean = clean.where(F.col("_held") | temp).join(held.select("path_id").distinct(), "path_id", "left_semi").select("path_id", "event_id", "order_index", F.lit(0).alias("_p"))
    t, c = F.col("event_type"), F.col("object_class")
    usual = holds_any("labels_triggered", *FOLLOW_UP_LABELS) | (c.isin("external_ip", "internal_ip") & t.isin("SEND", "RECV", "CONNECT")) | (t.isin(DELETES) & temp)
    place = X.cases([((t == "EXEC") & X.basename(F.lower("object_key")).isin(ELEVATION_HELPERS), F.lit(1)), (usual, F.lit(2))], F.lit(None).cast("int"))
    after = rows.select("path_id", "event_id", "order_index", place.alias("_p")).where("_p is not null").unionByName(clean)
    after = first_of(after.groupBy("path_id", "event_id", "order_index").agg(F.min("_p").alias("_p")), "event_id", ["_p", "order_index", "event_id"], ids, "followups")
    out = paths
    for part in (ev, obj, rel, pre, after):
        out = out.join(part, "path_id", "left")
    id_type = dict(events.dtypes)["event_id"]
    for name, kind in (("support_events", id_type), ("support_objects", "string"), ("relations", "string"), ("precursors", id_type), ("followups", id_type)):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    if contexts is not None:
        holders = out.select("path_id", "task_id", F.explode(F.array_distinct(F.concat("chain", "support_objects"))).alias("holder"))
        known = holders.join(contexts, ["task_id", "holder"]).groupBy("path_id").agg(F.array_sort(F.collect_set("context_id")).alias("contexts"))
        out = out.join(known, "path_id", "left").withColumn("contexts", F.coalesce("contexts", strings([])))
    return out.withColumn("chain_kind", chain_kind("stages"))


def family_tags(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """paths plus families, in order of priority, from labels and from the lower-case text of the path's events and processes (path_id, text)."""
    df = paths.join(texts.select("path_id", F.lower("text").alias("_t")), "path_id", "left").withColumn("_t", F.coalesce("_t", F.lit("")))
    t = F.col("_t")
    tests = {
        "short_lived_precursor": F.size("precursors") > 0 if "precursors" in paths.columns else F.lit(False),
        "attachment_or_tcexec_exec": X.contains_any(t, ["tcexec", ".xlsm", "attachment"]),
        "initial_or_drop_exec": X.contains_any(t, X.TEMP_EXEC_MARKERS) | holds_any("labels", "B_EXEC_TEMP", "B_EXEC_DOWNLOADED", "B_EXEC_UPLOADED", "B_EXEC_SUSPECT_WRITTEN"),
        "privilege_escalation_followup": t.contains("payload_elevate"),
        "callback_c2": holds_any("labels", "B_EXTERNAL_SEND", "B_EXTERNAL_RECV"), "scan_discovery": holds_any("labels", "B_LATERAL_CONNECT"),
        "cleanup_delete": holds_any("labels", "B_DELETE_LOG"), "mail_browser_context_tail": X.contains_any(t, ["firefox", "thunderbird", "browser", "mail"]),
    }
    return df.withColumn("families", F.array_compact(F.array(*[F.when(tests[f], F.lit(f)) for f in FAMILIES]))).drop("_t")


def truth_hints(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """paths plus hints: markers whose family is missing, and families that ought to come with another."""
    df = paths.join(texts.select("path_id", F.lower("text").alias("_t")), "path_id", "left").withColumn("_t", F.coalesce("_t", F.lit("")))
    has = lambda f: F.array_contains("families", f)
    tests = {"attachment_markers_without_exec_family": X.contains_any(F.col("_t"), ["tcexec", ".xlsm", "attachment"]) & ~has("attachment_or_tcexec_exec"),
             "elevate_markers_without_privilege_family": F.col("_t").contains("elevate") & ~has("privilege_escalation_followup"),
             "external_network_seen_without_callback_family": has("scan_discovery") & ~has("callback_c2") & F.col("_t").contains("remote_targets="),
             "mail_browser_tail_without_precursor": has("mail_browser_context_tail") & ~has("short_lived_precursor")}
    return df.withColumn("hints", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))).drop("_t")


def rescue_precursor(precursors: DataFrame, states: DataFrame, paths: DataFrame, seconds: int = 600) -> DataFrame:
    """(task_id, chain) for tasks without a precursor path but with two or more precursor events: all their processes, and all siblings that start within `seconds` of one, by start."""
    have = paths.where(F.array_contains("families", "short_lived_precursor")).select("task_id").distinct()
    p = precursors.join(have, "task_id", "left_anti")
    many = p.groupBy("task_id").agg(F.count("*").alias("n")).where("n >= 2").select("task_id")
    own = p.join(many, "task_id").select("task_id", "process_guid").distinct().join(states.select("task_id", "process_guid", "parent_process_guid", "first_us"), ["task_id", "process_guid"])
    near = own.select("task_id", "parent_process_guid", F.col("first_us").alias("_u")).join(states.select("task_id", "process_guid", "parent_process_guid", "first_us"), ["task_id", "parent_process_guid"]).where(F.abs(F.col("first_us") - F.col("_u")) <= seconds * 1_000_000)
    rows = own.select("task_id", "process_guid", "first_us").union(near.select("task_id", "process_guid", "first_us")).distinct()
    return rows.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("first_us", "process_guid"))).alias("_c")).select("task_id", F.col("_c.process_guid").alias("chain"))


def select_paths(paths: DataFrame, k: int = 20, preserve: bool = True) -> DataFrame:
    """k paths of each task: the best of each family first, in order of priority, then the rest by risk; or simply by risk."""
    order = [F.desc("risk_score"), F.desc(F.size("stages")), "path_id"]
    one = paths.withColumn("_d", F.row_number().over(Window.partitionBy("task_id", "chain", "families").orderBy(*order))).where("_d = 1").drop("_d")
    if not preserve:
        return one.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(*order))).where(F.col("rank") <= k)
    place = F.create_map(*[F.lit(x) for i, f in enumerate(FAMILIES) for x in (f, i)])
    fam = one.select("task_id", "path_id", "risk_score", "stages", F.explode("families").alias("_f")).withColumn("_b", F.row_number().over(Window.partitionBy("task_id", "_f").orderBy(*order))).where("_b = 1")
    first = fam.groupBy("task_id", "path_id").agg(F.min(place[F.col("_f")]).alias("_p"))
    w = Window.partitionBy("task_id").orderBy(F.asc_nulls_last("_p"), *order)
    return one.join(first, ["task_id", "path_id"], "left").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_p")


def rerank_paths(paths: DataFrame, provenance: DataFrame, events: DataFrame) -> DataFrame:
    """paths with risk_score moved by up to 4 for compact, well-founded and coherent support. provenance: (task_id, holder, label); needs path_support."""
    span = paths.select("path_id", "task_id", F.explode("support_events").alias("event_id")).join(events.select("task_id", "event_id", "us"), ["task_id", "event_id"]).groupBy("path_id").agg(((F.max("us") - F.min("us")) / 6e7).alias("_span"), F.count("us").alias("_n"))
    key = F.filter("labels", lambda x: x.startswith("B_") | x.isin("P_UNTRUSTED_CTX", "P_WEB_CTX", "P_REMOTE_CTX"))
    holders = paths.select("path_id", "task_id", F.explode(F.concat("chain", "support_objects")).alias("holder"))
    held = holders.join(provenance.select("task_id", "holder", "label").distinct(), ["task_id", "holder"]).groupBy("path_id").agg(F.collect_set("label").alias("_held"))
    df = paths.join(span, "path_id", "left").join(held, "path_id", "left").withColumn("_key", key)
    s, n, o, r = F.col("_span"), F.size("_key"), F.size("support_objects"), F.size("relations")
    compact = F.when((F.size("support_events") < 2) | (F.coalesce("_n", F.lit(0)) < 2), 0.0).when(s <= 5, 2.0).when(s <= 15, 1.0).when(s <= 45, 0.0).when(s <= 90, -1.0).when(s <= 180, -2.0).otherwise(-3.0)
    ratio = F.size(F.array_intersect("_key", F.coalesce("_held", F.array().cast("array<string>")))) / n
    dense = F.when(n == 0, 0.0).when(ratio >= 0.85, 3.0).when(ratio >= 0.6, 1.5).when(ratio >= 0.35, 0.0).when(ratio > 0, -1.5).otherwise(-3.0)
    coherent = F.when((o == 0) & (r == 0), 0.0).when((o <= 3) & (r >= 1), 1.0).when((o <= 5) & (r >= F.greatest(F.lit(1), F.floor(o / 2))), 0.5).when((o >= 8) & (r <= 1), -2.0).when((o >= 6) & (r <= 2), -1.0).when(o > 3 * F.greatest(F.lit(1), r), -1.0).otherwise(0.0)
    total = compact + dense + coherent
    score = F.greatest(F.lit(0.0), F.col("risk_score") + F.least(F.lit(4.0), F.greatest(F.lit(-4.0), total)))
    return df.withColumn("support_quality", total).withColumn("risk_score", score).withColumn("risk_level", X.risk_level(F.col("risk_score"))).drop("_span", "_n", "_held", "_key")


def path_summaries(states: DataFrame, labels: DataFrame, paths: DataFrame, bridges: DataFrame) -> DataFrame:
    """Per task: processes, suspicious processes, bridges, paths and the best risk."""
    sus = seed_processes(labels).groupBy("task_id").agg(F.count("*").alias("suspicious"))
    return states.groupBy("task_id").agg(F.count("*").alias("processes")).join(sus, "task_id", "left").join(bridges.groupBy("task_id").agg(F.count("*").alias("bridges")), "task_id", "left").join(
        paths.groupBy("task_id").agg(F.count("*").alias("paths"), F.max("risk_score").alias("best_risk")), "task_id", "left").na.fill(0)


SIGNAL_TYPES = ["EXEC", "WRITE", "CREATE", "DELETE", "RENAME", "CHMOD", "CONNECT", "SEND", "RECV"]
SIGNAL_CLASSES = ["temp_file", "credential_file", "history_file", "business_file", "persistence_file", "privilege_file", "external_ip"]


def timeline(paths: DataFrame, events: DataFrame, bridge_events: DataFrame, max_items: int = 24) -> DataFrame:
    """(path_id, event_id, order_index, priority): the most telling events of each path's processes; pinned ones (column pinned, if there) always.

    events need labels_triggered; bridge_events (task_id, event_id)."""
    link = paths.select("path_id", "task_id", F.explode("chain").alias("process_guid"))
    b = bridge_events.select("task_id", "event_id").distinct().withColumn("_bridge", F.lit(True))
    e = link.join(events, ["task_id", "process_guid"]).join(b, ["task_id", "event_id"], "left")
    n = F.size("labels_triggered")
    flag = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0)
    score = flag(F.col("_bridge"), 100) + F.when(n > 0, 40 + 12 * n).otherwise(0) + flag(F.exists("labels_triggered", lambda x: x.startswith("B_")), 20) + flag(F.col("event_type").isin(SIGNAL_TYPES), 8) + flag(
        F.col("object_class").isin(SIGNAL_CLASSES), 8) + flag(X.is_temp_exec_path("object_key"), 10) + flag(F.col("object_key").contains("->") | F.col("object_class").isin("external_ip", "internal_ip"), 6)
    pin = F.col("pinned") if "pinned" in events.columns else F.lit(False)
    e = e.withColumn("priority", score).withColumn("_r", F.row_number().over(Window.partitionBy("path_id").orderBy(F.desc(pin), F.desc(score), "order_index", "event_id")))
    return e.where((F.col("_r") <= max_items) | pin).select("path_id", "task_id", "event_id", "order_index", "priority")


#: Names of service programs; beside them every name of four letters and more that ends in d counts. Fixed values.
SERVICES = ["cron", "cleanup", "cupsd", "dbus-daemon", "login", "master", "pickup", "postfix", "qmgr", "rpcbind", "smtpd", "sshd", "systemd"]


def object_summaries(timelines: DataFrame, events: DataFrame, object_labels: DataFrame, limit: int = 4) -> DataFrame:
    """(path_id, category, names): the first `limit` objects of a path's timeline in each category: system, strong, weak and weak_system (sensitive), log_cleanup and staged_cleanup.

    events: normalized events with labels_triggered; object_labels (task_id, entity, label)."""
    lab = object_labels.groupBy("task_id", F.col("entity").alias("object_key")).agg(F.collect_set("label").alias("_l"))
    e = timelines.select("path_id", "task_id", "event_id").join(events, ["task_id", "event_id"]).join(lab, ["task_id", "object_key"], "left").withColumn("_l", F.coalesce("_l", strings([]))).where("object_key <> ''")
    c, k, service = F.col("object_class"), F.lower("object_key"), X.is_system_service_key("object_key")
    strong = holds_any("_l", "O_CREDENTIAL", "O_HISTORY", "O_SENSITIVE_STRONG") | c.isin("credential_file", "history_file") | holds_any("labels_triggered", "B_READ_CRED", "B_READ_HISTORY")
    weak = holds_any("_l", "O_BUSINESS_DATA", "O_SENSITIVE_WEAK") | (c == "business_file") | holds_any("labels_triggered", "B_READ_BUSINESS", "B_MASS_FILE_ACCESS")
    gone = F.col("event_type").isin(DELETES) & ~X.is_placeholder_key("object_key")
    log = holds_any("labels_triggered", "B_DELETE_LOG") | (c == "log_file") | X.contains_any(k, LOGS) | holds_any("_l", "O_LOG_ARTIFACT")
    staged = X.is_temp_exec_path("object_key") | holds_any("_l", *L.STAGED_LABELS, "O_STAGED_EXEC_SOURCE")
    tests = {"system": service, "strong": strong, "weak": weak & ~strong & ~service, "weak_system": weak & ~strong & service, "log_cleanup": gone & log, "staged_cleanup": gone & ~log & staged}
    names = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))
    rows = e.select("path_id", "object_key", "order_index", F.explode(names).alias("category")).groupBy("path_id", "category", "object_key").agg(F.min("order_index").alias("_o"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("path_id", "category").orderBy("_o", "object_key"))).where(F.col("_r") <= limit)
    return rows.groupBy("path_id", "category").agg(F.array_sort(F.collect_list(F.struct("_r", "object_key"))).alias("_x")).select("path_id", "category", F.col("_x.object_key").alias("names"))


def dossiers(paths: DataFrame, timelines: DataFrame, states: DataFrame, events: DataFrame, object_labels: DataFrame, max_items: int = 24) -> DataFrame:
    """One nested document for each path: chain, stages, risk, its timeline in order, its service programs and a map of object summaries."""
    t = timelines.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "event_id", "priority"))).alias("timeline"))
    name = F.lower(F.trim("process_name"))
    own = paths.select("path_id", "task_id", F.posexplode("chain").alias("_i", "process_guid")).join(states.select("task_id", "process_guid", name.alias("name")), ["task_id", "process_guid"])
    own = own.where(F.col("name").isin(SERVICES) | (F.col("name").endswith("d") & (F.length("name") >= 4))).groupBy("path_id", "name").agg(F.min("_i").alias("_i"))
    service = own.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("_i", "name"))).alias("_s")).select("path_id", F.slice(F.col("_s.name"), 1, 4).alias("services"))
    seen = object_summaries(timelines, events, object_labels).groupBy("path_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "names"))).alias("objects"))
    return paths.join(t, "path_id", "left").join(service, "path_id", "left").join(seen, "path_id", "left").select(
        "task_id", "path_id", F.struct("chain", "stages", "labels", "risk_score", "risk_level").alias("path"), F.slice("timeline", 1, max_items).alias("timeline"), F.coalesce("services", strings([])).alias("services"), "objects")
