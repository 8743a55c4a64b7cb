"""Process identity and joins of evidence to tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditloom.functions import scalars as X
from auditloom.operators.scratch import written


def first_by(key, order) -> Window:
    """A window of each key's rows in order; null keys share one, null orders come first."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([order] if isinstance(order, str) else order))


def resolve_process_alias(subjects: DataFrame, mode: str = "identity") -> DataFrame:
    """(raw_id, canonical_id, parent_id) of subjects (uuid, parent, cid, ppid, tgid, path, ord).

    identity: the uuid itself. pid: the cid; parent is a non-zero ppid, else the cid of the parent uuid. thread_group: the
    first uuid (smallest ord) with the same parent, tgid and path. The first row of a repeated uuid counts.
    """
    s = subjects.groupBy("uuid").agg(*[F.min_by(c, "ord").alias(c) for c in ("parent", "cid", "ppid", "tgid", "path")], F.min("ord").alias("ord"))
    if mode == "identity":
        return s.select(F.col("uuid").alias("raw_id"), F.col("uuid").alias("canonical_id"), F.col("parent").alias("parent_id"))
    if mode == "pid":
        parent = s.select(F.col("uuid").alias("parent"), F.col("cid").alias("_pcid"))
        own = F.when(X.text("ppid").isin("", "0"), F.lit(None)).otherwise(F.col("ppid"))
        return s.join(parent, "parent", "left").select(F.col("uuid").alias("raw_id"), F.coalesce("cid", "uuid").alias("canonical_id"), F.coalesce(own, "_pcid").alias("parent_id"))
    if mode == "thread_group":
        key = ["parent", "tgid", "path"]
        named = [F.col(k).alias(f"_{k}") for k in key]
        head = s.groupBy(*named).agg(F.min_by("uuid", "ord").alias("_head"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        canon = s.join(head, same).select(F.col("uuid").alias("raw_id"), F.when(F.col("tgid").isNull(), F.col("uuid")).otherwise(F.col("_head")).alias("canonical_id"), "parent")
        up = canon.select(F.col("raw_id").alias("parent"), F.col("canonical_id").alias("_up"))
        return canon.join(up, "parent", "left").select("raw_id", "canonical_id", F.coalesce("_up", "parent").alias("parent_id"))
    raise ValueError(f"unknown mode {mode!r}")


def apply_alias(events: DataFrame, alias: DataFrame, ends: tuple[str, ...] = ("subject", "object")) -> DataFrame:
    """Both ends replaced by their canonical id, unknown ids kept."""
    for e in ends:
        a = alias.select(F.col("raw_id").alias(e), F.col("canonical_id").alias(f"_{e}"))
        events = events.join(a, e, "left").withColumn(e, F.coalesce(f"_{e}", e)).drop(f"_{e}")
    return events


def node_dimension(nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """First attributes (smallest ord) of each needed uuid; nodes (uuid, node_type, node_attr, ord)."""
    return nodes.join(needed.select("uuid").distinct(), "uuid", "left_semi").groupBy("uuid").agg(F.min_by("node_type", "ord").alias("node_type"), F.min_by("node_attr", "ord").alias("node_attr"))


def select_tasks(tasks: DataFrame, mode: str) -> DataFrame:
    """predicted_positive, ground_truth_positive, or either with _base_only, which drops augmented tasks."""
    col = "predicted_label" if mode.startswith("predicted_positive") else "label"
    if not mode.startswith(("predicted_positive", "ground_truth_positive")):
        raise ValueError(f"unknown mode {mode!r}")
    out = tasks.where(F.col(col) == 1)
    return out.where(~X.is_augmented_task("task_id")) if mode.endswith("_base_only") else out


def score_percentile(tasks: DataFrame, score: str = "score") -> DataFrame:
    """tasks plus percentile (share of scores not above the own, times 100) and severity, which is Moderate at least.

    Ranks come from counts of distinct scores in a range-partitioned running sum, so no window holds all rows."""
    n = tasks.groupBy(score).agg(F.count("*").alias("_n"))
    upto = running_total(n, score, "_n", "_upto")
    total = n.agg(F.sum("_n").alias("_all"))
    p = 100.0 * F.col("_upto") / F.col("_all")
    sev = X.severity(F.col("percentile"))
    return tasks.join(upto.drop("_n"), score).crossJoin(F.broadcast(total)).withColumn("percentile", p).drop("_upto", "_all").withColumn(
        "severity", F.when(sev.isin("Minor", "Negligible"), "Moderate").otherwise(sev))


def running_total(df: DataFrame, order: str, value: str | list[str], out: str | list[str]) -> DataFrame:
    """df plus the sums of the values over all rows of smaller or equal `order`, which may be of any orderable type and whose values are unique.

    Rows are range-partitioned into as many ranges as the session has shuffle partitions, and written with the number of their range; each range's own running sum is moved
    by the total of the ranges before it (a row for each range, broadcast). Null orders come first; an empty table gives an empty result.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    d = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = d.groupBy("_part").agg(*[F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)])
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = before.select("_part", *[F.coalesce(F.sum(f"_s{i}").over(w), F.lit(0)).alias(f"_b{i}") for i in range(len(values))])
    own = Window.partitionBy("_part").orderBy(order)
    sums = [(F.sum(v).over(own) + F.col(f"_b{i}")).alias(o) for i, (v, o) in enumerate(zip(values, outs, strict=True))]
    return d.join(F.broadcast(before), "_part").select(*df.columns, *sums)


def exact_quantiles(df: DataFrame, value: str, wanted: dict[str, float]) -> DataFrame:
    """One row: the exact interpolated quantiles of a column by name; nulls do not count, no value gives nulls.

    Counts of distinct values with running sums stand in for a sort of all rows in one task."""
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_total(n, "_v", "_n", "_upto")
    total = n.agg(F.sum("_n").alias("_all"))
    place = {name: F.lit(q) * (F.col("_all") - 1) for name, q in wanted.items()}
    at = upto.join(F.broadcast(total))  # one row
    ends = [F.min(F.when(F.col("_upto") > f(p), F.col("_v"))).alias(f"_{name}_{side}") for name, p in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    row = at.agg(F.max("_all").alias("_all"), *ends)
    return row.select(*[(F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (p - F.floor(p))).alias(name) for name, p in place.items()])


def match_frontier(events: DataFrame, task_nodes: DataFrame, include_object_side: bool = True) -> DataFrame:
    """Events of each task that holds their subject (or object): events plus task_id, once for each task."""
    t = task_nodes.select("task_id", "node_id").distinct()
    out = events.join(t.withColumnRenamed("node_id", "subject"), "subject")
    if include_object_side:
        out = out.unionByName(events.join(t.withColumnRenamed("node_id", "object"), "object"))
    return out.dropDuplicates(["task_id", "event_id"])


IDENTITY = ("subject", "object", "action", "ts", "type_hint", "attr_hint")


def recover_evidence(events: DataFrame, task_nodes: DataFrame, hops: int = 1, cap: int | None = 300_000, include_object_side: bool = True) -> DataFrame:
    """Events within `hops` rounds of each task: task_id, hop, order_index, dropped (events over the task's cap).

    The next round's frontier are the processes of the events found. Equal events (six fields) count once for each
    task, the first of them, before the cap counts; order is by hop, then event_id.
    """
    frontier, found = task_nodes.select("task_id", "node_id"), None
    same = [c for c in IDENTITY if c in events.columns]
    for hop in range(1, hops + 1):
        got = match_frontier(events, frontier, include_object_side).withColumn("hop", F.lit(hop))
        found = got if found is None else found.unionByName(got)
        if hop < hops:
            frontier = got.select("task_id", F.col("subject").alias("node_id")).union(got.where("object_is_process").select("task_id", F.col("object").alias("node_id")) if "object_is_process" in got.columns else got.select("task_id", F.col("subject").alias("node_id"))).distinct()
    once = found.withColumn("_rn", F.row_number().over(Window.partitionBy("task_id", *same).orderBy("hop", "event_id"))).where("_rn = 1").drop("_rn")
    ranked = once.withColumn("order_index", F.row_number().over(Window.partitionBy("task_id").orderBy("hop", "event_id")))
    if cap is None:
        return ranked.withColumn("dropped", F.lit(0).cast("long"))
    n = ranked.groupBy("task_id").agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("dropped"))
    return ranked.where(F.col("order_index") <= cap).join(n, "task_id")


def normalize_events(matched: DataFrame, node_dim: DataFrame) -> DataFrame:
    """Normalized events of matched ones (task_id, order_index, subject, object, action, ts, type_hint, attr_hint, raw): all of the scalar functions in one projection."""
    s = node_dim.select(F.col("uuid").alias("subject"), F.col("node_attr").alias("_sattr"))
    o = node_dim.select(F.col("uuid").alias("object"), F.col("node_type").alias("_otype"), F.col("node_attr").alias("_oattr"))
    df = matched.join(s, "subject", "left").join(o, "object", "left")
    kind = X.normalize_node_type(X.first_non_empty("_otype", "type_hint"))
    df = df.withColumn("event_type", X.normalize_event_type("action")).withColumn("object_type", kind).withColumn(
        "object_key", X.object_key(X.first_non_empty("_oattr", "attr_hint"), F.col("object"))).withColumn("_p", X.first_non_empty("_sattr", "subject"))
    df = df.withColumn("_f", X.flow_endpoints("object_key"))
    return df.select(
        F.concat("task_id", F.lit(":"), F.lpad(F.col("order_index").cast("string"), 8, "0")).alias("event_id"), "task_id", F.col("ts").alias("timestamp"), "order_index",
        F.col("subject").alias("process_guid"), X.process_name("_p").alias("process_name"), X.process_exe("_p").alias("process_exe"), X.process_cmdline("_p").alias("process_cmdline"),
        "event_type", "object_type", "object_key", X.object_name("object_key").alias("object_name"), X.classify_object("object_type", "object_key").alias("object_class"),
        X.syscall_direction(F.col("event_type"), F.col("object_type")).alias("syscall_direction"), X.semantic_flow_direction(F.col("event_type"), F.col("object_type")).alias("semantic_flow_direction"),
        X.event_result("raw").alias("result"), "_f.local_ip", "_f.local_port", "_f.remote_ip", "_f.remote_port", F.col("raw").alias("raw_event"))


def parent_process(events: DataFrame, alias: DataFrame, process: str = "process_guid") -> DataFrame:
    """events plus parent_process_guid: the raw record's own (column raw_parent), else the alias table's."""
    a = alias.select(F.col("canonical_id").alias(process), F.col("parent_id").alias("_p")).groupBy(process).agg(F.min("_p").alias("_p"))
    own = X.blank_to_null("raw_parent") if "raw_parent" in events.columns else F.lit(None)
    return events.join(a, process, "left").withColumn("parent_process_guid", F.coalesce(own, X.blank_to_null("_p"))).drop("_p")


def refresh_placeholders(events: DataFrame, node_dim: DataFrame) -> DataFrame:
    """Second pass: blank, numeric or id-like process names and object keys are filled from the node table, then classified anew."""
    uuid = r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"
    p = node_dim.select(F.col("uuid").alias("process_guid"), F.col("node_attr").alias("_p"))
    o = node_dim.select(F.col("uuid").alias("object_key"), F.col("node_attr").alias("_o"), F.col("node_type").alias("_t"))
    df = events.join(p, "process_guid", "left").join(o, "object_key", "left")
    name = X.text("process_name")
    poor = (name == "") | (name == F.col("process_guid")) | name.rlike(r"^\d+$")
    weak = F.col("object_type").isin("object", "") | F.col("object_class").isin("object", "") | F.col("object_key").rlike(uuid)
    df = df.withColumn("process_name", F.when(poor & X.blank_to_null("_p").isNotNull(), X.process_name("_p")).otherwise(F.col("process_name")))
    hit = weak & X.blank_to_null("_o").isNotNull()
    df = df.withColumn("object_type", F.when(hit, X.normalize_node_type(F.col("_t"))).otherwise(F.col("object_type"))).withColumn("object_key", F.when(hit, X.text("_o")).otherwise(F.col("object_key")))
    return df.withColumn("object_class", F.when(hit, X.classify_object("object_type", "object_key")).otherwise(F.col("object_class"))).drop("_p", "_o", "_t")


def entity_index(events: DataFrame) -> DataFrame:
    """Attributes of the first event, first and last time and count of each process and each object that is no process."""
    p = events.groupBy("task_id", F.lit("process").alias("entity"), F.col("process_guid").alias("key"))
    o = events.where("object_type <> 'process'").groupBy("task_id", F.lit("object").alias("entity"), F.col("object_key").alias("key"))
    return p.agg(F.min_by("process_name", "order_index").alias("name"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n")).unionByName(
        o.agg(F.min_by("object_class", "order_index").alias("name"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n")))


def event_index(events: DataFrame, key: str) -> DataFrame:
    """(task_id, key, place, event_id): the events of each key in order, as rows, so that no key's events become one row."""
    place = F.row_number().over(Window.partitionBy("task_id", key).orderBy("order_index", "event_id"))
    return events.select("task_id", key, place.alias("place"), "event_id")


def evidence_graph(events: DataFrame, priors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (task, process, event type, object, count) and the frontier of each task: anchors (the prior's roots, else its task root, else the task's first process), boundary ids, and links
    (kind, process) to other tasks, which a task root that a split made gives. priors: (task_id, root_ids, task_root, boundary_ids)."""
    edges = events.groupBy("task_id", "process_guid", "event_type", "object_key").agg(F.count("*").alias("n"), F.min("order_index").alias("first_index"))
    first = events.groupBy("task_id").agg(F.min_by("process_guid", "order_index").alias("_first"))
    df = first.join(priors.select("task_id", "root_ids", X.blank_to_null("task_root").alias("_root"), "boundary_ids"), "task_id", "left")
    none = F.array().cast("array<string>")
    link = F.array(F.struct(F.lit("split_root").alias("kind"), F.col("_root").alias("process")))
    anchors = F.when(F.size("root_ids") > 0, F.col("root_ids")).when(F.col("_root").isNotNull(), F.array("_root")).otherwise(F.array("_first"))
    return edges, df.select("task_id", anchors.alias("anchors"), F.coalesce("boundary_ids", none).alias("boundary"), F.when(F.col("_root").isNotNull(), link).otherwise(F.slice(link, 1, 0)).alias("links"))


def build_priors(tasks: DataFrame, meta: DataFrame, attribution: DataFrame) -> DataFrame:
    """Task scores with graph facts and attributions where there are any: a left join each, with defaults."""
    return tasks.join(meta, "task_id", "left").join(attribution, "task_id", "left").select(
        "task_id", F.coalesce("task_score", F.lit(0.0)).alias("task_score"), F.coalesce("root_ids", F.array().cast("array<string>")).alias("root_ids"),
        F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("top_processes", F.array().cast("array<string>")).alias("top_processes"))


def seed_coverage(task_nodes: DataFrame, events: DataFrame, top_processes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per task: its seeds, those without any event, and the top processes (task_id, process) without any; and the mapped ids as rows (task_id, node_id)."""
    seen = events.select("task_id", F.col("process_guid").alias("node_id")).distinct().withColumn("_hit", F.lit(1))
    seeds = task_nodes.select("task_id", "node_id").distinct()
    out = seeds.join(seen, ["task_id", "node_id"], "left").groupBy("task_id").agg(F.count("*").alias("seeds"), F.count_if(F.col("_hit").isNull()).alias("unmapped"))
    ids = seeds
    if top_processes is not None:
        top = top_processes.select("task_id", F.trim("process").alias("node_id")).where("node_id <> ''").distinct()
        lost = top.join(seen, ["task_id", "node_id"], "left").groupBy("task_id").agg(F.count_if(F.col("_hit").isNull()).alias("unmapped_top"))
        out, ids = out.join(lost, "task_id", "left").na.fill(0, ["unmapped_top"]), seeds.union(top).distinct()
    return out, ids.join(seen.select("task_id", "node_id"), ["task_id", "node_id"], "left_semi")


def canonical_ground_truth(ids: DataFrame, alias: DataFrame) -> DataFrame:
    """Distinct malicious ids, mapped to canonical ones where known."""
    a = alias.select(F.col("raw_id").alias("node_id"), "canonical_id")
    return ids.join(a, "node_id", "left").select(F.coalesce("canonical_id", "node_id").alias("node_id")).distinct()


def object_linked_ground_truth(events: DataFrame, objects: DataFrame, slots: tuple[str, ...] = ("object", "object2")) -> DataFrame:
    """Subjects that touch a malicious object in any slot: (subject, event_type, n)."""
    touched = None
    for s in slots:
        part = events.join(objects.select(F.col("node_id").alias(s)).distinct(), s, "left_semi").select("event_id", "subject", "event_type")
        touched = part if touched is None else touched.unionByName(part)
    return touched.distinct().groupBy("subject", "event_type").agg(F.count("*").alias("n"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int, how: str = "inner") -> DataFrame:
    """Interval join of left (lo, hi) and right (rlo, rhi) on equal keys: overlapping pairs, once each.

    Intervals are dealt to time buckets, which join as equality; a pair counts in the bucket where its overlap begins.
    Ends are whole numbers; `bucket` is about the usual length of an interval."""
    def dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("_time_bucket", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.greatest(F.col(lo), F.col(hi)) / bucket))))

    pairs = dealt(left.where("lo is not null and hi is not null"), "lo", "hi").join(dealt(right.where("rlo is not null and rhi is not null"), "rlo", "rhi"), [*keys, "_time_bucket"])
    pairs = pairs.where((F.col("lo") <= F.col("rhi")) & (F.col("rlo") <= F.col("hi")) & (F.floor(F.greatest("lo", "rlo") / bucket) == F.col("_time_bucket"))).drop("_time_bucket")
    return pairs


def filter_tasks_by_windows(tasks: DataFrame, windows: DataFrame, pad: int = 0, offset: int = 0) -> DataFrame:
    """tasks (task_id, lo, hi in seconds) plus reason: kept, no_time, or no_overlap with any window (window_id, rlo, rhi) moved by offset and widened by pad; and the number of windows met.

    A task meets the windows that begin by its end less those that end before it begins, so running counts over the points of time answer all tasks without a pair ever being formed."""
    w = windows.where("rlo is not null and rhi is not null").select((F.col("rlo") + offset - pad).alias("rlo"), (F.greatest("rlo", "rhi") + offset + pad).alias("rhi"))
    t = tasks.select("lo", F.greatest("lo", "hi").alias("hi")).where("lo is not null and hi is not null")
    none = F.lit(0).alias("_s"), F.lit(0).alias("_e")
    points = w.select(F.col("rlo").alias("_t"), F.lit(1).alias("_s"), F.lit(0).alias("_e")).union(w.select(F.col("rhi") + 1, F.lit(0), F.lit(1))).union(t.select("lo", *none)).union(t.select("hi", *none))
    sums = running_total(points.groupBy("_t").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e")), "_t", ["_s", "_e"], ["_begun", "_ended"])
    begun, ended = sums.select(F.col("_t").alias("_hi"), "_begun"), sums.select(F.col("_t").alias("_lo"), "_ended")
    keyed = tasks.withColumn("_lo", F.when(F.col("hi").isNotNull(), F.col("lo"))).withColumn("_hi", F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.greatest("lo", "hi")))
    met = F.coalesce(F.col("_begun") - F.col("_ended"), F.lit(0)).cast("long")
    reason = F.when(F.col("lo").isNull() | F.col("hi").isNull(), "no_time").when(met == 0, "no_overlap").otherwise("kept")
    return keyed.join(begun, "_hi", "left").join(ended, "_lo", "left").withColumn("reason", reason).withColumn("windows", met).drop("_lo", "_hi", "_begun", "_ended")


def parent_task_map(roots: DataFrame, boundary: DataFrame) -> DataFrame:
    """(task_id, parent_task): the smallest other task whose boundary holds the task's root."""
    b = boundary.select(F.col("task_id").alias("parent_task"), F.col("node_id").alias("root"))
    return roots.join(b, "root").where("parent_task <> task_id").groupBy("task_id").agg(F.min("parent_task").alias("parent_task"))


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of `size` letters."""
    letters = F.split(text, "")
    out = letters
    for i in range(1, size):
        out = F.zip_with(out, F.slice(letters, F.lit(i + 1), F.greatest(F.length(text) - i, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(out, lambda g: F.length(g) == size))


def match_observables(texts: DataFrame, observables: DataFrame, few: int = 200) -> DataFrame:
    """(event_id, term) for each term (lower case) that a text holds anywhere, also inside a word, whatever the number of terms.

    Up to `few` terms are looked for where the texts lie. Of more, a term joins the texts that hold one chosen piece of it, of three letters or of all that a shorter term has, and is then looked for in them.
    Texts are keyed by a hash, so the pieces travel without them; a shared hash only adds candidates."""
    terms = observables.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()
    size = F.least(F.length("term"), F.lit(3))
    # letters late in the alphabet are the rarer ones
    piece = F.when(size < 3, F.col("term")).otherwise(F.array_max(grams(F.col("term"), 3)))
    terms = written(terms.withColumn("_gram", piece), "terms")
    if terms.count() <= few:
        lower = texts.where("text is not null").select("event_id", F.lower("text").alias("_text"))
        return lower.join(F.broadcast(terms.select("term")), F.expr("contains(_text, term)")).select("event_id", "term")
    sizes = [r[0] for r in terms.select(F.length("_gram")).distinct().collect()]  # three at most
    t = texts.where("text is not null").select("event_id", F.lower("text").alias("_text")).withColumn("_key", F.xxhash64("_text"))
    pieces = F.array().cast("array<string>") if not sizes else F.concat(*[grams(F.col("_text"), n) for n in sorted(sizes)])
    found = t.select("_key", F.explode(pieces).alias("_gram")).join(terms, "_gram").select("_key", "term").distinct()
    return t.join(found, "_key").where(F.expr("contains(_text, term)")).select("event_id", "term")


def offset_sweep(hits: DataFrame, windows: DataFrame, offsets: DataFrame, malicious: DataFrame, bucket: int = 86_400, top: int = 20) -> DataFrame:
    """For each clock offset and window: hits within, distinct subjects, objects and terms, malicious ids (node_id) among its subjects and in any role, and its `top` actions (action, n).

    hits (event_id, subject, object, term, action, lo); the offsets are a short stated list. Windows that cover the same times at any offset have the same answer, which is counted once; rows that repeat a window id are one window."""
    moved = windows.join(F.broadcast(offsets)).select("window_id", "offset", (F.col("rlo") + F.col("offset")).alias("rlo"), (F.col("rhi") + F.col("offset")).alias("rhi"))
    asked = moved.groupBy("window_id", "offset").agg(F.array_sort(F.collect_list(F.struct("rlo", "rhi"))).alias("_spans"), F.count("*").alias("_rows"))
    spans = asked.select("_spans").distinct().select("_spans", F.explode("_spans").alias("_w")).select("_spans", "_w.*")
    pairs = written(overlap_join(hits.withColumn("hi", F.col("lo")), spans, [], bucket), "offsets")
    key = ["_spans"]
    got = pairs.groupBy(*key).agg(F.count("*").alias("hits"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"), F.count_distinct("term").alias("terms"))
    role = F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("subject").alias("node_id")), F.struct(F.lit(False).alias("own"), F.col("object").alias("node_id")))).alias("x")
    bad = pairs.select(*key, role).select(*key, "x.*").distinct().join(malicious.select("node_id").distinct(), "node_id", "left_semi").groupBy(*key).agg(
        F.count_distinct(F.when(F.col("own"), F.col("node_id"))).alias("malicious_subjects"), F.count_distinct("node_id").alias("malicious"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "action"))
    acts = pairs.where("action is not null").groupBy(*key, "action").agg(F.count("*").alias("n")).withColumn("_r", rank).where(F.col("_r") <= top)
    acts = acts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_r", "action", "n"))).alias("_a")).select(*key, F.transform("_a", lambda x: F.struct(x["action"].alias("action"), x["n"].alias("n"))).alias("actions"))
    facts = got.join(bad, key, "left").join(acts, key, "left")
    out = asked.withColumn("_rows", F.explode(F.sequence(F.lit(1), "_rows"))).join(facts, key, "left").drop("_spans", "_rows")
    return out.na.fill(0, ["hits", "subjects", "objects", "terms", "malicious_subjects", "malicious"]).withColumn("actions", F.coalesce("actions", F.array().cast("array<struct<action:string,n:bigint>>")))


def onehop_ground_truth(events: DataFrame, tasks: DataFrame, gt: DataFrame, slots: tuple[str, ...] = ("subject", "object")) -> tuple[DataFrame, DataFrame]:
    """Malicious ids in malicious tasks: (node_id, role, event_type, n, first_us, last_us), and their one-hop events (task_id, event_id, node_id, role, other).

    A task (task_id, node_id) is malicious if it holds a malicious id (gt: node_id); its events are those with one of its ids in any slot. An event with several malicious ends counts once for each."""
    bad = gt.select("node_id").distinct()
    held = tasks.select("task_id", "node_id").distinct()
    mine = held.join(held.join(bad, "node_id", "left_semi").select("task_id").distinct(), "task_id", "left_semi")
    ends = events.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("role"), F.col(s).alias("node_id")) for s in slots])).alias("_end")).select("event_id", "event_type", "us", *slots, "_end.*").where("node_id is not null")
    inside = ends.join(mine, "node_id").select("task_id", "event_id").distinct()
    hits = ends.join(bad, "node_id", "left_semi").join(inside, "event_id")
    other = F.filter(F.array(*slots), lambda x: x.isNotNull() & (x != F.col("node_id")))
    stats = hits.select("event_id", "node_id", "role", "event_type", "us").distinct().groupBy("node_id", "role", "event_type").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return stats, hits.select("task_id", "event_id", "node_id", "role", F.get(other, F.lit(0)).alias("other"))


def with_span(tasks: DataFrame) -> DataFrame:
    """tasks (lo, hi in seconds) plus span_min, their length in minutes; null where an end is missing."""
    return tasks.withColumn("span_min", F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.greatest(F.lit(0.0), (F.col("hi") - F.col("lo")) / 60.0)))


def _id_lists(batches):
    """Rows of one group after another: its windows' ids by span (kind 0), then sets of times with the spans that they meet (kind 1), each before the rows of its tasks (kind 2).

    Yields the rows of each set with the sorted ids of all its spans. Ids are held once, as numbers in order of their text; lists go out by some two million ids."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ("window_ids", "attempted_ids")
    group, read, texts, places, kept = None, [], None, {}, []

    def closed():
        """Numbers for the ids that were read: the texts in order, and for each span its two lists of places."""
        held = [pa.concat_arrays([x[c].cast(pa.list_(pa.large_string())) for x in read]) for c in names]
        every = pa.concat_arrays([x.flatten() for x in held]).dictionary_encode()
        order = pc.sort_indices(every.dictionary)
        place = np.empty(len(order), np.int32)
        place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        ends = np.cumsum(np.concatenate([x.value_lengths().to_numpy() for x in held]))
        lists = [np.sort(x) for x in np.split(place[every.indices.to_numpy()], ends[:-1])]
        spans = [k for x in read for k in zip(x["rlo"].to_pylist(), x["rhi"].to_pylist())]
        return every.dictionary.take(order), dict(zip(spans, zip(lists, lists[len(spans):])))

    def listed(rows, starts, lists):
        """One row for each run of task rows: the rows themselves and the two lists."""
        cols = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rows.values)]
        for part in zip(*lists):
            cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, part)]), pa.int32()), texts.take(pa.array(np.concatenate(part))).cast(pa.string())))
        return pa.RecordBatch.from_arrays(cols, names=["_rows", *names])

    for b in batches:
        salts, kinds = b["_salt"].to_numpy(zero_copy_only=False), b["_kind"].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(kinds) != 0) | (np.diff(salts) != 0) | (kinds[1:] == 1)) + 1).tolist(), len(kinds)]
        rows = b["_rows"]
        at, starts, lists, n = rows.offsets.to_numpy(), [], [], 0
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if salts[i] != group:
                if lists:  # they name texts of the group before
                    yield listed(rows, starts, lists)
                    starts, lists, n = [], [], 0
                group, read, texts, places = salts[i], [], None, {}
            if kinds[i] == 0:
                read.append(b.slice(i, j - i))
            elif kinds[i] == 1:
                if texts is None:
                    texts, places = closed() if read else (pa.array([], pa.large_string()), {})
                    read = []
                mine = [places[x["rlo"], x["rhi"]] for x in b["_met"][i].as_py()]
                kept = [m[0] if len(m) == 1 else np.unique(np.concatenate(m)) for m in zip(*mine)] or [np.empty(0, np.int32)] * 2
            else:
                starts = starts or [at[i]]
                starts.append(at[j])
                lists.append(kept)
                n += len(kept[0]) + len(kept[1])
                if n > 2_000_000:
                    yield listed(rows, starts, lists)
                    starts, lists, n = [], [], 0
        if lists:
            yield listed(rows, starts, lists)


def task_window_diagnosis(tasks: DataFrame, windows: DataFrame, bucket: int = 86_400, groups: int = 12) -> DataFrame:
    """tasks (task_id, lo, hi, n_nodes, n_boundary, shared) plus the ids of confirmed and attempted windows (column status) that they overlap, their span in minutes and the cause class of those that overlap no confirmed one.

    shared: the task holds a malicious id of a task that overlaps a confirmed window. Rows that repeat a task id are one task, with the id lists of all.
    Neither pairs nor lists of tasks are shuffled: tasks are dealt to `groups` by their times, each group gets the ids of all windows once, by span of time, and makes a list once for each set of times
    that tasks have. So what is shuffled grows with the tables, though the lists, the result, grow with their square; a group holds the ids of all windows."""
    ids = lambda ok: F.sort_array(F.collect_set(F.when(ok, F.col("window_id"))))  # noqa: E731 (in order they take less room)
    confirmed = F.col("status") == "confirmed"
    held = windows.where("rlo is not null and rhi is not null").groupBy("rlo", "rhi").agg(ids(confirmed).alias("window_ids"), ids(~confirmed).alias("attempted_ids"))
    time = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.struct("lo", "hi"))
    own = tasks.where("task_id is not null").groupBy("task_id").agg(F.array_sort(F.collect_set(time)).alias("_spans"), F.collect_list(F.struct(*tasks.columns)).alias("_rows"))
    sets = own.select("_spans").distinct()
    spans = sets.select("_spans", F.explode("_spans").alias("_t")).select("_spans", "_t.*")
    met = overlap_join(spans, held.select("rlo", "rhi"), [], bucket).groupBy("_spans").agg(F.collect_set(F.struct("rlo", "rhi")).alias("_met"))
    met = sets.join(met, "_spans", "left").withColumn("_met", F.coalesce("_met", F.array().cast(met.schema["_met"].dataType)))
    # tasks of one time, of which there may be many, go to four groups
    often = F.size("_spans") == 1
    salt = lambda part: F.pmod(F.xxhash64("_spans") + part, F.lit(groups)).cast("int").alias("_salt")
    lists = held.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_salt"), F.lit(0).alias("_kind"), "rlo", "rhi", "window_ids", "attempted_ids")
    met = met.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(often, 3).otherwise(0)))).select(salt(F.col("_part")), F.lit(1).alias("_kind"), "_spans", "_met")
    rows = own.select(salt(F.when(often, F.pmod(F.xxhash64("task_id"), F.lit(4))).otherwise(0)), F.lit(2).alias("_kind"), "_spans", "_rows")
    dealt = lists.unionByName(met, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True).repartition("_salt").sortWithinPartitions("_salt", F.col("_kind") > 0, "_spans", "_kind")
    out = dealt.drop("_spans").mapInArrow(_id_lists, StructType([rows.schema["_rows"], held.schema["window_ids"], held.schema["attempted_ids"]]))
    none = F.array().cast("array<string>")
    df = out.select(F.explode("_rows").alias("_x"), "window_ids", "attempted_ids").select("_x.*", "window_ids", "attempted_ids").union(tasks.where("task_id is null").select("*", none, none))
    df = with_span(df)
    s, n, b = F.coalesce("span_min", F.lit(0.0)), F.col("n_nodes"), F.col("n_boundary")
    cause = X.cases([(F.size("window_ids") > 0, None), (F.size("attempted_ids") > 0, "gt_node_outside_confirmed_windows"), (F.coalesce("shared", F.lit(False)), "shared_gt_node_cross_window"),
                     ((s >= 120) | ((s >= 60) & (n >= 50)), "long_lived_root_glue"), ((s >= 30) & (n <= 12) & (b <= 2), "wide_subject_alias_epoch")], F.lit("unknown"))
    return df.withColumn("cause", cause)


def numeric_summary(df: DataFrame, value: str) -> DataFrame:
    """One row: count, smallest, median, interpolated 90th percentile and largest of a column, nulls left out."""
    row = df.agg(F.count(value).alias("count"), F.min(value).cast("double").alias("smallest"), F.max(value).cast("double").alias("largest"))
    return row.join(F.broadcast(exact_quantiles(df, value, {"median": 0.5, "p90": 0.9})))


def alias_width(subjects: DataFrame, events: DataFrame, task_nodes: DataFrame) -> DataFrame:
    """Per alias key: distinct uuids, path variants and files, first and last event, tasks hit, those of them that overlap no window, and the reasons why the key is wide (none: an empty list).

    subjects (alias, uuid, path, file), events (uuid, us, file), task_nodes (task_id, node_id, overlaps). A uuid that repeats belongs to its last alias by name."""
    own = subjects.groupBy("uuid").agg(F.max("alias").alias("alias"))
    # what has the same alias and file, or alias and task, is one row before anything distinct is counted, so no row is copied for a second count
    near = events.join(own, "uuid").groupBy("alias", "file").agg(F.min("us").alias("_first"), F.max("us").alias("_last"))
    named = subjects.select("alias", "file").distinct().withColumn("_first", F.lit(None).cast(events.schema["us"].dataType)).withColumn("_last", F.col("_first"))
    files = near.unionByName(named).groupBy("alias").agg(F.count_distinct("file").alias("files"), F.min("_first").alias("first_us"), F.max("_last").alias("last_us"))
    hit = task_nodes.select("task_id", F.col("node_id").alias("uuid"), "overlaps").where("task_id is not null").join(own, "uuid").groupBy("alias", "task_id").agg(F.bool_or(~F.col("overlaps")).alias("_outside"))
    hit = hit.groupBy("alias").agg(F.count("*").alias("tasks"), F.count(F.when(F.col("_outside"), 1)).alias("outside_tasks"))
    df = subjects.groupBy("alias").agg(F.count_distinct("uuid").alias("uuids"), F.count_distinct("path").alias("paths")).join(files, "alias", "left").join(hit, "alias", "left").na.fill(0, ["files", "tasks", "outside_tasks"])
    span = F.coalesce((F.col("last_us") - F.col("first_us")) / 6e7, F.lit(0.0))
    reasons = {"uuid_ge_8_and_span_ge_30m": (F.col("uuids") >= 8) & (span >= 30), "uuid_ge_5_file_ge_2_span_ge_20m": (F.col("uuids") >= 5) & (F.col("files") >= 2) & (span >= 20), "hits_ge_3_nonoverlap_tasks": F.col("outside_tasks") >= 3}
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()])))
