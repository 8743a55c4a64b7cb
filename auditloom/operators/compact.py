"""Ordered state and compaction of a task's events, all as window functions.

Events have task_id, event_id, order_index (unique in a task), us (time in microseconds, may be null), process_guid,
process_name, parent_process_guid, event_type, object_type, object_key and object_class; optional are process_cmdline and result.

All operators of this module: a null task, process or object is a group of its own and changes no other; a null event type or class matches no rule; a null time
is near nothing but the skip's; rows that repeat count as often as they come, in the order of order_index; columns of other names are carried where events are returned;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.functions import settings as S
from auditloom.operators.scratch import discard, written

_BEFORE, _UPTO = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.currentRow)


def by_process(*rows: int):
    """Events of a process in order, or a frame of them; events without a process share one."""
    w = Window.partitionBy("task_id", "process_guid").orderBy("order_index")
    return w.rowsBetween(*rows) if rows else w


def by_object(*rows: int):
    """Events of an object in order, or a frame of them; events without an object share one."""
    w = Window.partitionBy("task_id", "object_key").orderBy("order_index")
    return w.rowsBetween(*rows) if rows else w


def is_mutation() -> Column:
    """Events that make a new version of their object; a null type gives null."""
    return F.col("event_type").isin(S.MUTATIONS)


def is_external(*kinds: str) -> Column:
    """Events of these types with an external address; nulls give null."""
    return F.col("event_type").isin(list(kinds)) & (F.col("object_class") == "external_ip")


def is_control() -> Column:
    """Events that begin a new epoch of their process: external receives and executions."""
    return is_external("RECV") | F.col("event_type").isin(S.EXECUTIONS)


def optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def process_states(events: DataFrame, most: int = 12) -> DataFrame:
    """Per process: name of its first event, times, first non-blank parent, number of events and ids of the first `most` of them (identity.event_index gives all as rows).

    Processes seen only as the object of FORK or CLONE are listed too. Ids are ranked and cut before they are gathered, so a busy process costs no long row."""
    own = events.groupBy("task_id", "process_guid").agg(
        F.min_by("process_name", "order_index").alias("process_name"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.min_by("parent_process_guid", F.when(X.blank_to_null("parent_process_guid").isNotNull(), F.col("order_index"))).alias("parent_process_guid"),
        F.count("*").alias("events"))
    rank = F.row_number().over(Window.partitionBy("task_id", "process_guid").orderBy("order_index"))
    first = events.select("task_id", "process_guid", "order_index", "event_id").withColumn("_r", rank).where(F.col("_r") <= most)
    first = first.groupBy("task_id", "process_guid").agg(F.array_sort(F.collect_list(F.struct("order_index", "event_id"))).alias("_e")).select("task_id", "process_guid", F.col("_e.event_id").alias("evidence"))
    own = own.join(first, ["task_id", "process_guid"])
    born = events.where("event_type in ('FORK', 'CLONE') and object_type = 'process'").groupBy("task_id", F.col("object_key").alias("process_guid")).agg(
        F.lit("").alias("process_name"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min_by("process_guid", "order_index").alias("parent_process_guid"), F.lit(0).cast("long").alias("events"))
    born = born.join(own, ["task_id", "process_guid"], "left_anti").withColumn("evidence", F.array().cast(own.schema["evidence"].dataType))
    return own.unionByName(born)


def object_states(events: DataFrame) -> DataFrame:
    """Per object: class and type of its first event, times, and counts of reads, writes and executions."""
    n = lambda kinds: F.count(F.when(F.col("event_type").isin(kinds), 1))
    return events.groupBy("task_id", "object_key").agg(
        F.min_by("object_class", "order_index").alias("object_class"), F.min_by("object_type", "order_index").alias("object_type"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        n(["READ", "OPEN"]).alias("reads"), n(S.MUTATIONS).alias("writes"), n(S.EXECUTIONS).alias("executions"))


def semantic_epochs(events: DataFrame) -> DataFrame:
    """events plus object_epoch_before/after (mutations of the object so far) and process_epoch_before/after (external receives and executions of the process so far)."""
    o, p = is_mutation().cast("long"), is_control().cast("long")
    return events.withColumn("object_epoch_after", F.sum(o).over(by_object(*_UPTO))).withColumn("object_epoch_before", F.col("object_epoch_after") - o).withColumn(
        "process_epoch_after", F.sum(p).over(by_process(*_UPTO))).withColumn("process_epoch_before", F.col("process_epoch_after") - p)


def recent_network(events: DataFrame, seconds: int = 120) -> DataFrame:
    """events plus last_recv_us and last_connect_us (latest earlier external contact of the process) and whether each lies within `seconds`."""
    def last(*kinds: str) -> Column:
        return F.last(F.when(is_external(*kinds), F.col("us")), ignorenulls=True).over(by_process(*_BEFORE))

    return near_network(events.withColumn("last_recv_us", last("RECV")).withColumn("last_connect_us", last("CONNECT", "SEND")), seconds)


def near_network(df: DataFrame, seconds: int) -> DataFrame:
    """df (us, last_recv_us, last_connect_us) plus recent_recv and recent_connect: whether the contact lies within `seconds`; a missing time does not."""
    near = lambda c: F.coalesce(F.abs(F.col("us") - F.col(c)) <= seconds * 1_000_000, F.lit(False))
    return df.withColumn("recent_recv", near("last_recv_us")).withColumn("recent_connect", near("last_connect_us"))


_CLASS_LABELS = {"external_ip": "O_NET_EXTERNAL", "temp_file": "O_FILE_TEMP", "credential_file": "O_CREDENTIAL", "history_file": "O_HISTORY",
                 "business_file": "O_BUSINESS_DATA", "persistence_file": "O_PERSISTENCE", "privilege_file": "O_PRIV_CONFIG"}


def _first_marks(df: DataFrame, marks: list[Column], entity: str) -> DataFrame:
    """(task_id, entity, label, acquired_order): the first event of each label; marks are conditional label names."""
    m = df.select("task_id", entity, "order_index", F.explode(F.array_compact(F.array(*marks))).alias("label"))
    return m.groupBy("task_id", F.col(entity).alias("entity"), "label").agg(F.min("order_index").alias("acquired_order"))


def object_marks(df: DataFrame) -> list[Column]:
    """Conditional names of the labels that an event (with recent_recv and recent_connect) gives its object."""
    t, temp = F.col("event_type"), F.col("object_class") == "temp_file"
    hint = X.has_download_hint(optional(df, "process_cmdline"))
    fetcher = F.lower("process_name").isin(S.PROCESS_TYPES["downloader"]) & (F.col("recent_recv") | F.col("recent_connect"))
    names = F.create_map(*[F.lit(x) for kv in _CLASS_LABELS.items() for x in kv])
    return [names[F.col("object_class")],
            F.when(t.isin("WRITE", "CREATE") & X.contains_upload_marker("object_key"), "O_FILE_UPLOADED"),
            F.when(temp & t.isin("READ", "OPEN", *S.EXECUTIONS) & F.upper(X.text(optional(df, "result"))).isin("ENOENT", "NOT_FOUND"), "O_FILE_NONEXIST"),
            F.when(t.isin("WRITE", "CREATE") & (F.col("object_type") == "file") & (hint | fetcher | (temp & F.col("recent_recv"))), "O_FILE_DOWNLOADED")]


BAD_OBJECTS = ["O_FILE_DOWNLOADED", "O_FILE_UPLOADED", "O_SUSPECT_WRITTEN_EXECUTABLE"]


def process_marks(bad_by_now: Column) -> list[Column]:
    """Conditional names of the labels that an event gives its process; bad_by_now: its object is labelled downloaded, uploaded or suspect by then."""
    t, name = F.col("event_type"), F.lower("process_name")
    return [F.when(name.isin(S.PROCESS_TYPES["web_service"]) | (t.isin("WRITE", "CREATE") & X.contains_upload_marker("object_key") & X.under_web_root("object_key")), "P_WEB_CTX"),
            F.when(name.isin(S.PROCESS_TYPES["remote_service"]), "P_REMOTE_CTX"), F.when(is_external(*S.NETWORK_EVENTS), "P_NET_CTX"),
            F.when(is_external("RECV") | (t.isin(S.EXECUTIONS) & bad_by_now), "P_UNTRUSTED_CTX")]


def object_prelabels(events: DataFrame, seconds: int = 120) -> DataFrame:
    """First event that gives each object one of ten labels: by class, by upload path, not found, or written by a download.

    Null classes and keys give none; an empty table gives none."""
    df = recent_network(events, seconds)
    return _first_marks(df, object_marks(df), "object_key")


def process_prelabels(events: DataFrame, object_labels: DataFrame) -> DataFrame:
    """First event that gives each process P_WEB_CTX, P_REMOTE_CTX, P_NET_CTX or P_UNTRUSTED_CTX; executions count if the object is labelled downloaded, uploaded or suspect by then."""
    bad = object_labels.where(F.col("label").isin(BAD_OBJECTS)).groupBy("task_id", F.col("entity").alias("object_key")).agg(F.min("acquired_order").alias("_bad"))
    df = events.join(bad, ["task_id", "object_key"], "left")
    return _first_marks(df, process_marks(F.col("_bad") <= F.col("order_index")), "process_guid")


_NEVER = (1 << 63) - 1


def inherit_on_fork(labels: DataFrame, forks: DataFrame) -> DataFrame:
    """labels (task_id, entity, label, acquired_order) with those that children get at a fork (task_id, parent, child, order) from what the parent held before it.

    The least fixpoint. A child that is forked once has its label as a function of its parent's: before the fork's order one value, else another; such functions
    compose to functions of that kind. Each such child's function is composed with that of the child above it, doubling its reach in each round, up to an entity that
    is never forked or forked several times, so a chain takes a logarithm of rounds. Only the entities forked several times (or in a cycle) are then settled in turn.
    A label of a task is followed through all its forks: label kinds are few. Rows that repeat count once; null entities and orders play no part.
    """
    key = ["task_id", "entity", "label"]
    own = written(labels.where("entity is not null and acquired_order is not null").groupBy(*key).agg(F.min("acquired_order").alias("own")), "forks")
    f = written(forks.where("parent is not null and child is not null and `order` is not null").select("task_id", "parent", F.col("child").alias("entity"), F.col("order").alias("at")).distinct(), "forks")
    kinds = own.select("task_id", "label").distinct()
    once = f.groupBy("task_id", "entity").agg(F.count("*").alias("_n"), F.first("parent").alias("up"), F.first("at").alias("before")).where("_n = 1").drop("_n")
    step = once.join(kinds, "task_id").join(own, key, "left")
    mine = F.coalesce("own", F.lit(_NEVER))
    inner = once.select("task_id", F.col("entity").alias("up"), F.lit(True).alias("_inner"))
    step = step.join(inner, ["task_id", "up"], "left").select(*key, "up", "before", F.least(mine, F.col("before")).alias("yes"), mine.alias("no"), F.col("_inner").isNull().alias("done"))
    step = written(step, "forks")
    for _ in range(max(1, once.count()).bit_length() + 1):
        if step.where("not done").isEmpty():
            break
        above = step.select("task_id", F.col("entity").alias("up"), "label", F.col("up").alias("_up"), F.col("before").alias("_before"), F.col("yes").alias("_yes"), F.col("no").alias("_no"), F.col("done").alias("_done"))
        got = step.where("not done").join(above, ["task_id", "up", "label"])
        of = lambda y: F.when(F.col(y) < F.col("before"), F.col("yes")).otherwise(F.col("no"))
        got = got.select(*key, F.col("_up").alias("up"), F.col("_before").alias("before"), of("_yes").alias("yes"), of("_no").alias("no"), F.col("_done").alias("done"))
        nxt = written(step.where("done").union(got), "forks")
        discard(step)
        step = nxt
    done = step.where("done").drop("done")  # what is not done by now hangs on a cycle
    heads = f.join(done.select("task_id", "entity").distinct(), ["task_id", "entity"], "left_anti")

    def through(at: DataFrame) -> DataFrame:
        """What entities that end in those of `at` (task_id, entity, label, order) get from them."""
        x = done.join(at.select("task_id", F.col("entity").alias("up"), "label", "order"), ["task_id", "up", "label"], "left")
        return x.select(*key, F.when(F.coalesce("order", F.lit(_NEVER)) < F.col("before"), F.col("yes")).otherwise(F.col("no")).alias("order")).where(F.col("order") < _NEVER)

    outer = written(own.join(done.select("task_id", "entity").distinct(), ["task_id", "entity"], "left_anti").withColumnRenamed("own", "order"), "forks")
    best = outer
    if not heads.isEmpty():
        new = written(outer.unionByName(through(outer)), "forks")
        while not new.isEmpty():
            got = new.select("task_id", F.col("entity").alias("parent"), "label", "order").join(heads, ["task_id", "parent"]).where("`order` < at").groupBy(*key).agg(F.min("at").alias("_new"))
            gain = written(got.join(best, key, "left").where("`order` is null or _new < `order`").select(*key, F.col("_new").alias("order")), "forks")
            if gain.isEmpty():
                break
            best = written(best.unionByName(gain).groupBy(*key).agg(F.min("order").alias("order")), "forks")
            reached = through(best).join(gain.select("task_id", "label").distinct(), ["task_id", "label"], "left_semi")
            new = written(gain.unionByName(reached), "forks")
    return best.unionByName(through(best)).withColumnRenamed("order", "acquired_order")


def _held(events: DataFrame, labels: DataFrame, entity: str) -> DataFrame:
    """(task_id, order_index, signature): sorted labels of the entity held at each of its events, joined by `|`."""
    rows = events.select("task_id", F.col(entity).alias("entity"), "order_index", F.lit(None).cast("string").alias("label"))
    got = labels.select("task_id", "entity", F.col("acquired_order").alias("order_index"), "label")
    w = Window.partitionBy("task_id", "entity").orderBy("order_index").rangeBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(got).withColumn("signature", F.array_join(F.array_sort(F.collect_set("label").over(w)), "|")).where("label is null").select("task_id", "order_index", "signature")


def label_signatures(events: DataFrame, process_labels: DataFrame, object_labels: DataFrame) -> DataFrame:
    """events plus process_signature and object_signature, the labels held once the event's own triggers are in. Label kinds are few, so a running set stays small."""
    p, o = (_held(events, lab, e).withColumnRenamed("signature", n) for lab, e, n in ((process_labels, "process_guid", "process_signature"), (object_labels, "object_key", "object_signature")))
    return events.join(p, ["task_id", "order_index"]).join(o, ["task_id", "order_index"])


def triggered(events: DataFrame, process_labels: DataFrame, object_labels: DataFrame) -> DataFrame:
    """events plus labels_triggered: sorted labels first acquired at the event."""
    both = process_labels.union(object_labels).groupBy("task_id", F.col("acquired_order").alias("order_index")).agg(F.array_sort(F.collect_set("label")).alias("labels_triggered"))
    return events.join(both, ["task_id", "order_index"], "left").withColumn("labels_triggered", F.coalesce("labels_triggered", F.array().cast("array<string>")))


def force_keep(events: DataFrame) -> DataFrame:
    """events plus is_force_kept: executions, network events with a remote address, sensitive mutations, listed types and classes, and events that trigger a label."""
    t, c = F.col("event_type"), F.col("object_class")
    sensitive = t.isin("WRITE", "CREATE", "RENAME", "CHMOD", "CHOWN", "DELETE") & c.isin("temp_file", "persistence_file", "privilege_file", "credential_file", "business_file")
    keep = t.isin(S.FORCE_KEEP_EVENTS) | c.isin(S.FORCE_KEEP_CLASSES) | sensitive
    if "labels_triggered" in events.columns:
        keep = keep | (F.size("labels_triggered") > 0)
    return events.withColumn("is_force_kept", keep)


SEMANTIC_KEY = ["task_id", "process_guid", "event_type", "object_key", "object_class"]


def semantic_skip(events: DataFrame, ttl_seconds: int = S.SKIP_TTL_SECONDS, missing_time_skips: bool = True) -> DataFrame:
    """events plus `skipped`: equal in meaning to the last such event, seen within the time to live and with nothing changed since, and not force-kept.

    Needs epochs, signatures and is_force_kept. The flow direction follows from the event and object types, so it is part of the key."""
    w = Window.partitionBy(*SEMANTIC_KEY).orderBy("order_index")
    then = {c: F.lag(c).over(w) for c in ("us", "process_signature", "object_signature", "object_epoch_after", "process_epoch_after", "order_index")}
    df = events.withColumns({f"_{k}": v for k, v in then.items()})
    same = (F.col("_process_signature") == F.col("process_signature")) & (F.col("_object_signature") == F.col("object_signature")) & (
        F.col("_object_epoch_after") == F.col("object_epoch_before")) & (F.col("_process_epoch_after") == F.col("process_epoch_before"))
    fresh = F.coalesce(F.abs(F.col("us") - F.col("_us")) <= ttl_seconds * 1_000_000, F.lit(missing_time_skips))
    skip = F.col("_order_index").isNotNull() & same & fresh & ~F.col("is_force_kept")
    return df.withColumn("skipped", F.coalesce(skip, F.lit(False))).drop(*[f"_{k}" for k in then])


def compacted(events: DataFrame, ttl_seconds: int = S.SKIP_TTL_SECONDS) -> DataFrame:
    """Epochs, labels, signatures, force-keep and skip of normalized events in one plan."""
    o = object_prelabels(events)
    p = process_prelabels(events, o)
    return semantic_skip(force_keep(triggered(label_signatures(semantic_epochs(events), p, o), p, o)), ttl_seconds)


def access_records(compact: DataFrame) -> DataFrame:
    """Every event, also skipped ones, with signatures and epochs before and after."""
    return compact.select("task_id", "event_id", "order_index", "us", "process_guid", "process_name", "event_type", "object_key", "object_type", "object_class",
                          *[F.col(f"{e}_signature").alias(f"{e}_signature_{s}") for e in ("process", "object") for s in ("before", "after")],
                          "object_epoch_before", "object_epoch_after", "process_epoch_before", "process_epoch_after")


def object_versions(events: DataFrame) -> DataFrame:
    """(task_id, object_key, version): one more for each mutation but the object's first event, with times, writers, readers and executors."""
    df = events.where("object_type <> 'process' and trim(object_key) <> ''")
    new = (is_mutation() & (F.row_number().over(by_object()) > 1)).cast("long")
    df = df.withColumn("version", F.sum(new).over(by_object(*_UPTO)) + 1)
    who = lambda kinds: F.array_sort(F.collect_set(F.when(F.col("event_type").isin(kinds), F.col("process_guid"))))
    return df.groupBy("task_id", "object_key", "version").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), who(S.MUTATIONS).alias("writers"), who(["READ", "OPEN"]).alias("readers"), who(S.EXECUTIONS).alias("executors"))


def label_provenance(process_labels: DataFrame, object_labels: DataFrame, inherited: DataFrame) -> DataFrame:
    """One row for each way an entity got a label: holder, kind, source, order and the id of the label it came from. label_id numbers a task's rows in order."""
    cols = ["task_id", "holder", "holder_type", "label", "source", "order_index", "from_holder"]
    p = process_labels.select("task_id", F.col("entity").alias("holder"), F.lit("process").alias("holder_type"), "label", F.lit("event").alias("source"), F.col("acquired_order").alias("order_index"), F.lit(None).cast("string").alias("from_holder"))
    o = object_labels.select("task_id", F.col("entity").alias("holder"), F.lit("object").alias("holder_type"), "label", F.lit("event").alias("source"), F.col("acquired_order").alias("order_index"), F.lit(None).cast("string").alias("from_holder"))
    i = inherited.select("task_id", F.col("child").alias("holder"), F.lit("process").alias("holder_type"), "label", F.lit("fork").alias("source"), F.col("order").alias("order_index"), F.col("parent").alias("from_holder"))
    rows = p.union(o).union(i).dropDuplicates(cols)
    n = F.row_number().over(Window.partitionBy("task_id").orderBy("order_index", "holder_type", "holder", "label", "source"))
    rows = rows.withColumn("label_id", F.concat("task_id", F.lit(":L"), F.lpad(n.cast("string"), 6, "0")))
    before = rows.select("task_id", F.col("holder").alias("from_holder"), "label", F.col("order_index").alias("_o"), F.col("label_id").alias("prev_label_id"))
    prev = rows.where("from_holder is not null").join(before, ["task_id", "from_holder", "label"]).where("_o < order_index").groupBy("label_id").agg(F.array_sort(F.collect_set("prev_label_id")).alias("prev_label_ids"))
    return rows.join(prev, "label_id", "left").withColumn("prev_label_ids", F.coalesce("prev_label_ids", F.array().cast("array<string>")))


def trace_back(provenance: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, label_id, depth): each wanted label and all labels it came from; depth is the longest way, so sorting by it, falling, puts ancestors first.

    The result lists all ancestors, so the rounds are the longest way; a way longer than there are labels is a cycle and raises ValueError. Repeated rows count once."""
    links = written(provenance.select("label_id", F.explode("prev_label_ids").alias("prev")), "trace")
    level = written(wanted.select(F.col("label_id").alias("wanted"), "label_id", F.lit(0).alias("depth")).distinct(), "trace")
    parts = level
    for k in range(1, links.select("label_id").distinct().count() + 2):
        level = written(level.join(links, "label_id").select("wanted", F.col("prev").alias("label_id"), F.lit(k).alias("depth")).distinct(), "trace")
        if level.isEmpty():
            return parts.groupBy("wanted", "label_id").agg(F.max("depth").alias("depth"))
        parts = parts.union(level)
    raise ValueError("the provenance holds a cycle")


EPISODE_KEY = ["task_id", "bucket_us", "process_guid", "event_type", "object_type", "object_class", "object_key", "process_signature", "object_signature", "object_epoch_after", "process_epoch_after"]


def bucket_us(us: Column, minutes: int) -> Column:
    """Start of the minute-of-hour bucket; sizes that do not divide 60 begin anew each hour."""
    hour = us - F.pmod(us, F.lit(3_600_000_000))
    return hour + F.floor((us - hour) / (minutes * 60_000_000)).cast("long") * (minutes * 60_000_000)


def episodes(retained: DataFrame, minutes: int = 1, representatives: int = 5) -> DataFrame:
    """Events that are equal within a bucket as one row: count, first time (the bucket's), last time, labels, and the first events with the last one as representatives."""
    df = retained.withColumn("bucket_us", bucket_us(F.col("us"), minutes))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("order_index", "event_id"))), lambda x: x["event_id"])
    df = df.groupBy(*EPISODE_KEY).agg(F.count("*").alias("n"), F.max("us").alias("last_us"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels_triggered")))).alias("labels"),
                                      F.bool_or("is_force_kept").alias("is_force_kept"), ids.alias("_ids"))
    few = F.concat(F.slice("_ids", 1, representatives - 1), F.slice("_ids", -1, 1))
    return df.withColumn("representatives", F.when(F.size("_ids") <= representatives, F.col("_ids")).otherwise(few)).withColumn("first_us", F.col("bucket_us")).drop("_ids")


def important_objects(events: DataFrame) -> DataFrame:
    """Objects of each process that triggered a label or are of a sensitive class."""
    hit = (F.size("labels_triggered") > 0) | F.col("object_class").isin("credential_file", "history_file", "business_file", "persistence_file")
    return events.where(hit).groupBy("task_id", "process_guid").agg(F.array_sort(F.collect_set("object_key")).alias("objects"))


def compaction_summary(compact: DataFrame, episode_rows: DataFrame) -> DataFrame:
    """Raw, retained and episode counts of each task and, under a null task, of all."""
    ep = episode_rows.groupBy("task_id").agg(F.count("*").alias("_e"))
    per = compact.groupBy("task_id").agg(F.count("*").alias("_r"), F.sum((~F.col("skipped")).cast("long")).alias("_k")).join(ep, "task_id", "left")
    return per.rollup("task_id").agg(F.sum("_r").alias("raw"), F.sum("_k").alias("retained"), F.coalesce(F.sum("_e"), F.lit(0)).alias("episodes"))
