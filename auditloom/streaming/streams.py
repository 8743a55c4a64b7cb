"""Structured Streaming forms of the operators that make sense on live data.

Streams have an event time column `ts`; late rows beyond the watermark are dropped, and counted in the query's progress.
Each form gives on a closed input what its batch form gives.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.functions import settings as S
from auditloom.operators import compact as C
from auditloom.operators import labels as L
from auditloom.operators.scratch import scratch_dir
from auditloom.streaming.replay import KEEP_SECONDS, staged


def stream_normalize(events: DataFrame, alias: DataFrame) -> DataFrame:
    """Stateless normalization with a static alias table (raw_id, canonical_id): canonical process, event type, object class and flow ends."""
    a = alias.select(F.col("raw_id").alias("process_guid"), F.col("canonical_id").alias("_c"))
    df = events.join(a, "process_guid", "left").withColumn("process_guid", F.coalesce("_c", "process_guid")).drop("_c")
    return df.withColumn("event_type", X.normalize_event_type("event_type")).withColumn("object_class", X.classify_object("object_type", "object_key")).withColumn("flow", X.flow_endpoints("object_key"))


def stream_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each type, process and object in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type", "process_guid", "object_key").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "process_guid", "object_key", "n")


def stream_mass_access(events: DataFrame, n: int = 100, window: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Windows in which a process reads n distinct files or more; the set is kept, so the count is exact."""
    e = events.where("event_type = 'READ' and object_type = 'file'").withWatermark("ts", late)
    g = e.groupBy(F.window("ts", window).alias("w"), "process_guid").agg(F.size(F.collect_set("object_key")).alias("objects"))
    return g.where(F.col("objects") >= n).select(F.col("w.start").alias("start"), "process_guid", "objects")


def stream_sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions of activity of each process: runs of events with smaller gaps."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "process_guid").agg(F.count("*").alias("n"), F.max("ts").alias("last")).select(F.col("s.start").alias("start"), "process_guid", "n", "last")


def _recent_step(held: dict, ids: list, rows: pd.DataFrame):
    """Latest external receive and connect or send before each event of a process."""
    before, now = [], {}
    external = (rows["object_class"] == "external_ip").tolist()
    for key, us, kind, out in zip(ids, rows["us"].tolist(), rows["event_type"], external):
        recv, connect = state = now[key] if key in now else held.get(key, (None, None))
        before.append(state)
        now[key] = (us if out and kind == "RECV" else recv, us if out and kind in ("CONNECT", "SEND") else connect)
    for i, name in enumerate(("last_recv_us", "last_connect_us")):
        rows[name] = pd.array([b[i] for b in before], dtype="Int64")
    return rows, now


def stream_recent_network(events: DataFrame, seconds: int = 120, late: str = "1 hour", keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """compact.recent_network on a stream: events (none of ts, us and event_id null, else a row is left out) plus last_recv_us and last_connect_us of the process (task_id, process_guid), and whether each lies within `seconds`.

    An event is answered once the watermark has passed it, so events may come in any order within `late`. What a process did is forgotten keep_seconds after its last event."""
    e = events.where("ts is not null and us is not null and event_id is not null").withWatermark("ts", late)
    df = staged(e, ["task_id", "process_guid"], _recent_step, "recv bigint, connect bigint", "last_recv_us bigint, last_connect_us bigint", buffered=True, keep_seconds=keep_seconds)
    return C.near_network(df, seconds)


def _held_step(name: str):
    """Epochs (rows that bump it) and labels (marks) held by a process or object at each of its events, its own triggers included."""

    def step(held: dict, ids: list, rows: pd.DataFrame):
        now, have = {}, {}
        before, after, signatures, triggered = [], [], [], []
        for key, marks, bump in zip(ids, rows["marks"], rows["bump"].astype("int64").tolist()):
            epoch, own = now[key] if key in now else held.get(key, (0, ""))
            if key not in have:
                have[key] = set(filter(None, own.split("|")))
            new = sorted({m for m in marks if m not in have[key]})
            if new:
                have[key].update(new)
                own = "|".join(sorted(have[key]))
            before.append(epoch)
            after.append(epoch + bump)
            signatures.append(own)
            triggered.append(new)
            now[key] = (epoch + bump, own)
        rows[f"{name}_epoch_after"], rows[f"{name}_epoch_before"] = after, before
        rows[f"{name}_signature"], rows[f"{name}_triggered"] = signatures, triggered
        return rows, now

    return step


def _held_stage(df: DataFrame, name: str, key: str, marks: list, bump, keep_seconds: int) -> DataFrame:
    df = df.withColumn("marks", F.array_compact(F.array(*marks))).withColumn("bump", F.coalesce(bump, F.lit(False)))
    added = f"{name}_epoch_before bigint, {name}_epoch_after bigint, {name}_signature string, {name}_triggered array<string>"
    return staged(df, ["task_id", key], _held_step(name), "epoch bigint, labels string", added, keep_seconds=keep_seconds).drop("marks", "bump")


def stream_objects(events: DataFrame, late: str = "1 hour", keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """stream_recent_network plus epochs and labels of the event's object."""
    df = stream_recent_network(events, 120, late, keep_seconds).drop("last_recv_us", "last_connect_us")
    return _held_stage(df, "object", "object_key", C.object_marks(df), C.is_mutation(), keep_seconds)


def _skip_step(held: dict, ids: list, rows: pd.DataFrame):
    """The last event of the same meaning, for each event."""
    names = ["us", "process_signature", "object_signature", "object_epoch_after", "process_epoch_after"]
    then, now = [], {}
    for key, own in zip(ids, zip(*[rows[c].tolist() for c in names])):
        then.append(now[key] if key in now else held.get(key, (None,) * len(names)))
        now[key] = own
    for i, c in enumerate(names):
        rows[f"_{c}"] = pd.Series([t[i] for t in then], dtype="object")
    return rows, now


def stream_compacted(events: DataFrame, ttl_seconds: int = S.SKIP_TTL_SECONDS, late: str = "1 hour", keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """compact.compacted on a stream: events with epochs, signatures, labels_triggered, is_force_kept and skipped.

    Four stages: the process's network contacts, the object's epochs and labels, the process's epochs and labels, and the last event of the same process, type,
    object and class. Processes and objects are forgotten keep_seconds after their last event; as long as none is silent for longer, the rows are those of the batch."""
    df = stream_objects(events, late, keep_seconds)
    bad = F.arrays_overlap(F.split("object_signature", "[|]"), F.array(*[F.lit(x) for x in C.BAD_OBJECTS]))
    df = _held_stage(df, "process", "process_guid", C.process_marks(bad), C.is_control(), keep_seconds)
    df = C.force_keep(df.withColumn("labels_triggered", F.array_sort(F.array_union("object_triggered", "process_triggered"))))
    then = "_us bigint, _process_signature string, _object_signature string, _object_epoch_after bigint, _process_epoch_after bigint"
    df = staged(df, C.SEMANTIC_KEY, _skip_step, "us bigint, ps string, os string, oe bigint, pe bigint", then, keep_seconds=max(ttl_seconds, 1))
    same = (F.col("_process_signature") == F.col("process_signature")) & (F.col("_object_signature") == F.col("object_signature")) & (
        F.col("_object_epoch_after") == F.col("object_epoch_before")) & (F.col("_process_epoch_after") == F.col("process_epoch_before"))
    fresh = F.col("us") - F.col("_us") <= ttl_seconds * 1_000_000
    return df.withColumn("skipped", F.coalesce(same & fresh & ~F.col("is_force_kept"), F.lit(False))).drop("_us", "_process_signature", "_object_signature", "_object_epoch_after", "_process_epoch_after")


def stream_semantic_skip(events: DataFrame, ttl_seconds: int = S.SKIP_TTL_SECONDS, late: str = "1 hour", keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """(event_id, skipped) of stream_compacted."""
    return stream_compacted(events, ttl_seconds, late, keep_seconds).select("event_id", "skipped")


def _episode_steps(representatives: int, columns: list[str]):
    empty = pd.DataFrame(columns=columns)

    def step(held: dict, ids: list, rows: pd.DataFrame):
        now = {}
        names = ["us", "event_id", "labels_triggered", "is_force_kept", "until_us"]
        for key, (us, event, own, keep, until) in zip(ids, zip(*[rows[c].tolist() for c in names])):
            n, last, labels, kept, first, _, _ = now[key] if key in now else held.get(key, (0, 0, [], False, [], 0, 0))
            labels = sorted({*labels, *own}) if len(own) else labels
            now[key] = (n + 1, max(last, us), labels, bool(kept or keep), [*first, event] if len(first) < representatives else first, event, until)
        return empty, now

    def end(key, state, mark, gone):
        n, last, labels, kept, ids, final, until = state
        if until > mark and not gone:
            return [], state, until
        few = list(ids) if n <= representatives else [*ids[:representatives - 1], final]
        return [(*key, n, last, list(labels), kept, few)], None, None

    return step, end


def stream_episodes(compact: DataFrame, minutes: int = 1, representatives: int = 5, keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """compact.episodes on the stream of stream_compacted: its retained events that are equal within a bucket, as one row once the watermark has passed the bucket."""
    df = compact.where("not skipped").withColumn("bucket_us", C.bucket_us(F.col("us"), minutes))
    hour = F.col("bucket_us") - F.pmod("bucket_us", F.lit(3_600_000_000)) + 3_600_000_000
    df = df.withColumn("until_us", F.least(F.col("bucket_us") + minutes * 60_000_000, hour)).select("ts", "us", "event_id", "labels_triggered", "is_force_kept", "until_us", *C.EPISODE_KEY)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    added = ", ".join(f"{c} {kinds[c]}" for c in C.EPISODE_KEY) + ", n bigint, last_us bigint, labels array<string>, is_force_kept boolean, representatives array<bigint>"
    columns = [*C.EPISODE_KEY, "n", "last_us", "labels", "is_force_kept", "representatives"]
    step, end = _episode_steps(representatives, columns)
    state = "n bigint, last_us bigint, labels array<string>, kept boolean, ids array<bigint>, final bigint, until_us bigint"
    return staged(df, C.EPISODE_KEY, step, state, added, keep_seconds=keep_seconds, end=end, replace=True).withColumn("first_us", F.col("bucket_us"))


_BRIDGE = ["task_id", "object_key", "src", "dst", "write_event", "read_event", "write_us", "read_us", "read_type", "labels"]


def _bridge_steps(gap_seconds: int, limit: int, settle_seconds: int):
    gap, settle = gap_seconds * 1_000_000, settle_seconds * 1_000_000
    empty = pd.DataFrame(columns=_BRIDGE)

    def step(held: dict, ids: list, rows: pd.DataFrame):
        open_ = {}
        for key, r in zip(ids, rows.itertuples(index=False)):
            if key not in open_:
                write, n, _, pending = held.get(key, (None, 0, "", "[]"))
                open_[key] = [write and json.loads(write), n, "", json.loads(pending)]
            at = open_[key]
            write, n, _, pending = at
            takes_part = r.object_class not in S.DENIED_BRIDGE_CLASSES
            if r.event_type in S.MUTATIONS:  # a new version: only its own write can be followed
                at[0] = [r.process_guid, int(r.event_id), int(r.us)] if takes_part and r.event_type in S.BRIDGE_WRITES else None
            elif write and takes_part and n < limit and r.event_type in S.BRIDGE_READS and None not in (write[0], r.process_guid) and write[0] != r.process_guid and r.us - write[2] <= gap:
                pending.append([write[0], r.process_guid, write[1], int(r.event_id), write[2], int(r.us), r.event_type])
                at[1] = n + 1
            at[2] = r.object_signature
        return empty, {k: (json.dumps(w) if w else None, n, labels, json.dumps(pending)) for k, (w, n, labels, pending) in open_.items()}

    def end(key, state, mark, gone):
        write, n, labels, pending = *state[:3], json.loads(state[3])
        due = [p for p in pending if gone or p[5] + settle <= mark]
        rest = [p for p in pending if not (gone or p[5] + settle <= mark)]
        own = labels.split("|")
        allowed = any(x in L.ALLOWED_BRIDGES for x in own) and not any(x in L.DENIED_BRIDGES for x in own)
        out = [(*key, *p, own) for p in due] if allowed else []
        return out, (write, n, labels, json.dumps(rest) if due else state[3]), min((p[5] + settle for p in rest), default=None)

    return step, end


def stream_bridges(objects: DataFrame, gap_seconds: int = S.BRIDGE_GAP_SECONDS, limit: int = S.BRIDGES_PER_OBJECT, settle_seconds: int = S.BRIDGE_GAP_SECONDS, keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """labels.bridge_edges on the stream of stream_objects: writes followed within the gap by a read or execution of the same version by another process, the first `limit` of each object.

    State of an object is its open write (each write begins a version, so there is one at most) and its bridges that are not yet out. A bridge goes out settle_seconds after its read, judged by the labels
    that the object has by then; labels that come later do not count, so with a settle time as long as the input lasts the rows are those of the batch."""
    step, end = _bridge_steps(gap_seconds, limit, settle_seconds)
    df = objects.select("ts", "us", "event_id", "task_id", "object_key", "object_class", "process_guid", "event_type", "object_signature")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    added = f"task_id {kinds['task_id']}, object_key string, src string, dst string, write_event bigint, read_event bigint, write_us bigint, read_us bigint, read_type string, labels array<string>"
    return L.bridge_kinds(staged(df, ["task_id", "object_key"], step, "write string, n int, labels string, pending string", added, keep_seconds=keep_seconds, end=end, replace=True))


def drained(stream: DataFrame, complete: bool = False) -> DataFrame:
    """Run a stream to the end of all that is there now, however long it takes, and read its result: appended rows, or the last complete table of an aggregation."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if complete:
        q = w.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    else:
        q = w.outputMode("append").format("parquet").option("path", f"{base}/out").start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
