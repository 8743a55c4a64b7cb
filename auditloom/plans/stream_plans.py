"""Queries of the streams: the events table read as a stream, run to its end, against the batch result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.operators.identity import resolve_process_alias
from auditloom.operators.scratch import new_path
from auditloom.plans.compact_plans import COMPACT, EPISODES, TTL
from auditloom.plans.evidence_plans import subjects
from auditloom.plans.fixture import duck, table
from auditloom.plans.label_plans import BRIDGES, DAY
from auditloom.plans.registry import query
from auditloom.streaming import late
from auditloom.streaming import streams as L


def live(spark, d, path=None):
    """The events (or those at another path) as a stream of provenance events; the binding's row number is left out, as it needs all rows."""
    return bound(spark.readStream.schema(table(spark, d, "events").schema).parquet(path or f"{d}/events.parquet*"))


def bound(e):
    """Rows of the events table as provenance events."""
    u, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("bigint")
    flow = F.col("event_type").isin("signup", "error")
    kinds = F.create_map(*[F.lit(x) for x in ("view", "READ", "click", "EXEC", "purchase", "WRITE", "signup", "SEND", "error", "RECV")])
    names = F.array(*[F.lit(x) for x in ("nginx", "bash", "python3", "curl", "sshd", "tar", "app")])
    ks = k.cast("string")
    key = F.when(flow & (k % 2 == 0), F.concat(F.lit("10.0.0.5:4000->8.8.8."), ks, F.lit(":443"))).when(flow, F.concat(F.lit("10.0.0.5:4000->192.168.1."), ks, F.lit(":22"))).when(k % 8 == 0, F.concat(F.lit("/tmp/f"), ks)).when(
        k % 8 == 1, F.concat(F.lit("/home/u/Documents/f"), ks, F.lit(".csv"))).when(k % 8 == 2, "/etc/passwd").when(k % 8 == 3, "/home/u/.bash_history").when(k % 8 == 4, F.concat(F.lit("/etc/cron.d/j"), ks)).when(
        k % 8 == 5, F.concat(F.lit("/var/log/s"), ks)).when(k % 8 == 6, F.concat(F.lit("/usr/lib/l"), ks, F.lit(".so"))).otherwise(F.concat(F.lit("/opt/app/b"), ks))
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), F.concat(F.lit("task_"), (u % 10).cast("string")).alias("task_id"), F.concat(F.lit("p"), u.cast("string")).alias("process_guid"), F.get(names, (u % 7).cast("int")).alias("process_name"), kinds[F.col("event_type")].alias("event_type"), F.when(flow, "flow").otherwise("file").alias("object_type"), key.alias("object_key")).withColumn("object_class", X.classify_object("object_type", "object_key"))


@query("l01_stream_normalize", duck("SELECT event_id, 'c' || user_id AS process_guid, event_type, object_class, CASE WHEN object_type = 'flow' THEN CASE WHEN object_class = 'external_ip' THEN 443 ELSE 22 END END AS port FROM pe"))
def l01(spark, d):
    alias = resolve_process_alias(subjects(spark, d), "pid")
    return L.drained(L.stream_normalize(live(spark, d), alias)).select("event_id", "process_guid", "event_type", "object_class", F.col("flow.remote_port").alias("port"))


@query("l02_stream_counts", duck("SELECT us // 86400000000 AS day, event_type, process_guid, object_key, count(*) AS n FROM pe GROUP BY ALL"))
def l02(spark, d):
    return L.drained(L.stream_counts(live(spark, d)), complete=True).withColumn("day", F.floor(F.unix_micros("start") / 86_400_000_000)).drop("start")


def closed(spark, d):
    """live() with one row of another time at its end, behind which every event lies: a live stream's watermark goes on, a table's does not."""
    e = live(spark, d)
    path = new_path(spark, "closing")
    row = spark.range(1).select(F.timestamp_seconds(F.lit(7_258_118_400)).alias("ts"), F.lit(7_258_118_400_000_000).alias("us"), F.lit(-1).cast("long").alias("event_id"))
    row.write.mode("append").parquet(path)
    return e.unionByName(spark.readStream.schema(row.schema).parquet(path), allowMissingColumns=True)


@query("l03_stream_episodes", duck(f"WITH {EPISODES} SELECT task_id, bucket_us AS first_us, process_guid, event_type, object_type, object_class, object_key, process_signature, object_signature, object_epoch_after, process_epoch_after, n, last_us, representatives, is_force_kept FROM epi"))
def l03(spark, d):
    return L.drained(L.stream_episodes(L.stream_compacted(closed(spark, d), TTL), 60)).drop("labels", "bucket_us")


@query("l04_stream_mass_access", duck("SELECT us // 86400000000 AS day, process_guid, count(DISTINCT object_key) AS objects FROM pe WHERE event_type = 'READ' AND object_type = 'file' GROUP BY ALL HAVING count(DISTINCT object_key) >= 2"))
def l04(spark, d):
    return L.drained(L.stream_mass_access(live(spark, d), 2, "1 day"), complete=True).select(F.floor(F.unix_micros("start") / 86_400_000_000).alias("day"), "process_guid", "objects")


@query("l05_stream_semantic_skip", duck(f"WITH {COMPACT} SELECT event_id, skipped FROM sk"))
def l05(spark, d):
    return L.drained(L.stream_semantic_skip(closed(spark, d), TTL))


@query("l06_stream_recent_network", duck(f"WITH {COMPACT} SELECT event_id, last_recv_us, last_connect_us, coalesce(us - last_recv_us <= 86400000000, false) AS recent_recv, coalesce(us - last_connect_us <= 86400000000, false) AS recent_connect FROM net"))
def l06(spark, d):
    return L.drained(L.stream_recent_network(closed(spark, d), 86_400)).select("event_id", "last_recv_us", "last_connect_us", "recent_recv", "recent_connect")


@query("l07_stream_bridges", duck(f"WITH {BRIDGES} SELECT task_id, object_key, src, dst, write_event, read_event, write_us, read_us, labels, bridge_type, CAST(confidence AS DOUBLE) AS confidence FROM br"))
def l07(spark, d):
    return L.drained(L.stream_bridges(L.stream_objects(closed(spark, d)), DAY, settle_seconds=L.KEEP_SECONDS)).drop("read_type")


@query("l08_stream_sessions", duck("WITH g AS (SELECT process_guid, us, CASE WHEN us - lag(us) OVER (PARTITION BY process_guid ORDER BY us) < 43200000000 THEN 0 ELSE 1 END AS new FROM pe), s AS (SELECT *, sum(new) OVER (PARTITION BY process_guid ORDER BY us) AS sid FROM g) SELECT process_guid, min(us) AS start_us, count(*) AS n, max(us) AS last_us FROM s GROUP BY process_guid, sid"))
def l08(spark, d):
    return L.drained(L.stream_sessions(live(spark, d), "12 hours"), complete=True).select("process_guid", F.unix_micros("start").alias("start_us"), "n", F.unix_micros("last").alias("last_us"))


@query("l09_late_rows", duck("""WITH w AS (SELECT event_id % 3 AS part, us FROM pe), m AS (SELECT max(CASE WHEN part = 0 THEN us END) // 1000 * 1000 - 3600000000 AS w0, max(CASE WHEN part < 2 THEN us END) // 1000 * 1000 - 3600000000 AS w1 FROM w)
 SELECT count(*) AS dropped FROM w, m WHERE (part = 1 AND us <= w0) OR (part = 2 AND us <= w1)"""))
def l09(spark, d):
    """The events come in three runs of one query, each a restart: a third of them, then two thirds that are late but for their end."""
    base = new_path(spark, "late")
    listener = late.LateRows(spark, f"{base}/counts")
    spark.streams.addListener(listener)
    try:
        for part in range(3):
            table(spark, d, "events").where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{base}/in")
            q = L.stream_recent_network(live(spark, d, f"{base}/in")).writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").option("path", f"{base}/out").start()
            q.awaitTermination()
            listener.wait(q)
    finally:
        spark.streams.removeListener(listener)
    return late.late_counts(spark, f"{base}/counts").agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))
