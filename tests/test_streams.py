"""drained() reads its result only after the stream's end."""

import time

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from auditloom.operators import compact as C
from auditloom.operators import labels as B
from auditloom.plans import stream_plans
from auditloom.streaming import late
from auditloom.streaming import streams as L


def test_drained_waits_for_the_end(spark, tmp_path, monkeypatch):
    spark.range(40).coalesce(1).write.parquet(str(tmp_path / "in"))
    full = StreamingQuery.awaitTermination
    # a limit, if there is one, passes before the batch ends
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda q, timeout=None: full(q) if timeout is None else full(q, 0.01))
    slow = F.udf(lambda x: time.sleep(0.05) or x, "long")
    assert L.drained(spark.readStream.schema("id long").parquet(str(tmp_path / "in")).select(slow("id").alias("id"))).count() == 40


SCHEMA = "event_id long, ts timestamp, event_type string, process_guid string, object_key string"


def test_late_rows_are_counted_over_restarts_and_short_logs(spark, tmp_path):
    """Three triggers of one file each, the last by a new run of the query, with a progress log of one entry: the last brings rows that are older than the watermark of the first, and one that is not."""
    path, counts = str(tmp_path / "in"), str(tmp_path / "counts")
    rows = {1: [(1, "2024-01-01 00:10:00"), (2, "2024-01-09 00:20:00")], 2: [(6, "2024-01-09 00:30:00"), (7, "2023-12-01 00:00:00")], 3: [(3, "2024-01-02 00:00:00"), (4, "2024-01-03 00:00:00"), (5, "2024-01-08 23:50:00")]}
    listener = late.LateRows(spark, counts)
    spark.streams.addListener(listener)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    seen = []
    try:
        for name, part in rows.items():
            df = spark.createDataFrame([(i, t, "READ", f"p{i}", "o") for i, t in part], "event_id long, ts string, event_type string, process_guid string, object_key string")
            df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
            q = L.stream_counts(spark.readStream.schema(SCHEMA).parquet(path), "1 day", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
            q.awaitTermination()
            listener.wait(q)
            seen.append(sum(r.dropped for r in late.late_counts(spark, counts).collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        spark.streams.removeListener(listener)
    # the watermark is 8 January 23:20 after the first run: the window of 8 January is still open
    assert seen == [0, 1, 3]
    spark.read.parquet(counts).limit(1).write.mode("append").parquet(counts)  # a batch that was run again
    assert sum(r.dropped for r in late.late_counts(spark, counts).collect()) == 3


def test_streams_of_shuffled_triggers_equal_the_batch(spark, tmp_path):
    """The events are dealt to triggers at random, all within the watermark; the last trigger lies behind them."""
    path = str(tmp_path / "in")
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("user_id % 10 = 1 and event_id < 6000")
    end = events.limit(1).withColumn("event_id", F.lit(-1).cast("long")).withColumn("ts", F.lit("2200-01-01").cast(events.schema["ts"].dataType)).withColumn("user_id", F.lit(None).cast(events.schema["user_id"].dataType))
    for part in [events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k) for k in range(3)] + [end]:
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their times

    def live():
        e = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
        return stream_plans.bound(e)

    p = bound_batch(spark, events)
    compact = {r.event_id: r.skipped for r in C.compacted(p, stream_plans.TTL).select("event_id", "skipped").collect()}
    assert {r.event_id: r.skipped for r in L.drained(L.stream_semantic_skip(live(), stream_plans.TTL, "60 days")).collect()} == compact
    labels = C.object_prelabels(p)
    want = {(r.write_event, r.read_event, r.bridge_type, tuple(r.labels)) for r in B.bridge_edges(C.semantic_epochs(p), labels, 30 * stream_plans.DAY).collect()}
    got = L.drained(L.stream_bridges(L.stream_objects(live(), "60 days"), 30 * stream_plans.DAY, settle_seconds=L.KEEP_SECONDS)).collect()
    assert {(r.write_event, r.read_event, r.bridge_type, tuple(r.labels)) for r in got} == want and want


def bound_batch(spark, events):
    """The batch binding of some events: places come from time and id."""
    p = stream_plans.bound(events)
    return p.withColumn("order_index", F.row_number().over(Window.partitionBy("task_id").orderBy("us", "event_id")))
