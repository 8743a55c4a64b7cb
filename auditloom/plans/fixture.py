"""Binding of the driver's events table to provenance events, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import scalars as X
from auditloom.operators.scratch import ranked, stamp, still_there, written

_made: dict = {}


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A written table from which several queries of one session start, so that no query rebuilds what another has made of the same files.

    The given tables' sizes, numbers of files and times of change are part of the key, so changed files give a new table; a table that is gone is made anew."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    now = stamp(spark, f"{sf_dir}/*.parquet")
    if key not in _made or _made[key][0] != now or not still_there(_made[key][1]):
        _made[key] = (now, written(make(), name))
    return _made[key][1]


def forget() -> None:
    """Queries from here on make their own tables, as each does in a session of its own; tables that are still read stay until the driver ends."""
    _made.clear()


_BINDING = """
SELECT event_id, ts, 'task_' || CAST(user_id % 10 AS STRING) AS task_id,
  row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS order_index,
  'p' || CAST(user_id AS STRING) AS process_guid, user_id,
  CASE WHEN user_id >= 10 THEN 'p' || CAST(10 * ((user_id {div} 10 - 1) {div} 3) + user_id % 10 AS STRING) END AS parent_process_guid,
  CASE user_id % 7 WHEN 0 THEN 'nginx' WHEN 1 THEN 'bash' WHEN 2 THEN 'python3' WHEN 3 THEN 'curl' WHEN 4 THEN 'sshd' WHEN 5 THEN 'tar' ELSE 'app' END AS process_name,
  CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'EXEC' WHEN 'purchase' THEN 'WRITE' WHEN 'signup' THEN 'SEND' ELSE 'RECV' END AS event_type,
  CASE WHEN event_type IN ('signup','error') THEN 'flow' ELSE 'file' END AS object_type,
  CASE WHEN event_type IN ('signup','error') THEN
    CASE WHEN k % 2 = 0 THEN '10.0.0.5:4000->8.8.8.' || CAST(k AS STRING) || ':443' ELSE '10.0.0.5:4000->192.168.1.' || CAST(k AS STRING) || ':22' END
  ELSE CASE k % 8 WHEN 0 THEN '/tmp/f' || CAST(k AS STRING) WHEN 1 THEN '/home/u/Documents/f' || CAST(k AS STRING) || '.csv'
    WHEN 2 THEN '/etc/passwd' WHEN 3 THEN '/home/u/.bash_history' WHEN 4 THEN '/etc/cron.d/j' || CAST(k AS STRING) WHEN 5 THEN '/var/log/s' || CAST(k AS STRING)
    WHEN 6 THEN '/usr/lib/l' || CAST(k AS STRING) || '.so' ELSE '/opt/app/b' || CAST(k AS STRING) END END AS object_key, value, props
FROM (SELECT *, CAST({json} AS BIGINT) AS k FROM {source}) e
"""
#: DuckDB text of the provenance view with its object class and the time in whole microseconds.
PE = f"""SELECT *, CASE WHEN object_key LIKE '10.0.0.5:4000->%' THEN CASE WHEN object_key LIKE '%->8.8.8.%' THEN 'external_ip' ELSE 'internal_ip' END
  WHEN object_key LIKE '/tmp/%' THEN 'temp_file' WHEN object_key = '/etc/passwd' THEN 'credential_file' WHEN object_key LIKE '%.bash_history' THEN 'history_file'
  WHEN object_key LIKE '/etc/cron.d/%' THEN 'persistence_file' WHEN object_key LIKE '/var/log%' THEN 'log_file' WHEN object_key LIKE '%.csv' THEN 'business_file'
  WHEN object_key LIKE '/usr/lib%' THEN 'system_library' ELSE 'file' END AS object_class, epoch_us(ts) AS us
FROM ({_BINDING.format(div="//", json="json_extract_string(props,'$.k')", source="events")}) b"""


def duck(sql: str) -> str:
    """SQL over the provenance view `pe`; `WITH` goes on with further names."""
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE pe AS ({PE}), {body[14:]}"
    return f"WITH pe AS ({PE}), {body[4:]}" if body.upper().startswith("WITH ") else f"WITH pe AS ({PE}) {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(_BINDING.format(div="DIV", json="get_json_object(props,'$.k')", source="{source}"), source=source)


def _classed(df: DataFrame) -> DataFrame:
    return df.withColumn("object_class", X.classify_object("object_type", "object_key")).withColumn("us", F.unix_micros("ts"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized provenance events of the events table: the binding, then object class, time in microseconds and flow ends."""
    return _classed(_bound(spark, sf_dir))


def provenance_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of provenance() as a table that a session writes once: places in the task come from ranges of time, not from one task for each of the ten tasks, and the
    classes are sought once and not at every use."""
    def make() -> DataFrame:
        df = _bound(spark, sf_dir)
        placed = ranked(df.drop("order_index"), ["task_id"], ["ts", "event_id"], "_place")
        return _classed(placed.select(*[(F.col("_place") + 1).cast("int").alias(c) if c == "order_index" else c for c in df.columns]))

    return once(spark, sf_dir, "events", make)
