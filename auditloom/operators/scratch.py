"""Tables between the rounds of iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where the setting is absent, a folder of this machine serves a local session (tests); a cluster raises, as its executors share no such folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="auditloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the scratch folder, which is deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    p, store = _hadoop_path(spark, path)
    store.mkdirs(p)
    store.deleteOnExit(p)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df into the scratch folder and read it back: cuts the lineage and survives lost executors. The table lives until discard() or the driver's end."""
    path = new_path(df.sparkSession, label)
    df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def still_there(df: DataFrame) -> bool:
    """Whether the table behind a DataFrame from written() exists."""
    p, store = _hadoop_path(df.sparkSession, df._scratch_path)
    return store.exists(p)


def stamp(spark: SparkSession, pattern: str) -> list[tuple]:
    """What tells that files or folders of a path pattern have changed: for each its path, time of change, bytes and number of files."""
    p, store = _hadoop_path(spark, pattern)
    out = []
    for status in store.globStatus(p) or []:
        held = store.getContentSummary(status.getPath())
        out.append((status.getPath().toString(), status.getModificationTime(), held.getLength(), held.getFileCount()))
    return sorted(out)


def discard(*tables: DataFrame) -> None:
    """Delete the tables behind DataFrames from written(), once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            p, store = _hadoop_path(df.sparkSession, path)
            store.delete(p, True)


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], n: str, share: int = 1000) -> DataFrame:
    """rows left join facts (one row for each value of `on`, column n = its rows); n is not carried.

    A key that holds more than 1/share of all rows is joined by broadcast: there are fewer than `share` of them, whatever
    the data. The others are shuffled, so no task gathers the rows of a hot key; rows of hot keys and with a null
    key are dealt evenly. A shuffled key that is large in bytes all the same is split by Spark's adaptive skew join, as it is in any join of two shuffled sides.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    hot = facts.where(F.col(n) * share > total)
    values = [c for c in facts.columns if c not in (*on, n)]
    fat = F.broadcast(hot.select(*on, F.struct(*values).alias("_hot")))
    minus_one = F.least(F.lit(-1), F.col(n)).cast("bigint")  # Spark would take a plain literal out of the join's keys, and hot rows would meet again
    rest = facts.where(F.col(n) * share <= total).select(*on, F.struct(*values).alias("_cold"), minus_one.alias("_salt"))
    any_null = F.lit(False)
    for c in on:
        any_null = any_null | F.col(c).isNull()
    away: Column = F.when(any_null | F.col("_hot").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    out = rows.join(fat, on, "left").withColumn("_salt", away.cast("bigint")).join(rest, [*on, "_salt"], "left")
    return out.select(*rows.columns, *[F.coalesce(f"_hot.{v}", f"_cold.{v}").alias(v) for v in values])


def ranked(df: DataFrame, by: list[str], order: list[str], place: str, total: str | None = None) -> DataFrame:
    """df plus each row's place (from 0) by `order` among the rows of equal `by`, and the number of those rows.

    Rows are range-partitioned by (by, order), sorted where they lie and written with their number; places follow from the numbers
    and the counts of each (part, by), so neither a hot `by` nor the whole table meets in one task, and the number of
    ranges follows the session's shuffle partitions. Nulls come first, a null `by` is a group of its own, and rows equal in all of `by` and `order`
    are placed in any order. An empty table gives an empty result. The written table lives as `_scratch_path` of the result.
    """
    d = written(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    d_part = F.shiftright("_at", 33)  # the number's upper bits are the partition's number
    own = d.groupBy(*by, d_part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each part
    before = F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    facts = own.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), (before - F.col("_first")).alias("_move"), F.sum("_n").over(group).alias("_all"))
    same = d_part == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = d.join(facts, same).select(*df.columns, (F.col("_at") + F.col("_move")).alias(place), *([F.col("_all").alias(total)] if total else []))
    out._scratch_path = d._scratch_path
    return out
