"""Shared helpers: stable hashing of ids, bounded samples of labelled rows; scratch tables and components come from the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.graph import connected_components
from auditloom.operators.scratch import discard, new_path, ranked, spread_join, written

__all__ = ["connected_components", "discard", "free_name", "id_bucket", "labelled_ids", "new_path", "ranked", "sampled", "spread_join", "texts_of", "written"]


def free_name(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def id_bucket(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null ids give null."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def labelled_ids(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(_id, _y): ids of docs with a label that is not negative; the largest label of an id counts. Reads no text."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y >= 0").groupBy("_id").agg(F.max("_y").alias("_y"))
    return known.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")


def sampled(rows: DataFrame, most: int, seed: int, key: str = "_id", by: tuple[str, ...] = ()) -> DataFrame:
    """At most `most` rows (of each value of `by`, if given), chosen by a hash of the key.

    A hash threshold cuts the rows to about the number wanted where they lie, so the exact pick sees a bounded number of rows, however many there were.
    rows is read twice; null keys have one hash."""
    scale = 1 << 30
    h = F.xxhash64(key, F.lit(seed))

    def cut(n):
        return F.pmod(h, F.lit(scale)) < F.least(F.lit(scale), F.ceil((1.2 * most + 100) / n * scale))

    if not by:
        return rows.where(cut(F.lit(max(1, rows.count())))).orderBy(h, key).limit(most)
    n = rows.groupBy(*[F.col(c).alias(f"_{c}_") for c in by]).agg(F.count("*").alias("_n"))
    near = rows.join(F.broadcast(n), [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by]).where(cut(F.col("_n"))).select(*rows.columns)
    order = Window.partitionBy(*by).orderBy(h, key)
    return near.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most).drop("_rn")


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _y, _text) of a bounded sample of ids, which is broadcast, so other texts are never shuffled; a repeated id counts once, with its smallest text."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
