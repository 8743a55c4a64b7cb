"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within `radius` bits share at least one variant within radius/2 of both. Every distinct
fingerprint emits its whole half-radius ball; a shuffle on the variant brings colliding fingerprints together,
sorted neighbours are verified and linked, and components of the links are the groups. A bucket of one variant
holds at most one fingerprint per ball member (65 for radius 2), whatever the data.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import connected_components, spread_join, written

BITS = 64
_BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text as a signed integer; null and wordless texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and split touch ASCII only
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(width)))]
    digest, n, ones = xxhash.xxh64_intdigest, len(shingles), np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        part = shingles[at:at + _BLOCK]
        h = np.fromiter((digest(s, seed) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """docs plus a long column `out`; a column of that name is replaced."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in text], dtype="int64")

    return docs.withColumn(out, fp(F.col(text_col)))


def ball_masks(half_radius: int) -> list[int]:
    """XOR masks of all variants within half_radius bits, as signed 64-bit integers."""
    masks = [sum(1 << b for b in bits) for k in range(half_radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def ball_links(reps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between the representatives `rep` of distinct fingerprints (columns fp, rep) within `radius` bits.

    The links are a spanning part of each bucket: members are chained in order of rep, and all members of an
    even-radius bucket lie within `radius` of each other, so components equal those of all links. Odd radii
    use the next even ball and verify each chained pair against every smaller member within the bounded bucket.
    """
    half = (radius + 1) // 2
    variants = reps.select("fp", "rep", F.explode(F.array(*[F.lit(m).cast("long") for m in ball_masks(half)])).alias("mask"))
    variants = variants.select("fp", "rep", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    w = Window.partitionBy("variant").orderBy("rep")
    if radius % 2 == 0:
        pairs = variants.select("rep", "fp", F.lag("rep").over(w).alias("other"), F.lag("fp").over(w).alias("other_fp"))
    else:
        earlier = F.collect_list(F.struct("rep", "fp")).over(w.rowsBetween(Window.unboundedPreceding, -1))
        pairs = variants.select("rep", "fp", earlier.alias("earlier")).select("rep", "fp", F.explode("earlier").alias("e")).select(
            "rep", "fp", F.col("e.rep").alias("other"), F.col("e.fp").alias("other_fp"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= radius
    return pairs.where(F.col("other").isNotNull() & near).select(F.col("other").alias("a"), F.col("rep").alias("b")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """One row per input row: id, fp (long), component_id (smallest id reachable through links, own id included).

    Exact copies share a fingerprint and meet before the ball join, so a group of any size costs one ball.
    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id get the group of their
    fingerprint, or a null component_id if the group has no id. Repeated rows are answered each. Extra columns
    are not carried, so none can clash. An empty table gives an empty result.
    """
    fps = written(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp", width)
                  .select("id", "fp"), "fps")
    return fingerprint_groups(fps, radius).withColumnRenamed("id", id_col)


def fingerprint_groups(fps: DataFrame, radius: int = 2) -> DataFrame:
    """simhash_groups of written fingerprints (id, fp) -> (id, fp, component_id); a fingerprint of very many rows is joined back by broadcast."""
    reps = fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("rep is not null")
    comps = connected_components(ball_links(reps, radius))
    of_fp = written(reps.join(comps, reps.rep == comps.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")), "classes")
    return spread_join(fps, of_fp, ["fp"], "n").select("id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash_groups(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
