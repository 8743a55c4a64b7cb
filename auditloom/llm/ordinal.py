"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector is shared by all ordered thresholds. Features are the
distinct lower-case words of a text and their stems (first 4 to 6 letters), screened by how much more often they
occur in texts of higher grade. The output is the expected grade, sum over k of P(grade > k).

Where labels say only toxic or not, grades are cross-fitted: the labelled rows fall into two halves by a hash, and a toxic text
is graded by how often words screened on the other half occur in it, repeats included. So no text's grade rests on its own label's
screening, and weights are fitted to the presence of words against the amount of evidence.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import discard, free_name, labelled_ids, sampled, texts_of, written

_WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)


def features(text: str | None) -> set[str]:
    """Words of 3 letters and more as `=word`, and longer words' stems as `^stem`."""
    words = set(_WORD.findall((text or "").lower()))
    out = {"=" + w for w in words if len(w) > 2}
    for k in STEMS:
        out.update(["^" + w[:k] for w in words if len(w) > k])
    return out


def grade_counts(labelled: DataFrame) -> DataFrame:
    """(feature, high_0, n_0, high_1, n_1): in each half, documents of grade above 0 and all documents that hold the feature.

    Features go to a partial aggregation before the shuffle, so a word of every text costs a row for each task."""

    @F.pandas_udf("array<string>")
    def feats(text: pd.Series) -> pd.Series:
        return pd.Series([list(features(t)) for t in text])

    held = labelled.select("_high", "_half", F.explode(feats("_text")).alias("feature"))
    return held.groupBy("feature").agg(*[f(F.when(F.col("_half") == h, F.col("_high"))).alias(f"{name}_{h}") for h in (0, 1) for name, f in (("high", F.sum), ("n", F.count))])


def screen(counts: DataFrame, halves: tuple[int, ...], n_high: int, n_all: int, size: int = 2000, z_least: float = 6.0, least_share: float = 0.004, words: bool = False) -> list[str]:
    """The `size` features with the largest z value of the difference of document shares in these halves; a bounded model size.

    A feature must occur in least_share of the texts of higher grade (three at least), so words of a few copies of one text do not count."""
    if not n_high or n_high == n_all:
        return []
    share = F.lit(n_high / n_all)
    high, n = (sum((F.coalesce(F.col(f"{name}_{h}"), F.lit(0)) for h in halves), F.lit(0)) for name in ("high", "n"))
    z = (high - n * share) / F.sqrt(n * share * (1 - share))
    known = counts.where("feature like '=%'") if words else counts
    rows = known.where((high >= max(3, math.ceil(least_share * n_high))) & (n > 0)).select("feature", z.alias("z")).where(F.col("z") >= z_least).orderBy(F.desc("z"), "feature").limit(size).collect()
    return [r.feature for r in rows]


def evidence(text: str | None, words: set[str]) -> int:
    """How often words of the set (as features) occur in the text, repeats included."""
    return sum("=" + w in words for w in _WORD.findall((text or "").lower()))


def fit(x: list[list[int]], grade: np.ndarray, n_features: int, n_grades: int, epochs: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch Adam on the ordinal likelihood; thresholds are kept in order as a first value plus positive gaps."""
    doc = np.repeat(np.arange(len(x)), [len(r) for r in x])
    col = np.fromiter((c for r in x for c in r), np.int64, len(doc))
    k = n_grades - 1
    w, raw = np.zeros(n_features), np.array([1.0] + [0.0] * (k - 1))
    ms, vs = [np.zeros(n_features), np.zeros(k)], [np.zeros(n_features), np.zeros(k)]
    rows = np.arange(len(x))
    for step in range(1, epochs + 1):
        theta = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
        z = np.bincount(doc, w[col], len(x))[:, None] - theta
        below = 1 / (1 + np.exp(np.clip(z, -30, 30)))  # P(grade <= k)
        edge = np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1)
        hi, lo = edge[rows, grade + 1], edge[rows, grade]
        share = np.maximum(hi - lo, 1e-12)
        slope = (1 - hi - lo) / len(x)  # of -log P(grade) by w.x
        gw = np.bincount(col, slope[doc], n_features) + l2 * w
        both = np.zeros((len(x), n_grades + 1))
        both[rows, grade + 1] -= hi * (1 - hi) / share / len(x)
        both[rows, grade] += lo * (1 - lo) / share / len(x)
        gt = both[:, 1:-1].sum(axis=0)
        gr = np.concatenate([[gt.sum()], [np.exp(raw[j]) * gt[j:].sum() for j in range(1, k)]])
        for i, (p, g) in enumerate(((w, gw), (raw, gr))):
            ms[i] += 0.1 * (g - ms[i])
            vs[i] += 0.01 * (g * g - vs[i])
            p -= 0.05 * (ms[i] / (1 - 0.9 ** step)) / (np.sqrt(vs[i] / (1 - 0.99 ** step)) + 1e-9)
    return w, np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          screened: int = 60_000, sample: int = 6000, size: int = 2000, grades: tuple[int, ...] = (1, 3, 6)) -> dict | None:
    """Screen features on at most `screened` labelled rows, then fit on at most `sample` of them, half of grade above 0 where there are enough.

    Both bounds are of rows chosen by a hash of the id.

    A label column with values above 1 gives the grades as they are. A 0/1 label is graded by evidence: a text
    marked 1 gets one grade for each entry of `grades` that its evidence (see the module's head) reaches (one at least).
    None (nothing is toxic) if a class is missing. Null labels and ids are never learned; an id with several
    labels counts with the largest, an id with several texts with the smallest, and equal texts count once, with their largest label.
    """
    ids = written(labelled_ids(docs, labels, label, id_col), "labelled")
    known = sampled(ids, screened, 5)
    rows = texts_of(docs, known, id_col, text_col).groupBy("_text").agg(F.min("_id").alias("_id"), F.max("_y").alias("_y"))
    rows = written(rows.withColumn("_high", (F.col("_y") > 0).cast("long")).withColumn("_half", F.pmod(F.xxhash64("_id", F.lit(19)), F.lit(2)).cast("int")), "labelled")
    total = {r._half: r for r in rows.groupBy("_half").agg(F.count("*").alias("n"), F.sum("_high").alias("high"), F.max("_y").alias("top")).collect()}
    n_all, n_high, top = sum(r.n for r in total.values()), sum(r.high for r in total.values()), max([r.top for r in total.values()], default=0)
    if not n_high or n_high == n_all:
        return None
    counts = written(grade_counts(rows), "features")
    vocab = screen(counts, (0, 1), n_high, n_all, size)
    if not vocab:
        return None
    at = {f: i for i, f in enumerate(vocab)}
    other = {h: set(screen(counts, (1 - h,), total[1 - h].high, total[1 - h].n, size, 4.0, words=True)) if 1 - h in total else set() for h in (0, 1)} if top <= 1 else {0: set(), 1: set()}

    @F.pandas_udf("struct<x:array<int>,seen:int>")
    def found(text: pd.Series, half: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"x": [sorted(at[f] for f in features(t) if f in at) for t in text], "seen": [evidence(t, other[h]) for t, h in zip(text, half, strict=True)]})

    got = []
    for high in (1, 0):
        got += sampled(rows.where(F.col("_high") == high), sample // 2, 5).select("_id", "_y", found("_text", "_half").alias("f")).collect()
    got.sort(key=lambda r: r._id)
    x = [list(r.f.x) for r in got]
    n_grades = top + 1 if top > 1 else len(grades) + 1
    y = np.array([r._y if top > 1 or not r._y else max(1, sum(r.f.seen >= g for g in grades)) for r in got])
    w, theta = fit(x, y, len(vocab), n_grades)
    discard(ids, rows, counts)
    shift = math.log(n_high / (n_all - n_high)) - math.log(max(1, (y > 0).sum()) / max(1, (y == 0).sum()))
    return {"weights": {f: float(w[i]) for f, i in at.items()}, "theta": [float(t) - shift for t in theta]}


def expected_severity(model: dict, text: str | None) -> tuple[float, float]:
    """(expected grade, P(grade > 0))."""
    w = model["weights"]
    z = sum(w[f] for f in sorted(features(text)) if f in w)
    above = [1 / (1 + math.exp(min(max(t - z, -50.0), 50.0))) for t in model["theta"]]
    return sum(above), above[0]


def with_severity(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs plus expected_severity (0 to the highest grade), toxic_probability and toxic (probability >= 0.5), over whole texts.

    Null and empty texts hold no feature and get the lowest severity. Each row is scored by its text alone, so repeated rows and ids get equal
    answers; an empty table gives an empty result. Input columns of these names are replaced.
    """

    @F.pandas_udf("struct<s:double,p:double>")
    def sev(text: pd.Series) -> pd.DataFrame:
        if model is None:
            return pd.DataFrame({"s": [0.0] * len(text), "p": [0.0] * len(text)}, dtype=float)
        return pd.DataFrame([expected_severity(model, t) for t in text], columns=["s", "p"], dtype=float)

    x = free_name(docs, "_sev")
    return docs.withColumn(x, sev(F.col(text_col))).withColumn("expected_severity", F.col(f"{x}.s")).withColumn(
        "toxic_probability", F.col(f"{x}.p")).withColumn("toxic", F.col(f"{x}.p") >= 0.5).drop(x)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_severity(docs.select("doc_id", "text"), model).select("doc_id", "expected_severity", "toxic_probability", F.col("toxic").cast("int").alias("toxic"))
