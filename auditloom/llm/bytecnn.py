"""Quality classifier: a byte-level convolutional network in numpy.

Filters of `WIDTH` bytes are learned as tables (one row of filter weights per offset and byte value), which is a
convolution over one-hot bytes. A document is covered by overlapping chunks of `CHUNK` windows: they share WIDTH - 1 bytes,
and the last one is moved back so that it ends with the text, so every window lies in a chunk and no chunk but that of a shorter
text holds padding, which takes no part. Filters are max-pooled in each chunk; the chunk maxima of the document are
combined by their mean, maximum and minimum, and a logistic layer turns the three into one probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import discard, id_bucket, labelled_ids, sampled, texts_of, written

WIDTH, FILTERS, CHUNK = 8, 16, 512
_ROWS = 128  # chunks convolved at a time: bounds memory for texts of any length


def chunked(data: bytes) -> tuple[np.ndarray, int]:
    """(chunks, CHUNK + WIDTH - 1) bytes covering the whole of data, and the number of windows in the first chunk.

    Texts of fewer windows than CHUNK are one chunk; below WIDTH bytes its one window is filled with zero bytes."""
    b = np.frombuffer(data, np.uint8)
    windows = max(1, len(b) - WIDTH + 1)
    size = CHUNK + WIDTH - 1
    if windows <= CHUNK:
        flat = np.zeros((1, size), np.uint8)
        flat[0, :len(b)] = b
        return flat, windows
    starts = np.append(np.arange(0, windows - CHUNK, CHUNK), windows - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(b, size)[starts], CHUNK


def convolve(table: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK, FILTERS) responses of all filters at all windows."""
    out = table[0][chunks[:, :CHUNK]]
    for k in range(1, WIDTH):
        out += table[k][chunks[:, k:k + CHUNK]]
    return out


def pooled(table: np.ndarray, chunks: np.ndarray, windows: int = CHUNK) -> np.ndarray:
    """(chunks, FILTERS) maxima over the first `windows` windows of each chunk, a bounded block of chunks at a time."""
    return np.concatenate([convolve(table, chunks[i:i + _ROWS])[:, :windows].max(axis=1) for i in range(0, len(chunks), _ROWS)])


def combined(maxima: np.ndarray) -> np.ndarray:
    return np.concatenate([maxima.mean(axis=0), maxima.max(axis=0), maxima.min(axis=0)])


def fit(samples: list[tuple[np.ndarray, int]], labels: np.ndarray, prior: float, epochs: int = 16, batch: int = 64, seed: int = 7) -> dict:
    """Adam on the logistic loss with classes weighted alike; the intercept is then moved to `prior`, the share of label 1."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    p = {"t": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
         "w": rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), "b": np.zeros(1, np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    step, sites = 0, WIDTH * 256 * FILTERS
    cell = np.arange(FILTERS)
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at:at + batch]
            parts = [samples[i][0] for i in rows]
            x = np.concatenate(parts)
            windows = np.repeat([samples[i][1] for i in rows], [len(c) for c in parts])
            ends = np.cumsum([len(c) for c in parts])
            starts = ends - [len(c) for c in parts]
            tops, sites_at = [], []
            for i in range(0, len(x), _ROWS):
                r = convolve(p["t"], x[i:i + _ROWS])
                for j in np.nonzero(windows[i:i + _ROWS] < CHUNK)[0]:
                    r[j, windows[i + j]:] = -np.inf
                a = r.argmax(axis=1)
                sites_at.append(a)
                tops.append(np.take_along_axis(r, a[:, None, :], 1)[:, 0, :])
            top, pos = np.concatenate(tops), np.concatenate(sites_at)
            sizes = (ends - starts)[:, None].astype(np.float32)
            h = np.concatenate([np.add.reduceat(top, starts) / sizes, np.maximum.reduceat(top, starts), np.minimum.reduceat(top, starts)], axis=1)
            z = h @ p["w"] + p["b"]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            gh = g[:, None] * p["w"]
            doc = np.repeat(np.arange(len(rows)), ends - starts)
            gt = (gh[:, :FILTERS] / sizes)[doc]
            gt += gh[:, FILTERS:2 * FILTERS][doc] * (top == h[:, FILTERS:2 * FILTERS][doc])
            gt += gh[:, 2 * FILTERS:][doc] * (top == h[:, 2 * FILTERS:][doc])
            flat = np.zeros(sites)
            for k in range(WIDTH):
                byte = np.take_along_axis(x, pos + k, 1).astype(np.int64)
                flat += np.bincount(((k * 256 + byte) * FILTERS + cell).ravel(), gt.ravel(), sites)
            grads = {"t": flat.reshape(p["t"].shape).astype(np.float32) + 1e-5 * p["t"], "w": h.T @ g + 1e-3 * p["w"], "b": g.sum(keepdims=True)}
            step += 1
            for k, d in grads.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    p["b"] = p["b"] + np.float32(np.log(prior / (1 - prior)))
    return p


def score(model: dict, data: bytes) -> float:
    z = float(combined(pooled(model["t"], *chunked(data))) @ model["w"] + model["b"][0])
    return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def training_rows(docs: DataFrame, known: DataFrame, per_class: int, most_bytes: int, id_col: str, text_col: str) -> list:
    """[(whole text as bytes, label)] of at most per_class rows of each label, chosen by a hash of the id, and of at most about most_bytes.

    In the order of the hash, rows count until the texts before them fill most_bytes; a text longer than that is never chosen. All of a chosen text is learned."""
    ids = sampled(known, per_class, 3, by=("_y",))
    texts = texts_of(docs, ids, id_col, text_col).select("_id", "_y", F.encode(F.coalesce("_text", F.lit("")), "utf-8").alias("x"))
    texts = texts.where(F.octet_length("x") <= most_bytes)
    before = Window.partitionBy("_y").orderBy(F.xxhash64("_id", F.lit(3)), "_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = texts.withColumn("_before", F.coalesce(F.sum(F.octet_length("x")).over(before), F.lit(0))).where(F.col("_before") < most_bytes).select("_id", "_y", "x").collect()
    return [(bytes(r.x), r._y) for r in sorted(rows, key=lambda r: r._id)]


def learn(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text",
          fold: int = 5, held: int = 0, per_class: int = 1500, most_bytes: int = 12 << 20) -> dict | float:
    """Fit on labelled rows outside the held-out fold; a constant (share of label 1, 0.5 without labels) if a class is missing.

    per_class and most_bytes bound the sample of labelled rows that the driver sees; every chunk of a sampled text is learned.
    Labels that are null or not 0 or 1 and null ids are never learned; an id with both labels counts as label 1, an id with several texts with the smallest.
    """
    known = written(labelled_ids(docs, labels, label, id_col).where((F.col("_y") <= 1) & (id_bucket("_id", fold) != held)), "labelled")
    counts = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    rows = training_rows(docs, known, per_class, most_bytes, id_col, text_col) if n0 and n1 else []
    discard(known)
    if len({y for _, y in rows}) < 2:
        return n1 / (n0 + n1) if n0 + n1 else 0.5
    return fit([chunked(x) for x, _ in rows], np.array([y for _, y in rows]), n1 / (n0 + n1))


def with_score(docs: DataFrame, model: dict | float, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs plus a double column `out` between 0 and 1 over whole texts; null and empty texts are scored as empty.

    Each row is scored by its text alone, so repeated rows and ids get equal scores; an empty table gives an empty result. An input column of that name is replaced."""

    @F.pandas_udf("double")
    def p(text: pd.Series) -> pd.Series:
        if isinstance(model, float):
            return pd.Series([model] * len(text), dtype=float)
        return pd.Series([score(model, (t or "").encode("utf-8", "surrogatepass")) for t in text], dtype=float)

    return docs.withColumn(out, p(F.col(text_col)))


THRESHOLD = 0.3


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    held = F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(True))
    out = with_score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
