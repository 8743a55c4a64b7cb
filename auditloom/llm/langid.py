"""Language identification by hierarchical discrimination: family first, then one-versus-one linear SVMs within it.

Features are hashed letter 1- to 3-grams of the whole lower-cased text, square-rooted and scaled to unit length.
Families are told apart by one-versus-rest linear SVMs, the languages of the winning family by one SVM for each
pair, with votes and margins. Languages without an entry in `FAMILIES` form a family of their own.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import free_name, id_bucket, sampled

#: Public classification of languages, by ISO 639-1 code; fixed values.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
DIMS = 2048
_LETTER = regex.compile(r"\p{L}")
_BLOCK = 1 << 17
UNKNOWN = "und"


def counts(text: str) -> np.ndarray:
    """DIMS counts of hashed letter n-grams; other characters count as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(DIMS)
    for at in range(0, len(c), _BLOCK):
        x = c[max(0, at - 2):at + _BLOCK].astype(np.uint32)
        new = min(at, 2)
        x = np.where((x < 65) | ((x > 90) & (x < 97)) | ((x > 122) & (x < 170)) | ((x > 0x2000) & (x < 0x2C00)), np.uint32(32), x)
        with np.errstate(over="ignore"):
            one = x * np.uint32(2654435761)
            two = one[1:] ^ (x[:-1] * np.uint32(2246822519))
            three = two[1:] ^ (x[:-2] * np.uint32(3266489917))
        for h, size in ((one, 1), (two, 2), (three, 3)):
            h = h[max(0, new - size + 1):]
            out += np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(DIMS), minlength=DIMS)
    return out


def vector(text: str | None) -> np.ndarray:
    v = np.sqrt(counts(text or ""))
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 200.0, steps: int = 200) -> np.ndarray:
    """Squared-hinge linear SVM by Nesterov's gradient method, classes weighted alike; y is +1 or -1; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, cost / 2 / max(1, (y > 0).sum()), cost / 2 / max(1, (y < 0).sum())).astype(np.float32)
    w = last = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1 / (1 + 4 * weight.sum()))  # rows have squared length 2 at most
    for t in range(1, steps + 1):
        look = w + np.float32((t - 1) / (t + 2)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ look)).astype(np.float32)
        last, w = w, look - rate * (look - 2 * x.T @ (weight * slack * y).astype(np.float32))
    return w


def fit(x: np.ndarray, langs: list[str]) -> dict:
    lang = np.array(langs)
    names = sorted(set(langs))
    family = np.array([_FAMILY_OF.get(a, a) for a in langs])
    members = {f: [a for a in names if _FAMILY_OF.get(a, a) == f] for f in sorted(set(family))}
    one_rest = {f: linear_svm(x, np.where(family == f, 1, -1)) for f in members} if len(members) > 1 else {}
    pairs = {}
    for inside in members.values():
        for a, b in itertools.combinations(inside, 2):
            m = (lang == a) | (lang == b)
            pairs[a, b] = linear_svm(x[m], np.where(lang[m] == a, 1, -1))
    return {"members": members, "family": one_rest, "pairs": pairs}


def _sure(w: np.ndarray, v: np.ndarray) -> float:
    """Margin as a number between 0 and 1."""
    return float(1 / (1 + np.exp(-4 * np.clip(v @ w[:-1] + w[-1], -8, 8))))


def predict(model: dict, v: np.ndarray) -> tuple[str, float]:
    """(language, score): the family of the largest margin, then the language of most votes; ties by mean margin, then by name.

    The score is the family's margin times the mean margin of the language's own pairs, each between 0 and 1."""
    margin = {f: _sure(w, v) for f, w in model["family"].items()}
    best = max(sorted(margin), key=margin.get) if margin else next(iter(model["members"]))
    won = {a: [] for a in model["members"][best]}
    for a, b in itertools.combinations(model["members"][best], 2):
        p = _sure(model["pairs"][a, b], v)
        won[a].append(p)
        won[b].append(1 - p)
    lang = max(won, key=lambda a: (sum(p > 0.5 for p in won[a]), sum(won[a])))
    return lang, float(margin.get(best, 1.0) * (np.mean(won[lang]) if won[lang] else 1.0))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 3, held: int = 1,
          per_lang: int = 1500) -> dict | None:
    """Fit on at most per_lang texts of each language outside the held-out fold (a bounded sample, chosen by a hash of the id).

    Null languages, null ids and texts without a letter are never learned; an id that repeats counts as often as the sample holds it. None if nothing is left to learn from.
    The sample and the model grow with the number of languages, the corpus adds nothing to them.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where(
        "_id is not null and _lang is not null and _text is not null").where(id_bucket("_id", fold) != held)
    rows = rows.where(F.col("_text").rlike("\\p{L}"))

    @F.pandas_udf("binary")
    def vec(text: pd.Series) -> pd.Series:
        return pd.Series([vector(t).tobytes() for t in text])

    got = sampled(rows, per_lang, 11, by=("_lang",)).select("_id", "_lang", vec("_text").alias("v")).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r._lang, r._id, bytes(r.v)))
    return fit(np.stack([np.frombuffer(r.v, np.float32) for r in got]), [r._lang for r in got])


def with_language(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs plus lang_pred and score, over whole texts; `und` with score 0 for null texts, texts without a letter (category L), and without a model.

    Each row is predicted by its text alone, so repeated rows and ids get equal answers. An empty table gives an empty result; input columns of the two names are replaced.
    """

    @F.pandas_udf("struct<l:string,s:double>")
    def p(text: pd.Series) -> pd.DataFrame:
        out = [(UNKNOWN, 0.0) if model is None or not t or not _LETTER.search(t) else predict(model, vector(t)) for t in text]
        return pd.DataFrame(out, columns=["l", "s"])

    x = free_name(docs, "_p")
    return docs.withColumn(x, p(F.col(text_col))).withColumn("lang_pred", F.col(f"{x}.l")).withColumn("score", F.col(f"{x}.s")).drop(x)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs)
    held = F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(True))
    return with_language(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
