"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation over the counts of all vote patterns
(at most 3 ** rules of them, whatever the corpus) estimates each rule's accuracies and the share of good documents
among those that pass the base rule, as only these are the method's to judge. No rule restates the base rule (length,
repeated windows), so the posterior probability of being good says something that the base rule does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import written

WHITE = "[\\x20\\x09-\\x0D]+"
SIGNS = "!-@\\[-`{-~"  # digits and punctuation of ASCII
ODD = "[#$%&*+/<=>@\\\\^_`{|}~][^\\x20\\x09-\\x0D]*"  # one match for each word with such a character
LEAST_WORDS, MOST_REPEATED = 50, 50
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus the base columns and what the rules need (n_lines, n_distinct, n_upper, n_marks, n_signs, n_odd), over whole texts; null texts count as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(t, WHITE), "")
    df = docs.withColumn("_w", words).withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("_h", F.when(F.size("_w") >= 3, F.transform(
        F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    # positions of windows found twice or more: equal neighbours after sorting by (hash, position)
    s = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), s))
    twice = F.filter("_s", lambda x, k: (x["h"] == F.get("_s", k + 1)["h"]) | (x["h"] == F.get("_s", k - 1)["h"]))
    df = df.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_p", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(
        p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    n = F.size("_w")
    return df.withColumn("n_words", n.cast("long")).withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long")).withColumn(
        "n_symbols", (F.size(F.split(t, "[#*$%&|<>]", -1)) - 1).cast("long")).withColumn(
        "n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).withColumn(
        "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).withColumn("n_lines", F.size("_l").cast("long")).withColumn(
        "n_upper", F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long")).withColumn(
        "n_marks", (F.size(F.split(t, "[!?]", -1)) - 1).cast("long")).withColumn("n_distinct", F.size(F.array_distinct("_w")).cast("long")).withColumn(
        "n_signs", F.length(F.regexp_replace(t, f"[^{SIGNS}]+", "")).cast("long")).withColumn("n_odd", F.regexp_count(t, F.lit(ODD)).cast("long")).drop("_w", "_l", "_h", "_s", "_p")


#: rule -> (votes bad, votes good, else it abstains), read by Spark and DuckDB alike. Shares are compared as products, so an empty text never divides by zero.
RULES = {
    "few_symbols": ("100 * n_symbols > 20 * n_words", "100 * n_symbols <= 4 * n_words"),
    "few_signs": ("100 * n_signs > 15 * word_chars", "100 * n_signs <= 8 * word_chars"),
    "plain_words": ("100 * n_odd > 25 * n_words", "100 * n_odd <= 10 * n_words"),
    "varied_words": ("100 * n_distinct < 25 * n_words", "100 * n_distinct >= 40 * n_words"),
    "fresh_lines": ("100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines <= 10 * n_lines"),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 4 * n_words AND 9 * n_words"),
    "mixed_case": ("100 * n_upper > 40 * word_chars", "100 * n_upper <= 15 * word_chars"),
    "calm_marks": ("100 * n_marks > 30 * n_words", "100 * n_marks <= 5 * n_words"),
}
FAILED = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"
SMOOTH, PRIOR, ROUNDS = 0.5, 0.8, 200


def votes() -> dict[str, Column]:
    """Rule -> vote."""
    return {k: F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for k, (bad, good) in RULES.items()}


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(share of good, for each rule {vote: (P(vote | good), P(vote | bad))}) by expectation-maximisation, from the votes' majority.

    Counts of either class are smoothed alike, so no probability is 0; patterns of no document at all leave the prior and even tables.
    """
    rules = len(patterns[0][0]) if patterns else 0
    q = {v: 1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in patterns}
    share, table = prior, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        good = sum(n * q[v] for v, n in patterns)
        last, share = share, (good + prior) / (total + 1)
        table = []
        for r in range(rules):
            row = {}
            for vote in (-1, 0, 1):
                g = sum(n * q[v] for v, n in patterns if v[r] == vote)
                b = sum(n * (1 - q[v]) for v, n in patterns if v[r] == vote)
                row[vote] = ((g + SMOOTH) / (good + 3 * SMOOTH), (b + SMOOTH) / (total - good + 3 * SMOOTH))
            table.append(row)
        q = {v: posterior(v, share, table) for v, _ in patterns}
        if abs(last - share) < 1e-9:
            break
    return share, table


def posterior(vote: tuple[int, ...], share: float, table: list) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for v, t in zip(vote, table, strict=True))
    return 1 / (1 + math.exp(min(max(-odds, -500.0), 500.0)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base columns, base_failed, posterior (probability of being good) and kept.

    kept: not base_failed and posterior >= 0.5. The posterior is estimated on every row that passes the base rule. Null
    and empty texts have no word, so they fail. Null and repeated ids are rows of their own; extra columns are not
    carried; an empty table gives an empty result.
    """
    rules = votes()
    found = written(measured(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text").drop("_text"), "rules")
    voted = found.withColumn("base_failed", F.expr(FAILED)).withColumns({f"_v_{k}": v for k, v in rules.items()})
    names = [f"_v_{k}" for k in rules]
    rows = voted.groupBy(*names).agg(F.count_if(~F.col("base_failed")).alias("n")).collect()  # at most 3 ** rules rows
    patterns = sorted((tuple(r[k] for k in names), r.n) for r in rows)
    share, table = estimate(patterns)
    odds = F.lit(math.log(share / (1 - share)))
    for k, t in zip(names, table, strict=False):
        odds = odds + F.when(F.col(k) < 0, math.log(t[-1][0] / t[-1][1])).when(F.col(k) > 0, math.log(t[1][0] / t[1][1])).otherwise(math.log(t[0][0] / t[0][1]))
    out = voted.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.select(F.col("_id").alias(id_col), *BASE_COLUMNS, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")


def query(spark, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("posterior", F.round("posterior", 6))


def _sql() -> str:
    names = ", ".join(RULES)
    cast = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {k}" for k, (bad, good) in RULES.items())
    odds = " + ".join(f"ln((g_{k} + {SMOOTH}e0) / (good + {3 * SMOOTH}e0) / ((b_{k} + {SMOOTH}e0) / (total - good + {3 * SMOOTH}e0)))" for k in RULES)
    sums = ", ".join(f"sum(n * q) OVER (PARTITION BY {k}) AS g_{k}, sum(n * (1 - q)) OVER (PARTITION BY {k}) AS b_{k}" for k in RULES)
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
u AS (SELECT r, unnest(w) AS a, unnest(range(len(w))) AS i FROM s),
v AS (SELECT r, i, [a, lead(a) OVER o, lead(a, 2) OVER o] AS x FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i FROM (SELECT r, i, x, count(*) OVER (PARTITION BY r, x) AS n FROM v WHERE x[3] IS NOT NULL) WHERE n > 1),
y AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT s.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             coalesce(y.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_marks,
             len(list_distinct(w)) AS n_distinct, length(regexp_replace(t, '[^{SIGNS}]+', '', 'g')) AS n_signs, len(regexp_extract_all(t, '{ODD}')) AS n_odd
      FROM s LEFT JOIN y USING (r)),
c AS (SELECT *, {FAILED} AS base_failed, {cast} FROM m),
e AS (SELECT 0 AS turn, false AS done, {PRIOR}e0 AS share, {names}, CAST(count(*) FILTER (NOT base_failed) AS DOUBLE) AS n, 1 / (1 + exp(-2.0e0 * ({" + ".join(RULES)}))) AS q FROM c GROUP BY {names}
      UNION ALL
      SELECT turn + 1, abs(share - new) < 1e-9, new, {names}, n, 1 / (1 + exp(-(ln(new / (1 - new)) + {odds})))
      FROM (SELECT *, (good + {PRIOR}e0) / (total + 1) AS new FROM (SELECT *, sum(n * q) OVER () AS good, sum(n) OVER () AS total, {sums} FROM e WHERE NOT done AND turn < {ROUNDS})))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept, round(q, 6) AS posterior
FROM c JOIN (SELECT {names}, q FROM e WHERE turn = (SELECT max(turn) FROM e)) USING ({names})"""


SQL = _sql()
