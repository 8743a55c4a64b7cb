"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are reported wherever they match. Parts that mean little alone (key identifiers, bare 40-character
secrets, endpoints) are weak candidates: an interval join over each document reports one only if parts that
complement it lie within its scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import written

WHITE = "\\x20\\x09-\\x0D"
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: Weak kinds: a key or account identifier, a bare secret of 40 characters, an endpoint.
KEY_ID = "(?i:client_?id|access_?key_?id|key_?id|account|username|user|login)[\"']?\\x20{0,8}[:=]\\x20{0,8}[\"']?[A-Za-z0-9._@-]{4,128}"
BARE = "(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = f"(?:https?|jdbc:[a-z0-9]{{1,32}}|postgres|mysql|mongodb|redis|amqp|s3)://[^{WHITE}\"'<>]{{3,512}}"
#: In the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "key_id", "bare_secret", "endpoint"]
BASE, WEAK = KINDS[:3], KINDS[3:]
IDENTIFIERS, SECRETS = ["access", "key_id"], ["assign", "hex", "bare_secret"]
SCOPE = 200
CHUNK = 256

_SPAN = "array<struct<start:bigint,end:bigint,kind:int>>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_chunks(items: Column, kind: str, inner) -> Column:
    """struct(at, outs) of a fold over non-empty items in chunks: inner(chunk, at) gives struct(at, out of type `kind`).

    Appending to an array copies it, so one fold over n items would cost n squared; a chunk's array is short, and only one entry for each chunk is carried on."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("outs"))

    def whole(p):
        def add(acc, c):
            return _let(inner(F.slice(p, c * CHUNK + 1, F.lit(CHUNK)), acc["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), zero, add)

    return _let(items, whole)


def spans(text: Column, pattern: str, kind: int, valid=None) -> Column:
    """Leftmost non-overlapping matches as (start, end, kind) in code points: the pieces between matches give the offsets."""
    found, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(acc, pair):
        s = acc["at"] + F.length(pair["gap"])
        e = s + F.length(pair["m"])
        one = F.array(F.struct(s.alias("start"), e.alias("end"), F.lit(kind).alias("kind"))).cast(_SPAN)
        more = F.concat(acc["out"], one)
        return F.struct(e.cast("bigint").alias("at"), (F.when(valid(pair["m"]), more).otherwise(acc["out"]) if valid else more).alias("out"))

    def inner(chunk, at):
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step)

    pairs = _let(found, lambda f: F.arrays_zip(F.slice(rest, F.lit(1), F.size(f)).alias("gap"), f.alias("m")))
    return F.when(text.rlike(pattern), F.flatten(in_chunks(pairs, _SPAN, inner)["outs"])).otherwise(F.array().cast(_SPAN))


def _listed(found: Column) -> Column:
    """`kind:start:end` joined by commas, by start and then kind."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus `base` and `weak`: spans of the base kinds and of the weak candidates; null texts have none."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(spans(t, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8), spans(t, ACCESS, 1), spans(t, HEX, 2))
    weak = F.concat(spans(t, KEY_ID, 3), spans(t, BARE, 4), spans(t, ENDPOINT, 5))
    return docs.withColumn("base", base).withColumn("weak", weak)


def linked(found: DataFrame, row: str, scope: int = SCOPE) -> DataFrame:
    """(row, linked): weak candidates with complementary parts whose starts lie within `scope` code points.

    An identifier needs a secret in scope, a bare secret an identifier or an endpoint, an endpoint both. Only documents
    with a weak candidate take part; each document's parts are swept once in order, so their number squared never is.
    """
    parts = found.where(F.size("weak") > 0).select(row, F.explode(F.concat("base", "weak")).alias("s")).select(row, "s.start", "s.end", "s.kind")
    near = Window.partitionBy(row).orderBy("start").rangeBetween(-scope, scope)
    has = {n: F.max(F.col("kind").isin([KINDS.index(k) for k in ks]).cast("int")).over(near) == 1 for n, ks in
           (("ids", IDENTIFIERS), ("secrets", SECRETS), ("ends", ["endpoint"]))}
    parts = parts.select(row, "start", "end", "kind", *[c.alias(n) for n, c in has.items()])
    k = {n: F.col("kind") == KINDS.index(n) for n in WEAK}
    ok = (k["key_id"] & F.col("secrets")) | (k["bare_secret"] & (F.col("ids") | F.col("ends"))) | (k["endpoint"] & F.col("ids") & F.col("secrets"))
    return parts.where(ok).groupBy(row).agg(F.collect_list(F.struct("start", "end", "kind")).cast(_SPAN).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: id, base and linked spans (start, end, kind as an index into KINDS), over whole texts.

    Null and empty texts have no span; null and repeated ids are rows of their own. Extra columns are not carried.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = written(candidates(rows, "_text").select(F.monotonically_increasing_id().alias("_row"), "_id", "base", "weak"), "secrets")
    out = found.join(linked(found, "_row", scope), "_row", "left")
    return out.select(F.col("_id").alias(id_col), "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """docs with every reported span of the text replaced by `mask`; overlapping spans are replaced together.

    Other columns stay as they are, whatever their names; null texts stay null; null and repeated ids are rows of their own, as rows are
    told apart by a number of their own. Rows without a weak candidate need no link and are masked where they lie;
    only the others' texts meet their links by a join. An empty table gives an empty result."""
    rows = candidates(docs.select(F.struct("*").alias("_doc")), f"_doc.`{text_col}`").withColumn("_row", F.monotonically_increasing_id())
    found = written(rows, "secrets")
    cut = linked(found, "_row", scope)
    spans_of = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN))))
    alone = found.where(F.size("weak") == 0).select("_doc", F.array_sort("base").alias("_cut"))
    others = found.where(F.size("weak") > 0).join(cut, "_row", "left").select("_doc", spans_of.alias("_cut"))
    both = alone.unionByName(others)
    t = F.col(f"_doc.`{text_col}`")

    def inner(chunk, origin):
        return _let(t.substr(origin + 1, F.array_max(F.transform(chunk, lambda s: s["end"])) - origin), lambda block: masked(chunk, origin, block))

    def masked(chunk, origin, block):
        def step(acc, s):
            gap = F.when(s["start"] >= acc["at"], F.concat(block.substr(acc["at"] - origin + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

        return F.aggregate(chunk, F.struct(origin.alias("at"), F.lit("").alias("out")), step)

    done = _let(in_chunks(F.col("_cut"), "string", inner), lambda a: F.concat(F.array_join(a["outs"], ""), t.substr(a["at"] + 1, F.length(t).cast("bigint"))))
    return both.withColumn("_done", F.when(F.size("_cut") > 0, done).otherwise(t)).select(
        *[F.col("_done").alias(c) if c == text_col else F.col(f"_doc.`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    n = {k: count(i) for i, k in enumerate(BASE)}
    return scan(docs).select("doc_id", *[c.alias(f"n_{k}") for k, c in n.items()], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                             _listed(F.concat("base", "linked")).alias("spans"))


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: kind -> (pattern of the matches, condition on a match m) in the regular expressions of DuckDB, which lack look-around: a bare
#: secret is a whole run of the letters that may not stand beside one.
_SQL_KINDS = {
    "assign": ("(" + _either_case("password|passwd|secret|token|api_?key") + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "length(regexp_extract(m, {p}, 2)) >= 8"),
    "access": ("AKIA[A-Z0-9]+", "length(m) >= 16"),
    "hex": ("[0-9a-f]+", "length(m) >= 32"),
    "key_id": ("(?:" + _either_case("client_?id|access_?key_?id|key_?id|account|username|user|login") + ")[\"']?\\x20{0,8}[:=]\\x20{0,8}[\"']?[A-Za-z0-9._@-]{4,128}", "true"),
    "bare_secret": ("[A-Za-z0-9+/=_-]+", "length(m) = 40 AND NOT regexp_matches(m, '[=_-]')"),
    "endpoint": ("(?:https?|jdbc:[a-z0-9]{1,32}|postgres|mysql|mongodb|redis|amqp|s3)://[^\\x20\\x09-\\x0D\"'<>]{3,512}", "true"),
}


def _sql() -> str:
    found = []
    for k, (pattern, valid) in _SQL_KINDS.items():
        p = "'" + pattern.replace("'", "''") + "'"
        found.append(f"""SELECT r, {KINDS.index(k)} AS k, pos AS start, pos + length(m) AS "end" FROM (
    SELECT r, m, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS pos FROM (
        SELECT r, unnest(regexp_extract_all(t, {p})) AS m, unnest(string_split_regex(t, {p})) AS gap, unnest(range(len(string_split_regex(t, {p})))) AS i FROM d)
    WHERE m IS NOT NULL WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE {valid.format(p=p)}""")
    near = "OVER (PARTITION BY r ORDER BY start RANGE BETWEEN {0} PRECEDING AND {0} FOLLOWING)".format(SCOPE)

    def has(kinds: list[str]) -> str:
        return f"bool_or(k IN ({', '.join(str(KINDS.index(x)) for x in kinds)})) {near}"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(found)}),
n AS (SELECT *, {has(IDENTIFIERS)} AS ids, {has(SECRETS)} AS secrets, {has(["endpoint"])} AS ends FROM s),
o AS (SELECT r, k, start, list_extract({KINDS!r}, k + 1) || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT) AS x FROM n
      WHERE k < 3 OR k = 3 AND secrets OR k = 4 AND (ids OR ends) OR k = 5 AND ids AND secrets)
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(x, ',' ORDER BY start, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY start, k), '') AS spans
FROM d LEFT JOIN o USING (r) GROUP BY d.r, doc_id"""


SQL = _sql()
