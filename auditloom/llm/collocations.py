"""Phrase collocations on counting quotient filters.

Tasks count the phrases of bounded chunks of text under word numbers of their own, so a word travels once a chunk. Words found
often enough to be part of a candidate get numbers over the corpus. A phrase is then its packed word numbers, which an invertible mixing
permutes; the high bits (quotient) name a slot, the low bits (remainder) are kept in full, so the sorted filter of
(quotient, remainder, count) is lossless: its phrases are read back by the inverse. Filters are cut by quotient and merged as
sorted lists, shard by shard; quotients are spread evenly whatever the language, and a frequent phrase has one entry a filter.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import ranked, spread_join, written

WORDS = 3  # longest phrase
LEAST, TOP, SHARE = 10, 2000, 50
CHUNK = 1 << 18  # words of a chunk: its row is about 1 MB, and its few words beside its many occurrences keep what travels small
ENTRIES = 1 << 18  # entries of a merged filter, about
GATHER = 1 << 20  # entries that a task gathers before it cuts them up, about
STEP = 10  # bits by which a round cuts filters at most
MILLION = 1_000_000

_STOPS = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r", b" " + b"\n" * 10)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lower-cased, and b"\\n" between pieces."""
    return list(filter(None, text.lower().translate(_STOPS).replace(b"\n", b" \n ").split(b" ")))


def width(words: int) -> str:
    """How local word numbers up to `words` are stored."""
    return "<u2" if words < 1 << 16 else "<u4"


class Chunk:
    """Word numbers (from 1) and the sequence of a chunk; 0 ends a piece."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.parts: list[np.ndarray] = []
        self.size, self.tail = 0, 0

    def add(self, lang: str, words: list[bytes], begins: int) -> None:
        """Words of a text; phrases begin at the first `begins` of them only, which are fewer than all in the last part only."""
        put, own = self.numbers, {b"\n": 0}
        get = own.get
        ids = np.zeros(len(words) + 1, np.uint32)
        for i, w in enumerate(words):
            n = get(w)
            if n is None:
                n = own[w] = put.setdefault((lang, w), len(put) + 1)
            ids[i] = n
        self.parts.append(ids)
        self.size += begins
        self.tail = len(words) - begins + 1

    def row(self) -> dict:
        """The chunk's words with their counts, and its sequence; its last `tail` entries begin nothing."""
        ids = np.concatenate(self.parts)
        n = np.bincount(ids[:len(ids) - self.tail], minlength=len(self.numbers) + 1)[1:]
        return {"lang": [k[0] for k in self.numbers], "word": [k[1] for k in self.numbers], "n": n.tolist(), "ids": ids.astype(width(len(n))).tobytes(), "size": len(ids), "tail": self.tail}


_CHUNK = pa.schema([("lang", pa.list_(pa.string())), ("word", pa.list_(pa.binary())), ("n", pa.list_(pa.int64())), ("ids", pa.binary()), ("size", pa.int32()), ("tail", pa.int32())])


def chunks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = CHUNK) -> DataFrame:
    """One row a chunk of about `size` words: its (lang, word, n) as arrays, and its texts as local word numbers.

    A text longer than a chunk goes to several; what begins in one of them is read on beyond its end, so nothing is lost or counted twice."""
    if not 0 < size <= CHUNK:
        raise ValueError(f"a chunk holds 1 to {CHUNK} words")
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        chunk = Chunk()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = tokens(text.as_py() or b"")
                at = 0
                while at < len(words):
                    n = min(len(words) - at, size - chunk.size)
                    chunk.add(lang, list(islice(words, at, at + n + WORDS - 1)), n)
                    at += n
                    if chunk.size >= size:
                        yield pa.RecordBatch.from_pylist([chunk.row()], _CHUNK)
                        chunk = Chunk()
        if chunk.size:
            yield pa.RecordBatch.from_pylist([chunk.row()], _CHUNK)

    return rows.mapInArrow(run, "lang array<string>, word array<binary>, n array<bigint>, ids binary, size int, tail int")


# Packed phrases: word numbers of `bits` bits each as (high, low), with all words but the last in high. The mixing is a
# three-round Feistel network over the two, so it is its own inverse read backwards.

def _mixed(x: np.ndarray, bits: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(64 - bits)


def permuted(high: np.ndarray, low: np.ndarray, words: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    wide = bits * (words - 1)
    high = high ^ _mixed(low, wide, 1)
    low = low ^ _mixed(high, bits, 2)
    return high ^ _mixed(low, wide, 3), low


def restored(high: np.ndarray, low: np.ndarray, words: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    wide = bits * (words - 1)
    high = high ^ _mixed(low, wide, 3)
    low = low ^ _mixed(high, bits, 2)
    return high ^ _mixed(low, wide, 1), low


_BLOCK = 1 << 14  # values unpacked at once


def _bits_of(values: np.ndarray, width: int) -> bytes:
    """Whole numbers of `width` bits each, one after the other."""
    if not width:
        return b""
    shifts = np.arange(width, dtype=np.uint64)
    parts = (values[at:at + _BLOCK] for at in range(0, len(values), _BLOCK))
    return b"".join(np.packbits((v[:, None] >> shifts & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes() for v in parts)


def _of_bits(data: bytes, n: int, width: int) -> np.ndarray:
    out, shifts = np.zeros(n, np.uint64), np.arange(width, dtype=np.uint64)
    for at in range(0, n if width else 0, _BLOCK):
        m = min(_BLOCK, n - at)
        got = np.unpackbits(np.frombuffer(data, np.uint8, offset=at * width // 8, count=-(-m * width // 8)), count=m * width, bitorder="little")
        out[at:at + m] = (got.reshape(m, width).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
    return out


class Filter:
    """Counting quotient filter in rest: for each quotient the length of its run, then the runs' remainders in order, in full, then their counts.

    Quotients are the `q` high bits of the permuted `high`; the remainder is its other bits and `low`. Counts take one byte each, and
    those of 255 and more follow in eight bytes."""

    @staticmethod
    def dump(high: np.ndarray, low: np.ndarray, count: np.ndarray, words: int, bits: int, base: int, cut: int) -> bytes:
        """Of sorted entries whose `cut` high bits are all `base`."""
        wide, n = bits * (words - 1), len(high)
        q = min(wide - cut, max(0, int(n).bit_length() - 1))
        rest = np.uint64(wide - cut - q)
        inner = high - (np.uint64(base) << np.uint64(wide - cut)) if cut else high
        runs = np.bincount((inner >> rest).astype(np.int64), minlength=1 << q).astype(np.uint32)
        wide_run = max(1, int(runs.max(initial=0)).bit_length())
        small = np.minimum(count, 255).astype(np.uint8)
        head = np.array([n, q, wide_run], "<u4").tobytes()
        parts = [_bits_of(runs, wide_run), _bits_of(inner & ((np.uint64(1) << rest) - np.uint64(1)), int(rest)), _bits_of(low, bits), small.tobytes(), count[count >= 255].astype("<u8").tobytes()]
        return head + np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)

    @staticmethod
    def load(data: bytes, words: int, bits: int, base: int, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide = bits * (words - 1)
        n, q, wide_run, *sizes = np.frombuffer(data, "<u4", 8).tolist()
        ends = np.cumsum([32, *sizes])
        runs, rest, low, small, large = (data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        quotient = np.repeat(np.arange(1 << q, dtype=np.uint64), _of_bits(runs, 1 << q, wide_run).astype(np.int64))
        width = wide - cut - q
        high = (quotient << np.uint64(width)) | _of_bits(rest, n, width)
        if cut:
            high |= np.uint64(base) << np.uint64(wide - cut)
        count = np.frombuffer(small, np.uint8).astype(np.uint64)
        count[count == 255] = np.frombuffer(large, "<u8")
        return high, _of_bits(low, n, bits), count


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], low_bits: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted entries of several filters as one: counts of equal entries are added."""
    high, low, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(high):
        return high, low, count
    order = np.argsort(high << np.uint64(low_bits) | low) if bits <= 64 else np.lexsort((low, high))
    high, low, count = high[order], low[order], count[order]
    first = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    return high[first], low[first], np.add.reduceat(count, np.flatnonzero(first))


_FILTER = pa.schema([("words", pa.int32()), ("base", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])
_FILTER_DDL = "words int, base bigint, shard bigint, data binary"


def cut_up(entries: tuple[np.ndarray, np.ndarray, np.ndarray], words: int, bits: int, cut: int, shard: int) -> list[dict]:
    """The filters of sorted entries, one for each value of their `cut` high bits."""
    high, low, count = entries
    base = high >> np.uint64(bits * (words - 1) - cut)
    out, at = [], 0
    for end in np.flatnonzero(np.diff(base, append=np.uint64((1 << 64) - 1))) + 1:
        own, b = slice(at, end), int(base[at])
        out.append({"words": words, "base": b, "shard": shard, "data": Filter.dump(high[own], low[own], count[own], words, bits, b, cut)})
        at = end
    return out


def filters(found: DataFrame, numbers: DataFrame, bits: int, cuts: dict[int, int], gather: int = GATHER) -> DataFrame:
    """(words, base, shard, data): filters of the chunks' phrases of numbered words, cut by their high bits; a task gathers chunks first."""

    def flush(words: int, parts: list, shard: int):
        rows = cut_up(merged(parts, bits, bits * words), words, bits, cuts[words], shard)
        return pa.RecordBatch.from_pylist(rows, _FILTER)

    def run(batches):
        parts, held, shard = {k: [] for k in cuts}, dict.fromkeys(cuts, 0), 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                shard = r["chunk"]
                number = np.zeros(r["most"] + 1, np.uint64)  # of words that are never frequent enough: 0, as between pieces
                pairs = np.array(r["numbers"], np.int64)
                number[(pairs >> 40) + 1] = (pairs & ((1 << 40) - 1)).astype(np.uint64)
                ids = number[np.frombuffer(r["ids"], width(r["most"]))]
                each = [np.concatenate([ids[k:], np.zeros(k, np.uint64)])[:len(ids) - r["tail"]] for k in range(WORDS)]
                known = each[0] != 0
                for words in sorted(cuts):
                    known = known & (each[words - 1] != 0)
                    w = [e[known] - np.uint64(1) for e in each[:words]]
                    high, low = permuted(w[0] if words == 2 else w[0] << np.uint64(bits) | w[1], w[-1], words, bits)
                    parts[words].append((high, low, np.ones(len(high), np.uint64)))
                    held[words] += len(high)
                    if held[words] >= gather:
                        yield flush(words, parts[words], shard)
                        parts[words], held[words] = [], 0
        for words in cuts:
            if held[words]:
                yield flush(words, parts[words], shard)

    rows = found.join(numbers, "chunk").select("chunk", "most", "numbers", "ids", "tail")
    return rows.mapInArrow(run, _FILTER_DDL)


def merge_round(cut_filters: DataFrame, bits: int, cuts: dict[int, int], finer: dict[int, int], groups: dict[int, int]) -> DataFrame:
    """Filters of one range of quotients merged, in `groups` sets of shards apart, and cut up by the `finer` bits."""

    def run(key, pdf):
        words, base = int(key[0]), int(key[1])
        entries = merged([Filter.load(x, words, bits, base, cuts[words]) for x in pdf["data"]], bits, bits * words)
        return pd.DataFrame(cut_up(entries, words, bits, finer[words], int(key[2])), columns=["words", "base", "shard", "data"])

    n = F.when(F.col("words") == 2, groups[2]).otherwise(groups[3])
    return cut_filters.withColumn("shard", F.pmod(F.xxhash64("shard"), n.cast("long"))).groupBy("words", "base", "shard").applyInPandas(run, _FILTER_DDL)


def entries(merged_filters: DataFrame, bits: int, cuts: dict[int, int], least: int) -> DataFrame:
    """(words, w1, w2, w3, a): what the filters hold `least` times or more, as word numbers (w3 null for two words)."""

    def run(batches):
        for pdf in batches:
            for words, base, data in zip(pdf["words"], pdf["base"], pdf["data"], strict=True):
                high, low, count = Filter.load(data, words, bits, base, cuts[words])
                often = count >= least
                high, low = restored(high[often], low[often], words, bits)
                low = low.astype(np.int64)
                if words == 2:
                    w = [high.astype(np.int64), low, None]
                else:
                    w = [(high >> np.uint64(bits)).astype(np.int64), (high & np.uint64((1 << bits) - 1)).astype(np.int64), low]
                yield pd.DataFrame({"words": np.full(len(low), words, np.int32), "w1": w[0], "w2": w[1], "w3": pd.array(w[2] if words == 3 else [None] * len(low), "Int64"), "a": count[often].astype(np.int64)})

    return merged_filters.select("words", "base", "data").mapInPandas(run, "words int, w1 bigint, w2 bigint, w3 bigint, a bigint")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact while a is below 10 ** 16: a whole decimal division."""
    d = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", F.lit(MILLION).cast("decimal(38,0)") * d(a) * d(a), d(left) * d(right)).cast("long")


def top_of(df: DataFrame, by: str, order: list[Column], most: int, salts: int = 32) -> DataFrame:
    """The first `most` rows of each `by`, with their rank: the firsts of salted parts, then the firsts of these, so no task meets all rows of a hot value."""
    part = Window.partitionBy(by, F.pmod(F.xxhash64(*df.columns), F.lit(salts))).orderBy(*order)
    near = df.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= most)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("_r")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, chunk: int = CHUNK, per_filter: int = ENTRIES, gather: int = GATHER, step: int = STEP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, n, number), phrases (words, w1, w2, w3, a) found `least` times or more, and (lang, n) of all words.

    Only words found `least` times have a number, as no phrase is found more often than its rarest word."""
    found = written(chunks(docs, text_col, lang_col, chunk).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    seen = found.select("chunk", F.posexplode(F.arrays_zip("lang", "word", "n")).alias("at", "x")).select("chunk", "at", "x.*")
    words = written(seen.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.count("*").alias("chunks")), "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    numbered = written(ranked(words.where(F.col("n") >= least), [], ["lang", "word"], "number"), "numbers")
    many = numbered.count()
    bits = max(8, int(many).bit_length())
    if bits > 32:
        raise ValueError(f"{many} frequent words do not fit in 32 bits")
    own = spread_join(seen.select("chunk", "at", "lang", "word"), numbered.select("lang", "word", "chunks", "number"), ["lang", "word"], "chunks").where("number is not null")
    pair = F.collect_list(F.shiftleft(F.col("at").cast("long"), 40) + F.col("number") + 1)  # at most a chunk's words, each with its number from 1
    numbers = own.groupBy("chunk").agg(pair.alias("numbers"))
    many_words = found.agg(F.sum("size").alias("n")).first()["n"] or 0  # a phrase of either length begins at each at most
    whole = min(bits, max(0, int(many_words / per_filter)).bit_length())
    cut = min(step, whole)
    now = filters(found.withColumn("most", F.size("word")), numbers, bits, {2: cut, 3: cut}, gather)
    while cut < whole:  # more ranges than a task should cut at once: sets of shards are merged and cut further, by `step` bits a round
        finer, groups = min(whole, cut + step), max(1, int(many_words / (per_filter << cut)))
        now = written(merge_round(now, bits, {2: cut, 3: cut}, {2: finer, 3: finer}, {2: groups, 3: groups}), "filters")
        cut = finer
    cuts = {2: cut, 3: cut}
    now = merge_round(now, bits, cuts, cuts, {2: 1, 3: 1})
    return numbered, written(entries(now, bits, cuts, least), "phrases"), total


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP, **sizes: int) -> DataFrame:
    """Each lang's first `top` phrases of two or three words: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty; a null lang is `und`. Counts cover whole texts, repeated rows included. A candidate is found `least`
    times or more; its lowest-scoring cut counts, the smallest on a tie. A candidate whose words lie in a longer one found at least share / 100 times as often goes.
    Ties of score go by a, then by the phrase in UTF-8 order. Extra columns play no part; an empty table gives an empty result. The number of
    frequent words must stay below 2 ** 32, else an error is raised.
    """
    words, phrases, total = phrase_counts(docs, text_col, lang_col, least, **sizes)
    two, three = phrases.where("words = 2").drop("w3"), phrases.where("words = 3")
    pair = lambda a, b, n: two.select(F.col("w1").alias(a), F.col("w2").alias(b), F.col("a").alias(n))
    longer = three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    kept = two.join(longer, ["w1", "w2"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", F.lit(None).cast("long").alias("l2"), F.lit(None).cast("long").alias("r1"))
    cut = three.drop("words").join(pair("w1", "w2", "l2"), ["w1", "w2"]).join(pair("w2", "w3", "r1"), ["w2", "w3"])
    rows = kept.unionByName(cut.select("w1", "w2", "w3", "a", "l2", "r1"))
    held = {}
    for w in ("w1", "w2", "w3"):  # words of many candidates are joined by broadcast, others are shuffled
        n = rows.where(F.col(w).isNotNull()).groupBy(w).agg(F.count("*").alias("_times"))
        facts = written(n.join(words.select(F.col("number").alias(w), F.struct("lang", "word", "n").alias(f"{w}_")), w), "facts")
        rows = spread_join(rows, facts, [w], "_times")
        held[w] = F.col(f"{w}_.n")
    last = F.coalesce(held["w3"], held["w2"])
    one = F.struct(score(F.col("a"), held["w1"], F.coalesce("r1", last)).alias("score"), F.lit(1).alias("k"), held["w1"].alias("l"), F.coalesce("r1", last).alias("r"))
    both = F.when(F.col("w3").isNotNull(), F.struct(score(F.col("a"), F.col("l2"), last).alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), last.alias("r")))
    text = F.concat_ws(" ", *[F.col(f"{w}_.word").cast("string") for w in ("w1", "w2", "w3")])
    scored = rows.select(F.col("w1_.lang").alias("lang"), text.alias("phrase"), "a", F.least(one, both).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    best = top_of(scored, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS s, unnest(range(len(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')))) AS k FROM t),
q AS (SELECT d, k, lang, list_filter(string_split_regex(s, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
u AS (SELECT d, k, lang, unnest(w) AS a, unnest(range(len(w))) AS i FROM q),
v AS (SELECT lang, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY d, k ORDER BY i)),
f1 AS (SELECT lang, a, CAST(count(*) AS HUGEINT) AS f FROM v GROUP BY ALL),
f2 AS (SELECT lang, a, b, CAST(count(*) AS HUGEINT) AS f FROM v WHERE b IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a, b, c, CAST(count(*) AS HUGEINT) AS f FROM v WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
m AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY ALL),
z AS (SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
        LEFT JOIN m ON m.lang = f2.lang AND m.a = f2.a AND m.b = f2.b WHERE f2.f >= {LEAST} AND (m.f IS NULL OR 100 * m.f < {SHARE} * f2.f)
      UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, x.f, y.f, 1 FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
      UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, x.f, y.f, 2 FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c),
s AS (SELECT *, {MILLION} * a * a // (l * r) AS score FROM z),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM g JOIN n USING (lang) WHERE rank <= {TOP}"""
