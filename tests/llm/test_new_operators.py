"""Operators 11 to 13: Merkle manifest, minimum bin slack, collocations; against plain versions, with odd tables."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditloom.llm import collocations, merkle, slackbins

sys.path.insert(0, "/opt/tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(d, n_chars):
    return h(*(field(v) for v in (d[0], d[3], d[2], n_chars, d[1])))


def tree(leaves):
    """(root, for each leaf its siblings with their side, level by level)."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            ways[i].append(None if other >= len(level) else (level[other], other < k))
            at[i] = k // 2
        level = [h(*level[k:k + 2]) for k in range(0, len(level), 2)]
    return level[0], ways


def folded(leaf, way):
    for step in way:
        leaf = h(leaf) if step is None else h(step[0], leaf) if step[1] else h(leaf, step[0])
    return leaf


def manifest(docs):
    by = {}
    for d in docs:
        by.setdefault(d[2], []).append(d)
    langs = sorted(by, key=lambda x: b"" if x is None else b"=" + x.encode())
    subs = {}
    for lang in langs:
        rows = sorted(by[lang], key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d, d[4])))
        subs[lang] = (rows, *tree([leaf_of(d, d[4]) for d in rows]))
    root, top = tree([subs[lang][1] for lang in langs])
    out = []
    for lang, up in zip(langs, top, strict=True):
        rows, sub, ways = subs[lang]
        for d, way in zip(rows, ways, strict=True):
            full = way + up
            bad = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[4] is not None
            end = folded(leaf_of(d, d[4] + 1 if bad else d[4]), full)
            out.append((d[0], leaf_of(d, d[4]), sub, root, h(*(s[0] for s in full if s)), end, end == root))
    return out


def odd_documents(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"text {i} ä", rng.choice(["en"] * 6 + ["de", "ß", ""]), rng.choice(["web", None]), rng.choice([None, i])) for i in range(n)]
    rows += [(None, None, None, None, None), (3, "again", "en", None, 5), (3, "again", "en", None, 5), (n + 5, "", None, "x", 0), (n + 6, "alone", "zz", "x", 5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, bits", [(1, 6), (40, 2), (300, 1), (300, 6), (700, 3)])
def test_merkle_against_plain_trees(spark, n, bits):
    docs = odd_documents(n)
    df = spark.createDataFrame(docs, DOC).withColumn("place", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("digest", F.lit(0)).repartition(5)
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = [tuple(r) for r in merkle.manifest(df, tampered={"n_chars": changed}, bits=bits).collect()]
    assert Counter(got) == Counter(manifest(docs))
    verified = [r[-1] for r in got]
    assert all(verified) if n == 1 else any(verified) and not all(verified)


def test_merkle_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], DOC)
    assert merkle.manifest(none).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "a", "en", None, 1)], DOC)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == hashlib.sha256(b"").hexdigest() and one.verified


def test_siblings_are_interval_differences(spark):
    """Of a tree of five leaves: the last leaf has none on two levels, and the rest of each parent is the sibling's interval."""
    leaves = spark.createDataFrame([("t", i, 5, bytes([i]) * 32) for i in range(5)], "tree string, place long, size long, digest binary")
    nodes = merkle.intervals(merkle.blocks(leaves, 3), 3)
    assert {(r.level, r.lo, r.hi) for r in nodes.collect()} == {*((0, i, i + 1) for i in range(5)), (1, 0, 2), (1, 2, 4), (1, 4, 5), (2, 0, 4), (2, 4, 5), (3, 0, 5)}
    beside = {(r.level, r.lo): r.side for r in merkle.siblings(nodes).collect()}
    assert beside[0, 4] == beside[1, 4] == merkle.NONE and beside[2, 4] == merkle.LEFT and beside[2, 0] == merkle.RIGHT and beside[0, 3] == merkle.LEFT and (3, 0) not in beside


def same_as_sql(spark, module, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = Counter(con.execute(module.SQL).fetchall())
    got = module.query(spark, SF)
    assert got.columns == [c[0] for c in con.description] and Counter(tuple(r) for r in got.collect()) == want, name


def test_queries_equal_their_sql(spark):
    same_as_sql(spark, merkle, "op11")
    same_as_sql(spark, collocations, "op13")


def test_fullest_combination_against_all_combinations():
    rng = random.Random(2)
    for _ in range(60):
        size = rng.randrange(6, 30)
        pieces = [rng.randrange(1, size) for _ in range(rng.randrange(1, 10))]
        have = slackbins.Lengths(Counter(pieces), size)
        sums = {sum(c) for k in range(1, len(pieces) + 1) for c in itertools.combinations(pieces, k) if sum(c) <= size}
        took = have.fullest(False)
        assert sum(have.lengths[i] * k for i, k in took) == max(sums) and all(k <= have.left[i] for i, k in took)
        longest = max(pieces)
        rest = list(pieces)
        rest.remove(longest)
        with_it = {longest + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if longest + sum(c) <= size}
        took = have.fullest(True)
        assert sum(have.lengths[i] * k for i, k in took) == max(with_it) and took[0][0] == len(have.lengths) - 1


def test_repeating_a_combination_is_bin_by_bin_planning():
    """Taking a combination for as long as its lengths last gives the bins that one search for each bin gives."""
    rng = random.Random(3)
    for longest in (False, True):
        counts = {n: rng.randrange(1, 9) for n in rng.sample(range(1, 40), 12)}
        have, slow = slackbins.Lengths(counts, 40), []
        while took := have.fullest(longest):
            slow.append(sorted((have.lengths[i], k) for i, k in took))
            have.remove(took, 1)
        have, fast = slackbins.Lengths(counts, 40), []
        while took := have.fullest(longest):
            times = min(have.left[i] // k for i, k in took)
            fast += [sorted((have.lengths[i], k) for i, k in took)] * times
            have.remove(took, times)
        assert fast == slow
    used = Counter()
    for times, took in slackbins.plan(counts, 40):
        for n, k in took:
            used[n] += times * k
    assert used == Counter(counts) and slackbins.plan({}, 40) == []


def test_slack_bins_hold_every_token_once(spark):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "word", "many words " * 90, "long " * 400, "<|endoftext|> x"] + [f"text {i} " * (i % 37) for i in range(120)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "no id", 7), (3, "same id", 7), (3, "same id", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)
    size = 64
    got = slackbins.packed(df, path, size=size).toPandas()
    slow = tokenizers.Tokenizer.from_file(path)
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % size or size
        for piece, start in enumerate([0, *range(first, len(ids), size)]):
            part = ids[start:first if piece == 0 else start + size]
            want[i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((None if pd.isna(a) else int(a), *map(int, b)) for a, *b in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"] == seq["length"].cumsum() - seq["length"]).all() and seq["length"].sum() <= size
    assert got["sequence_id"].nunique() == -(-got["length"].sum() // size)  # none fewer is possible
    assert slackbins.packed(df.limit(0), path).count() == 0


def phrases(docs, least=10, share=50, top=2000):
    words, n = Counter(), Counter()
    f = Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    rows = []
    for p, a in f.items():
        if len(p) < 3 or a < least:
            continue
        lang, w = p[0], p[1:]
        longer = [b for q, b in f.items() if len(q) > len(p) and q[0] == lang and b >= least and any(q[i:i + len(w)] == w for i in range(1, len(q)))]
        if any(100 * b >= share * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        s, _, left, right = min(cuts)
        rows.append((lang, " ".join(w), a, left, right, n[lang], s))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[-1], -r[2], r[1].encode()))[:top]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk": 7, "per_filter": 8, "gather": 5, "step": 2}])
def test_collocations_against_brute_force(spark, sizes):
    rng = random.Random(4)
    vocabulary = ["New", "york", "City", "of", "the", "é", "x\x00y", "naïve", "a-b", "\x1c"]
    docs = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]) for _ in range(rng.randrange(0, 90))), rng.choice(["en", "en", "en", "de", None]), None, i) for i in range(60)]
    docs += [(1, None, "en", None, None), (None, "", None, None, None), (2, "new york city " * 40, "fr", None, 1), (2, "new york city " * 40, "fr", None, 1), (5, "und so weiter " * 15, "und", None, 1)]
    df = spark.createDataFrame(docs, DOC).withColumn("word", F.lit("w")).withColumn("chunk", F.lit(1)).withColumn("n", F.lit(2))
    got = collocations.collocations(df.repartition(3), **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(phrases(docs))
    assert collocations.collocations(df.limit(0)).count() == 0


def test_quotient_filters_are_lossless_and_merge():
    rng = np.random.default_rng(5)
    for words, bits in ((2, 8), (3, 8), (3, 17), (3, 21), (2, 32), (3, 32)):
        wide = bits * (words - 1)
        high = rng.integers(0, 1 << min(wide, 63), 3000, dtype=np.uint64)
        low = rng.integers(0, 1 << bits, 3000, dtype=np.uint64)
        mixed = collocations.permuted(high, low, words, bits)
        assert all((a == b).all() for a, b in zip(collocations.restored(*mixed, words, bits), (high, low), strict=True))
        count = rng.integers(1, 1000, 3000).astype(np.uint64)
        whole = Counter()
        for a, b, c in zip(*mixed, count, strict=True):
            whole[int(a), int(b)] += int(c)
        parts = [collocations.merged([(mixed[0][k::3], mixed[1][k::3], count[k::3])], bits, bits * words) for k in range(3)]
        back = Counter()
        cut = 3
        rows = [r for k, p in enumerate(parts) for r in collocations.cut_up(p, words, bits, cut, k)]
        for base in {r["base"] for r in rows}:
            loaded = [collocations.Filter.load(r["data"], words, bits, base, cut) for r in rows if r["base"] == base]
            for a, b, c in zip(*collocations.merged(loaded, bits, bits * words), strict=True):
                assert (int(a), int(b)) not in back
                back[int(a), int(b)] = int(c)
        assert back == whole


def test_scores_beyond_64_bits(spark):
    a, left, right = 3_037_000_500, 9_000_000_000, 7_000_000_000
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * a * a // (left * right)
