"""Hierarchical multi-length packing of tokenized documents.

Each document (its ids and one id 0) is cut into full windows of the longest context, which are sequences at once,
and a tail. Tails are routed to context tiers by length (the smallest tier that holds them), and dealt to groups of
bounded size. A group packs its tiers from the longest to the shortest: each window opens with the longest tail of
its tier, its gap is filled with the longest tails of any shorter tier that fit, and what gap is left takes the head
of one more tail, whose rest is routed anew. What remains at the end is cut into sequences of lengths that are powers of two, so no
sequence needs padding. Sequences of a tier are dealt to steps of equal token counts.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import written

TIERS = (1024, 512, 256)
STEP_TOKENS = 65_536
GROUP = 8_000  # pieces of a group, about; a group's memory is bounded by it
SPECIAL = "<|endoftext|>"

_encoders: dict[str, tuple] = {}


def encoder(json_path: str):
    """Encoder of whole texts with the ids of the `tokenizers` file at json_path, by its rank file beside it, about six times as fast.

    As `tokenizers` does by default, the special token's own string in a text becomes its one id."""
    if json_path not in _encoders:
        import public_tokenizers

        ranks = dict((base64.b64decode(a), int(b)) for a, b in map(bytes.split, open(json_path.removesuffix(".json") + ".tiktoken", "rb")))
        _encoders[json_path] = (tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)}),)
    enc = _encoders[json_path][0]
    return lambda text: enc.encode(text, allowed_special={SPECIAL}) if SPECIAL in text else enc.encode_ordinary(text)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


_CUT = "id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, tail binary"


def cut(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = TIERS[0]) -> DataFrame:
    """Pieces of each document: full windows of `size` with their checksum, and the rest as `tail` (ids as unsigned 32-bit integers)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    types = {"ids_crc32": "Int64"} | ({"id": "Int64"} if kind == "bigint" else {})

    def run(batches):
        encode = encoder(tokenizer)
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = np.array([*encode(text or ""), 0], np.uint32)
                i = None if pd.isna(i) else i
                full = len(ids) // size * size
                out += [(i, at, size, crc(ids[at:at + size]), len(ids), None) for at in range(0, full, size)]
                if full < len(ids):
                    out.append((i, full, len(ids) - full, None, len(ids), ids[full:].astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "tail"]).astype(types)

    return rows.mapInPandas(run, _CUT.format(kind=kind))


def pack_group(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Pack tails of one group: [(tier, [(index of tail, first token, tokens)])], every token once and every sequence full to a power of two."""
    pool: list[tuple[int, int, int]] = sorted((n, i, 0) for i, n in enumerate(lengths) if n)  # (left, tail, first token)
    out = []
    for tier in tiers:
        below = tier // 2 if tier != tiers[-1] else 0
        while pool and pool[-1][0] > below:
            if sum_at_least(pool, tier):
                seq, room = [], tier
                while room:
                    at = bisect_right(pool, (room, 1 << 62, 0)) - 1
                    if at < 0:  # nothing fits: the head of the shortest tail fills the gap, its rest stays
                        n, i, first = pool.pop(0)
                        seq.append((i, first, room))
                        insort(pool, (n - room, i, first + room))
                        room = 0
                    else:
                        n, i, first = pool.pop(at)
                        seq.append((i, first, n))
                        room -= n
                out.append((tier, seq))
            else:
                break
    # fewer tokens than one window of the last tier, or of a tier whose pieces are too long for the next: powers of two
    rest = [(i, first, n) for n, i, first in reversed(pool)]
    left = sum(n for _, _, n in rest)
    for bit in range(tiers[0].bit_length() - 1, -1, -1):
        size = 1 << bit
        while left >= size:
            seq, room = [], size
            while room:
                i, first, n = rest.pop(0)
                take = min(n, room)
                seq.append((i, first, take))
                if take < n:
                    rest.insert(0, (i, first + take, n - take))
                room -= take
            out.append((size, seq))
            left -= size
    return out


def sum_at_least(pool: list, size: int) -> bool:
    total = 0
    for n, _, _ in reversed(pool):
        total += n
        if total >= size:
            return True
    return False


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS,
           group: int = GROUP, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier and step.

    Null and empty texts are documents of the one id 0. Null and repeated ids are documents of their own. Texts are
    tokenized once; full windows and tails are written before they are dealt to groups, whose number follows the
    number of pieces, by a hash of their place, so a hot id or source changes nothing. Extra columns are not
    carried; an empty table gives an empty result. Sequence ids and steps are unique over all groups: a `step` is sequences of one
    tier of step_tokens tokens together, fewer only in the last step of a tier of a group.
    """
    pieces = written(cut(docs, tokenizer, id_col, text_col, tiers[0]).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    kind = pieces.schema["id"].dataType.simpleString()

    def run(key, pdf):
        g = int(key[0])
        pdf = pdf.sort_values("_row").reset_index(drop=True)
        whole, tails = pdf[pdf["tail"].isna()], pdf[pdf["tail"].notna()].reset_index(drop=True)
        rows, seqs = [], [(tiers[0], None, r) for r in whole.itertuples(index=False)]
        seqs += [(size, seq, None) for size, seq in pack_group(tails["length"].tolist(), tiers)]
        seqs.sort(key=lambda s: -s[0])
        step, spent, last = (g << 32) - 1, step_tokens, None
        for k, (size, seq, r) in enumerate(seqs):
            if size != last or spent >= step_tokens:
                step, spent, last = step + 1, 0, size
            spent += size
            sid, at = (g << 32) + k, 0
            if seq is None:
                rows.append((r.id, r.start, r.length, r.ids_crc32, r.doc_tokens, sid, 0, size, step))
                continue
            for i, first, take in seq:
                ids = np.frombuffer(tails["tail"][i], "<u4")[first:first + take]
                rows.append((tails["id"][i], tails["start"][i] + first, take, crc(ids), tails["doc_tokens"][i], sid, at, size, step))
                at += take
        out = pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"])
        return out.astype({"id": "Int64"}) if kind == "bigint" else out

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step bigint"
    return dealt.groupBy("_group").applyInPandas(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
