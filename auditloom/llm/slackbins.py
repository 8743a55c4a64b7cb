"""Packing into as few sequences as possible by minimum bin slack.

Each document (its ids and one id 0) is one piece; a longer one than a sequence is cut into full pieces behind a first
piece that holds the remainder. Full pieces are sequences at once. The others matter by their length only, of which
there are fewer than `size`, so the bins are planned on the counts of the lengths, whatever the corpus: a bitset
subset-sum over the available lengths finds the fullest feasible combination, which is removed. The same combination
stays the fullest for as long as its lengths last, so it is taken for that many bins at once. Pieces then find their
place by their rank among the pieces of their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import written
from auditloom.llm.packing import crc, encoder

SIZE = 2048

#: A piece's place: its part (task that cut it) and its number among the pieces of its length there.
_CUT = "id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"


def cut(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Pieces of each document with their checksum and place; texts stay where they lie, and a piece carries no ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = np.array([*encode(text or ""), 0], np.uint32)
                ends = range(len(ids) % size or size, len(ids) + 1, size)
                for piece, end in enumerate(ends):
                    start = max(0, end - size) if piece else 0
                    out.append((None if pd.isna(i) else i, piece, start, end - start, crc(ids[start:end]), part, int(seen[end - start])))
                    seen[end - start] += 1
            pdf = pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", "part", "nth"])
            yield pdf.astype({"id": "Int64"}) if kind == "bigint" else pdf

    return rows.mapInPandas(run, _CUT.format(kind=kind))


class Lengths:
    """Available lengths with their counts, and for each the bitset of the sums that lengths up to it can make."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.lengths = size, sorted(n for n, c in counts.items() if c > 0)
        self.left = [counts[n] for n in self.lengths]
        self.sums = [1] * (len(self.lengths) + 1)  # sums[i]: what lengths[:i] can make; bit s stands for the sum s
        self._from(0)

    def _from(self, first: int) -> None:
        mask = (2 << self.size) - 1
        for i in range(first, len(self.lengths)):
            n, bits = self.lengths[i], self.sums[i]
            most, step = min(self.left[i], self.size // n), 1
            while most > 0:  # multiplicities by doubling
                take = min(step, most)
                bits |= (bits << n * take) & mask
                most, step = most - take, step * 2
            self.sums[i + 1] = bits

    def fullest(self, longest: bool) -> list[tuple[int, int]]:
        """[(index, number of pieces)] of the largest feasible sum, or of the largest that holds the longest piece left; among equal sums, that with the most of the longest lengths."""
        sums = self.sums[-1]
        if longest and self.lengths:
            n, sums = self.lengths[-1], 1
            for k in range(1, min(self.left[-1], self.size // n) + 1):
                sums |= self.sums[-2] << k * n
            sums &= (2 << self.size) - 1
        total, out = sums.bit_length() - 1, []
        for i in range(len(self.lengths) - 1, -1, -1):
            n = self.lengths[i]
            for k in range(min(self.left[i], total // n), -1, -1):
                if self.sums[i] >> (total - k * n) & 1:
                    break
            if k:
                out.append((i, k))
                total -= k * n
        return out

    def remove(self, taken: list[tuple[int, int]], times: int) -> None:
        low = len(self.lengths)
        for i, k in taken:
            had, most = self.left[i], self.size // self.lengths[i]
            self.left[i] -= k * times
            if min(had, most) != min(self.left[i], most):
                low = min(low, i)
        while self.left and not self.left[-1]:
            self.lengths.pop(), self.left.pop(), self.sums.pop()
        self._from(low)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, pieces in each)])]: every piece in one bin, bin after bin the fullest feasible combination.

    Planned twice, with any combination and with those that hold the longest piece left; the plan with fewer bins counts, the first on a tie."""
    plans = []
    for longest in (False, True):
        have, out = Lengths(counts, size), []
        while taken := have.fullest(longest):
            times = min(have.left[i] // k for i, k in taken)
            out.append((times, [(have.lengths[i], k) for i, k in taken]))
            have.remove(taken, times)
        plans.append(out)
    return min(plans, key=lambda p: sum(times for times, _ in p))


def slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, pieces in each bin, first sequence, offset of the first), sorted: where the ranks of a length go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, taken in bins:
        at = 0
        for n, k in taken:
            rows.append((n, used.get(n, 0), k, sequence, at))
            used[n] = used.get(n, 0) + times * k
            at += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per piece: id, piece (from 0), start, length, ids_crc32, sequence_id and offset (gapless from 0 in each sequence).

    Null and empty texts are documents of the one id 0. Null and repeated ids are documents of their own; extra columns
    are not carried; an empty table gives an empty result. What reaches the driver is one count for each length, fewer
    than `size`; the plan made of them goes to the tasks, with at most size / 1 + size / 2 + ... combinations. Pieces are
    shuffled once, without text or ids, by their part and length, which no hot length makes large. Sequences of
    full pieces have negative numbers.
    """
    pieces = written(cut(docs, tokenizer, id_col, text_col, size), "pieces")
    kind = pieces.schema["id"].dataType.simpleString()
    tails = pieces.where(F.col("length") < size)
    held = written(tails.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {int(r["length"]): int(r["n"]) for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # fewer than size rows
    where = slots(plan(counts, size))
    keys = where[:, 0] << 48 | where[:, 1]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ranked = tails.join(held.withColumn("before", before).drop("n"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))

    def run(batches):
        for pdf in batches:
            n, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            if not len(pdf):
                continue
            slot = where[np.searchsorted(keys, n << 48 | rank, "right") - 1]
            nth = rank - slot[:, 1]
            pdf["sequence_id"], pdf["offset"] = slot[:, 3] + nth // slot[:, 2], slot[:, 4] + nth % slot[:, 2] * n
            pdf = pdf[["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]
            yield pdf.astype({"id": "Int64"}) if kind == "bigint" else pdf

    columns = ["id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*columns, "rank").mapInPandas(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    full = pieces.where(F.col("length") == size).select(*columns, (-1 - F.shiftleft("part", 40) - F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
