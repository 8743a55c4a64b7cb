"""SentencePiece encoding and decoding with a merge-type prefix table.

The encoding of a text by greedy merges has a useful property: a sequence of pieces is an encoding exactly if each
neighbouring pair is the encoding of its own text. So the last piece of every prefix is unique: it is the one suffix
piece (found by an Aho-Corasick automaton) that is compatible with the last piece of the prefix before it. The table
holds these last pieces; the ids are recovered from its end backwards.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CACHED, _PAIRS = 400_000, 1_000_000


class _Recent(dict):
    """Segment -> its ids as bytes, made when missing. Two generations of half the bound each: what is in use survives the
    younger one's turn, the rest is forgotten; segments of over 64 characters are never kept."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, s: str) -> bytes:
        ids = self.older.get(s)
        if ids is None:
            ids = array("I", self.make(s)).tobytes()
        if len(s) <= 64:
            if len(self) >= _CACHED // 2:
                self.older = dict(self)
                self.clear()
            self[s] = ids
        return ids


class PieceCodec:
    """Encoder and decoder for a merge-type (BPE) model without normalization rules; other models are refused.

    The model file gives pieces and scores only. Caches are bounded: segments and pair tests are forgotten once too many.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = {}
        self.raw = [b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for i in range(n):
            if sp.is_byte(i):
                b = int(self.pieces[i][1:-1], 16)
                self.byte[b] = i
                self.raw[i] = bytes([b])
        self.is_byte = set(self.byte.values())
        self._check(sp)
        self.found = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if (p.strip(SPACE) or p == SPACE) and self.merged(p) == [p]:
                self.found.add_word(p, (i, len(p)))
        self.found.make_automaton()
        self.size = [len(p) for p in self.pieces]
        self.odd = re.compile("[^" + re.escape("".join(sorted({c for p in self.ids for c in p}))) + "]")
        self.cache = _Recent(self.segment)
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, tuple[int, ...]] = {}

    def _check(self, sp) -> None:
        singles = {c for p in self.ids for c in p}
        if len(self.byte) != 256 or sp.normalize(" ÅＡ\n x") != f"{SPACE}{SPACE}ÅＡ\n{SPACE}x":
            raise ValueError("the model has normalization rules or no byte fallback")
        if singles - self.ids.keys() or any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.ids):
            raise ValueError("the model has pieces across spaces or letters without a piece")
        low = max((self.score[p] for p in self.ids if not p.strip(SPACE) and len(p) > 1), default=-1e30)
        if low >= min(s for p, s in self.score.items() if p.strip(SPACE)):
            raise ValueError("runs of spaces merge before words do")

    def merged(self, text: str) -> list[str]:
        """Greedy merges by score, leftmost first: the definition, used for pairs of pieces and runs of spaces."""
        part = list(text)
        nxt, prv = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(text) and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, part[i] + part[j]))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, p = heapq.heappop(heap)
            if not part[i] or (j := nxt[i]) >= len(text) or part[i] + part[j] != p:
                continue
            part[i], part[j] = p, ""
            nxt[i] = nxt[j]
            if nxt[j] < len(text):
                prv[nxt[j]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [p for p in part if p]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (yes := self.pairs.get(key)) is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            p, q = self.pieces[a], self.pieces[b]
            yes = self.pairs[key] = self.merged(p + q) == [p, q]
        return yes

    def _known(self, s: str, out: list[int]) -> None:
        """Appends the ids of s, of which every character is a piece."""
        last, pairs = [-1] * len(s), self.pairs
        for end, (i, n) in self.found.iter(s):
            if last[end] < 0:
                at = end - n
                if at < 0 or (before := last[at]) >= 0 and ((ok := pairs.get(before << 32 | i)) or ok is None and self.compatible(before, i)):
                    last[end] = i
        got, at, size = [], len(s) - 1, self.size
        while at >= 0:
            if (i := last[at]) < 0:
                raise ValueError(f"no piece ends at {at} in {s!r}")
            got.append(i)
            at -= size[i]
        got.reverse()
        out.extend(got)

    def _word(self, s: str) -> list[int]:
        """Ids of a segment with at most one space, at its start; characters without a piece become bytes."""
        out: list[int] = []
        if not self.odd.search(s):
            self._known(s, out)
            return out
        run = 0
        for i in range(len(s) + 1):
            if i == len(s) or s[i] not in self.ids:
                if i > run:
                    self._known(s[run:i], out)
                if i < len(s):
                    out.extend(self.byte[b] for b in s[i].encode())
                run = i + 1
        return out

    def spaces(self, k: int) -> tuple[int, ...]:
        if k not in self.runs:
            got = tuple(self.ids[p] for p in self.merged(SPACE * k))
            if k > 1000:
                return got
            self.runs[k] = got
        return self.runs[k]

    def segment(self, s: str) -> tuple[int, ...]:
        """Ids of a run of spaces with the word after it. All other merges come before those of spaces with each other."""
        k = len(s) - len(s.lstrip(SPACE))
        if k == len(s):
            return self.spaces(k)
        if k == 0:
            return tuple(self._word(s))
        got = self._word(s[k - 1:])
        if k == 1:
            return tuple(got)
        own = self.ids[SPACE]
        return self.spaces(k) + tuple(got[1:]) if got[0] == own else self.spaces(k - 1) + tuple(got)

    def encode(self, text: str) -> array:
        """All ids of a text without begin and end; an empty text has none."""
        out = array("I")
        if text:
            out.frombytes(b"".join(map(self.cache.__getitem__, _SEGMENT.findall(SPACE + text.replace(" ", SPACE)))))
        return out

    def decode(self, ids) -> str:
        """Text of ids: control ids give nothing, byte ids join to UTF-8 (one U+FFFD for each byte that fits nowhere), the first space goes."""
        raw = self.raw
        joined = b"".join(map(raw.__getitem__, ids))
        try:
            text = joined.decode()
        except UnicodeDecodeError:
            text = self._decode_slowly(ids)
        return text[1:] if text[:1] == " " else text

    def _decode_slowly(self, ids) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at:at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if i in self.is_byte:
                run += self.raw[i]
            else:
                flush()
                out.append(self.raw[i].decode())
        flush()
        return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each model and Python worker."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def with_ids(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs plus the array of ids of each whole text, begin and end ids included; null texts count as empty."""

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([np.array([c.bos, *c.encode(t or ""), c.eos], np.int32) for t in text])

    return docs.withColumn(out, ids(F.col(text_col)))


def with_decoded(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df plus the text of an array of ids; null arrays give null."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([None if x is None else c.decode(x) for x in ids])

    return df.withColumn(out, text(F.col(ids_col)))


def round_trip_digest(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs plus n_tokens, ids_sha256 and decoded_sha256: with_ids and with_decoded in one pass that keeps no ids."""

    @F.pandas_udf("struct<n:long,i:string,d:string>")
    def digest(text: pd.Series) -> pd.DataFrame:
        c, rows = codec(path), []
        for t in text:
            ids = array("I", [c.bos])
            ids.extend(c.encode(t or ""))
            ids.append(c.eos)
            rows.append((len(ids), _sha(np.frombuffer(ids, np.uint32).astype("<u4").tobytes()), _sha(c.decode(ids).encode("utf-8", "surrogatepass"))))
        return pd.DataFrame(rows, columns=["n", "i", "d"])

    return docs.withColumn("_x", digest(F.col(text_col))).withColumn("n_tokens", F.col("_x.n")).withColumn(
        "ids_sha256", F.col("_x.i")).withColumn("decoded_sha256", F.col("_x.d")).drop("_x")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip_digest(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
