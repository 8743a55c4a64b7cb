"""WARC archives: writing, a normaliser for files compressed as one gzip stream, and reading by a sidecar index.

Tasks write archives into a folder that all executors share (any store that pyarrow opens by its URI). A file's name is
new for each attempt and only files that a finished task reports are ever read, so lost executors and
repeated tasks leave orphans at most, never doubled records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import new_path, spread_join, written

ARCHIVE_BYTES = 16 << 20  # of records before compression, after which a task starts a new archive
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CHUNK = 1 << 18


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + page).urn}>"


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record. A revisit holds the HTTP head only; digest and length are those of the full payload in either case."""
    block = _HTTP + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page or ""), "WARC-Date": date,
        "WARC-Target-URI": "".join(c for c in (url or "") if c.isprintable() and c != " ") or "urn:unknown",
        "WARC-Payload-Digest": "sha1:" + digest32(hashlib.sha1(payload).digest()),
        "WARC-Block-Digest": "sha1:" + digest32(hashlib.sha1(block).digest()),
        "Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response",
    }
    if page is not None:
        head["Page-Id"] = page
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "Refers-To-Page-Id": refers_to}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def with_duplicates(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): the smallest page_id of an equal payload for all rows of other ids, else null.

    Payloads below least_bytes, rows of that smallest id, and rows whose payload has no id at all stay responses. Payloads
    are told apart by SHA-1. The group's smallest id comes from a partial aggregation over ids and digests alone; payloads
    of very many copies get it by a broadcast of bounded size, so no task gathers a payload's rows."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1(F.encode("html", "utf-8")))
    copies = rows.where(F.octet_length("html") >= least_bytes).groupBy("_sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = written(copies.where("n > 1 and first is not null"), "payloads")
    return spread_join(rows, first, ["_sha"], "n").select("page_id", "url", "html", F.expr("case when not page_id <=> first then first end").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", roll: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html, refers_to) as archives of one gzip stream each -> table (archive, records)."""

    def run(batches):
        store, folder = opened(path)
        store.create_dir(folder, recursive=True)
        out = done = n = size = name = None
        for pdf in batches:
            for page, url, html, to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, done = store.open_output_stream(f"{folder}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                rec = record(None if pd.isna(page) else str(page), url, html.encode("utf-8", "surrogatepass"), None if pd.isna(to) else str(to), date)
                out.write(done.compress(rec))
                n, size = n + 1, size + len(rec)
                if size >= roll:
                    out.write(done.flush())
                    out.close()
                    out = None
                    yield pd.DataFrame({"archive": [f"{path}/{name}"], "records": [n]})
        if out is not None:
            out.write(done.flush())
            out.close()
            yield pd.DataFrame({"archive": [f"{path}/{name}"], "records": [n]})

    ids = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.col("refers_to").cast("string").alias("refers_to"))
    return written(ids.mapInPandas(run, "archive string, records bigint"), "archives")


def inflated(source) -> Iterator[bytes]:
    """The plain bytes of a gzip file of any number of members, in pieces of bounded size, in one pass; a file that ends within a member raises ValueError."""
    d, within = zlib.decompressobj(31), False
    while data := source.read(_CHUNK):
        while data:
            if not within:
                data = data.lstrip(b"\0")  # padding between members
                if not data:
                    break
                within = True
            yield d.decompress(data, _CHUNK)
            while d.unconsumed_tail:
                yield d.decompress(d.unconsumed_tail, _CHUNK)
            data = d.unused_data
            if d.eof:
                d, within = zlib.decompressobj(31), False
    if within:
        raise ValueError("the archive ends within a gzip member")


def split_records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a plain WARC stream by their Content-Length; a cut-off or malformed record raises ValueError."""
    buf = bytearray()
    need = head_end = None
    for part in parts:
        buf += part
        while True:
            if need is None:
                while buf[:2] == b"\r\n":
                    del buf[:2]
                head_end = buf.find(b"\r\n\r\n")
                if head_end < 0:
                    break
                fields = headers(bytes(buf[:head_end]))
                size = fields.get("content-length", "")
                if not size.isdecimal():
                    raise ValueError(f"a record without a usable Content-Length: {size!r}")
                need = head_end + 4 + int(size) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = None
    if buf.strip(b"\r\n"):
        raise ValueError("the archive ends within a record")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise(archives: DataFrame, path: str, level: int = 3) -> DataFrame:
    """Rewrite archives so that each record is a gzip member of its own, with a sidecar index -> table (archive, index, records).

    The index holds one JSON line for each record: id, type, offset and length of its member. Each source is inflated
    once, a bounded piece at a time. An archive without records gives files without records.
    """

    def run(batches):
        store, folder = opened(path)
        store.create_dir(folder, recursive=True)
        for pdf in batches:
            for source in pdf["archive"]:
                name, at, n = uuid.uuid4().hex, 0, 0
                src_store, src = opened(source)
                with src_store.open_input_stream(src, compression=None) as raw, store.open_output_stream(f"{folder}/{name}.warc.gz", compression=None) as out, store.open_output_stream(f"{folder}/{name}.idx", compression=None) as idx:
                    for rec in split_records(inflated(raw)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(rec) + z.flush()
                        h = headers(rec[:rec.index(b"\r\n\r\n")])
                        line = {"id": h.get("warc-record-id"), "type": h.get("warc-type"), "offset": at, "length": len(member)}
                        idx.write((json.dumps(line) + "\n").encode())
                        out.write(member)
                        at, n = at + len(member), n + 1
                yield pd.DataFrame({"archive": [f"{path}/{name}.warc.gz"], "index": [f"{path}/{name}.idx"], "records": [n]})

    spread = archives.repartition(max(1, archives.count()))
    return written(spread.mapInPandas(run, "archive string, index string, records bigint"), "normalised")


def read_archives(normalised: DataFrame) -> DataFrame:
    """Every record by its index entry: page_id and refers_to (strings), payload_bytes, payload_digest, record_type, url and payload.

    Length and digest of a response are computed from its payload and must equal its headers, else ValueError; a
    revisit has a null payload and gives those of its headers."""

    def run(batches):
        for pdf in batches:
            for archive, index in zip(pdf["archive"], pdf["index"], strict=True):
                store, src = opened(archive)
                with store.open_input_stream(opened(index)[1]) as f:
                    lines = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with store.open_input_file(src) as f:
                    for line in lines:
                        f.seek(line["offset"])
                        rec = zlib.decompress(f.read(line["length"]), 31)
                        head_end = rec.index(b"\r\n\r\n")
                        h = headers(rec[:head_end])
                        block = rec[head_end + 4:head_end + 4 + int(h["content-length"])]
                        size, digest, payload = int(h["payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), None
                        if h["warc-type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4:]
                            if len(payload) != size or digest32(hashlib.sha1(payload).digest()) != digest:
                                raise ValueError(f"record {h['warc-record-id']} of {archive} is damaged")
                        rows.append((h.get("page-id"), size, digest, h["warc-type"], h.get("refers-to-page-id"), h["warc-target-uri"], payload))
                        if len(rows) >= 256:
                            yield pd.DataFrame(rows, columns=_COLUMNS)
                            rows = []
                yield pd.DataFrame(rows, columns=_COLUMNS)

    spread = normalised.repartition(max(1, normalised.count()))
    return spread.mapInPandas(run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, payload binary")


_COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]


def archive_round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html), normalise the archives, read them back: the rows of read_archives with ids of page_id's type.

    Null html is an empty payload; null ids and urls are records without them; repeated rows are records of their
    own; other columns are not carried. An empty table writes nothing and gives an empty result."""
    kind = pages.schema["page_id"].dataType
    path = path or new_path(pages.sparkSession, "warc")
    raw = write_archives(with_duplicates(pages, least_bytes), f"{path}/raw")
    back = read_archives(normalise(raw, f"{path}/records"))
    return back.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def query(spark, sf_dir: str) -> DataFrame:
    out = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the SHA-1 from its hex digits: five of them give four letters.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""
