"""WARC records in ZIP archives: written by tasks, read back by byte ranges.

An archive is a ZIP file with three stored members: ``archive/data.warc.gz`` (each
record a gzip member of its own), ``indexes/index.cdxj`` (a line a record: file,
offset, length) and ``datapackage.json``.  The reader takes the central directory
(``ziprange``), the index, and then the records' byte ranges, which Spark deals
over tasks in blocks; nothing is extracted.

Of records with equal payloads (by SHA-256) of at least ``least`` bytes, those with
the largest id are responses and hold the payload, all others are revisits of it;
smaller payloads are all responses.  A null payload is the empty one.  A null id is
below all others and is read back as null.  Rows that repeat id and payload are
records of their own, alike in type.  A null url gives a record without one;
control characters in urls are percent-encoded.  No row gives no archive, and the
reader an empty table.  A payload may be of any length a row may have.

A task that fails, or runs twice, leaves a file that no manifest names: names are
drawn anew for each attempt, and only what successful tasks returned is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.llm import ziprange
from brakta.llm.components import FEW, SHARE
from brakta.plans.staging import folder, stage
from brakta.sources.files import qualified, store

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records in an archive, and in a block that is read at once; a record more may follow.
ARCHIVE, BLOCK = 64 << 20, 4 << 20
#: Records of an archive, whose index is held until it is written.
RECORDS = 200_000
ID = re.compile(r"<urn:record:(-?\d*):([A-Z2-7]{32})>")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, at: str, payload: bytes | None, length: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC record; ``payload`` is None for a revisit, which has the response's headers only."""
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:record:{name}:{digest}>", f"WARC-Date: {at}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{refers_to}:{digest}>"]
    block = HTTP % length + (payload or b"")
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP headers, payload) of one record; names of headers in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    return headers, http, payload


class _Sink:
    """Bytes on their way to a store: written in order, never sought."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


class Archive:
    """One archive on its way to ``uri``; of what it holds, only the index is in memory."""

    def __init__(self, uri: str):
        where, path = store(uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.stream = uri, where.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Sink(self.stream), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(WARC), "w", force_zip64=True)
        self.index, self.size = [], 0

    def add(self, data: bytes) -> None:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = squeeze.compress(data) + squeeze.flush()
        self.member.write(packed)
        self.index.append((self.size, len(packed)))
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        """(uri, records, bytes of records); the archive is there from now on."""
        self.member.close()
        lines = (json.dumps({"filename": "data.warc.gz", "offset": at, "length": n}) for at, n in self.index)
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{line}\n" for line in lines))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": WARC}, {"path": INDEX}]}))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.index), self.size


def typed(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the id of the response that a revisit refers to, else null.

    Payloads are counted by their hash before anything is dealt; a payload that very many pages share is
    met where its pages are (there are at most 2 * SHARE such), and pages whose payload is their own stay
    as they are unless Spark finds the table of shared payloads too large to broadcast.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.when(F.length("payload") >= least, F.sha2("payload", 256)))
    shared = stage(rows.filter("same is not null").groupBy("same").agg(F.max("page_id").alias("m"), F.count("*").alias("n")).filter("n > 1 and m is not null"), "warc-shared")
    cut = max(FEW, (shared.agg(F.sum("n")).first()[0] or 0) // SHARE)
    hubs = F.broadcast(shared.filter(F.col("n") > cut).select("same", F.col("m").alias("hub")))
    marked = rows.join(hubs, "same", "left")
    near = marked.filter("hub is not null").withColumnRenamed("hub", "m")
    far = marked.filter("hub is null").drop("hub").join(shared.filter(F.col("n") <= cut).select("same", "m"), "same", "left")
    mine: Column = F.col("page_id").eqNullSafe(F.col("m"))
    return near.unionByName(far).select("page_id", "url", "payload", F.when(~mine, F.col("m")).alias("refers_to"))


def write(pages: DataFrame, least: int = 0, at: str = "2024-01-01T00:00:00Z", size: int = ARCHIVE, key: str = "page_id", url: str = "url", body: str = "html", to: str | None = None) -> DataFrame:
    """Writes archives under ``to`` (else in the shared folder) and returns their manifest (uri, records, bytes)."""
    spark = pages.sparkSession
    root = qualified(spark, to or folder(spark, "warc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("uri", "records", "bytes"), archive.close(), strict=True))])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, target, payload, refers_to = (c[i].as_py() for c in batch.columns)
                if archive is None:
                    archive = Archive(f"{root}/{uuid.uuid4().hex}.wacz")
                archive.add(record(page_id, target, at, payload if refers_to is None else None, len(payload), base32(hashlib.sha1(payload).digest()), refers_to))
                if archive.size >= size or len(archive.index) >= RECORDS:
                    yield closed()
                    archive = None
        if archive is not None:
            yield closed()

    return stage(typed(pages, least, key, url, body).mapInArrow(run, "uri string, records long, bytes long"), "warc-manifest")


def blocks(manifest: DataFrame) -> DataFrame:
    """(uri, at, lengths): runs of records that stand one after the other, of about BLOCK bytes, from the archives' indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                yield from held(uri)

    def held(uri: str) -> Iterator[pa.RecordBatch]:
        where, path = store(uri)
        with where.open_input_file(path) as f:
            found = {m.name: m for m in ziprange.members(f)}
            out = []
            for index in (m for name, m in found.items() if name.startswith("indexes/") and m.stored):
                text = f.read_at(index.size, ziprange.start(f, index))
                text = zlib.decompress(text, 31) if index.name.endswith(".gz") else text
                starts: dict[str, int] = {}
                for line in text.decode().splitlines():
                    entry = json.loads(line[line.index("{") :])
                    name, offset, length = f"archive/{entry['filename']}", int(entry["offset"]), int(entry["length"])
                    if name not in starts:
                        if not found[name].stored:
                            raise ValueError(f"{name} is compressed in {uri}: its records have no byte ranges")
                        starts[name] = ziprange.start(f, found[name])
                    at = starts[name] + offset
                    if out and out[-1]["at"] + out[-1]["n"] == at and out[-1]["n"] + length <= BLOCK:
                        out[-1]["lengths"].append(length)
                        out[-1]["n"] += length
                    else:
                        out.append({"at": at, "n": length, "lengths": [length]})
            if out:
                yield pa.RecordBatch.from_pydict({"uri": [uri] * len(out), "at": pa.array([b["at"] for b in out], pa.int64()), "lengths": pa.array([b["lengths"] for b in out], pa.list_(pa.int64()))})

    return manifest.select("uri").mapInArrow(run, "uri string, at long, lengths array<long>")


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact), with the payload itself on demand.

    ``intact`` says whether a response's payload has the digest in its header; digests and lengths of
    revisits are those of the payload they refer to, from their headers.
    """
    total = manifest.agg(F.count("*"), F.sum("bytes")).first()
    tasks = max(spark.sparkContext.defaultParallelism, (total[1] or 0) // (32 << 20))
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())]
    if payloads:
        fields.append(("payload", pa.binary()))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at, lengths in zip(*(batch.column(c).to_pylist() for c in ("uri", "at", "lengths")), strict=True):
                where, path = store(uri)
                with where.open_input_file(path) as f:
                    data, out, place = f.read_at(sum(lengths), at), [], 0
                for n in lengths:
                    out.append(row(zlib.decompress(memoryview(data)[place : place + n], 31)))
                    place += n
                    if sum(r["payload_bytes"] for r in out) > BLOCK:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    def row(data: bytes) -> dict:
        headers, http, payload = parsed(data)
        kind, digest = headers["warc-type"], headers["warc-payload-digest"].partition(":")[2]
        own, refers = (ID.fullmatch(headers.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        got = {
            "page_id": int(own[1]) if own and own[1] else None, "url": headers.get("warc-target-uri"), "payload_bytes": len(payload) if kind == "response" else int(length[1]) if length else None,
            "payload_digest": base32(hashlib.sha1(payload).digest()) if kind == "response" else digest, "record_type": kind, "refers_to": int(refers[1]) if refers and refers[1] else None,
        }
        return got | {"intact": got["payload_digest"] == digest, "payload": payload}

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
    return blocks(manifest).repartition(tasks, "uri", "at").mapInArrow(run, kinds + (", payload binary" if payloads else ""))


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """The records of all pages, written and read back."""
    return read(pages.sparkSession, write(pages, least))


SQL = """
    WITH said AS (
        SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages
    ), typed AS (
        SELECT *, max(page_id) OVER (PARTITION BY payload) AS keeper FROM said
    )
    SELECT page_id, octet_length(payload) AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
           CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> keeper THEN keeper END AS refers_to
    FROM typed
"""
