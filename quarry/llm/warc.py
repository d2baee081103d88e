"""WARC archives, index first: written with an index of every record, read back by coalesced byte ranges.

`write_archives` puts a record for each row into gzip-per-record WARC files in a
folder that all executors share and returns a written index table with file,
offset, length, URL, digest and record type. `read_records` takes any selection
of index rows, sorts it by file and offset, joins neighbouring byte ranges to
few larger reads, and parses the records. Of records with equal payloads the one
with the least id is a response, the others are revisits that refer to it.

A task's retry writes a file of its own name; the index names only files of
tasks that ended well, so what an executor leaves half written is never read.

Defined cases: a null payload is empty; a null id sorts after all others and
stays null; rows that agree in id and payload with the response are responses
too, as nothing tells them apart; a null URL is left out of the record; control
characters and spaces in URLs are percent-encoded in the archive, and URLs come
back decoded; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import passing_path, written

#: Payloads shorter than this are not deduplicated.
MIN_BYTES = 0
#: An archive file is closed beyond this size; ranges nearer than GAP are read as one, up to BLOCK.
FILE_BYTES, GAP, BLOCK = 1 << 30, 1 << 16, 8 << 20
#: Records of at most and at least this many neighbouring bytes are read by one task.
SPLIT, LEAST_SPLIT = 64 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX_SCHEMA = "record_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORD_SCHEMA = "record_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """The bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(record: int | None) -> str:
    return f"<urn:x-record:{'none' if record is None else record}>"


def _of_urn(urn: str | None) -> int | None:
    value = urn[len("<urn:x-record:") : -1] if urn else "none"
    return None if value == "none" else int(value)


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(record: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed. A revisit has the response's HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(record)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_safe(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> dict:
    """What `record_bytes` was given, from its bytes; a payload that its digest belies is an error."""
    data = zlib.decompress(raw, 31)
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    return {
        "record_id": _of_urn(fields["WARC-Record-ID"]), "url": None if url is None else unquote(url, errors="surrogatepass"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": _of_urn(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


def _filesystem(uri: str):
    """The file system and path of a URI that Spark takes too: local ones, and the stores that Arrow knows (hdfs, viewfs, s3, gs, abfs)."""
    from pyarrow import fs

    uri = re.sub("^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def with_responses(pages: DataFrame, record_id: str = "page_id", payload: str = "html", min_bytes: int = MIN_BYTES, broadcast_groups: int = 200_000) -> DataFrame:
    """record_id, url, payload (as bytes), refers_to and revisit: which rows repeat another's payload.

    Only digests are grouped, and only groups of two or more are joined back:
    by broadcast if they are few, so that payloads stay where they are, else by
    a join on the digest.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(record_id).cast("long").alias("record_id"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("_sha"))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("_sha").agg(F.min("record_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = groups.where("_n > 1").select(F.col("_sha").alias("_same"), "_first")
    groups = written(groups, "groups")
    groups = F.broadcast(groups) if groups.count() <= broadcast_groups else groups
    joined = rows.join(groups, rows["_sha"] == groups["_same"], "left")
    revisit = F.col("_same").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("_first"))
    return joined.select("record_id", "url", "payload", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(rows: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The index of the archives that are written for rows of `with_responses`."""
    folder = folder or passing_path(rows.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        task, made, at, sink, path = TaskContext.get().partitionId(), 0, 0, None, ""
        try:
            for batch in batches:
                index = []
                for record, url, payload, refers_to, revisit in zip(*batch.columns, strict=True):
                    if sink is None:
                        path = f"part-{task:05d}-{made:03d}-{uuid.uuid4().hex}.warc.gz"
                        sink, at, made = files.open_output_stream(f"{base}/{path}", compression=None), 0, made + 1
                    content = payload.as_py()
                    raw = record_bytes(record.as_py(), url.as_py(), content, refers_to.as_py(), revisit.as_py())
                    sink.write(raw)
                    index.append((record.as_py(), f"{folder}/{path}", at, len(raw), url.as_py(), digest_of(content), "revisit" if revisit.as_py() else "response", refers_to.as_py()))
                    at += len(raw)
                    if at >= file_bytes:
                        sink.close()
                        sink = None
                if index:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), kinds, strict=True)], names=["record_id", "file", "offset", "length", "url", "digest", "record_type", "refers_to"])
        finally:
            if sink is not None:
                sink.close()

    return written(rows.mapInArrow(run, INDEX_SCHEMA), "cdx")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, block: int = BLOCK) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """start, end and members of joined ranges (offset, length), which come sorted by offset."""
    held: list[tuple[int, int]] = []
    end = 0
    for offset, length in ranges:
        if held and (offset - end > gap or max(end, offset + length) - held[0][0] > block):
            yield held[0][0], end, held
            held = []
        end = max(end, offset + length) if held else offset + length
        held.append((offset, length))
    if held:
        yield held[0][0], end, held


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the index rows given, in columns of RECORD_SCHEMA."""
    # the number of tasks follows the archives' bytes, not those of the index rows
    whole = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    split = min(SPLIT, max(LEAST_SPLIT, whole // (2 * index.sparkSession.sparkContext.defaultParallelism)))
    places = index.select("file", "offset", "length").withColumn("_split", F.floor(F.col("offset") / split))
    places = places.repartition(1 + whole // split, "file", "_split").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, files = None, None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            first = 0
            while first < len(rows):
                last = first
                while last < len(rows) and rows[last][0] == rows[first][0]:
                    last += 1
                if rows[first][0] != name:
                    if source is not None:
                        source.close()
                    name = rows[first][0]
                    files, path = _filesystem(name)
                    source = files.open_input_file(path)
                for start, end, members in coalesced([r[1:] for r in rows[first:last]]):
                    source.seek(start)
                    block = source.read(end - start)
                    parsed = [parse_record(block[o - start : o - start + n]) for o, n in members]
                    if not with_payload:
                        parsed = [p | {"payload": None} for p in parsed]
                    yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in parsed], t) for c, t in zip(names, kinds, strict=True)], names=names)
                first = last
        if source is not None:
            source.close()

    return places.mapInArrow(run, RECORD_SCHEMA)
