"""WARC archives: one gzip member per record, written in parallel and read back by byte ranges.

``write_pages`` writes a response record per page, or a revisit record where an equal payload is kept by
another page (the one with the largest page_id); a revisit holds the HTTP head, whose Content-Length is
that of the full payload, and the payload's digest, but not the payload. ``read_records`` splits archives
into byte ranges. A task looks for the gzip magic in its range, takes a candidate only if it decodes to
a WARC head and to its end with the right checksum, then goes on from member to member; it owns the
records that start inside its range and reads past the end of the range to finish the last one. UTF-8
payloads can't hold the magic, so a stored payload isn't taken for a member.

Tasks write to a name of their own and move it into place, so that a repeated task replaces its file.

A null html is an empty payload, a null url leaves out the target. Rows of equal payload whose page_id is
the largest are all responses; a null page_id is smaller than any other, and among null ids alone all are
responses. Extra columns are ignored. An empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.llm.common import slices, table
from tidegrid.session import cut, scratch_root

RANGE = 8 << 20
MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 18
ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}"]
    head.append(f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, wbits=31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def owners(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest in hex, refers_to): equal payloads refer to their largest page_id."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    kept = rows.groupBy("digest", "size").agg(F.max("page_id").alias("owner")).where(F.col("size") >= min_bytes)
    joined = rows.join(kept, ["digest", "size"], "left")
    other = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("owner")).alias("refers_to"))


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives and returns (path, size) of each."""
    def run(batches):
        context = TaskContext.get()
        where, root = store(folder)
        where.create_dir(root, recursive=True)
        name, size = f"{root}/part-{context.partitionId():05d}.warc.gz", 0
        draft = f"{root}/.draft-{context.partitionId():05d}-{context.taskAttemptId()}"
        with where.open_output_stream(draft, compression=None) as out:
            for batch in slices(batches, "payload"):
                for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    member = record(page, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers, date)
                    size += out.write(member)
        where.move(draft, name)
        yield pa.RecordBatch.from_pydict({"path": pa.array([name]), "size": pa.array([size], pa.int64())})

    return cut(owners(pages, min_bytes).mapInArrow(run, "path string, size bigint"))


def member_at(file, at: int) -> tuple[bytes, int] | None:
    """The record of the gzip member that starts at ``at`` and where the next may start; None if it is no record."""
    file.seek(at)
    unpack, parts, got, checked = zlib.decompressobj(31), [], 0, False
    read = 0
    while not unpack.eof:
        data = file.read(STEP)
        if not data:
            return None
        read += len(data)
        try:
            parts.append(unpack.decompress(data))
        except zlib.error:
            return None
        got += len(parts[-1])
        if not checked and got >= 7:
            parts, checked = [b"".join(parts)], True
            if not parts[0].startswith(b"WARC/1."):
                return None
    return (b"".join(parts), at + read - len(unpack.unused_data)) if checked else None


def members(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """Records that start in [start, end)."""
    at = start
    while at < end:
        file.seek(at)
        data = file.read(min(STEP, end - at) + len(MAGIC) - 1)
        found = data.find(MAGIC)
        if found < 0:
            at += max(len(data) - len(MAGIC) + 1, 1)
            continue
        at += found
        if at >= end:
            return
        member = member_at(file, at)
        if member is None:
            at += 1
        else:
            yield member[0]
            at = member[1]


def fields(body: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in body.decode().split("\r\n")[1:])}


def parse(body: bytes) -> dict:
    head, _, rest = body.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
    length = int(fields(http)["content-length"])
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, length):
            raise ValueError(f"{warc['warc-record-id']}: the payload isn't that of the head")
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(ID)) else None
    return {"page_id": number(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest,
            "record_type": kind, "refers_to": number(warc.get("warc-refers-to", "")), "payload": payload if kind == "response" else None}


def read_records(files: DataFrame, folder: str, payloads: bool = True, split: int = RANGE) -> DataFrame:
    """Records of the archives (path, size), a task for one or more byte ranges."""
    columns = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    schema = columns + ", payload binary" * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        where, _ = store(folder)
        for batch in batches:
            for path, size, start in zip(*(batch[c].to_pylist() for c in ("path", "size", "start"))):
                rows, held = [], 0
                with where.open_input_file(path) as file:
                    for body in members(file, start, min(start + split, size), size):
                        rows.append(parse(body))
                        held += len(body) if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint"))).alias("start"))
    return ranges.repartition(max(1, min(ranges.count(), 100_000))).mapInArrow(run, schema)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_root(spark)}/tidegrid-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    return read_records(write_pages(table(spark, sf_dir, "pages"), folder), folder, payloads=False).drop("url")
