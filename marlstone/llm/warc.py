"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member. The reader's tasks own byte ranges: a task looks for gzip's magic from the start
of its range, validates a candidate by decoding it and parsing the WARC header, and reads the records that
start inside the range one after another; the last may end beyond it. So a file of any size is read in
parallel without an index. Archives of other writers are read too: without a manifest (a folder or one file of
gzip members), with any record ids and types, without digests, or with several records in a member.

Equal payloads: the one with the largest page_id is the response, the others are revisits that name it. Only
digests meet by key, in a partial aggregate; a digest of very many pages is a skewed key of one join, which
adaptive execution splits. Files are named once for each attempt and count only if the manifest names them.

Defined results: null html counts as an empty payload; rows that repeat the largest page_id of a payload are
all responses; a null page_id revisits a payload that has another page_id and is a response otherwise; null
url is written as empty; an empty table gives an archive without files. Of other writers' records, ids that are no
page's are null as page_id, and a payload that differs from its digest is marked; in an archive with a manifest it
is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, file_system, scratch, spread

MAGIC = b"\x1f\x8b\x08"
HEAD, CHUNK = 8 << 10, 256 << 10
SIGN, PAGE = b"WARC/1.", "<urn:page:"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response and has headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + press.flush()


def resolved(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to: the response that holds an equal payload of at least `least_bytes`."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = keyed.withColumn("digest", F.when(F.length("payload") >= least_bytes, F.sha1("payload")))
    shared = keyed.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("digest IS NOT NULL AND n > 1 AND keeper IS NOT NULL").select("digest", "keeper")
    return keyed.join(shared, "digest", "left").select("page_id", "url", "payload", F.expr("CASE WHEN keeper <=> page_id THEN NULL ELSE keeper END").alias("refers_to"))


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> str:
    """Write a record for each page; returns the archive's path, whose manifest lists files and sizes."""
    bounded_batches(pages.sparkSession)
    path = path or scratch(pages.sparkSession, "warc")
    fs, root = file_system(path)
    fs.create_dir(f"{root}/data", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, size, n, name = None, 0, 0, f"{uuid.uuid4().hex}.warc.gz"
        fs, root = file_system(path)
        for batch in batches:
            sink = sink or fs.open_output_stream(f"{root}/data/{name}", compression=None)
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                size += sink.write(record(*row)) or 0
                n += 1
        if sink is not None:
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [n]})

    resolved(pages, least_bytes).mapInArrow(run, "file string, bytes long, records long").write.parquet(f"{path}/manifest")
    return path


def header(text: bytes) -> dict[str, str] | None:
    """The WARC header's fields; none where this is no whole header."""
    head, end, _ = text.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not end or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields if {"warc-type", "content-length"} <= fields.keys() else None


def _member(file, at: int, size: int, only_head: bool) -> tuple[bytes, int] | None:
    """The member that starts at `at` (or as much as holds its header) and its end; none where it doesn't decode or begin as a record."""
    unpack, out, start = zlib.decompressobj(31), bytearray(), at
    while at < size and not unpack.eof:
        raw = file.read_at(min(HEAD if only_head else CHUNK, size - at), at)
        try:
            got = unpack.decompress(raw)
        except zlib.error:
            return None
        known = max(0, len(out) - 3)
        out += got
        at += len(raw)
        if len(out) >= len(SIGN) and not out.startswith(SIGN):
            return None
        if only_head and out.find(b"\r\n\r\n", known) >= 0:
            return bytes(out), start
    return (bytes(out), at - len(unpack.unused_data)) if unpack.eof else None


def records(file, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header and body of the records whose members start in [start, end)."""
    at = start
    while at < end:  # the first true member
        raw = file.read_at(min(CHUNK, end - at) + len(MAGIC) - 1, at)
        k = raw.find(MAGIC)
        if k < 0 or at + k >= end:
            at += min(CHUNK, end - at)
            continue
        at += k
        if (got := _member(file, at, size, True)) and header(got[0]):
            break
        at += 1
    while at < end:
        got = _member(file, at, size, False)
        if got is None:
            raise ValueError(f"no WARC record at byte {at}")
        rest = got[0]
        while rest:
            fields = header(rest)
            if fields is None:
                raise ValueError(f"no WARC record in the member at byte {at}")
            head = rest.index(b"\r\n\r\n") + 4
            n = int(fields["content-length"])
            if len(rest) < head + n:
                raise ValueError(f"the record at byte {at} is cut off")
            yield at, fields, rest[head : head + n]
            rest = rest[head + n :].lstrip(b"\r\n")
        at = got[1]


def _payload(fields: dict[str, str], body: bytes) -> tuple[bytes | None, int | None]:
    """A record's payload, none in a revisit, and its size as far as it's told."""
    http = fields.get("content-type", "").startswith("application/http")
    if not http or b"\r\n\r\n" not in body and not body.startswith(b"HTTP/"):
        return (None, None) if fields["warc-type"] == "revisit" else (body, len(body))
    head, _, payload = body.partition(b"\r\n\r\n")
    if fields["warc-type"] != "revisit":
        return payload, len(payload)
    said = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return None, int(said[1]) if said else None


def _files(spark: SparkSession, path: str) -> tuple[list[tuple[str, int, int | None]], bool]:
    """Path, size and number of records of the files that count, and whether a manifest names them."""
    fs, root = file_system(path)
    info = fs.get_file_info(f"{root}/manifest")
    if info.type != pafs.FileType.NotFound:
        rows = spark.read.schema("file string, bytes long, records long").parquet(f"{path}/manifest").collect()
        return [(f"{path}/data/{r.file}", r.bytes, r.records) for r in rows], True
    here = fs.get_file_info(root)
    found = [here] if here.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    scheme = path[: path.index("://") + 3] if "://" in path else "file://"
    return [(scheme + f.path, f.size, None) for f in found if f.type == pafs.FileType.File and f.path.endswith(".gz")], False


def read_records(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """One row for each record of any type: its file and the place of its member there, id, type, URI, the id it refers to, content
    type, payload size (null where a revisit doesn't tell) and digest (as stated, or computed), and whether the payload differs from it."""
    files, own = _files(spark, path)
    rows = [(name, size, at, min(size, at + split_bytes)) for name, size, _ in files for at in range(0, size, split_bytes)]
    schema = "file string, at long, record_id string, record_type string, uri string, refers_to string, content_type string, payload_bytes long, payload_digest string, differs boolean"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = (pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for name, size, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                fs, place = file_system(name)
                out = []
                with fs.open_input_file(place) as file:
                    for at, fields, body in records(file, start, end, size):
                        payload, n = _payload(fields, body)
                        stated = fields.get("warc-payload-digest", "")
                        digest = digest32(payload) if payload is not None else stated.removeprefix("sha1:") or None
                        differs = payload is not None and stated.startswith("sha1:") and stated[5:].upper() != digest
                        if differs and own:
                            raise ValueError("a payload differs from its digest")
                        get = fields.get
                        out.append((name, at, get("warc-record-id"), fields["warc-type"], get("warc-target-uri"), get("warc-refers-to"), get("content-type"), n, digest, differs))
                        if len(out) == 10_000:
                            yield batch_of(out)
                            out = []
                if out:
                    yield batch_of(out)

    return spread(spark, rows, "file string, bytes long, start long, end long").mapInArrow(run, schema)


def read_archive(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """One row for each response or revisit: page, size and digest of its payload, type, and the page it refers to."""
    page = lambda c: f"cast(nullif(regexp_extract({c}, '^{PAGE}(-?[0-9]+)>$', 1), '') AS bigint)"
    found = read_records(spark, path, split_bytes).where("record_type IN ('response', 'revisit')")
    return found.selectExpr(f"{page('record_id')} AS page_id", "payload_bytes", "payload_digest", "record_type", f"{page('refers_to')} AS refers_to")


def verify(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> None:
    """Raises where a file holds another number of records than the manifest says."""
    files, _ = _files(spark, path)
    found = {r.file: r.n for r in read_records(spark, path, split_bytes).groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name, _, n in files:
        if n is not None and found.get(name, 0) != n:
            raise ValueError(f"{name} holds {found.get(name, 0)} records, not {n}")
