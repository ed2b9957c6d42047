"""WARC archives: writing, normalising monolithic gzip files, and reading back.

Some crawlers gzip a whole WARC file as one stream, so no record can be read
without inflating all before it. The normaliser inflates such a stream once,
rewrites every record as a gzip member of its own and writes a sidecar index of
offsets; then any record can be read alone.

Archives are rows (archive, body) of a bounded size. ``export`` writes them as
files that any WARC reader opens, with a sidecar file of offsets for each
normalised one; tasks write under a name of their own and rename, so a lost
executor costs the archives it was working on only. In a store that Arrow's
file systems don't open, the round trip keeps them as Parquet rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import scratch, written

#: An archive is closed once its records have this many bytes before compression.
ARCHIVE_BYTES = 8 << 20
#: Payloads shorter than this are always written in full.
REVISIT_BYTES = 100
#: Digests that several pages have are broadcast within this many bytes; beyond, each is dealt to SALTS parts of a shuffle.
BROADCAST_BYTES, DIGEST_BYTES, SALTS = 32 << 20, 128, 64
LEVEL = 1
GZIP = 31  # zlib's window bits for the gzip format
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "array<struct<record_id:string,record_type:string,offset:bigint,length:bigint>>"


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which record each page gets.

    ``refers_to`` is null for a response. Of equal payloads of at least
    REVISIT_BYTES bytes the smallest page_id is the response. A null html is an
    empty payload. Repeated rows of that smallest page_id are all responses; a
    row without page_id is a revisit if an equal page has one.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Partial aggregation leaves one row for each digest and task before the shuffle.
    first = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # A digest of one page refers to nothing; pages without a copy need no join.
    first = written(first.where("n > 1").select(F.col("digest").alias("of_digest"), "first_id"), "warc-copies")
    same = F.col("digest") == F.col("of_digest")
    if first.count() * DIGEST_BYTES <= BROADCAST_BYTES:
        both = rows.join(F.broadcast(first), same, "left")
    else:
        first = first.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(first, same & (F.col("salt") == F.col("of_salt")), "left")
    # Digests are equal for payloads of any length, shorter ones too.
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.octet_length("payload") >= REVISIT_BYTES)
    return both.select("page_id", "url", "payload", "digest", F.when(other, F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, which tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, body): WARC files, each gzipped as one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, gz, out, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            for row in zip(*batch.columns):
                raw = record(*(x.as_py() for x in row))
                gz = gz or zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                out.append(gz.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    out.append(gz.flush())
                    yield pa.RecordBatch.from_pydict({"archive": [f"{part:06d}-{count:06d}.warc.gz"], "body": [b"".join(out)]})
                    count, gz, out, size = count + 1, None, [], 0
        if gz is not None:
            out.append(gz.flush())
            yield pa.RecordBatch.from_pydict({"archive": [f"{part:06d}-{count:06d}.warc.gz"], "body": [b"".join(out)]})

    rows = planned(pages, id_col, url_col, html_col)
    return rows.mapInArrow(run, "archive string, body binary")


def inflate(body: bytes) -> bytes:
    """All of a gzip file, be it one stream or many members."""
    out = []
    while body:
        stream = zlib.decompressobj(GZIP)
        out += [stream.decompress(body), stream.flush()]
        if not stream.eof:
            raise ValueError("the gzip stream ends early")
        body = stream.unused_data
    return b"".join(out)


def header(head: bytes) -> dict[str, str]:
    """Named fields of a record's or an HTTP message's head, names in lower case."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(warc: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """Fields, start and end of each record in an inflated WARC file."""
    at = 0
    while at < len(warc):
        split = warc.index(b"\r\n\r\n", at)
        fields = header(warc[at:split])
        end = split + 4 + int(fields["content-length"]) + 4
        if warc[end - 4 : end] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield fields, at, end
        at = end


def normalise_file(body: bytes) -> tuple[bytes, list[tuple[str, str, int, int]]]:
    """The file with a gzip member for each record, and its sidecar index."""
    warc, out, index, offset = inflate(body), [], [], 0
    for fields, start, end in records(warc):
        gz = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        member = gz.compress(warc[start:end]) + gz.flush()
        index.append((fields["warc-record-id"], fields["warc-type"], offset, len(member)))
        out.append(member)
        offset += len(member)
    return b"".join(out), index


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, body, index): every record its own gzip member, with the sidecar index."""
    names = ("record_id", "record_type", "offset", "length")
    kind = pa.list_(pa.struct([("record_id", pa.string()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                members, index = normalise_file(body.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([members], pa.binary()), pa.array([[dict(zip(names, x)) for x in index]], kind)], ["archive", "body", "index"])

    return archives.select("archive", "body").mapInArrow(run, f"archive string, body binary, index {_INDEX}")


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one record."""
    fields, start, end = next(records(raw))
    split = raw.index(b"\r\n\r\n")
    http_end = raw.index(b"\r\n\r\n", split + 4)
    declared = fields["warc-payload-digest"].removeprefix("sha256:")
    number = lambda urn: int(urn[len("<urn:page:") : -1]) if urn != "<urn:page:>" else None
    if fields["warc-type"] == "revisit":
        size, refers = int(header(raw[split + 4 : http_end])["content-length"]), number(fields["warc-refers-to"])
    else:
        payload, refers = raw[http_end + 4 : end - 4], None
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != declared:
            raise ValueError(f"the payload of {fields['warc-record-id']} doesn't match its digest")
    return number(fields["warc-record-id"]), size, declared, fields["warc-type"], refers


_RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _table(found: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(schema.types)], schema=schema)


def read_records(normalised: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), each record by its offset alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, index in zip(batch.column(1), batch.column(2)):
                view = memoryview(body.as_buffer())
                yield _table([parse(zlib.decompress(view[x["offset"] : x["offset"] + x["length"]], GZIP)) for x in index.as_py()])

    return normalised.select("archive", "body", "index").mapInArrow(run, _RECORDS)


def opens(folder: str) -> bool:
    """Whether Arrow's file systems open the folder."""
    return urlsplit(folder).scheme in ("", "file", "hdfs", "s3", "s3a", "s3n", "gs")


def _store(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


def export(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, bytes, records): each archive as a file in ``folder``.

    With an ``index`` there is a sidecar ``<archive>.cdxj`` beside it, a line of
    JSON for each record. Files are there once the rows are computed; a repeated
    task replaces a file by the same one.
    """
    indexed = "index" in archives.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        store.create_dir(top, recursive=True)

        def put(name: str, data) -> None:
            own = f"{top}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own, compression=None) as f:
                f.write(data)
            store.move(own, f"{top}/{name}")

        for batch in batches:
            for k, name in enumerate(batch.column(0).to_pylist()):
                body = batch.column(1)[k].as_buffer()
                put(name, body)
                index = batch.column(2)[k].as_py() if indexed else []
                if indexed:
                    put(f"{name}.cdxj", "".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": pa.array([len(body)], pa.int64()), "records": pa.array([len(index)], pa.int64())})

    return archives.select("archive", "body", *["index"] * indexed).mapInArrow(run, "archive string, bytes bigint, records bigint")


def load(files: DataFrame, folder: str) -> DataFrame:
    """(archive, body) of the exported files that ``files`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{top}/{name}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read()], pa.binary())], ["archive", "body"])

    return files.select("archive").mapInArrow(run, "archive string, body binary")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """As ``read_records``: each record of the exported files, found by the sidecar and read alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{top}/{name}.cdxj") as f:
                    index = [json.loads(line) for line in f.read().splitlines()]
                with store.open_input_file(f"{top}/{name}") as f:
                    yield _table([parse(zlib.decompress(f.read_at(x["length"], x["offset"]), GZIP)) for x in index])

    return files.select("archive").mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): write, normalise and read back, one row per page.

    Both kinds of archive lie in the shared folder. A null html is an empty
    payload, a null page_id comes back as null, repeated rows each have their
    record, and other columns are not read. A page above ``archive_bytes`` is an
    archive of its own. An empty table gives no archives and no rows.
    """
    streams = write_archives(pages, id_col, url_col, html_col, archive_bytes)
    folder = scratch(pages.sparkSession, "warc")
    if not opens(folder):
        return read_records(written(normalise(written(streams, "warc-streams")), "warc-members"))
    listed = written(export(streams, f"{folder}/streams"), "warc-streams")
    members = written(export(normalise(load(listed, f"{folder}/streams")), f"{folder}/members"), "warc-members")
    return read_files(members, f"{folder}/members")
