"""Readers and writers of the store's binary logs.

``needle_index`` and ``needle_journal`` are fixed-width, so a file is read in
stretches by many tasks; ``needle_data`` records tell their own length, so a
volume is read by one task, in pieces of bounded memory. Files are opened
through Arrow's file systems, so local, HDFS and object-store paths all work.

    register(spark)
    spark.read.format("needle_index").load("/data/3.idx")
    logs.by_volume(rows).write.format("needle_index").mode("append").save("/data")
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quern.functions.codecs import CHECKSUM_BYTES, FLAGS, HEADER_BYTES, PADDING, SUPER_BLOCK_BYTES

# Fixed values of the storage format: big-endian layouts.
INDEX_ROW = np.dtype([("key", ">u8"), ("offset", ">u4"), ("size", ">i4")])
JOURNAL_ROW = np.dtype([("key", ">u8")])
HEADER = struct.Struct(">IQi")
VERSION = 2
#: Rows of a fixed-width log that one task reads.
STRETCH_ROWS = 1 << 20
INDEX_SCHEMA = "vid bigint, seq bigint, key decimal(20,0), offset bigint, size int"
JOURNAL_SCHEMA = "vid bigint, seq bigint, key decimal(20,0)"
DATA_SCHEMA = "vid bigint, seq bigint, offset bigint, key decimal(20,0), cookie bigint, size int, data binary, flags int, name string, mime string, last_modified bigint, ttl_count int, ttl_unit int, pairs string, checksum bigint, intact boolean"


def _files(path: str, suffix: str):
    """File system and (path, size) of one file, or of a folder's files with a suffix."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = [x for x in system.get_file_info(fs.FileSelector(inner)) if x.path.endswith(suffix)]
    else:
        found = [info] if info.type == fs.FileType.File else []
    return system, sorted((x.path, x.size) for x in found)


def volume_id(path: str) -> int | None:
    """The volume that a file ``[collection_]vid.ext`` belongs to."""
    found = re.fullmatch(r"(?:.*_)?([0-9]+)", posixpath.basename(path).rpartition(".")[0])
    return int(found[1]) if found else None


class _Stretch(InputPartition):
    def __init__(self, path: str, first: int, rows: int):
        self.path, self.first, self.rows = path, first, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict, suffix: str):
        self.path, self.suffix = options["path"], options.get("suffix", suffix)

    def _open(self, path: str):
        return _files(self.path, self.suffix)[0].open_input_file(path)


class _FixedReader(_Reader):
    def __init__(self, options: dict, suffix: str, row: np.dtype):
        super().__init__(options, suffix)
        self.row, self.rows = row, int(options.get("stretch_rows", STRETCH_ROWS))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in _files(self.path, self.suffix)[1]:
            if size % self.row.itemsize:
                raise ValueError(f"{path} ends within a row")
            n = size // self.row.itemsize
            out += [_Stretch(path, a, min(self.rows, n - a)) for a in range(0, n, self.rows)]
        return out or [_Stretch("", 0, 0)]

    def read(self, part: _Stretch) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        with self._open(part.path) as f:
            f.seek(part.first * self.row.itemsize)
            table = np.frombuffer(f.read(part.rows * self.row.itemsize), self.row)
        vid = volume_id(part.path)
        for a in range(0, len(table), 65_536):
            own = table[a : a + 65_536]
            columns = [pa.array([vid] * len(own), pa.int64()), pa.array(np.arange(part.first + a, part.first + a + len(own))), pa.array(own["key"].astype(np.uint64)).cast(pa.decimal128(20, 0))]
            if "size" in self.row.names:
                columns += [pa.array(own["offset"].astype(np.int64) * PADDING), pa.array(own["size"].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["vid", "seq", "key", "offset", "size"][: len(columns)])


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """A file for each volume of a partition, in the order of its rows.

    A task writes under names of its own, and the driver renames what all tasks
    have written, so a task that runs again leaves nothing behind. The format
    bounds a volume, and a task holds one record at a time.
    """

    def __init__(self, options: dict, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"].rstrip("/"), options.get("suffix", suffix), overwrite

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def head(self) -> bytes:
        return b""

    def content(self, row) -> bytes:
        raise NotImplementedError

    def write(self, rows) -> _Written:
        system, folder = self._system()
        system.create_dir(folder, recursive=True)
        done, now, out = [], None, None
        try:
            for row in rows:
                if out is None or row["vid"] != now:
                    if out is not None:
                        out.close()
                    now = row["vid"]
                    final = f"{folder}/{now}{self.suffix}"
                    if any(final == x for _, x in done):
                        raise ValueError(f"volume {now} comes in more than one piece; sort by by_volume")
                    done.append((f"{folder}/.{now}{self.suffix}.{uuid.uuid4().hex}", final))
                    out = system.open_output_stream(done[-1][0], compression=None)
                    out.write(self.head())
                out.write(self.content(row))
        finally:
            if out is not None:
                out.close()
        return _Written(done)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, _ = self._system()
        files = [x for m in messages if m is not None for x in m.files]
        taken = [final for _, final in files if not self.overwrite and system.get_file_info(final).type != fs.FileType.NotFound]
        if taken or len({final for _, final in files}) < len(files):
            self.abort(messages)
            raise ValueError(f"volumes are there already or were written by several tasks: {sorted(taken)[:5]}")
        for own, final in files:
            system.move(own, final)

    def abort(self, messages: list) -> None:
        system, _ = self._system()
        for own, _ in (x for m in messages if m is not None for x in m.files):
            system.delete_file(own)


class _IndexWriter(_Writer):
    def content(self, row) -> bytes:
        return struct.pack(">QIi", int(row["key"]), row["offset"] // PADDING, row["size"])


class _JournalWriter(_Writer):
    def content(self, row) -> bytes:
        return struct.pack(">Q", int(row["key"]))


class _DataWriter(_Writer):
    def head(self) -> bytes:
        return encode_super_block()

    def content(self, row) -> bytes:
        ttl = None if row["ttl_count"] is None else (row["ttl_count"], row["ttl_unit"] or 0)
        return encode_record(int(row["key"]), row["cookie"], bytes(row["data"] or b""), row["name"], row["mime"], row["last_modified"], ttl, row["pairs"], bool((row["flags"] or 0) & FLAGS["gzip"]))


def by_volume(rows: DataFrame) -> DataFrame:
    """Rows as the sinks take them: all of a volume next to each other, in the order of ``seq``."""
    return rows.repartition("vid").sortWithinPartitions("vid", "seq")


class IndexLog(DataSource):
    """Rows of index logs in file order; a partial last row is an error."""

    @classmethod
    def name(cls) -> str:
        return "needle_index"

    def schema(self) -> str:
        return INDEX_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FixedReader(self.options, ".idx", INDEX_ROW)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _IndexWriter(self.options, ".idx", overwrite)


class JournalLog(DataSource):
    """Keys of deletion journals; no file means no deletions."""

    @classmethod
    def name(cls) -> str:
        return "needle_journal"

    def schema(self) -> str:
        return JOURNAL_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FixedReader(self.options, ".ecj", JOURNAL_ROW)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _JournalWriter(self.options, ".ecj", overwrite)


def encode_record(key: int, cookie: int, data: bytes, name: str | None = None, mime: str | None = None, last_modified: int | None = None, ttl: tuple[int, int] | None = None, pairs: str | None = None, zipped: bool = False) -> bytes:
    """Bytes of one record. Without data there is no body, as in a deletion; ``zipped`` says that the data are gzip already."""
    body = b""
    if data:
        flags, tail = FLAGS["gzip"] if zipped else 0, b""
        for flag, value, form in (("name", name, "B"), ("mime", mime, "B")):
            if value:
                flags, raw = flags | FLAGS[flag], value.encode()
                tail += struct.pack(f">{form}", len(raw)) + raw
        if last_modified is not None:
            flags, tail = flags | FLAGS["last_modified"], tail + struct.pack(">Q", last_modified)
        if ttl:
            flags, tail = flags | FLAGS["ttl"], tail + bytes(ttl)
        if pairs:
            raw = pairs.encode()
            flags, tail = flags | FLAGS["pairs"], tail + struct.pack(">H", len(raw)) + raw
        body = struct.pack(">I", len(data)) + data + bytes([flags]) + tail
    pad = PADDING - (HEADER_BYTES + len(body) + CHECKSUM_BYTES) % PADDING
    return HEADER.pack(cookie, key, len(body)) + body + struct.pack(">I", zlib.crc32(data)) + bytes(pad)


def decode_body(body: bytes) -> dict:
    """Fields of a record's body by its flags."""
    out = dict.fromkeys(("name", "mime", "last_modified", "pairs", "ttl_count", "ttl_unit"))
    if not body:
        return out | {"data": b"", "flags": 0}
    size = int.from_bytes(body[:4], "big")
    flags, at = body[4 + size], 5 + size
    out |= {"data": body[4 : 4 + size], "flags": flags}
    for flag, width in (("name", 1), ("mime", 1), ("last_modified", 8), ("ttl", 2), ("pairs", 2)):
        if not flags & FLAGS[flag] or at >= len(body):
            continue
        head, at = body[at : at + width], at + width
        if flag == "last_modified":
            out[flag] = int.from_bytes(head, "big")
        elif flag == "ttl":
            out |= {"ttl_count": head[0], "ttl_unit": head[1]}
        else:
            n = int.from_bytes(head, "big")
            out[flag], at = body[at : at + n].decode("utf-8", "replace"), at + n
    return out


#: Bytes of records that are handed to Spark at once.
BATCH_BYTES = 4 << 20
_FIELDS = ("data", "flags", "name", "mime", "last_modified", "ttl_count", "ttl_unit", "pairs")
_DATA_TYPES = pa.schema(
    [("vid", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()), ("key", pa.decimal128(20, 0)), ("cookie", pa.int64()), ("size", pa.int32()), ("data", pa.binary()), ("flags", pa.int32()), ("name", pa.string()), ("mime", pa.string())]
    + [("last_modified", pa.int64()), ("ttl_count", pa.int32()), ("ttl_unit", pa.int32()), ("pairs", pa.string()), ("checksum", pa.int64()), ("intact", pa.bool_())]
)


def read_record(f) -> tuple | None:
    """(key, cookie, size, fields, stored checksum, intact, bytes taken) of the record where the file stands; None at the end or if it is cut off."""
    head = f.read(HEADER_BYTES)
    if len(head) < HEADER_BYTES:
        return None
    cookie, key, size = HEADER.unpack(head)
    size = max(size, 0)
    pad = PADDING - (HEADER_BYTES + size + CHECKSUM_BYTES) % PADDING
    rest = f.read(size + CHECKSUM_BYTES + pad)
    if len(rest) < size + CHECKSUM_BYTES:
        return None  # a record cut off at the end was never acknowledged
    x, stored = decode_body(rest[:size]), int.from_bytes(rest[size : size + CHECKSUM_BYTES], "big")
    return key, cookie, size, x, stored, stored == zlib.crc32(x["data"]), HEADER_BYTES + size + CHECKSUM_BYTES + pad


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    columns[3] = pa.array(columns[3], pa.uint64()).cast(pa.decimal128(20, 0))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _DATA_TYPES.types)], schema=_DATA_TYPES)


class _DataReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        return [_Stretch(path, 0, size) for path, size in _files(self.path, self.suffix)[1]] or [_Stretch("", 0, 0)]

    def read(self, part: _Stretch) -> Iterator[pa.RecordBatch]:
        if part.rows <= SUPER_BLOCK_BYTES:
            return
        vid, seq, at, out, held = volume_id(part.path), 0, SUPER_BLOCK_BYTES, [], 0
        with self._open(part.path) as f:
            f.seek(at)
            while (found := read_record(f)) is not None:
                key, cookie, size, x, stored, intact, taken = found
                out.append((vid, seq, at, key, cookie, size, *(x[n] for n in _FIELDS), stored, intact))
                seq, at, held = seq + 1, at + taken, held + taken
                if held >= BATCH_BYTES:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)


def fetch(places: DataFrame, folder: str, suffix: str = ".dat") -> DataFrame:
    """The records at places (vid, offset) of the volumes' data logs in ``folder``, with the columns of ``needle_data`` but ``seq``.

    Places are dealt by volume and stretch and read in their order, each record
    alone; what isn't a whole record gives no row.
    """
    kept = [n for n in _DATA_TYPES.names if n != "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, files = _files(folder, suffix)
        paths = {volume_id(p): p for p, _ in files}
        now, f, out, held = None, None, [], 0
        for batch in batches:
            for vid, offset in zip(*(c.to_pylist() for c in batch.columns)):
                if vid not in paths:
                    continue
                if vid != now:
                    if f is not None:
                        f.close()
                    now, f = vid, system.open_input_file(paths[vid])
                f.seek(offset)
                if (found := read_record(f)) is not None:
                    key, cookie, size, x, stored, intact, taken = found
                    out.append((vid, 0, offset, key, cookie, size, *(x[n] for n in _FIELDS), stored, intact))
                    held += taken
                if held >= BATCH_BYTES:
                    yield _batch(out).select(kept)
                    out, held = [], 0
        if out:
            yield _batch(out).select(kept)

    rows = places.select(F.col("vid").cast("bigint").alias("vid"), F.col("offset").cast("bigint").alias("offset")).where("vid IS NOT NULL AND offset IS NOT NULL")
    schema = ", ".join(x for x in DATA_SCHEMA.split(", ") if not x.startswith("seq "))
    return rows.repartitionByRange("vid", "offset").sortWithinPartitions("vid", "offset").mapInArrow(run, schema)


def integrity(index: DataFrame, folder: str) -> DataFrame:
    """(vid, key, offset, reason): volumes whose last index row (vid, seq, key, offset, size) doesn't name a whole record of that key with its checksum."""
    last = index.groupBy("vid").agg(F.max_by(F.struct("key", "offset", "size"), "seq").alias("x")).select("vid", "x.*").where("size >= 0")
    found = fetch(last, folder).select("vid", F.col("key").alias("__key"), F.col("size").alias("__size"), "intact")
    reason = F.when(F.col("__key").isNull(), "unreadable").when(F.col("__key") != F.col("key"), "other key").when(F.col("__size") != F.col("size"), "other size").when(~F.col("intact"), "checksum")
    return last.join(found, "vid", "left").select("vid", "key", "offset", reason.alias("reason")).where("reason IS NOT NULL")


class DataLog(DataSource):
    """Records of volumes with their bodies; ``intact`` says whether the checksum fits."""

    @classmethod
    def name(cls) -> str:
        return "needle_data"

    def schema(self) -> str:
        return DATA_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _DataReader(self.options, ".dat")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _DataWriter(self.options, ".dat", overwrite)


def register(spark: SparkSession) -> None:
    for source in (IndexLog, JournalLog, DataLog):
        spark.dataSource.register(source)


def super_block(content) -> dict:
    """Columns of a volume's first eight bytes (a binary column)."""
    byte = lambda k, n=1: F.conv(F.hex(F.substring(content, k, n)), 16, 10).cast("bigint")
    return {"version": byte(1), "replica": F.lpad(byte(2).cast("string"), 3, "0"), "ttl_count": byte(3), "ttl_unit": byte(4), "compact_revision": byte(5, 2)}


def encode_super_block(replica: str = "000", ttl: tuple[int, int] = (0, 0), revision: int = 0) -> bytes:
    return bytes([VERSION, int(replica), *ttl]) + struct.pack(">H", revision) + bytes(2)


def encode_index(rows: DataFrame) -> DataFrame:
    """(vid, part, content): index rows (vid, seq, key, offset, size) as bytes, parts of a volume in the order of ``part``.

    A volume's log is cut into stretches of its sequence, so that no task holds
    a whole one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out = np.empty(len(pdf), INDEX_ROW)
        out["key"], out["offset"], out["size"] = [int(k) for k in pdf["key"]], pdf["offset"] // PADDING, pdf["size"]
        return pd.DataFrame({"vid": [pdf["vid"].iloc[0]], "part": [pdf["part"].iloc[0]], "content": [out.tobytes()]})

    cut = rows.select("vid", "seq", F.col("key").cast("decimal(20,0)").alias("key"), F.col("offset").cast("bigint").alias("offset"), F.col("size").cast("int").alias("size")).withColumn("part", F.floor(F.col("seq") / STRETCH_ROWS))
    return cut.groupBy("vid", "part").applyInPandas(run, "vid bigint, part bigint, content binary")


def encode_data(rows: DataFrame) -> DataFrame:
    """Rows (vid, seq, key, cookie, data, name, mime, last_modified) with the bytes of each record, and its place in the volume's log."""
    from quern.operators.keylog import running_sum

    def run(batches):
        for pdf in batches:
            clean = pdf.astype(object).where(pdf.notna(), None)
            content = [encode_record(int(k), int(c), bytes(d or b""), n, m, None if t is None else int(t)) for k, c, d, n, m, t in zip(*(clean[x] for x in ("key", "cookie", "data", "name", "mime", "last_modified")))]
            yield pd.DataFrame({"vid": pdf["vid"], "seq": pdf["seq"], "key": pdf["key"], "content": content})

    made = rows.select("vid", "seq", "key", "cookie", "data", "name", "mime", "last_modified").mapInPandas(run, "vid bigint, seq bigint, key bigint, content binary")
    placed = running_sum(made, ["vid"], "seq", F.octet_length("content"), "offset")
    return placed.withColumn("offset", F.col("offset") + SUPER_BLOCK_BYTES)


def discovered(spark: SparkSession, folder: str, suffix: str = ".dat") -> DataFrame:
    """(collection, vid, path, bytes) of a folder's volumes, from the names ``[collection_]vid`` of their files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", F.col("length").alias("bytes"))
    name = F.regexp_extract("path", rf"([^/]*){re.escape(suffix)}$", 1)
    return files.select(F.regexp_extract(name, r"^(?:(.*)_)?[0-9]+$", 1).alias("collection"), F.regexp_extract(name, r"([0-9]+)$", 1).cast("bigint").alias("vid"), "path", "bytes").where("vid IS NOT NULL")


def discovered_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(collection, vid, bits, shards, bytes, same_size) of the volumes that have shard files ``.ec00`` to ``.ec13`` beside a sorted index ``.ecx`` that isn't empty."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ec[0-9x]*").load(folder).select("path", "length")
    part = lambda k: F.regexp_extract("path", r"([^/]*)\.ec([0-9]{2}|x)$", k)
    named = files.select(part(1).alias("name"), part(2).alias("kind"), "length").where("name <> ''")
    shard = F.when(F.col("kind") != "x", F.col("kind").cast("int"))
    found = named.groupBy("name").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), shard)).alias("bits"), F.count(shard).alias("shards"), F.max(F.when(shard.isNotNull(), F.col("length"))).alias("bytes"), F.min(F.when(shard.isNotNull(), F.col("length"))).alias("__least"), F.bool_or(F.col("kind") == "x").alias("__index"))
    found = found.where("__index AND shards > 0")
    return found.select(F.regexp_extract("name", r"^(?:(.*)_)?[0-9]+$", 1).alias("collection"), F.regexp_extract("name", r"([0-9]+)$", 1).cast("bigint").alias("vid"), "bits", "shards", "bytes", (F.col("bytes") == F.col("__least")).alias("same_size"))


#: Fixed value: the fields of a volume's information file.
VOLUME_INFO = "files array<struct<backend_type:string,backend_id:string,key:string,offset:bigint,file_size:bigint,modified_time:bigint,extension:string>>, version bigint, replication string"


def volume_info(spark: SparkSession, folder: str) -> DataFrame:
    """(vid, files, version, replication) of the information files ``.vif`` of a folder; those without files count as none."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.vif").text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    info = F.from_json("value", VOLUME_INFO)
    return texts.select(F.regexp_extract("path", r"([0-9]+)\.vif$", 1).cast("bigint").alias("vid"), info.alias("i")).select("vid", "i.*").where("size(files) > 0")


def encode_volume_info(rows: DataFrame) -> DataFrame:
    """(vid, content): the text of an information file for each row (vid, files, version, replication)."""
    return rows.select("vid", F.to_json(F.struct("files", "version", "replication")).alias("content"))


def shard_ranges(shards: DataFrame, wanted: DataFrame, buffer: int = 2 << 20) -> DataFrame:
    """(request, nth, data): ranges (request, vid, shard, offset, size) of shards (vid, shard, content) in pieces of ``buffer`` bytes."""
    end = F.least(F.col("offset") + F.col("size"), F.octet_length("content"))
    rows = wanted.join(shards.select("vid", "shard", "content"), ["vid", "shard"]).where(end > F.col("offset"))
    pieces = rows.select("request", "content", F.posexplode(F.sequence("offset", end - 1, F.lit(buffer).cast("bigint"))).alias("nth", "at"), end.alias("end"))
    return pieces.select("request", "nth", F.substring(F.col("content"), (F.col("at") + 1).cast("int"), F.least(F.lit(buffer), F.col("end") - F.col("at")).cast("int")).alias("data"))
