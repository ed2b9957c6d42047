"""Operators over objects: reading by file id, putting, deleting, and serving byte ranges."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quern.functions import codecs
from quern.operators.keylog import is_expired, live, running_sum


def read(requests: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """Requests (request, vid, key, cookie) with the live record they name and a status.

    A record that isn't there, has another cookie or whose TTL is over is not
    served: its ``status`` says so and ``seq`` and ``size`` are null.
    """
    known = live(log).select("vid", "key", F.col("cookie").alias("__cookie"), "ttl", "modified", F.col("seq").alias("__seq"), F.col("size").alias("__size"))
    both = requests.join(known, ["vid", "key"], "left")
    status = F.when(F.col("__seq").isNull(), "not found").when(F.col("cookie") != F.col("__cookie"), "wrong cookie").when(is_expired(F.col("ttl"), F.col("modified"), now), "expired").otherwise("found")
    both = both.withColumn("status", status)
    served = lambda c: F.when(F.col("status") == "found", F.col(c))
    return both.select("request", "vid", "key", "status", served("__seq").alias("seq"), served("__size").alias("size"))


#: Bytes of bodies that a task puts together before it sends them on.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.Array], change: Callable[[pa.Buffer], bytes]) -> Iterator[pa.Array]:
    """Changed bodies in arrays of about PIECE_BYTES, so that a task never holds the results of a whole batch; nulls stay."""
    for batch in batches:
        done, held = [], 0
        for body in batch:
            done.append(change(body.as_buffer()) if body.is_valid else None)
            held += len(done[-1] or b"")
            if held >= PIECE_BYTES:
                yield pa.array(done, pa.binary())
                done, held = [], 0
        if done:
            yield pa.array(done, pa.binary())


@F.arrow_udf(BinaryType())
def zipped(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Bodies in the gzip format, the same bytes each time."""
    return pieces(data, lambda x: gzip.compress(x, 6, mtime=0))


@F.arrow_udf(BinaryType())
def unzipped(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return pieces(data, gzip.decompress)


def packed(rows: DataFrame) -> DataFrame:
    """Rows with ``data`` zipped where that makes it smaller, and the flag that says so."""
    both = rows.withColumn("__zipped", zipped("data"))
    smaller = F.octet_length("__zipped") < F.octet_length("data")
    return both.withColumn("flags", F.when(smaller, F.lit(codecs.FLAGS["gzip"])).otherwise(F.lit(0))).withColumn("data", F.when(smaller, F.col("__zipped")).otherwise(F.col("data"))).drop("__zipped")


def served(data: Column, flags: Column, accepts_gzip: Column, ext: Column) -> Column:
    """The body as sent: unzipped if it is stored zipped, unless the client takes it so or asked for a .gz file."""
    plain = codecs.has_flag(flags, "gzip") & ~accepts_gzip & (ext != "gz")
    return F.when(plain, unzipped(F.when(plain, data))).otherwise(data)


def _after(log: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Rows with the next sequence numbers of their volumes, in the order of ``order``, a whole number."""
    top = log.groupBy("vid").agg(F.max("seq").alias("__top"))
    placed = running_sum(rows, ["vid"], order, F.lit(1), "__before").join(top, "vid", "left")
    return placed.withColumn("seq", F.coalesce(F.col("__top") + 1, F.lit(0)) + F.col("__before")).drop("__top", "__before")


def put(log: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """The log rows that putting (vid, key, size, ...) appends, in the order of ``order``."""
    return _after(log, rows, order).withColumn("op", F.lit("put"))


def delete(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vid, key, freed, seq): of each wanted (vid, key) the bytes it frees, and where a tombstone is appended; 0 and null where there is nothing."""
    known = live(log).select("vid", "key", F.col("size").alias("__size"))
    both = wanted.select("vid", "key").distinct().join(known, ["vid", "key"], "left")
    there = _after(log, both.where("__size IS NOT NULL"), "key").select("vid", "key", F.col("__size").alias("freed"), "seq")
    gone = both.where("__size IS NULL").select("vid", "key", F.lit(0).cast("bigint").alias("freed"), F.lit(None).cast("bigint").alias("seq"))
    return there.unionByName(gone)


def tombstones(deleted: DataFrame) -> DataFrame:
    """The log rows of ``delete``."""
    return deleted.where("seq IS NOT NULL").select("vid", "key", "seq", F.lit("del").alias("op"), F.lit(0).cast("bigint").alias("size"))


def parse_ranges(header: Column, size: Column) -> Column:
    """array<struct<start,length>> of a Range header on a body of ``size`` bytes, null where it can't be met.

    An empty header asks for no range. A range beyond the body is left out; a
    header of such ranges only can't be met, nor one that isn't well formed.
    """
    texts = F.filter(F.transform(F.split(F.regexp_replace(header, "^bytes=", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    found_in = lambda x, k: F.regexp_extract(x, r"^([0-9]{0,18})-([0-9]{0,18})$", k)
    number = lambda x, k: F.when(found_in(x, k) != "", found_in(x, k)).cast("bigint")

    def one(x: Column) -> Column:
        first, last = number(x, 1), number(x, 2)
        good = (first.isNotNull() | last.isNotNull()) & F.coalesce(first <= last, F.lit(True))
        start = F.coalesce(first, F.greatest(size - last, F.lit(0)))
        stop = F.when(first.isNull() | last.isNull(), size).otherwise(F.least(last + 1, size))
        return F.struct(good.alias("good"), (F.coalesce(first, F.lit(0)) >= size).alias("beyond"), start.alias("start"), (stop - start).alias("length"))

    found = F.transform(texts, one)
    inside = F.transform(F.filter(found, lambda r: ~r["beyond"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length")))
    wrong = F.exists(found, lambda r: ~r["good"]) | ((F.size(found) > 0) & (F.size(inside) == 0))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    return F.when(header == "", none).when(header.startswith("bytes=") & ~wrong, inside)


def part_header(start: Column, length: Column, total: Column, kind: str, boundary: str) -> Column:
    """What stands before a range in a body of several."""
    return F.concat(F.lit(f"\r\n--{boundary}\r\nContent-Type: {kind}\r\nContent-Range: "), codecs.content_range(start, length, total), F.lit("\r\n\r\n"))


def ranges_size(ranges: Column, total: Column, kind: str, boundary: str) -> Column:
    """Bytes of a body of several ranges, with what stands before each and the end."""
    sizes = F.transform(ranges, lambda r: r["length"] + F.octet_length(part_header(r["start"], r["length"], total, kind, boundary)))
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x) + len(f"\r\n--{boundary}--\r\n")


def assemble(ranges: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """(request, nth, data): the bytes of ranges (request, nth, file, start, length) from parts (file, part, data) of ``size`` bytes each.

    A range is joined to the parts that it touches by their number, so a long
    one is put together from rows of many tasks, in order.
    """
    touched = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("length") - 1) / size))
    asked = ranges.where("length > 0").select("request", "nth", "file", "start", "length", F.explode(touched).alias("part"))
    both = asked.join(parts.select("file", "part", "data"), ["file", "part"])
    low = F.greatest(F.col("start") - F.col("part") * size, F.lit(0))
    high = F.least(F.col("start") + F.col("length") - F.col("part") * size, F.lit(size))
    piece = F.hex(F.substring(F.col("data"), (low + 1).cast("int"), (high - low).cast("int")))
    pieces = both.select("request", "nth", F.struct("part", piece.alias("hex")).alias("p")).groupBy("request", "nth").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return pieces.select("request", "nth", F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), "")).alias("data"))
