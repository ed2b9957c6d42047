"""Scalar codecs of the object store, as Column -> Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Fixed values of the storage format.
HEADER_BYTES = 16
CHECKSUM_BYTES = 4
PADDING = 8
SUPER_BLOCK_BYTES = 8
TOMBSTONE = -1
FLAGS = {"gzip": 0x01, "name": 0x02, "mime": 0x04, "last_modified": 0x08, "ttl": 0x10, "pairs": 0x20, "delete": 0x40, "chunk_manifest": 0x80}
TTL_MINUTES = {"m": 1, "h": 60, "d": 1440, "w": 10080, "M": 44640, "y": 525600}
TTL_CODES = {"m": 1, "h": 2, "d": 3, "w": 4, "M": 5, "y": 6}
KEY = DecimalType(20, 0)


def padding(size: Column) -> Column:
    """Bytes added after a record of ``size``: 1 to 8, never 0."""
    return F.lit(PADDING) - F.pmod(size + HEADER_BYTES + CHECKSUM_BYTES, F.lit(PADDING))


def actual_size(size: Column) -> Column:
    """Bytes a record takes in the data log."""
    return size + HEADER_BYTES + CHECKSUM_BYTES + padding(size)


def align(offset: Column) -> Column:
    """The next place that a record may start at."""
    return F.ceil(offset / PADDING) * PADDING


def is_tombstone(size: Column) -> Column:
    return size < 0


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(FLAGS[name])) > 0


def is_directory(mode: Column) -> Column:
    return mode.cast("bigint").bitwiseAND(F.lit(1 << 31)) != 0


def format_fid(vid: Column, key: Column, cookie: Column) -> Column:
    """``vid,`` then the key in hexadecimal and the cookie as eight digits of it."""
    return F.concat(vid.cast("string"), F.lit(","), F.lower(F.conv(key.cast("string"), 10, 16)), F.lpad(F.lower(F.hex(cookie.cast("bigint"))), 8, "0"))


def parse_fid(fid: Column) -> dict[str, Column]:
    """vid, key and cookie of a file id; null where it isn't one. ``_n`` at the end adds n to the key."""
    found = lambda k: F.regexp_extract(fid, r"^([0-9]{1,10}),([0-9a-fA-F]{1,16})([0-9a-fA-F]{8})(?:_([0-9]{1,9}))?$", k)
    ok = found(1) != ""
    key = F.conv(found(2), 16, 10).cast(KEY) + F.coalesce(F.when(found(4) != "", found(4)).cast(KEY), F.lit(0).cast(KEY))
    return {"vid": F.when(ok, found(1)).cast("bigint"), "key": F.when(ok, key).cast(KEY), "cookie": F.when(ok, F.conv(found(3), 16, 10)).cast("bigint")}


def parse_object_url(path: Column) -> dict[str, Column]:
    """vid, fid, file name and extension of ``/vid,fid[/name][.ext]``."""
    part = lambda k: F.regexp_extract(path, r"^/?([0-9]+)[/,]([0-9A-Za-z]+)(?:/([^./]*))?(\.[^/]*)?$", k)
    return {"vid": F.when(part(1) != "", part(1)).cast("bigint"), "fid": part(2), "name": part(3), "ext": part(4)}


def ttl_minutes(text: Column) -> Column:
    """Minutes of ``N[mhdwMy]`` (minutes without a unit, none for ''); null where it isn't one or N is over 255."""
    number, unit = F.regexp_extract(text, r"^([0-9]{1,9})([mhdwMy]?)$", 1), F.regexp_extract(text, r"^([0-9]{1,9})([mhdwMy]?)$", 2)
    scale = reduce(lambda rest, x: F.when(unit == x[0], F.lit(x[1])).otherwise(rest), TTL_MINUTES.items(), F.lit(1))
    count = F.when(number != "", number).cast("bigint")
    return F.when(text == "", F.lit(0).cast("bigint")).when(count <= 255, count * scale)


def ttl_code(text: Column) -> Column:
    """The two bytes of a TTL, count then unit, as one number; null where it isn't one."""
    unit = F.regexp_extract(text, r"^([0-9]{1,9})([mhdwMy]?)$", 2)
    code = reduce(lambda rest, x: F.when(unit == x[0], F.lit(x[1])).otherwise(rest), TTL_CODES.items(), F.lit(1))
    count = F.when(F.regexp_extract(text, r"^([0-9]{1,9})([mhdwMy]?)$", 1) != "", F.regexp_extract(text, r"^([0-9]{1,9})([mhdwMy]?)$", 1)).cast("bigint")
    return F.when(text == "", F.lit(0).cast("bigint")).when(count == 0, F.lit(0).cast("bigint")).when(count <= 255, count * 256 + code)


def ttl_text(code: Column) -> Column:
    """The text of a TTL's two bytes, '' for none; null where the unit is none of the format's."""
    unit = reduce(lambda rest, x: F.when(code % 256 == x[1], F.lit(x[0])).otherwise(rest), TTL_CODES.items(), F.lit(None).cast("string"))
    return F.when(code == 0, F.lit("")).otherwise(F.concat(F.floor(code / 256).cast("string"), unit))


def replica_parts(text: Column) -> dict[str, Column]:
    """Copies in other centres, in other racks and on other nodes of a placement of three digits, and its byte; null where it isn't one."""
    ok = text.rlike("^[0-9]{3}$")
    digit = lambda k: F.when(ok, F.substring(text, k, 1)).cast("bigint")
    return {"centres": digit(1), "racks": digit(2), "nodes": digit(3), "byte": digit(1) * 100 + digit(2) * 10 + digit(3)}


def replica_text(byte: Column) -> Column:
    """The three digits of a placement's byte."""
    return F.lpad(byte.cast("string"), 3, "0")


def needs_copies(text: Column) -> Column:
    """Whether a placement asks for more than one copy."""
    return replica_copies(text) > 1


def or_default(text: Column, default: str = "default") -> Column:
    """A name, or the default where it is empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)


def entry_time(mode: Column, crtime: Column, mtime: Column) -> Column:
    """When an entry counts as written: directories when they were made, files when they were changed."""
    return F.when(is_directory(mode), crtime).otherwise(mtime)


def pairs_of(headers: Column, prefix: str) -> Column:
    """The headers of an upload that are kept with the object: those with a prefix, in lower case."""
    return F.map_filter(headers, lambda k, v: F.lower(k).startswith(prefix.lower()))


def upload_type(ext: Column, posted: Column) -> Column:
    """The type kept with an object: the posted one unless it says no more than the extension or only raw bytes."""
    raw = F.coalesce(posted, F.lit("")).isin("", "application/octet-stream")
    return F.when(raw | (posted == mime_type(ext)), F.nullif(mime_type(ext), F.lit("application/octet-stream"))).otherwise(posted)


def replica_copies(text: Column) -> Column:
    """Copies that a placement of three digits (centres, racks, nodes) asks for; null where it isn't one."""
    ok = text.rlike("^[0-9]{3}$")
    digit = lambda k: F.when(ok, F.substring(text, k, 1)).cast("bigint")
    return digit(1) + digit(2) + digit(3) + 1


def extension(path: Column) -> Column:
    """The last extension of the last name in a path, without the dot; '' if none."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def trim_slash(path: Column) -> Column:
    """Without one slash at the end, but for the root."""
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))


def ancestors(path: Column) -> Column:
    """All proper ancestors of an absolute path, from the root down."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    )


def host_port(address: Column) -> dict[str, Column]:
    """Host, port (80 if none) and the RPC port beside it."""
    port = F.regexp_extract(address, r":([0-9]+)$", 1)
    number = F.coalesce(F.when(port != "", port).cast("bigint"), F.lit(80).cast("bigint"))
    return {"host": F.regexp_replace(address, r":[0-9]+$", ""), "port": number, "rpc_port": number + 10000}


def volume_name(collection: Column, vid: Column) -> Column:
    return F.when(F.coalesce(collection, F.lit("")) == "", vid.cast("string")).otherwise(F.concat(collection, F.lit("_"), vid.cast("string")))


def mime_type(ext: Column) -> Column:
    """Type by extension for the kinds the store serves, else the type of raw bytes."""
    # Fixed values.
    known = {"html": "text/html", "htm": "text/html", "txt": "text/plain", "css": "text/css", "js": "application/javascript", "json": "application/json", "png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "pdf": "application/pdf", "gz": "application/gzip"}
    return reduce(lambda rest, x: F.when(ext == x[0], F.lit(x[1])).otherwise(rest), known.items(), F.lit("application/octet-stream"))


def etag_of_crc(data: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.crc32(data)), 8, "0"))


def node_number(address: Column) -> Column:
    """Sum over an address of place times code point, as peers number themselves."""
    chars = F.split(address, "")
    places = F.sequence(F.lit(0), F.length(address) - 1)
    return F.when(F.length(address) > 0, F.aggregate(F.zip_with(places, chars, lambda i, c: i.cast("bigint") * F.ascii(c)), F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))


def index_entry(key: Column, offset: Column, size: Column) -> Column:
    """The 16 big-endian bytes of an index row: key, offset in units of eight bytes, size."""
    word = lambda x, digits: F.lpad(F.right(F.hex(x), F.lit(digits)), digits, "0")
    return F.unhex(F.concat(F.lpad(F.conv(key.cast("string"), 10, 16), 16, "0"), word((offset / PADDING).cast("bigint"), 8), word(F.when(size < 0, size + (1 << 32)).otherwise(size).cast("bigint"), 8)))


def fnv1a(text: Column) -> Column:
    """FNV-1a of a text of ASCII characters, in hexadecimal without zeros in front.

    The 64-bit value is carried as two halves of 32 bits, whose products fit a
    signed number; the prime is 2**40 + 0x1B3.
    """
    low = F.lit((1 << 32) - 1)
    half = lambda x, n: x.cast("bigint").alias(n)

    def step(h: Column, byte: Column) -> Column:
        own = h["lo"].bitwiseXOR(byte.cast("bigint"))
        product = own * 0x1B3
        return F.struct(half((h["hi"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(own, 8)).bitwiseAND(low), "hi"), half(product.bitwiseAND(low), "lo"))

    start = F.struct(half(F.lit(0xCBF29CE4), "hi"), half(F.lit(0x84222325), "lo"))
    bytes_of = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    digits = F.aggregate(bytes_of, start, step, lambda h: F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(digits, "^0+", "")), F.lit("")), F.lit("0"))


def joined_etag(etags) -> Column:
    """FNV-1a over the ordered etags (an array column or its name) of a file's chunks; one chunk keeps its own."""
    etags = F.col(etags) if isinstance(etags, str) else etags
    return F.when(F.size(etags) == 1, F.element_at(etags, 1)).otherwise(fnv1a(F.array_join(etags, "")))


def folder_option(text: Column) -> dict[str, Column]:
    """Folder and most volumes of ``dir[:max]``, seven if it names none."""
    most = F.regexp_extract(text, r":([0-9]{1,9})$", 1)
    return {"folder": F.regexp_replace(text, r":[0-9]{1,9}$", ""), "most": F.coalesce(F.when(most != "", most).cast("bigint"), F.lit(7).cast("bigint"))}


def content_range(start: Column, length: Column, total: Column) -> Column:
    """Header of the half-open range from ``start``; its last byte is named inclusively."""
    return F.concat(F.lit("bytes "), start.cast("string"), F.lit("-"), (start + length - 1).cast("string"), F.lit("/"), total.cast("string"))


def etag_header(etag: Column) -> Column:
    """An etag as a header has it, in quotes."""
    return F.when(etag.startswith('"'), etag).otherwise(F.concat(F.lit('"'), etag, F.lit('"')))


def etag_value(header: Column) -> Column:
    """The etag inside a header, without quotes and the mark of a weak one."""
    return F.regexp_replace(F.regexp_replace(header, '^W/', ""), '^"|"$', "")
