"""Erasure coding: stripe geometry, shard sets, and Reed-Solomon blocks over GF(256).

A volume of n bytes fills rows of ten large blocks while more than a row of
them is left, then rows of ten small blocks, the last padded with zeros. Ten
data shards hold the columns; four parity shards any four of which may be lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the storage format.
DATA, PARITY = 10, 4
TOTAL = DATA + PARITY
LARGE, SMALL = 1 << 30, 1 << 20
_POLYNOMIAL = 0x11D
#: Bytes of data blocks that a task codes side by side.
WORK = 1 << 20


def large_rows(size: Column, large: int = LARGE) -> Column:
    """Rows of large blocks in a volume of ``size`` bytes."""
    return F.when(size > 0, F.floor((size - 1) / (DATA * large))).otherwise(0).cast("bigint")


def intervals(ranges: DataFrame, large: int = LARGE, small: int = SMALL) -> DataFrame:
    """Rows (volume_size, offset, size, ...) with the shard stretches of each range.

    Adds (shard, shard_offset, length, range_offset), a row for each block that
    the range touches.
    """
    rows = ranges.where("size > 0").withColumn("__rows", large_rows(F.col("volume_size"), large)).withColumn("__edge", F.col("__rows") * DATA * large)
    end = F.col("offset") + F.col("size")
    block = lambda at: F.when(at < F.col("__edge"), F.floor(at / large)).otherwise(F.col("__rows") * DATA + F.floor((at - F.col("__edge")) / small)).cast("bigint")
    cut = rows.select("*", F.explode(F.sequence(block(F.col("offset")), block(end - 1))).alias("__block"))
    big = F.col("__block") < F.col("__rows") * DATA
    nth = F.when(big, F.col("__block")).otherwise(F.col("__block") - F.col("__rows") * DATA)
    width = F.when(big, F.lit(large)).otherwise(F.lit(small)).cast("bigint")
    start = F.when(big, nth * large).otherwise(F.col("__edge") + nth * small)
    lo, hi = F.greatest(F.col("offset"), start), F.least(end, start + width)
    base = F.when(big, F.floor(nth / DATA) * large).otherwise(F.col("__rows") * large + F.floor(nth / DATA) * small)
    out = cut.withColumn("shard", F.pmod(nth, F.lit(DATA)).cast("bigint")).withColumn("shard_offset", (base + lo - start).cast("bigint"))
    return out.withColumn("length", (hi - lo).cast("bigint")).withColumn("range_offset", (lo - F.col("offset")).cast("bigint")).drop("__rows", "__edge", "__block")


def shard_bits(shards: DataFrame, keys: list[str]) -> DataFrame:
    """The set of shards (numbers in ``shard``) of each key, as bits.

    Rows are dealt by their keys before they are counted: few keys repeat
    within a task that reads, and a small file may stand for many shards.
    """
    return shards.repartition(*keys).groupBy(*keys).agg(F.bit_or(F.expr("shiftleft(1L, CAST(shard AS INT))")).alias("bits"))


def bits_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, added, removed): shards that came and went, as bits; keys without a change are left out."""
    both = old.withColumnRenamed("bits", "__old").join(new.withColumnRenamed("bits", "__new"), keys, "full")
    a, b = F.coalesce("__old", F.lit(0).cast("bigint")), F.coalesce("__new", F.lit(0).cast("bigint"))
    out = both.select(*keys, b.bitwiseAND(F.bitwise_not(a)).alias("added"), a.bitwiseAND(F.bitwise_not(b)).alias("removed"))
    return out.where("added <> 0 OR removed <> 0")


def missing(bits: DataFrame) -> DataFrame:
    """Volumes that lack shards: how many they have, whether they can be rebuilt, which are missing."""
    absent = F.filter(F.sequence(F.lit(0), F.lit(TOTAL - 1)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1)) == 0)
    held = F.bit_count("bits").cast("bigint")
    return bits.withColumn("held", held).where(F.col("held") < TOTAL).withColumn("repairable", F.col("held") >= DATA).withColumn("missing", F.array_join(absent.cast("array<string>"), ",")).drop("bits")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and logarithms to the base 2."""
    exp, log, x = np.zeros(512, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = x << 1 ^ (_POLYNOMIAL if x & 0x80 else 0)
    exp[255:510] = exp[:255]
    return exp, log


def multiply(a, b) -> np.ndarray:
    exp, log = _tables()
    a, b = np.broadcast_arrays(np.asarray(a, np.int64), np.asarray(b, np.int64))
    return np.where((a == 0) | (b == 0), 0, exp[log[a] + log[b]]).astype(np.uint8)


def invert(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a square matrix over GF(256)."""
    exp, log = _tables()
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n, dtype=np.uint8)], axis=1).astype(np.uint8)
    for i in range(n):
        pivot = i + int(np.flatnonzero(work[i:, i])[0])
        work[[i, pivot]] = work[[pivot, i]]
        work[i] = multiply(work[i], exp[255 - log[work[i, i]]])
        for r in range(n):
            if r != i and work[r, i]:
                work[r] ^= multiply(work[i], work[r, i])
    return work[:, n:]


@lru_cache(maxsize=1)
def coding_matrix() -> np.ndarray:
    """14 x 10: the identity above the parity rows, any ten rows of which have an inverse."""
    exp, log = _tables()
    power = lambda r, c: 1 if c == 0 else 0 if r == 0 else int(exp[log[r] * c % 255])
    vander = np.array([[power(r, c) for c in range(DATA)] for r in range(TOTAL)], np.uint8)
    top = invert(vander[:DATA])
    return np.array([[np.bitwise_xor.reduce(multiply(row, top[:, c])) for c in range(DATA)] for row in vander], np.uint8)


@lru_cache(maxsize=1)
def _products() -> np.ndarray:
    """Products of all pairs of bytes, a row for each factor."""
    return np.array([multiply(np.full(256, m), np.arange(256)) for m in range(256)], np.uint8)


@lru_cache(maxsize=1024)
def _from_rows(rows: tuple[int, ...]) -> np.ndarray:
    """What turns the blocks of ten shards into those of the data shards."""
    return invert(coding_matrix()[list(rows)])


def combine(matrix: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Product of a matrix and blocks of bytes, (rows, n) @ (n, width)."""
    out, table = np.zeros((len(matrix), blocks.shape[1]), np.uint8), _products()
    for total, row in zip(out, matrix):
        for m, block in zip(row, blocks):
            if m:
                total ^= block if m == 1 else table[m][block]
    return out


@lru_cache(maxsize=1024)
def _whole_from_rows(rows: tuple[int, ...]) -> np.ndarray:
    """What turns the blocks of ten shards into those of all fourteen."""
    return combine(coding_matrix(), _from_rows(rows))


def _batch(schema: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """Rows of whole numbers that end in a block."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "block" else pa.int64()) for n, c in zip(schema, columns)], schema)


def _coded(groups: list[tuple[tuple, int, list]]) -> Iterator[tuple]:
    """(key columns, shard, block) of groups (key columns, width, pieces (shard, at, bytes)), coded side by side."""
    data, start = np.zeros((DATA, sum(width for _, width, _ in groups)), np.uint8), 0
    for _, width, pieces in groups:
        for shard, at, piece in pieces:
            data[shard, start + at : start + at + len(piece)] = np.frombuffer(piece, np.uint8)
        start += width
    every, start = np.concatenate([data, combine(coding_matrix()[DATA:], data)]), 0
    for key, width, _ in groups:
        yield from ((*key, i, row[start : start + width].tobytes()) for i, row in enumerate(every))
        start += width


def encode(stripes: DataFrame) -> DataFrame:
    """(key, shard, block) of stripes (key, body): a body is cut into ten blocks, padded with zeros, and four parity blocks are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, size = [], 0
            for key, body in zip(batch.column(0), batch.column(1)):
                body = body.as_py()
                width = max(1, -(-len(body) // DATA))
                groups.append(((key.as_py(),), width, [(i, 0, body[i * width : (i + 1) * width]) for i in range(DATA)]))
                size += width * DATA
                if size >= WORK:
                    yield _batch(["key", "shard", "block"], list(_coded(groups)))
                    groups, size = [], 0
            yield _batch(["key", "shard", "block"], list(_coded(groups)))

    return stripes.select("key", "body").mapInArrow(run, "key bigint, shard bigint, block binary")


def _recovered(rows: DataFrame, keys: list[str], partial: bool) -> DataFrame:
    """(keys, shard, block): the blocks that ``wanted`` names, as bits, of the keys of rows (keys, wanted, shard, block).

    Blocks that are there are given as they are, others rebuilt from ten. A key
    with fewer than ten gives what it has if ``partial``, else no row.

    Rows of a key are sorted next to each other by Spark; a task goes along
    them, and keys that lost the same shards are multiplied side by side.
    """
    schema = [*keys, "shard", "block"]

    def flush(ready: list[tuple[tuple, int, dict[int, bytes]]]) -> pa.RecordBatch:
        out, alike = [], {}
        for key, wanted, have in ready:
            lost = [s for s in range(TOTAL) if wanted >> s & 1 and s not in have]
            if len(have) >= DATA or partial:
                out += [(*key, s, have[s]) for s in sorted(have) if wanted >> s & 1]
            if lost and len(have) >= DATA:
                alike.setdefault((tuple(sorted(have)[:DATA]), tuple(lost)), []).append((key, have))
        for (rows, lost), own in alike.items():
            blocks = np.stack([np.frombuffer(b"".join(have[r] for _, have in own), np.uint8) for r in rows])
            again, start = combine(_whole_from_rows(rows)[list(lost)], blocks), 0
            for key, have in own:
                end = start + len(have[rows[0]])
                out += [(*key, s, row[start:end].tobytes()) for s, row in zip(lost, again)]
                start = end
        return _batch(schema, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready, size = None, [], 0
        for batch in batches:
            for *key, wanted, shard, block in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if size >= WORK:
                        yield flush(ready)
                        ready, size = [], 0
                    now = key
                    ready.append((tuple(key), wanted, {}))
                if ready[-1][2].setdefault(shard, block) is block:
                    size += len(block)
        yield flush(ready)

    rows = rows.select(*(F.col(k).cast("bigint").alias(k) for k in keys), "wanted", F.col("shard").cast("bigint").alias("shard"), "block").where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "shard").mapInArrow(run, f"{', '.join(f'{k} bigint' for k in keys)}, shard bigint, block binary")


def rebuild(shards: DataFrame, keys: tuple[str, ...] = ("key",), first: int = TOTAL) -> DataFrame:
    """All fourteen blocks, or the ``first`` of them, of each key that still has ten (keys, shard, block); keys with fewer give no row."""
    return _recovered(shards.withColumn("wanted", F.lit((1 << first) - 1).cast("bigint")), list(keys), partial=False)


def apply_delta(state: DataFrame, new: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bits): shards that came added to each key's bits, those that went taken off; keys left without any go."""
    bits = lambda df, name: df.select(*keys, F.col("bits").alias(name))
    both = state.join(bits(new, "__new"), keys, "full").join(bits(gone, "__gone"), keys, "left")
    zero = F.lit(0).cast("bigint")
    left = (F.coalesce("bits", zero)).bitwiseOR(F.coalesce("__new", zero)).bitwiseAND(F.bitwise_not(F.coalesce("__gone", zero)))
    return both.select(*keys, left.alias("bits")).where("bits <> 0")


def shard_nodes(held: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(vid, shard, nodes): the nodes (in order, each once) that hold a shard, without those that gave it up (vid, shard, node)."""
    left = held if gone is None else held.join(gone.select("vid", "shard", "node").distinct(), ["vid", "shard", "node"], "left_anti")
    return left.groupBy("vid", "shard").agg(F.array_join(F.transform(F.array_sort(F.collect_set("node")), lambda n: n.cast("string")), ",").alias("nodes"))


def shards_by_node(held: DataFrame) -> DataFrame:
    """(node, vid, bits): what each node reports of its shards."""
    return shard_bits(held, ["node", "vid"])


def shard_list(shards: DataFrame) -> DataFrame:
    """(vid, shards): the shards of each volume in order, each once."""
    return shards.groupBy("vid").agg(F.array_join(F.transform(F.array_sort(F.collect_set("shard")), lambda s: s.cast("string")), ",").alias("shards"))


def without(shards: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shards (vid, shard) that stay when others are deleted, and the volumes that have none left, whose index and journal go too."""
    left = shards.join(gone.select("vid", "shard").distinct(), ["vid", "shard"], "left_anti")
    return left, shards.select("vid").distinct().join(left.select("vid").distinct(), "vid", "left_anti")


def index_of(sorted_index: DataFrame, journal: DataFrame) -> DataFrame:
    """(vid, key, offset, size): an index log again, the sorted index and a tombstone for each key of the journal."""
    gone = journal.select("vid", "key").distinct().select("vid", "key", F.lit(0).cast("bigint").alias("offset"), F.lit(-1).cast("bigint").alias("size"))
    return sorted_index.select("vid", "key", "offset", "size").unionByName(gone)


def stripes(pieces: DataFrame, large: int = LARGE, small: int = SMALL) -> DataFrame:
    """(vid, shard, shard_offset, data): the bytes of pieces (vid, volume_size, offset, data) on the ten data shards, by the layout of ``intervals``."""
    cut = intervals(pieces.withColumn("size", F.octet_length("data").cast("bigint")), large, small)
    return cut.select("vid", "volume_size", "shard", "shard_offset", F.substring(F.col("data"), (F.col("range_offset") + 1).cast("int"), F.col("length").cast("int")).alias("data"))


def shard_size(volume_size: Column, large: int = LARGE, small: int = SMALL) -> Column:
    """Bytes of each shard of a volume, the last small row filled with zeros."""
    rows = large_rows(volume_size, large)
    return (rows * large + F.ceil((volume_size - rows * DATA * large) / (DATA * small)) * small).cast("bigint")


def encode_volumes(pieces: DataFrame, large: int = LARGE, small: int = SMALL, span: int = SMALL) -> DataFrame:
    """(vid, volume_size, span, shard, block): all fourteen shards of volumes, in blocks of ``span`` bytes.

    ``span`` is a multiple of the small block or divides it. The bytes of ten
    data shards at one stretch of places meet in one group, ten times ``span``
    bytes, and four parity blocks are added.
    """
    cut = stripes(pieces, large, small)
    inside = F.sequence(F.floor(F.col("shard_offset") / span), F.floor((F.col("shard_offset") + F.octet_length("data") - 1) / span))
    cut = cut.select("*", F.explode(inside).alias("span"))
    low, high = F.greatest(F.col("shard_offset"), F.col("span") * span), F.least(F.col("shard_offset") + F.octet_length("data"), (F.col("span") + 1) * span)
    cut = cut.select("vid", "volume_size", "span", "shard", (low - F.col("span") * span).alias("at"), F.substring(F.col("data"), (low - F.col("shard_offset") + 1).cast("int"), (high - low).cast("int")).alias("data"), F.least(F.lit(span).cast("bigint"), shard_size(F.col("volume_size"), large, small) - F.col("span") * span).alias("width"))

    schema = ["vid", "volume_size", "span", "shard", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size = [], 0
        for batch in batches:
            for *key, width, shard, at, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if not groups or (groups[-1][0][0], groups[-1][0][2]) != (key[0], key[2]):
                    if size >= WORK:
                        yield _batch(schema, list(_coded(groups)))
                        groups, size = [], 0
                    groups.append((tuple(key), width, []))
                    size += width * DATA
                groups[-1][2].append((shard, at, piece))
        yield _batch(schema, list(_coded(groups)))

    # Spark sorts the pieces of a group next to each other; a task goes along them.
    cut = cut.select("vid", "volume_size", "span", "width", "shard", "at", "data").select(*(F.col(c).cast("bigint") for c in ("vid", "volume_size", "span", "width", "shard", "at")), "data")
    return cut.repartition("vid", "span").sortWithinPartitions("vid", "span").mapInArrow(run, "vid bigint, volume_size bigint, span bigint, shard bigint, block binary")


def volume_pieces(blocks: DataFrame, large: int = LARGE, small: int = SMALL, span: int = SMALL) -> DataFrame:
    """(vid, offset, data): the volume's bytes again, from the blocks (vid, volume_size, span, shard, block) of its data shards.

    A block is cut where the layout goes on to another row, and padding goes.
    """
    rows = blocks.where(F.col("shard") < DATA).withColumn("edge", large_rows(F.col("volume_size"), large) * large).withColumn("start", F.col("span") * span)
    width = F.when(F.col("start") < F.col("edge"), F.lit(large)).otherwise(F.lit(small))
    # A span lies in large rows or in small ones if it divides both; a wider one is cut at small blocks.
    unit = min(span, small)
    cut = rows.select("*", width.alias("width"), F.explode(F.sequence(F.lit(0).cast("bigint"), (F.octet_length("block") - 1).cast("bigint"), F.lit(unit).cast("bigint"))).alias("within"))
    at = F.col("start") + F.col("within")
    big = at < F.col("edge")
    offset = F.when(big, (F.floor(at / large) * DATA + F.col("shard")) * large + at % large).otherwise(F.col("edge") * DATA + (F.floor((at - F.col("edge")) / small) * DATA + F.col("shard")) * small + (at - F.col("edge")) % small)
    cut = cut.withColumn("offset", offset.cast("bigint"))
    length = F.least(F.lit(unit).cast("bigint"), F.col("volume_size") - F.col("offset"), F.octet_length("block") - F.col("within"))
    return cut.where("offset < volume_size").select("vid", "offset", F.substring(F.col("block"), (F.col("within") + 1).cast("int"), length.cast("int")).alias("data"))


def read_ranges(blocks: DataFrame, ranges: DataFrame, large: int = LARGE, small: int = SMALL, span: int = SMALL) -> DataFrame:
    """(request, data): ranges (request, vid, volume_size, offset, size) read from coded blocks (vid, span, shard, block), some of them lost.

    A stretch whose block is there is cut from it; for the others the spans they
    lie in, and no more, are rebuilt from ten blocks. A range of which a span
    can't be rebuilt gives no row.
    """
    cut = intervals(ranges.select("request", "vid", "volume_size", "offset", "size"), large, small)
    inside = F.sequence(F.floor(F.col("shard_offset") / span), F.floor((F.col("shard_offset") + F.col("length") - 1) / span))
    cut = cut.select("request", "vid", "size", "shard", "shard_offset", "length", "range_offset", F.explode(inside).alias("span"))
    low, high = F.greatest(F.col("shard_offset"), F.col("span") * span), F.least(F.col("shard_offset") + F.col("length"), (F.col("span") + 1) * span)
    need = cut.select("request", "vid", "size", "span", "shard", (F.col("range_offset") + low - F.col("shard_offset")).alias("at"), (low - F.col("span") * span).alias("from"), (high - low).alias("n"))
    # Each span that a range touches is met once, with all blocks that its ranges want.
    touched = shard_bits(need, ["vid", "span"]).withColumnRenamed("bits", "wanted")
    found = _recovered(blocks.select("vid", "span", "shard", "block").join(touched, ["vid", "span"]), ["vid", "span"], partial=True)
    both = need.join(found, ["vid", "span", "shard"])
    pieces = both.select("request", "size", F.struct("at", F.hex(F.substring(F.col("block"), (F.col("from") + 1).cast("int"), F.col("n").cast("int"))).alias("hex")).alias("p"))
    whole = pieces.groupBy("request", "size").agg(F.array_sort(F.collect_list("p")).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), ""))
    return whole.select("request", "size", data.alias("data")).where(F.octet_length("data") == F.col("size")).select("request", "data")


def lookup(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """Fourteen rows for each wanted volume: the nodes (in order) that hold each shard, '' where none does."""
    held = shards.groupBy("vid", "shard").agg(F.array_join(F.transform(F.array_sort(F.collect_set("node")), lambda n: n.cast("string")), ",").alias("nodes"))
    every = wanted.select("vid").distinct().select("vid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(TOTAL - 1).cast("bigint"))).alias("shard"))
    return every.join(held, ["vid", "shard"], "left").withColumn("nodes", F.coalesce("nodes", F.lit("")))


def read_plan(stretches: DataFrame, shards: DataFrame, node: int) -> DataFrame:
    """Stretches (vid, shard, ...) with where to read them from a node: its own shard, another node's, or by rebuilding."""
    shards = shards.repartition("vid")  # as in shard_bits; both groupings below keep it
    held = shards.groupBy("vid", "shard").agg(F.bool_or(F.col("node") == node).alias("__own"), F.min("node").alias("__other"))
    whole = shards.groupBy("vid").agg((F.countDistinct("shard") >= DATA).alias("__enough"))
    at = stretches.join(held, ["vid", "shard"], "left").join(whole, "vid", "left")
    plan = F.when(F.col("__own"), "local").when(F.col("__other").isNotNull(), "remote").when(F.col("__enough"), "rebuild").otherwise("lost")
    return at.withColumn("plan", plan).withColumn("from_node", F.when(F.col("__own"), F.lit(node).cast("bigint")).otherwise(F.col("__other"))).drop("__own", "__other", "__enough")
