"""Operators over an append-only key log: (vid, key, seq, op, size[, ...]).

``op`` is 'put' or 'del' and ``seq`` gives the order; a key's state is its last
row. Everything aggregates on (vid, key) or runs along bounded stretches of a
volume, so a volume with a third of all rows fills many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import codecs

#: Rows of a volume summed in one task by ``running_sum``.
STRETCH = 65_536
GARBAGE_THRESHOLD = 0.3


def latest(log: DataFrame) -> DataFrame:
    """Last row of every key, tombstones included."""
    rest = [c for c in log.columns if c not in ("vid", "key")]
    last = log.groupBy("vid", "key").agg(F.max_by(F.struct(*rest), "seq").alias("last"))
    return last.select("vid", "key", "last.*")


def live(log: DataFrame) -> DataFrame:
    """Replay: the keys whose last row is a put."""
    return latest(log).where("op = 'put'")


def metrics(log: DataFrame) -> DataFrame:
    """Counters of each volume: files and bytes written, those since overwritten or deleted, the largest key."""
    by_key = Window.partitionBy("vid", "key").orderBy("seq")
    before = log.withColumn("prev_op", F.lag("op").over(by_key)).withColumn("prev_size", F.lag("size").over(by_key))
    put, lost = F.col("op") == "put", F.col("prev_op") == "put"
    return before.groupBy("vid").agg(
        F.count(F.when(put, 1)).alias("file_count"),
        F.coalesce(F.sum(F.when(put, F.col("size"))), F.lit(0)).alias("file_bytes"),
        F.count(F.when(lost, 1)).alias("deleted_count"),
        F.coalesce(F.sum(F.when(lost, F.col("prev_size"))), F.lit(0)).alias("deleted_bytes"),
        F.max("key").alias("max_key"),
    )


def garbage(log: DataFrame) -> DataFrame:
    """Share of each volume's bytes that no key points at."""
    ratio = F.when(F.col("file_bytes") == 0, F.lit(0.0)).otherwise(F.col("deleted_bytes") / F.col("file_bytes"))
    return metrics(log).select("vid", "file_bytes", "deleted_bytes", ratio.alias("garbage_ratio"))


def vacuum_candidates(log: DataFrame, threshold: float = GARBAGE_THRESHOLD) -> DataFrame:
    return garbage(log).where(F.col("garbage_ratio") > threshold)


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, stretch: int = STRETCH) -> DataFrame:
    """Exclusive running sum of ``value`` along ``order`` (a whole number) within ``keys``.

    Stretches of ``order`` are summed apart; only one row for each stretch is
    put in order across a key.
    """
    cut = df.withColumn("__stretch", F.floor(F.col(order) / stretch)).withColumn("__value", value.cast("bigint"))
    across = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy(*keys, "__stretch").agg(F.sum("__value").alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(across), F.lit(0))).drop("__sum")
    within = Window.partitionBy(*keys, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("__own", F.coalesce(F.sum("__value").over(within), F.lit(0))).join(bases, [*keys, "__stretch"]).withColumn(name, F.col("__base") + F.col("__own")).drop("__stretch", "__value", "__own", "__base")


def append_offsets(log: DataFrame) -> DataFrame:
    """Where each record lies in its volume's data log; a tombstone is a record without body."""
    size = F.when(F.col("op") == "put", F.col("size")).otherwise(0)
    placed = running_sum(log, ["vid"], "seq", codecs.actual_size(size), "offset")
    return placed.withColumn("offset", F.col("offset") + codecs.SUPER_BLOCK_BYTES)


def compacted(log: DataFrame, keep: Column | None = None) -> DataFrame:
    """Live records in log order with their place in the compacted data log; ``keep`` drops expired ones."""
    rows = live(log)
    rows = rows if keep is None else rows.where(keep)
    placed = running_sum(rows, ["vid"], "seq", codecs.actual_size(F.col("size")), "new_offset")
    return placed.withColumn("new_offset", F.col("new_offset") + codecs.SUPER_BLOCK_BYTES)


def caught_up(log: DataFrame, watermark: int) -> DataFrame:
    """A compaction of all rows before ``watermark`` brought up to date with those after it."""
    base, since = latest(log.where(F.col("seq") < watermark)), latest(log.where(F.col("seq") >= watermark))
    touched = since.select("vid", "key")
    return base.where("op = 'put'").join(touched, ["vid", "key"], "left_anti").unionByName(since.where("op = 'put'"))


def is_expired(ttl: Column, modified: Column, now: Column) -> Column:
    """Whether a record's minutes are over; records without a TTL or a time stay."""
    return F.coalesce((ttl > 0) & modified.isNotNull() & (now >= modified + ttl * 60), F.lit(False))


def volume_expired(ttl: Column, modified: Column, now: Column, used: Column) -> Column:
    return F.coalesce((ttl > 0) & (used > 0) & (now > modified + ttl * 60), F.lit(False))


def removable(ttl: Column, modified: Column, now: Column, most: int = 10) -> Column:
    """Expired for a tenth of its TTL, ten minutes at most: the volume itself may go."""
    delay = F.least(F.floor(ttl / 10), F.lit(most))
    return F.coalesce((ttl > 0) & ((ttl + delay) * 60 + modified < now), F.lit(False))


def lookup(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests (vid, key, ...) with the live record they name; ``found`` says whether there is one."""
    known = live(log).select("vid", "key", F.col("seq").alias("live_seq"), F.col("size").alias("live_size"))
    return requests.join(known, ["vid", "key"], "left").withColumn("found", F.col("live_seq").isNotNull())


def fold_journal(index: DataFrame, journal: DataFrame) -> DataFrame:
    """A sorted index (vid, key, offset, size) with the journal's (vid, key) deletions applied; unknown keys are ignored."""
    gone = journal.select("vid", "key").distinct().withColumn("__gone", F.lit(True))
    return index.join(gone, ["vid", "key"], "left").withColumn("size", F.when(F.col("__gone"), F.lit(codecs.TOMBSTONE).cast("bigint")).otherwise(F.col("size"))).drop("__gone")


def sorted_index(log: DataFrame) -> DataFrame:
    """Live keys with their places, sorted by volume and key along all partitions, so a large volume fills many."""
    placed = append_offsets(log)
    newest = placed.groupBy("vid", "key").agg(F.max_by(F.struct("op", "offset", "size"), "seq").alias("x")).where("x.op = 'put'")
    return newest.select("vid", "key", "x.offset", "x.size").repartitionByRange("vid", "key").sortWithinPartitions("vid", "key")


def status(log: DataFrame) -> DataFrame:
    """The counters of each volume, with the bytes of its data log."""
    size = F.when(F.col("op") == "put", F.col("size")).otherwise(0)
    ends = log.groupBy("vid").agg((F.sum(codecs.actual_size(size)) + codecs.SUPER_BLOCK_BYTES).alias("data_bytes"))
    return metrics(log).join(ends, "vid")


def journalled(index: DataFrame, journal: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vid, key): the journal rows that deleting wanted keys from a sorted index adds: those that it has and that aren't deleted yet."""
    known = wanted.select("vid", "key").distinct().join(index.select("vid", "key"), ["vid", "key"], "left_semi")
    return known.join(journal.select("vid", "key"), ["vid", "key"], "left_anti")


def violations(placed: DataFrame, data_ends: DataFrame) -> DataFrame:
    """Index rows (vid, key, offset, size) that reach beyond the end (vid, data_end) of their volume's data log, or whose volume has none."""
    end = F.col("offset") + codecs.actual_size(F.greatest("size", F.lit(0)))
    joined = placed.join(data_ends, "vid", "left")
    return joined.where(F.col("data_end").isNull() | (end > F.col("data_end"))).select("vid", "key", "offset", "size")
