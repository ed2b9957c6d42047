"""Operators over the byte ranges of files: chunks (file, pos, offset, size, fid), later ``pos`` over earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.keylog import running_sum

#: Bytes of a file that are resolved together.
BUCKET = 1 << 20


def _runs(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring stretches of one chunk within ``keys`` put together."""
    line = Window.partitionBy(*keys).orderBy("start")
    fresh = F.coalesce((F.lag("stop").over(line) < F.col("start")) | (F.lag("fid").over(line) != F.col("fid")), F.lit(True))
    runs = stretches.withColumn("run", F.sum(fresh.cast("bigint")).over(line))
    return runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("fid").alias("fid"), F.first("offset").alias("offset")).drop("run")


def visible(chunks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(file, start, stop, fid, chunk_offset): which chunk shows at each byte, and where in the chunk that byte is.

    Chunks are cut at bucket borders, so a large or hot file is resolved by many
    tasks; within a bucket each stretch between neighbouring borders belongs to
    the last chunk over it, and stretches of one chunk are put together again.
    Only the two that touch a bucket's borders are put together along a file.
    """
    ends = chunks.where("size > 0").withColumn("stop", F.col("offset") + F.col("size"))
    cut = ends.select("*", F.explode(F.sequence(F.floor(F.col("offset") / bucket), F.floor((F.col("stop") - 1) / bucket))).alias("bucket"))
    cut = cut.withColumn("lo", F.greatest(F.col("offset"), F.col("bucket") * bucket)).withColumn("hi", F.least(F.col("stop"), (F.col("bucket") + 1) * bucket))
    borders = cut.select("file", "bucket", F.explode(F.array("lo", "hi")).alias("start")).distinct()
    here = Window.partitionBy("file", "bucket").orderBy("start")
    pieces = borders.withColumn("stop", F.lead("start").over(here)).where("stop IS NOT NULL")
    over = cut.select("file", "bucket", "lo", "hi", "pos", "fid", "offset")
    won = pieces.join(over, ["file", "bucket"]).where((F.col("lo") <= F.col("start")) & (F.col("hi") >= F.col("stop")))
    won = won.groupBy("file", "bucket", "start", "stop").agg(F.max_by(F.struct("fid", "offset"), "pos").alias("x")).select("file", "bucket", "start", "stop", "x.fid", "x.offset")
    runs = _runs(won, ["file", "bucket"])
    edge = (F.col("start") == F.col("bucket") * bucket) | (F.col("stop") == (F.col("bucket") + 1) * bucket)
    out = runs.where(~edge).drop("bucket").unionByName(_runs(runs.where(edge).drop("bucket"), ["file"]))
    return out.select("file", "start", "stop", "fid", (F.col("start") - F.col("offset")).alias("chunk_offset"))


def range_view(chunks: DataFrame, offset: int, size: int, bucket: int = BUCKET) -> DataFrame:
    """What ``view`` gives of all visible stretches, resolved from the chunks that reach into the range only."""
    near = chunks.where((F.col("offset") < offset + size) & (F.col("offset") + F.col("size") > offset))
    return view(visible(near, bucket), offset, size)


def view(shown: DataFrame, offset: int, size: int) -> DataFrame:
    """The visible stretches inside a range of every file, cut to it; holes are simply not there."""
    end = offset + size
    inside = shown.where((F.col("start") < end) & (F.col("stop") > offset))
    start = F.greatest("start", F.lit(offset).cast("bigint"))
    return inside.select("file", start.alias("start"), F.least("stop", F.lit(end).cast("bigint")).alias("stop"), "fid", (F.col("chunk_offset") + start - F.col("start")).alias("chunk_offset"))


def compact(chunks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Chunks marked by whether any byte of theirs still shows."""
    seen = visible(chunks, bucket).select("file", "fid").distinct().withColumn("shown", F.lit(True))
    return chunks.join(seen, ["file", "fid"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))


def unused(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of the old version that the new one no longer has."""
    return old.join(new.select("fid").distinct(), "fid", "left_anti")


def file_sizes(chunks: DataFrame) -> DataFrame:
    """A file ends where its furthest chunk does."""
    return chunks.groupBy("file").agg(F.max(F.col("offset") + F.col("size")).alias("file_size"))


def appended(chunks: DataFrame) -> DataFrame:
    """Offsets of chunks appended one after another in the order of ``pos``."""
    return running_sum(chunks, ["file"], "pos", F.col("size"), "append_offset")


def split(files: DataFrame, size: int) -> DataFrame:
    """(file, part, offset, length): the chunks that a body of ``length`` bytes is uploaded in."""
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("length") / size) - 1))
    cut = files.where("length > 0").select("file", "length", parts.alias("part"))
    return cut.select("file", "part", (F.col("part") * size).alias("offset"), F.least(F.lit(size).cast("bigint"), F.col("length") - F.col("part") * size).alias("length"))
