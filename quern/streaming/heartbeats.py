"""Cluster state from a stream of heartbeats, and other loops over streams.

A heartbeat is (node, ts, vids): all volumes that a node holds at a time. The
state (node, vid) lives in Parquet tables, in parts by a hash of the node; every
micro-batch takes each node's last snapshot, rewrites the parts of these nodes,
and gives what came and went. Nodes that stay silent are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import keylog
from quern.operators.topology import apply_delta, snapshot_diff

STATE = "node bigint, vid bigint, ts bigint"
#: Parts of the state; a micro-batch rewrites those of the nodes that it hears from.
PARTS = 64


def apply_snapshots(state: DataFrame, beats: DataFrame, silent: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(new state, changes) of a batch of heartbeats; nodes that sent none keep their volumes.

    With ``silent``, nodes whose last heartbeat is longer ago than that, counted
    back from the newest of the batch, lose them.
    """
    last = beats.groupBy("node").agg(F.max_by("vids", "ts").alias("vids"), F.max("ts").alias("ts"))
    now = last.select("node", F.explode("vids").alias("vid"), "ts").dropDuplicates(["node", "vid"])
    heard = last.select("node")
    if silent is not None:
        newest = beats.agg(F.max("ts").alias("__newest"))
        heard = heard.union(state.join(F.broadcast(newest)).where(F.col("ts") < F.col("__newest") - silent).select("node")).distinct()
    before = state.join(heard, "node", "left_semi")
    return apply_delta(state, now, before, ["node", "vid"]), snapshot_diff(before, now, ["node", "vid"])


def _part(parts: int):
    return F.pmod(F.hash("node"), F.lit(parts))


def follow(beats: DataFrame, folder: str, checkpoint: str, silent: int | None = None, parts: int = PARTS) -> StreamingQuery:
    """Keep the state of a heartbeat stream in ``folder``/state/<part>/<version>, changes in ``folder``/changes.

    A micro-batch writes the parts it touches under its number, so a batch that
    runs again after a failure writes the same again; of each part the version
    before is kept for that, and older ones are removed. With ``silent`` every
    part is looked through for nodes that no longer send.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = None if silent is not None else sorted(r[0] for r in batch.select(_part(parts)).distinct().collect())  # PARTS at most
        if touched == []:
            return
        state = _state(spark, folder, number, touched)
        new, changes = apply_snapshots(state, batch, silent)
        changes.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
        rows = new.withColumn("part", _part(parts)).withColumn("version", F.lit(number))
        if touched is None:
            touched = sorted(_versions(spark, folder) | dict.fromkeys(r[0] for r in batch.select(_part(parts)).distinct().collect()))
        marks = spark.createDataFrame([(None, None, None, p, number) for p in touched], f"{STATE}, part int, version bigint")  # a part without nodes has a version too
        rows.unionByName(marks).repartition("part").write.partitionBy("part", "version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/state")
        for part, versions in _versions(spark, folder).items():
            for old in [v for v in versions if v < number][:-1]:
                _path(spark, f"{folder}/state/part={part}/version={old}", delete=True)

    return beats.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, name: str, delete: bool = False) -> list[str]:
    """Names in a folder, none if it isn't there; or the folder removed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if delete:
        system.delete(path, True)
        return []
    return [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []


def _versions(spark: SparkSession, folder: str) -> dict[int, list[int]]:
    """Versions of each part, in order."""
    told = lambda names, key: sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{key}="))
    return {p: told(_path(spark, f"{folder}/state/part={p}"), "version") for p in told(_path(spark, f"{folder}/state"), "part")}


def _state(spark: SparkSession, folder: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
    newest = {p: [v for v in versions if before is None or v < before][-1:] for p, versions in _versions(spark, folder).items() if parts is None or p in parts}
    paths = [f"{folder}/state/part={p}/version={v[0]}" for p, v in newest.items() if v]
    if not paths:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(*paths).where("node IS NOT NULL")


def read_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest state (node, vid), or the one before a batch; empty if there is none."""
    return _state(spark, folder, before).select("node", "vid")


def live_keys(log: DataFrame) -> DataFrame:
    """Streaming replay of a key log (vid, key, seq, op, size): after each batch the newest row of the keys it touched."""
    last = log.groupBy("vid", "key").agg(F.max_by(F.struct("seq", "op", "size"), "seq").alias("last"))
    return last.select("vid", "key", "last.*")


def vacuum_loop(ticks: DataFrame, read_log: Callable[[], DataFrame], folder: str, checkpoint: str, threshold: float = keylog.GARBAGE_THRESHOLD) -> StreamingQuery:
    """At each tick of a stream, compact the volumes whose garbage is above ``threshold``.

    The compacted records of a round are written to ``folder``/batch=<number>
    as a whole, a volume's rows under vid=<vid>; whoever reads the volumes takes
    the newest that has one.
    """

    def step(batch: DataFrame, number: int) -> None:
        log = read_log()
        chosen = log.join(keylog.vacuum_candidates(log, threshold).select("vid"), "vid", "left_semi")
        keylog.compacted(chosen).write.partitionBy("vid").mode("overwrite").parquet(f"{folder}/batch={number}")

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deletion_loop(queue: DataFrame, read_log: Callable[[], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Append tombstones for the chunks (vid, key) that a queue names, once each, to ``folder``/batch=<number>."""
    from quern.operators import objects

    def step(batch: DataFrame, number: int) -> None:
        objects.tombstones(objects.delete(read_log(), batch)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return queue.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(beats: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches in which a node kept reporting; a stretch is final once the watermark passes it."""
    return beats.withWatermark("ts", late).groupBy("node", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("beats")).select("node", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "beats")
