"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    Only where it is unset and the master is this machine alone (tests) a local
    folder is chosen and set, since then there is no other machine to share
    with; on a cluster a folder must be named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/quern-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage and survives lost executors: what is read later lies in
    the shared store, not on the executors. What was written is removed when
    the driver's Python ends, or before by ``removed``.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def removed(table: DataFrame | None) -> None:
    """Remove a table from ``written`` that nothing reads any more."""
    if table is not None and (path := getattr(table, "_written_at", None)):
        _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def measured(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """``df`` to be broadcast if the sum of ``size`` over its rows, counted first, is within ``limit`` bytes.

    Beyond the limit the join that uses it shuffles as any other.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): extra columns go, a null text counts as empty."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def batch_count(docs: DataFrame, batch_bytes: int, text_col: str = "text") -> int:
    """How many batches of about ``batch_bytes`` bytes of text the input makes."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, math.ceil(total / batch_bytes))
