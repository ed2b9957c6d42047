"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import removed, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each linked id can reach; nulls link nothing.

    Alternating large-star and small-star rounds: each is an aggregation and a
    join over the edges, edges never leave Spark, and a long chain shrinks by a
    constant factor a round. Every round is written to the shared folder.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    before = None
    while True:
        # Large star: of every id, link its larger neighbours to its smallest neighbour or itself.
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: of every id, link its smaller neighbours and itself to the smallest.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(low.select("hi", F.col("m").alias("lo"))).distinct()
        last, now = now, written(small, "components")
        removed(last)
        # Settled once every id has one smaller neighbour which has none: sum and count stay as they are.
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("hi", "lo").cast("bigint"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
        before = state
