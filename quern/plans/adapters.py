"""The driver's tables seen as the store's entities, each with the same projection in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def needle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "del").otherwise("put")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("vid"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.floor(F.col("value") * 100).cast("bigint").alias("size"))


NEEDLE_LOG = "needle_log AS (SELECT user_id % 16 AS vid, user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op, CAST(floor(value * 100) AS BIGINT) AS size FROM events)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), (F.col("event_id") * 37 % 5000).alias("offset"), (F.floor("value") + 1).cast("bigint").alias("size"), F.col("event_id").alias("fid"))


CHUNKS = "chunks AS (SELECT user_id AS file, event_id AS pos, (event_id * 37) % 5000 AS \"offset\", CAST(1 + floor(value) AS BIGINT) AS size, event_id AS fid FROM events)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    both = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("r_name").alias("dc"), F.col("n_name").alias("rack"), F.col("s_suppkey").alias("node"), (F.lit(28) + F.col("s_suppkey") % 17).alias("slots"))


NODES = "nodes AS (SELECT r_name AS dc, n_name AS rack, s_suppkey AS node, 28 + s_suppkey % 17 AS slots FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of each volume; the second falls on the same node now and then, as after a failed copy."""
    count = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(count))
    rows = rows.select("*", F.explode(F.array(F.col("c_custkey") % F.col("n"), (F.col("c_custkey") * 7 + 1) % F.col("n"))).alias("node"))
    return rows.select(F.col("c_mktsegment").alias("collection"), F.col("c_custkey").alias("vid"), "node", F.floor(F.abs("c_acctbal")).cast("bigint").alias("size"), (F.col("c_nationkey") % 5 == 0).alias("read_only"))


REPLICAS = """numbered AS (SELECT *, (SELECT count(*) FROM supplier) AS n FROM customer),
replicas AS (SELECT c_mktsegment AS collection, c_custkey AS vid, node, CAST(floor(abs(c_acctbal)) AS BIGINT) AS size, c_nationkey % 5 = 0 AS read_only
  FROM (SELECT *, unnest([c_custkey % n, (c_custkey * 7 + 1) % n]) AS node FROM numbered))"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as entries of a namespace: host and path of the url without query and fragment."""
    path = F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1))
    return table(spark, sf_dir, "pages").select(F.regexp_replace(path, "/$", "").alias("path")).distinct()


PATHS = "paths AS (SELECT DISTINCT regexp_replace('/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/$', '') AS path FROM pages)"
TREE = """ups AS (SELECT path AS leaf, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM paths),
dirs AS (SELECT DISTINCT '/' || array_to_string(parts[1:i], '/') AS path FROM ups, LATERAL (SELECT unnest(range(0, len(parts))) AS i)),
tree AS (SELECT path, true AS is_directory FROM dirs UNION ALL SELECT path, false FROM paths WHERE path NOT IN (SELECT path FROM dirs))"""


def shards(spark: SparkSession, sf_dir: str, step: int = 5) -> DataFrame:
    """Shards of the volumes that customers stand for, some of them lost."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"), F.explode(F.sequence(F.lit(0), F.lit(13))).alias("shard"))
    return rows.where((F.col("vid") * 7 + F.col("shard") * (F.col("vid") % 3 + 1)) % step != 0).withColumn("shard", F.col("shard").cast("bigint"))


def shards_sql(name: str, step: int = 5) -> str:
    return f"{name} AS (SELECT vid, shard FROM (SELECT c_custkey AS vid, unnest(range(0, 14)) AS shard FROM customer) WHERE (vid * 7 + shard * (vid % 3 + 1)) % {step} <> 0)"
