"""The query catalogue: name -> callable, and the oracle SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import codecs
from quern.operators import chunks as ch
from quern.operators import erasure, keylog, namespace, topology
from quern.plans import adapters as ad

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- the key log ---------------------------------------------------------------------------------------------------

LATEST = f"WITH {ad.NEEDLE_LOG}, latest AS (SELECT * FROM needle_log QUALIFY row_number() OVER (PARTITION BY vid, key ORDER BY seq DESC) = 1)"
_ACTUAL = "(size + 20 + 8 - (size + 20) % 8)"


@query(f"{LATEST} SELECT vid, key, seq, size FROM latest WHERE op = 'put'")
def needle_live(spark, sf_dir):
    return keylog.live(ad.needle_log(spark, sf_dir)).select("vid", "key", "seq", "size")


METRICS = f"""WITH {ad.NEEDLE_LOG}, before AS (SELECT *, lag(op) OVER w AS prev_op, lag(size) OVER w AS prev_size FROM needle_log WINDOW w AS (PARTITION BY vid, key ORDER BY seq)),
metrics AS (SELECT vid, count(*) FILTER (op = 'put') AS file_count, CAST(coalesce(sum(size) FILTER (op = 'put'), 0) AS BIGINT) AS file_bytes,
  count(*) FILTER (prev_op = 'put') AS deleted_count, CAST(coalesce(sum(prev_size) FILTER (prev_op = 'put'), 0) AS BIGINT) AS deleted_bytes, max(key) AS max_key FROM before GROUP BY vid),
garbage AS (SELECT vid, file_bytes, deleted_bytes, CASE WHEN file_bytes = 0 THEN 0.0 ELSE CAST(deleted_bytes AS DOUBLE) / file_bytes END AS garbage_ratio FROM metrics)"""


@query(f"{METRICS} SELECT * FROM metrics")
def needle_metrics(spark, sf_dir):
    return keylog.metrics(ad.needle_log(spark, sf_dir))


@query(f"{METRICS} SELECT * FROM garbage")
def garbage_ratio(spark, sf_dir):
    return keylog.garbage(ad.needle_log(spark, sf_dir))


@query(f"{METRICS} SELECT * FROM garbage WHERE garbage_ratio > 0.3")
def vacuum_candidates(spark, sf_dir):
    return keylog.vacuum_candidates(ad.needle_log(spark, sf_dir))


@query(f"WITH {ad.NEEDLE_LOG}, sized AS (SELECT vid, key, seq, op, CASE WHEN op = 'put' THEN size ELSE 0 END AS size FROM needle_log) SELECT vid, key, seq, CAST(8 + coalesce(sum({_ACTUAL}) OVER (PARTITION BY vid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_offset FROM sized")
def log_offsets(spark, sf_dir):
    return keylog.append_offsets(ad.needle_log(spark, sf_dir)).select("vid", "key", "seq", F.col("offset").alias("data_offset"))


@query(f"{LATEST} SELECT vid, key, seq, size, CAST(8 + coalesce(sum({_ACTUAL}) OVER (PARTITION BY vid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset FROM latest WHERE op = 'put'")
def compact_offsets(spark, sf_dir):
    return keylog.compacted(ad.needle_log(spark, sf_dir)).select("vid", "key", "seq", "size", "new_offset")


@query(f"""WITH {ad.NEEDLE_LOG}, mark AS (SELECT max(seq) // 2 AS m FROM needle_log),
base AS (SELECT * FROM needle_log, mark WHERE seq < m QUALIFY row_number() OVER (PARTITION BY vid, key ORDER BY seq DESC) = 1),
since AS (SELECT * FROM needle_log, mark WHERE seq >= m QUALIFY row_number() OVER (PARTITION BY vid, key ORDER BY seq DESC) = 1)
SELECT vid, key, seq, size FROM since WHERE op = 'put' UNION ALL SELECT vid, key, seq, size FROM base b WHERE op = 'put' AND NOT EXISTS (SELECT 1 FROM since s WHERE s.vid = b.vid AND s.key = b.key)""")
def compact_catchup(spark, sf_dir):
    log = ad.needle_log(spark, sf_dir)
    return keylog.caught_up(log, (log.agg(F.max("seq")).first()[0] or 0) // 2).select("vid", "key", "seq", "size")


_TTL = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1440 WHEN 'signup' THEN 10080 ELSE 44640 END"


def _timed(spark, sf_dir):
    kind = F.col("event_type")
    ttl = F.when(kind == "click", 0).when(kind == "view", 1440).when(kind == "signup", 10080).otherwise(44640).cast("bigint")
    return ad.table(spark, sf_dir, "events").select("event_id", "user_id", "value", ttl.alias("ttl"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("modified"))


_TIMED = f"timed AS (SELECT event_id, user_id, value, CAST({_TTL} AS BIGINT) AS ttl, CAST(floor(epoch(ts)) AS BIGINT) AS modified FROM events), clock AS (SELECT max(modified) AS now_s FROM timed)"


@query(f"WITH {_TIMED} SELECT event_id, ttl, ttl > 0 AND now_s >= modified + ttl * 60 AS expired FROM timed, clock")
def ttl_expired(spark, sf_dir):
    rows = _timed(spark, sf_dir)
    now = F.lit(rows.agg(F.max("modified")).first()[0])
    return rows.select("event_id", "ttl", keylog.is_expired(F.col("ttl"), F.col("modified"), now).alias("expired"))


@query(f"""WITH {_TIMED}, volumes AS (SELECT user_id % 16 AS vid, ttl, max(modified) AS modified, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS used FROM timed GROUP BY ALL)
SELECT vid, ttl, used, ttl > 0 AND used > 0 AND now_s > modified + ttl * 60 AS expired, ttl > 0 AND (ttl + least(ttl // 10, 10)) * 60 + modified < now_s AS removable FROM volumes, clock""")
def volume_expired(spark, sf_dir):
    rows = _timed(spark, sf_dir)
    now = F.lit(rows.agg(F.max("modified")).first()[0])
    volumes = rows.groupBy((F.col("user_id") % 16).alias("vid"), "ttl").agg(F.max("modified").alias("modified"), F.sum(F.floor("value").cast("bigint")).alias("used"))
    ttl, modified = F.col("ttl"), F.col("modified")
    return volumes.select("vid", "ttl", "used", keylog.volume_expired(ttl, modified, now, F.col("used")).alias("expired"), keylog.removable(ttl, modified, now).alias("removable"))


@query(f"{LATEST} SELECT o_orderkey AS request, o_custkey % 16 AS vid, o_custkey AS key, l.seq AS live_seq, l.size AS live_size, l.seq IS NOT NULL AS found FROM orders LEFT JOIN (SELECT * FROM latest WHERE op = 'put') l ON l.vid = o_custkey % 16 AND l.key = o_custkey")
def point_lookup(spark, sf_dir):
    asked = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 16).alias("vid"), F.col("o_custkey").alias("key"))
    return keylog.lookup(asked, ad.needle_log(spark, sf_dir)).select("request", "vid", "key", "live_seq", "live_size", "found")


_SORTED = f"""{LATEST}, sized AS (SELECT vid, key, seq, op, CASE WHEN op = 'put' THEN size ELSE 0 END AS size FROM needle_log),
placed AS (SELECT vid, key, seq, CAST(8 + coalesce(sum({_ACTUAL}) OVER (PARTITION BY vid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_offset FROM sized),
sorted AS (SELECT l.vid, l.key, p.data_offset, l.size FROM latest l JOIN placed p USING (vid, seq) WHERE l.op = 'put')"""


@query(f"{_SORTED} SELECT * FROM sorted")
def ecx_sorted(spark, sf_dir):
    return keylog.sorted_index(ad.needle_log(spark, sf_dir)).withColumnRenamed("offset", "data_offset")


@query(f"{_SORTED} SELECT vid, key, data_offset, CASE WHEN key % 4 = 1 THEN -1 ELSE size END AS size FROM sorted")
def ecj_fold(spark, sf_dir):
    index = keylog.sorted_index(ad.needle_log(spark, sf_dir))
    gone = ad.needle_log(spark, sf_dir).where("key % 4 = 1").select("vid", "key")
    return keylog.fold_journal(index, gone).select("vid", "key", F.col("offset").alias("data_offset"), "size")


@query(f"WITH {ad.NEEDLE_LOG} SELECT vid, max(data_end) AS data_size FROM (SELECT vid, op, CAST(8 + sum({_ACTUAL}) OVER (PARTITION BY vid ORDER BY seq) AS BIGINT) AS data_end FROM (SELECT vid, seq, op, CASE WHEN op = 'put' THEN size ELSE 0 END AS size FROM needle_log)) GROUP BY vid")
def ec_data_size(spark, sf_dir):
    placed = keylog.append_offsets(ad.needle_log(spark, sf_dir))
    size = F.when(F.col("op") == "put", F.col("size")).otherwise(0)
    return placed.groupBy("vid").agg(F.max(F.col("offset") + codecs.actual_size(size)).alias("data_size"))


# --- codecs --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey % 97 || ',' || lower(to_hex(o_orderkey * 1000003 + 17)) || lpad(lower(to_hex((o_custkey * 2654435 + 99) % 4294967296)), 8, '0') AS fid, o_custkey % 97 AS vid, CAST(o_orderkey * 1000003 + 17 AS BIGINT) AS key, (o_custkey * 2654435 + 99) % 4294967296 AS cookie FROM orders")
def fid_roundtrip(spark, sf_dir):
    fid = codecs.format_fid(F.col("o_custkey") % 97, F.col("o_orderkey") * 1000003 + 17, (F.col("o_custkey") * 2654435 + 99) % 4294967296)
    rows = ad.table(spark, sf_dir, "orders").select("o_orderkey", fid.alias("fid"))
    parsed = codecs.parse_fid(F.col("fid"))
    return rows.select("o_orderkey", "fid", parsed["vid"].alias("vid"), parsed["key"].cast("bigint").alias("key"), parsed["cookie"].alias("cookie"))


_TEXTS = "SELECT l_orderkey, l_linenumber, l_partkey || CASE l_linenumber % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN ',x' ELSE ',0' END || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || CASE l_linenumber % 3 WHEN 0 THEN '_2' ELSE '' END AS fid FROM lineitem"


@query(f"SELECT fid, count(*) AS n, regexp_matches(fid, '^[0-9]{{1,10}},[0-9a-fA-F]{{9,24}}(_[0-9]+)?$') AS valid FROM ({_TEXTS}) GROUP BY fid")
def fid_parse_invalid(spark, sf_dir):
    line = F.col("l_linenumber")
    sign = F.when(line % 4 == 0, ",").when(line % 4 == 1, ";").when(line % 4 == 2, ",x").otherwise(",0")
    fid = F.concat(F.col("l_partkey").cast("string"), sign, F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.when(line % 3 == 0, "_2").otherwise(""))
    return ad.table(spark, sf_dir, "lineitem").groupBy(fid.alias("fid")).agg(F.count(F.lit(1)).alias("n")).withColumn("valid", codecs.parse_fid(F.col("fid"))["vid"].isNotNull())


@query("SELECT page_id, CAST(page_id % 50 AS BIGINT) AS vid, lower(to_hex(page_id + 4096)) || '0000abcd' AS fid, CASE WHEN page_id % 2 = 0 THEN 'n' || page_id ELSE '' END AS name, CASE WHEN page_id % 3 = 0 THEN '.html' ELSE '' END AS ext FROM pages")
def url_parts(spark, sf_dir):
    page = F.col("page_id")
    path = F.concat(F.lit("/"), (page % 50).cast("string"), F.lit(","), F.lower(F.hex(page + 4096)), F.lit("0000abcd"), F.when(page % 2 == 0, F.concat(F.lit("/n"), page.cast("string"))).otherwise(""), F.when(page % 3 == 0, ".html").otherwise(""))
    parts = codecs.parse_object_url(F.col("path"))
    return ad.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", *(c.alias(n) for n, c in parts.items()))


_EXT = "coalesce(regexp_extract(path, '[^/]\\.([^./]+)$', 1), '')"


@query(f"WITH {ad.PATHS} SELECT path, {_EXT} AS ext, CASE {_EXT} WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'txt' THEN 'text/plain' WHEN 'css' THEN 'text/css' WHEN 'js' THEN 'application/javascript' WHEN 'json' THEN 'application/json' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'pdf' THEN 'application/pdf' WHEN 'gz' THEN 'application/gzip' ELSE 'application/octet-stream' END AS mime, string_split(path, '/')[-1] AS name FROM paths")
def mime_guess(spark, sf_dir):
    ext = codecs.extension(F.col("path"))
    return ad.paths(spark, sf_dir).select("path", ext.alias("ext"), codecs.mime_type(ext).alias("mime"), codecs.file_name(F.col("path")).alias("name"))


_UNITS = "['', 'm', 'h', 'd', 'w', 'M', 'y', 'x']"


@query(f"""SELECT ttl, n, CASE WHEN unit = 'x' OR number > 255 THEN NULL ELSE number * CASE unit WHEN 'h' THEN 60 WHEN 'd' THEN 1440 WHEN 'w' THEN 10080 WHEN 'M' THEN 44640 WHEN 'y' THEN 525600 ELSE 1 END END AS minutes,
CASE WHEN unit = 'x' OR number > 255 THEN NULL WHEN number = 0 THEN 0 ELSE number * 256 + CASE unit WHEN 'h' THEN 2 WHEN 'd' THEN 3 WHEN 'w' THEN 4 WHEN 'M' THEN 5 WHEN 'y' THEN 6 ELSE 1 END END AS code
FROM (SELECT CAST(l_quantity AS BIGINT) * 7 AS number, {_UNITS}[1 + l_linenumber % 8] AS unit, CAST(CAST(l_quantity AS BIGINT) * 7 AS VARCHAR) || {_UNITS}[1 + l_linenumber % 8] AS ttl, count(*) AS n FROM lineitem GROUP BY ALL)""")
def ttl_parse(spark, sf_dir):
    unit = F.element_at(F.array(*(F.lit(x) for x in ("", "m", "h", "d", "w", "M", "y", "x"))), F.col("l_linenumber") % 8 + 1)
    text = F.concat((F.col("l_quantity").cast("bigint") * 7).cast("string"), unit)
    rows = ad.table(spark, sf_dir, "lineitem").groupBy(text.alias("ttl")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("ttl", "n", codecs.ttl_minutes(F.col("ttl")).alias("minutes"), codecs.ttl_code(F.col("ttl")).alias("code"))


@query("SELECT p_partkey, lpad(CAST(p_partkey % 1200 AS VARCHAR), 3, '0') AS placement, CAST(CASE WHEN p_partkey % 1200 < 1000 THEN (p_partkey % 1200) // 100 + (p_partkey % 1200) // 10 % 10 + p_partkey % 10 + 1 ELSE substr(CAST(p_partkey % 1200 AS VARCHAR), 1, 1)::INT + substr(CAST(p_partkey % 1200 AS VARCHAR), 2, 1)::INT + substr(CAST(p_partkey % 1200 AS VARCHAR), 3, 1)::INT + 1 END AS BIGINT) AS copies FROM part")
def replica_parse(spark, sf_dir):
    text = F.lpad((F.col("p_partkey") % 1200).cast("string"), 3, "0")
    return ad.table(spark, sf_dir, "part").select("p_partkey", text.alias("placement"), codecs.replica_copies(text).alias("copies"))


@query("SELECT size, n, 28 - (size + 20) % 8 + size AS actual, 8 - (size + 20) % 8 AS padding, CAST(ceil(size / 8.0) * 8 AS BIGINT) AS aligned FROM (SELECT CAST(floor(l_extendedprice) AS BIGINT) AS size, count(*) AS n FROM lineitem GROUP BY 1)")
def align_sizes(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "lineitem").groupBy(F.floor("l_extendedprice").cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    size = F.col("size")
    return rows.select("size", "n", codecs.actual_size(size).alias("actual"), codecs.padding(size).alias("padding"), codecs.align(size).cast("bigint").alias("aligned"))


@query("SELECT s_suppkey, lower(s_name) || ':' || (8000 + s_suppkey % 100) AS address, lower(s_name) AS host, 8000 + s_suppkey % 100 AS port, 18000 + s_suppkey % 100 AS rpc_port, CAST(list_sum(list_transform(range(0, length(s_name)), lambda i: i * ascii(substr(s_name, i + 1, 1)))) AS BIGINT) AS number, 'c' || s_nationkey || '_' || s_suppkey AS volume FROM supplier")
def node_names(spark, sf_dir):
    address = F.concat(F.lower("s_name"), F.lit(":"), (F.col("s_suppkey") % 100 + 8000).cast("string"))
    parts = codecs.host_port(F.col("address"))
    rows = ad.table(spark, sf_dir, "supplier").withColumn("address", address)
    return rows.select("s_suppkey", "address", *(c.alias(n) for n, c in parts.items()), codecs.node_number(F.col("s_name")).alias("number"), codecs.volume_name(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")), F.col("s_suppkey")).alias("volume"))


@query("SELECT o_orderkey, lpad(lower(to_hex(o_orderkey * 1000003)), 16, '0') || lpad(lower(to_hex(o_custkey * 8 // 8)), 8, '0') || CASE WHEN o_orderstatus = 'F' THEN 'ffffffff' ELSE lpad(lower(to_hex(o_custkey + 7)), 8, '0') END AS entry FROM orders")
def index_entries(spark, sf_dir):
    size = F.when(F.col("o_orderstatus") == "F", F.lit(-1)).otherwise(F.col("o_custkey") + 7).cast("bigint")
    return ad.table(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.hex(codecs.index_entry(F.col("o_orderkey") * 1000003, F.col("o_custkey") * 8, size))).alias("entry"))


# --- topology ------------------------------------------------------------------------------------------------------

USAGE = f"WITH {ad.NODES}, {ad.REPLICAS}, usage AS (SELECT dc, rack, nodes.node, slots, coalesce(volumes, 0) AS volumes, max_vid, slots - coalesce(volumes, 0) AS free FROM nodes LEFT JOIN (SELECT node, count(*) AS volumes, max(vid) AS max_vid FROM replicas GROUP BY node) h ON h.node = nodes.node)"


def _usage(spark, sf_dir):
    return topology.node_usage(ad.nodes(spark, sf_dir), ad.replicas(spark, sf_dir))


@query(f"{USAGE} SELECT dc, rack, node, CAST(sum(volumes) AS BIGINT) AS volumes, CAST(sum(slots) AS BIGINT) AS slots, max(max_vid) AS max_vid FROM usage GROUP BY ROLLUP (dc, rack, node)")
def topology_rollup(spark, sf_dir):
    return topology.rolled_up(_usage(spark, sf_dir))


@query(f"{USAGE} SELECT node, volumes, slots, CAST(free - CASE WHEN node % 30 > 0 THEN node % 30 // 10 + 1 ELSE 0 END AS BIGINT) AS free FROM usage")
def node_free_slots(spark, sf_dir):
    return _usage(spark, sf_dir).select("node", "volumes", "slots", topology.free_slots(F.col("slots"), F.col("volumes"), F.col("node") % 30).cast("bigint").alias("free"))


@query(f"""{USAGE}, racks AS (SELECT dc, rack, count(*) FILTER (free >= 1) AS open_nodes, sum(free) AS rack_free FROM usage GROUP BY dc, rack),
good AS (SELECT dc FROM racks GROUP BY dc HAVING count(*) > 1 AND count(*) FILTER (open_nodes > 1) > 1 AND sum(rack_free) >= 3)
SELECT dc, rack, node, free FROM usage WHERE free >= 1 AND dc IN (SELECT dc FROM good) AND (dc, rack) IN (SELECT (dc, rack) FROM racks WHERE open_nodes > 1 AND rack_free >= 2)""")
def placement_candidates(spark, sf_dir):
    return topology.placements(_usage(spark, sf_dir), racks=1, nodes=1)


@query("SELECT p_size, copies, CASE copies WHEN 1 THEN 7 WHEN 2 THEN 6 WHEN 3 THEN 3 ELSE 1 END AS volumes, n FROM (SELECT p_size, 1 + p_size % 5 AS copies, count(*) AS n FROM part GROUP BY p_size)")
def growth_plan(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).withColumn("copies", F.col("p_size") % 5 + 1)
    return rows.select("p_size", "copies", topology.growth(F.col("copies")).alias("volumes"), "n")


LAYOUT = f"WITH {ad.REPLICAS}, layout AS (SELECT collection, vid, count(DISTINCT node) AS replicas, bool_or(read_only) AS read_only, max(size) AS size, max(size) >= 9000 AS oversize, count(DISTINCT node) >= 2 AND NOT bool_or(read_only) AND max(size) < 9000 AS writable FROM replicas GROUP BY collection, vid)"


@query(f"{LAYOUT} SELECT * FROM layout")
def layout_writable(spark, sf_dir):
    return topology.layout(ad.replicas(spark, sf_dir), copies=2, limit=9000)


@query(f"{LAYOUT} SELECT collection, count(*) AS volumes, count(*) FILTER (read_only) AS read_only, count(*) FILTER (oversize) AS oversize, count(*) FILTER (writable) AS active FROM layout GROUP BY collection")
def active_volumes(spark, sf_dir):
    rows = topology.layout(ad.replicas(spark, sf_dir), copies=2, limit=9000)
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("volumes"), F.count_if("read_only").alias("read_only"), F.count_if("oversize").alias("oversize"), F.count_if("writable").alias("active"))


_SPREAD = "(vid * 7919 + 5 * 104729) % 1000003"


@query(f"{LAYOUT} SELECT collection, arg_min(vid, {_SPREAD} * 1000000000 + vid) AS vid FROM layout WHERE writable GROUP BY collection")
def pick_for_write(spark, sf_dir):
    rows = topology.layout(ad.replicas(spark, sf_dir), copies=2, limit=9000)
    return topology.pick(rows.where("writable"), ["collection"], seed=5)


@query(f"""{USAGE}, spans AS (SELECT dc, node, sum(free) OVER w - free AS after, sum(free) OVER w AS upto, sum(free) OVER (PARTITION BY dc) AS total FROM usage WHERE free > 0 WINDOW w AS (PARTITION BY dc ORDER BY node)),
draws AS (SELECT r_name AS dc, o_orderkey * 31 AS draw FROM orders JOIN region ON r_regionkey = o_custkey % 5)
SELECT draws.dc, draw, node FROM draws JOIN spans ON spans.dc = draws.dc AND draw % total >= after AND draw % total < upto""")
def reserve_weighted(spark, sf_dir):
    region = ad.table(spark, sf_dir, "region")
    draws = ad.table(spark, sf_dir, "orders").join(region, F.col("r_regionkey") == F.col("o_custkey") % 5).select(F.col("r_name").alias("dc"), (F.col("o_orderkey") * 31).alias("draw"))
    return topology.reserve(_usage(spark, sf_dir), draws)


@query(f"WITH {ad.REPLICAS}, known AS (SELECT vid, array_to_string(list_sort(list_distinct(list(CAST(node AS VARCHAR)))), ',') AS nodes FROM replicas GROUP BY vid) SELECT w.vid, nodes, CASE WHEN nodes IS NULL THEN 'volume not found' END AS error FROM (SELECT DISTINCT o_custkey * 2 AS vid FROM orders) w LEFT JOIN known USING (vid)")
def batch_lookup(spark, sf_dir):
    wanted = ad.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("vid"))
    return topology.locations(ad.replicas(spark, sf_dir), wanted)


_OLD, _NEW = "o_orderkey % 10 < 7", "o_orderkey % 10 > 2"


def _snapshots(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("node"), F.col("o_custkey").alias("vid"), F.col("o_orderkey").alias("size"))
    pick = lambda rule: rows.where(rule.replace("o_orderkey", "size")).groupBy("node", "vid").agg(F.max("size").alias("size"))
    return pick(_OLD), pick(_NEW)


_SNAPSHOTS = f"old AS (SELECT o_custkey % 40 AS node, o_custkey AS vid, max(o_orderkey) AS size FROM orders WHERE {_OLD} GROUP BY ALL), new AS (SELECT o_custkey % 40 AS node, o_custkey AS vid, max(o_orderkey) AS size FROM orders WHERE {_NEW} GROUP BY ALL)"


@query(f"WITH {_SNAPSHOTS} SELECT node, vid, 'new' AS change FROM (SELECT node, vid FROM new EXCEPT SELECT node, vid FROM old) UNION ALL SELECT node, vid, 'deleted' FROM (SELECT node, vid FROM old EXCEPT SELECT node, vid FROM new)")
def heartbeat_diff(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return topology.snapshot_diff(old, new, ["node", "vid"])


@query(f"WITH {_SNAPSHOTS} SELECT node, vid, size FROM new WHERE vid % 3 <> 0 UNION ALL SELECT node, vid, size FROM old o WHERE vid % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM new n WHERE n.node = o.node AND n.vid = o.vid AND n.vid % 3 <> 0)")
def delta_apply(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return topology.apply_delta(old, new.where("vid % 3 <> 0"), old.where("vid % 5 = 0"), ["node", "vid"])


@query(f"WITH {_TIMED}, volumes AS (SELECT user_id % 16 AS node, user_id AS vid, max(event_id) AS max_key, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS size, max(modified) + 3600 * 2 < any_value(now_s) AS expired FROM timed, clock GROUP BY ALL) SELECT node, count(*) AS volumes, CAST(sum(size) AS BIGINT) AS bytes, max(max_key) AS max_key FROM volumes WHERE NOT expired GROUP BY node")
def heartbeat_collect(spark, sf_dir):
    rows = _timed(spark, sf_dir)
    now = rows.agg(F.max("modified")).first()[0]
    volumes = rows.groupBy((F.col("user_id") % 16).alias("node"), F.col("user_id").alias("vid")).agg(F.max("event_id").alias("max_key"), F.sum(F.floor("value").cast("bigint")).alias("size"), (F.max("modified") + 7200 < F.lit(now)).alias("expired"))
    return topology.heartbeat(volumes)


# --- namespace and files -------------------------------------------------------------------------------------------


@query(f"WITH {ad.PATHS}, {ad.TREE} SELECT path, is_directory FROM tree")
def namespace_tree(spark, sf_dir):
    return namespace.with_parents(ad.paths(spark, sf_dir))


@query(f"WITH {ad.PATHS}, {ad.TREE} SELECT path, substr(path, 2) AS name, is_directory FROM tree WHERE path <> '/' AND path NOT LIKE '/%/%' AND substr(path, 2) > 'm' ORDER BY name LIMIT 20")
def list_page(spark, sf_dir):
    return namespace.list_page(namespace.with_parents(ad.paths(spark, sf_dir)), "/", after="m", limit=20)


@query(f"WITH {ad.PATHS}, {ad.TREE}, first AS (SELECT min(path) AS p FROM tree WHERE path <> '/' AND path NOT LIKE '/%/%') SELECT path, is_directory FROM tree, first WHERE path <> p AND NOT starts_with(path, p || '/')")
def recursive_delete(spark, sf_dir):
    tree = namespace.with_parents(ad.paths(spark, sf_dir))
    first = tree.where(namespace.parent(F.col("path")) == "/").agg(F.min("path")).first()[0]
    return namespace.delete_recursive(tree, first)


@query(f"WITH {ad.PATHS}, {ad.TREE} SELECT leaf AS path, '/' || array_to_string(parts[1:i], '/') AS ancestor FROM ups, LATERAL (SELECT unnest(range(0, len(parts))) AS i)")
def path_ancestors(spark, sf_dir):
    return ad.paths(spark, sf_dir).select("path", F.explode(codecs.ancestors(F.col("path"))).alias("ancestor"))


VISIBLE = f"""WITH {ad.CHUNKS}, borders AS (SELECT DISTINCT file, unnest(["offset", "offset" + size]) AS start FROM chunks),
pieces AS (SELECT file, start, lead(start) OVER (PARTITION BY file ORDER BY start) AS stop FROM borders),
won AS (SELECT p.file, p.start, p.stop, arg_max(fid, pos) AS fid, arg_max(c."offset", pos) AS origin FROM pieces p JOIN chunks c ON c.file = p.file AND c."offset" <= p.start AND c."offset" + c.size >= p.stop WHERE p.stop IS NOT NULL GROUP BY ALL),
marked AS (SELECT *, coalesce(lag(stop) OVER w < start OR lag(fid) OVER w <> fid, true) AS fresh FROM won WINDOW w AS (PARTITION BY file ORDER BY start)),
numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY file ORDER BY start) AS run FROM marked),
visible AS (SELECT file, min(start) AS start, max(stop) AS stop, min(fid) AS fid, min(start) - min(origin) AS chunk_offset FROM numbered GROUP BY file, run)"""


@query(f"{VISIBLE} SELECT * FROM visible")
def visible_intervals(spark, sf_dir):
    return ch.visible(ad.chunks(spark, sf_dir), bucket=512)


@query(f"{VISIBLE} SELECT file, greatest(start, 1000) AS start, least(stop, 3000) AS stop, fid, chunk_offset + greatest(start, 1000) - start AS chunk_offset FROM visible WHERE start < 3000 AND stop > 1000")
def chunk_view(spark, sf_dir):
    return ch.range_view(ad.chunks(spark, sf_dir), 1000, 2000, bucket=512)


@query(f"{VISIBLE} SELECT c.file, c.fid, EXISTS (SELECT 1 FROM visible v WHERE v.file = c.file AND v.fid = c.fid) AS shown FROM chunks c")
def compact_chunks(spark, sf_dir):
    return ch.compact(ad.chunks(spark, sf_dir), bucket=512).select("file", "fid", "shown")


@query(f"WITH {ad.CHUNKS} SELECT file, fid FROM chunks WHERE fid % 3 <> 0 AND fid % 2 <> 0")
def unused_chunks(spark, sf_dir):
    rows = ad.chunks(spark, sf_dir)
    return ch.unused(rows.where("fid % 3 <> 0"), rows.where("fid % 2 = 0")).select("file", "fid")


@query(f"WITH {ad.CHUNKS} SELECT file, max(\"offset\" + size) AS file_size FROM chunks GROUP BY file")
def file_size(spark, sf_dir):
    return ch.file_sizes(ad.chunks(spark, sf_dir))


@query(f"WITH {ad.CHUNKS} SELECT file, fid, CAST(coalesce(sum(size) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS append_offset FROM chunks")
def append_offsets(spark, sf_dir):
    return ch.appended(ad.chunks(spark, sf_dir)).select("file", "fid", "append_offset")


@query("SELECT file, part, part * 1000 AS chunk_start, least(1000, length - part * 1000) AS length, sha256(substr(text, part * 1000 + 1, 1000)) AS digest FROM (SELECT doc_id AS file, text, length(text) AS length, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS part FROM documents)")
def auto_chunk(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.length("text").cast("bigint").alias("length"), "text")
    parts = ch.split(docs, 1000)
    body = F.substring(F.col("text"), F.col("offset").cast("int") + 1, F.lit(1000))
    return parts.join(docs.select("file", "text"), "file").select("file", "part", F.col("offset").alias("chunk_start"), "length", F.sha2(body, 256).alias("digest"))


# --- erasure coding ------------------------------------------------------------------------------------------------

_GEOMETRY = f"""WITH {ad.NEEDLE_LOG}, asked AS (SELECT seq, vid * 137 + 5000 AS volume_size, (seq * 911) % 4000 AS "offset", 1 + size % 900 AS size FROM needle_log),
rows AS (SELECT *, (volume_size - 1) // 640 AS big_rows FROM asked),
cut AS (SELECT *, unnest(range(0, size)) AS i FROM rows),
bytes AS (SELECT *, "offset" + i AS b, big_rows * 640 AS edge FROM cut),
placed AS (SELECT seq, i, CASE WHEN b < edge THEN b // 64 % 10 ELSE (b - edge) // 8 % 10 END AS shard, CASE WHEN b < edge THEN b // 640 * 64 + b % 64 ELSE big_rows * 64 + (b - edge) // 80 * 8 + (b - edge) % 8 END AS shard_offset,
  CASE WHEN b < edge THEN b // 64 ELSE big_rows * 10 + (b - edge) // 8 END AS block FROM bytes)"""


@query(f"{_GEOMETRY} SELECT seq, min(shard) AS shard, min(shard_offset) AS shard_offset, count(*) AS length, min(i) AS range_offset FROM placed GROUP BY seq, block")
def ec_locate(spark, sf_dir):
    log = ad.needle_log(spark, sf_dir)
    asked = log.select("seq", (F.col("vid") * 137 + 5000).alias("volume_size"), (F.col("seq") * 911 % 4000).alias("offset"), (F.col("size") % 900 + 1).alias("size"))
    return erasure.intervals(asked, large=64, small=8).select("seq", "shard", "shard_offset", "length", "range_offset")


_BITS = f"WITH {ad.shards_sql('now')}, {ad.shards_sql('was', 7)}, bits AS (SELECT vid, CAST(bit_or(1::BIGINT << shard) AS BIGINT) AS bits FROM now GROUP BY vid), old AS (SELECT vid, CAST(bit_or(1::BIGINT << shard) AS BIGINT) AS bits FROM was WHERE vid % 11 <> 0 GROUP BY vid)"


@query(f"{_BITS} SELECT vid, bits FROM bits")
def ec_bitmap(spark, sf_dir):
    return erasure.shard_bits(ad.shards(spark, sf_dir), ["vid"])


@query(f"{_BITS} SELECT vid, coalesce(n.bits, 0) & ~coalesce(o.bits, 0) AS added, coalesce(o.bits, 0) & ~coalesce(n.bits, 0) AS removed FROM bits n FULL JOIN old o USING (vid) WHERE coalesce(n.bits, 0) <> coalesce(o.bits, 0)")
def ec_bitmap_diff(spark, sf_dir):
    new = erasure.shard_bits(ad.shards(spark, sf_dir), ["vid"])
    old = erasure.shard_bits(ad.shards(spark, sf_dir, 7).where("vid % 11 <> 0"), ["vid"])
    return erasure.bits_diff(old, new, ["vid"])


@query(f"{_BITS} SELECT vid, CAST(bit_count(bits) AS BIGINT) AS held, bit_count(bits) >= 10 AS repairable, array_to_string(list_filter(range(0, 14), lambda i: (bits >> i) & 1 = 0), ',') AS missing FROM bits WHERE bit_count(bits) < 14")
def ec_missing(spark, sf_dir):
    return erasure.missing(erasure.shard_bits(ad.shards(spark, sf_dir), ["vid"]))


@query("SELECT doc_id AS key, sha256(coalesce(text, '')) AS digest FROM documents")
def ec_encode_rebuild(spark, sf_dir):
    """Every body is coded, loses four shards, and is put together again from the other ten."""
    docs = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    left = erasure.encode(docs).where("pmod(shard * 5 + key * 3, 14) >= 4")
    whole = erasure.rebuild(left, first=erasure.DATA)
    parts = whole.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("shard", F.hex("block").alias("hex")))).alias("parts"))
    digits = F.array_join(F.transform("parts", lambda p: p["hex"]), "")
    # The padding goes by the body's length alone; its bytes come from the rebuilt blocks.
    sizes = docs.select("key", F.octet_length("body").alias("n"))
    return sizes.join(parts, "key").select("key", F.sha2(F.unhex(F.substring(digits, F.lit(1), F.col("n") * 2)), 256).alias("digest"))


#: CRC-32 byte by byte over the hexadecimal digits of a text's bytes, with the table of its 256 steps.
_CRC = """WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
bytes AS (SELECT doc_id, list_transform(range(octet_length(encode(text))), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT)) AS b FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents)),
crcs AS (SELECT doc_id, CASE WHEN b IS NOT NULL THEN xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c // 256, t[1 + xor(c, x) % 256])), 4294967295) END AS crc FROM bytes, steps)"""


@query(f"{_CRC} SELECT doc_id, CASE WHEN crc IS NOT NULL THEN doc_id % 10 <> 0 END AS intact, lpad(lower(to_hex(crc)), 8, '0') AS etag FROM crcs")
def crc_check(spark, sf_dir):
    """Records whose stored checksum still fits their bytes, and the etag made of it."""
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    stored = F.crc32("data") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)
    return docs.select("doc_id", (stored == F.crc32("data")).alias("intact"), codecs.etag_of_crc(F.col("data")).alias("etag"))


#: FNV-1a over the codes of a text's characters.
_FNV = "list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(string_split(joined, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@query(f"""WITH {ad.CHUNKS}, parts AS (SELECT file, count(*) AS parts, string_agg(lower(to_hex(fid)), '' ORDER BY pos) AS joined FROM chunks GROUP BY file)
SELECT file, parts, CASE WHEN parts = 1 THEN joined ELSE lower(to_hex(CAST({_FNV} AS UBIGINT))) END AS etag FROM parts""")
def multi_etag(spark, sf_dir):
    """The etag of a file of several chunks, from those of its chunks in order."""
    rows = ad.chunks(spark, sf_dir).withColumn("etag", F.lower(F.hex("fid")))
    parts = rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "etag"))), lambda x: x["etag"]).alias("etags"))
    return parts.select("file", F.size("etags").cast("bigint").alias("parts"), codecs.joined_etag("etags").alias("etag"))


@query("""WITH beats AS (SELECT user_id % 16 AS node, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id % 16 ORDER BY ts)) > 1800000000, true) AS fresh FROM events),
numbered AS (SELECT node, ts, sum(fresh::INT) OVER (PARTITION BY node ORDER BY ts) AS session FROM beats)
SELECT node, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) AS beats FROM numbered GROUP BY node, session""")
def session_liveness(spark, sf_dir):
    """Stretches in which a node kept reporting at least every half hour."""
    rows = ad.table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return topology.sessions(rows, 1_800_000_000)


# --- more lookups, ids and headers ---------------------------------------------------------------------------------

_HELD = f"{ad.shards_sql('now')}, held AS (SELECT vid, shard, (vid + shard * 3) % 23 AS node FROM now UNION ALL SELECT vid, shard, (vid * 5 + shard) % 23 FROM now WHERE vid % 4 = 0)"


def _held(spark, sf_dir):
    rows = ad.shards(spark, sf_dir)
    first = rows.select("vid", "shard", ((F.col("vid") + F.col("shard") * 3) % 23).alias("node"))
    return first.unionByName(rows.where("vid % 4 = 0").select("vid", "shard", ((F.col("vid") * 5 + F.col("shard")) % 23).alias("node")))


@query(f"WITH {_HELD}, known AS (SELECT vid, shard, array_to_string(list_sort(list_distinct(list(node))), ',') AS nodes FROM held GROUP BY ALL) SELECT w.vid, w.shard, coalesce(nodes, '') AS nodes FROM (SELECT DISTINCT o_custkey AS vid, unnest(range(0, 14)) AS shard FROM orders) w LEFT JOIN known USING (vid, shard)")
def ec_lookup(spark, sf_dir):
    wanted = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vid"))
    return erasure.lookup(_held(spark, sf_dir), wanted)


@query(f"""WITH {_HELD}, best AS (SELECT vid, shard, bool_or(node = 7) AS own, min(node) AS other FROM held GROUP BY ALL), whole AS (SELECT vid, count(DISTINCT shard) >= 10 AS enough FROM held GROUP BY vid)
SELECT o_orderkey AS request, CASE WHEN own THEN 'local' WHEN other IS NOT NULL THEN 'remote' WHEN enough THEN 'rebuild' ELSE 'lost' END AS plan, CASE WHEN own THEN 7 ELSE other END AS from_node
FROM orders LEFT JOIN best b ON b.vid = o_custkey AND b.shard = o_orderkey % 10 LEFT JOIN whole w ON w.vid = o_custkey""")
def ec_read_plan(spark, sf_dir):
    asked = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("vid"), (F.col("o_orderkey") % 10).alias("shard"))
    return erasure.read_plan(asked, _held(spark, sf_dir), node=7).select("request", "plan", "from_node")


@query(f"WITH {ad.REPLICAS} SELECT node, array_to_string(list_sort(list_distinct(list(vid))), ',') AS vids FROM replicas GROUP BY node")
def node_volumes(spark, sf_dir):
    return topology.held_volumes(ad.replicas(spark, sf_dir))


@query(f"{USAGE} SELECT dc, rack, arg_max(node, free * 1000000 - node) AS disk, max(free) AS free FROM usage WHERE free > 0 GROUP BY dc, rack")
def freest_disk(spark, sf_dir):
    return topology.freest(_usage(spark, sf_dir).withColumnRenamed("node", "disk"), ["dc", "rack"])


@query("SELECT o_orderkey AS request, o_custkey % 5 AS collection, coalesce(top, 0) + row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS id FROM orders LEFT JOIN (SELECT c_custkey % 5 AS g, max(c_custkey * 10) AS top FROM customer WHERE c_custkey % 5 <> 2 GROUP BY 1) ON g = o_custkey % 5")
def assigned_ids(spark, sf_dir):
    asked = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 5).alias("collection"))
    taken = ad.table(spark, sf_dir, "customer").where("c_custkey % 5 <> 2").select((F.col("c_custkey") % 5).alias("collection"), (F.col("c_custkey") * 10).alias("id"))
    return topology.numbered(asked, taken, "collection", "request")


@query(f"{_SORTED}, ends AS (SELECT vid, 2000000 + vid * 1000 AS data_end FROM (SELECT DISTINCT vid FROM needle_log) WHERE vid % 5 <> 3) SELECT s.vid, s.key, data_offset, s.size FROM sorted s LEFT JOIN ends e USING (vid) WHERE data_end IS NULL OR data_offset + {_ACTUAL} > data_end")
def index_violations(spark, sf_dir):
    index = keylog.sorted_index(ad.needle_log(spark, sf_dir))
    ends = ad.needle_log(spark, sf_dir).where("vid % 5 <> 3").select("vid").distinct().withColumn("data_end", F.col("vid") * 1000 + 2000000)
    return keylog.violations(index, ends).withColumnRenamed("offset", "data_offset")


@query("""SELECT p_partkey, '/d' || p_size AS folder, CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 10 ELSE 7 END AS BIGINT) AS most,
'bytes ' || p_size || '-' || (p_size + p_partkey % 9) || '/' || 1000 AS content_range, '"' || lower(to_hex(p_partkey)) || '"' AS etag_header, lower(to_hex(p_partkey)) AS etag FROM part""")
def header_codecs(spark, sf_dir):
    size, part = F.col("p_size").cast("bigint"), F.col("p_partkey")
    option = codecs.folder_option(F.concat(F.lit("/d"), size.cast("string"), F.when(size % 2 == 0, F.concat(F.lit(":"), (size * 10).cast("string"))).otherwise("")))
    header = codecs.etag_header(F.lower(F.hex(part)))
    rows = ad.table(spark, sf_dir, "part")
    return rows.select("p_partkey", option["folder"].alias("folder"), option["most"].alias("most"), codecs.content_range(size, part % 9 + 1, F.lit(1000)).alias("content_range"), header.alias("etag_header"), codecs.etag_value(F.concat(F.lit("W/"), header)).alias("etag"))


from quern.plans import objects  # noqa: E402, F401  registers its queries here
