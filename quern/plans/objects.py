"""Queries over objects, placement and coded volumes; ``catalogue`` registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import codecs
from quern.operators import erasure, keylog, namespace, objects, topology
from quern.plans import adapters as ad
from quern.plans.catalogue import _HELD, _SNAPSHOTS, _TTL, LATEST, LAYOUT, METRICS, USAGE, _held, _snapshots, _usage, query

# --- objects -------------------------------------------------------------------------------------------------------


def _object_log(spark, sf_dir):
    kind = F.col("event_type")
    ttl = F.when(kind == "click", 0).when(kind == "view", 1440).when(kind == "signup", 10080).otherwise(44640).cast("bigint")
    rows = ad.table(spark, sf_dir, "events").select("event_id", ttl.alias("ttl"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("modified"))
    log = ad.needle_log(spark, sf_dir).withColumn("cookie", F.col("key") * 2654435 % 4294967296)
    return log.join(rows, F.col("seq") == F.col("event_id")).drop("event_id")


@query(f"""{LATEST}, timed AS (SELECT event_id, CAST({_TTL} AS BIGINT) AS ttl, CAST(floor(epoch(ts)) AS BIGINT) AS modified FROM events),
asked AS (SELECT o_orderkey AS request, o_custkey % 16 AS vid, o_custkey AS key, (o_custkey * 2654435 + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) % 4294967296 AS cookie FROM orders),
served AS (SELECT a.*, l.seq AS s, l.size AS z, CASE WHEN l.seq IS NULL THEN 'not found' WHEN a.cookie <> a.key * 2654435 % 4294967296 THEN 'wrong cookie' WHEN ttl > 0 AND (SELECT max(modified) FROM timed) >= modified + ttl * 60 THEN 'expired' ELSE 'found' END AS status
  FROM asked a LEFT JOIN (SELECT * FROM latest WHERE op = 'put') l ON l.vid = a.vid AND l.key = a.key LEFT JOIN timed ON event_id = l.seq)
SELECT request, vid, key, status, CASE WHEN status = 'found' THEN s END AS seq, CASE WHEN status = 'found' THEN z END AS size FROM served""")
def object_read(spark, sf_dir):
    log = _object_log(spark, sf_dir)
    cookie = (F.col("o_custkey") * 2654435 + F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)) % 4294967296
    asked = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 16).alias("vid"), F.col("o_custkey").alias("key"), cookie.alias("cookie"))
    return objects.read(asked, log, F.lit(log.agg(F.max("modified")).first()[0]))


@query("SELECT doc_id, sha256(text) AS plain, octet_length(encode(text)) AS plain_bytes, doc_id % 2 = 0 AS accepts FROM documents")
def gzip_bodies(spark, sf_dir):
    """Bodies stored zipped come back plain, also those that a client takes zipped, once it unzips them."""
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"), (F.col("doc_id") % 2 == 0).alias("accepts"))
    sent = objects.packed(docs).withColumn("sent", objects.served(F.col("data"), F.col("flags"), F.col("accepts"), F.lit("txt")))
    taken = codecs.has_flag(F.col("flags"), "gzip") & F.col("accepts")
    plain = F.when(taken, objects.unzipped(F.when(taken, F.col("sent")))).otherwise(F.col("sent"))
    return sent.select("doc_id", "accepts", plain.alias("data")).select("doc_id", F.sha2("data", 256).alias("plain"), F.octet_length("data").cast("bigint").alias("plain_bytes"), "accepts")


@query(f"WITH {ad.NEEDLE_LOG}, top AS (SELECT vid, max(seq) AS t FROM needle_log GROUP BY vid) SELECT o_orderkey AS request, o_custkey % 16 AS vid, coalesce(t + 1, 0) + row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) - 1 AS seq FROM orders LEFT JOIN top ON vid = o_custkey % 16")
def object_put(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 16).alias("vid"), F.col("o_custkey").alias("key"), F.floor("o_totalprice").cast("bigint").alias("size"))
    return objects.put(ad.needle_log(spark, sf_dir), rows, "request").select("request", "vid", "seq")


_DELETED = f"""{LATEST}, wanted AS (SELECT DISTINCT o_custkey % 16 AS vid, o_custkey AS key FROM orders WHERE o_orderstatus = 'F'), lives AS (SELECT * FROM latest WHERE op = 'put'), top AS (SELECT vid, max(seq) AS t FROM needle_log GROUP BY vid),
deleted AS (SELECT w.vid, w.key, coalesce(l.size, 0) AS freed, CASE WHEN l.key IS NOT NULL THEN t + row_number() OVER (PARTITION BY w.vid, l.key IS NOT NULL ORDER BY w.key) END AS seq FROM wanted w LEFT JOIN lives l ON l.vid = w.vid AND l.key = w.key LEFT JOIN top ON top.vid = w.vid)"""


def _deleted(spark, sf_dir):
    """Deletions of the keys of finished orders, which is what the orders ask for."""
    wanted = ad.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") % 16).alias("vid"), F.col("o_custkey").alias("key"))
    return objects.delete(ad.needle_log(spark, sf_dir), wanted)


@query(f"{_DELETED} SELECT * FROM deleted")
def object_delete(spark, sf_dir):
    return _deleted(spark, sf_dir)


@query(f"{_DELETED} SELECT l.vid, l.key, l.seq, l.size FROM lives l WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.vid = l.vid AND w.key = l.key)")
def log_after_delete(spark, sf_dir):
    log = ad.needle_log(spark, sf_dir)
    return keylog.live(log.unionByName(objects.tombstones(_deleted(spark, sf_dir)))).select("vid", "key", "seq", "size")


def _header(k, a, b):
    text = lambda *x: F.concat(*(F.lit(i) if isinstance(i, str) else i.cast("string") for i in x))
    forms = [text("bytes=", a, "-", a + b), text("bytes=", a, "-"), text("bytes=-", b), text("bytes=", a, "-", a + b, ", ", b, "-", b + 9), F.lit("lines=1-2"), text("bytes=", a + 1, "-", a), F.lit("")]
    out = forms[-1]
    for i, form in enumerate(forms[:-1]):
        out = F.when(k == i, form).otherwise(out)
    return out


_RANGES = """asked AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_orderkey % 3000 AS a, o_custkey % 500 AS b, 2000 AS total FROM orders),
single AS (SELECT *, CASE WHEN k IN (0, 3) THEN [{'s': a, 'l': least(a + b + 1, total) - a}] WHEN k = 1 THEN [{'s': a, 'l': total - a}] WHEN k = 2 THEN [{'s': total - b, 'l': b}] WHEN k = 6 THEN [] END AS one, CASE WHEN k = 3 THEN [{'s': b, 'l': 10}] ELSE [] END AS two FROM asked),
ranges AS (SELECT o_orderkey, total, k, list_concat(CASE WHEN k IN (0, 1, 3) AND a >= total THEN [] ELSE one END, two) AS r FROM single),
valid AS (SELECT o_orderkey, total, CASE WHEN k IN (4, 5) OR k < 4 AND len(r) = 0 THEN NULL ELSE r END AS r FROM ranges)"""


@query(f"""WITH {_RANGES} SELECT o_orderkey, CASE WHEN r IS NOT NULL THEN array_to_string(list_transform(r, lambda x: x.s || '+' || x.l), ';') END AS ranges,
CASE WHEN r IS NOT NULL THEN CAST(coalesce(list_sum(list_transform(r, lambda x: x.l + length('____--B__Content-Type: text/plain__Content-Range: bytes ' || x.s || '-' || (x.s + x.l - 1) || '/' || total || '____') - 2)), 0) + 9 AS BIGINT) END AS body_bytes FROM valid""")
def range_parse(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = ad.table(spark, sf_dir, "orders").select(key, _header(key % 7, key % 3000, F.col("o_custkey") % 500).alias("header"))
    rows = rows.withColumn("r", objects.parse_ranges(F.col("header"), F.lit(2000).cast("bigint")))
    text = F.array_join(F.transform("r", lambda x: F.concat(x["start"].cast("string"), F.lit("+"), x["length"].cast("string"))), ";")
    return rows.select(key, text.alias("ranges"), objects.ranges_size(F.col("r"), F.lit(2000), "text/plain", "B").alias("body_bytes"))


@query("""WITH bodies AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
ranges AS (SELECT doc_id, h, n, unnest([0, 1]) AS nth FROM bodies), cut AS (SELECT doc_id, nth, h, CASE nth WHEN 0 THEN doc_id % 700 ELSE greatest(n - 900, 0) END AS s, CASE nth WHEN 0 THEN least(doc_id % 700 + 1500, n) ELSE n END AS e, n FROM ranges)
SELECT doc_id AS request, nth, e - s AS length, sha256(lower(substr(h, 2 * s + 1, 2 * (e - s)))) AS digest FROM cut WHERE s < n AND e > s""")
def range_assembly(spark, sf_dir):
    """Two ranges of each document, put together from its parts of 512 bytes."""
    docs = ad.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("file"), F.col("text").cast("binary").alias("body"))
    n = F.octet_length("body").cast("bigint")
    parts = docs.where(n > 0).select("file", "body", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / 512))).alias("part")).select("file", "part", F.substring(F.col("body"), (F.col("part") * 512 + 1).cast("int"), F.lit(512)).alias("data"))
    first = F.struct(F.lit(0).alias("nth"), (F.col("file") % 700).alias("start"), F.least(F.col("file") % 700 + 1500, n).alias("stop"))
    last = F.struct(F.lit(1).alias("nth"), F.greatest(n - 900, F.lit(0)).alias("start"), n.alias("stop"))
    asked = docs.select("file", n.alias("n"), F.explode(F.array(first, last)).alias("r")).where("r.start < n AND r.stop > r.start")
    asked = asked.select(F.col("file").alias("request"), "r.nth", "file", "r.start", (F.col("r.stop") - F.col("r.start")).alias("length"))
    found = objects.assemble(asked, parts, 512)
    return found.select("request", "nth", F.octet_length("data").cast("bigint").alias("length"), F.sha2(F.lower(F.hex("data")), 256).alias("digest"))


# --- namespace -----------------------------------------------------------------------------------------------------


def _put_entries(spark, sf_dir):
    """Pages by even and odd number: those that are there, and those that are put, of which every fifth goes below a file."""
    path = F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)), "/$", "")
    rows = ad.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    old = rows.where("page_id % 3 <> 0").groupBy("path").agg(F.max("page_id").alias("id"))
    new = rows.where("page_id % 3 <> 1").groupBy(F.when(F.col("page_id") % 5 == 0, F.concat("path", F.lit("/under"))).otherwise(F.col("path")).alias("path")).agg(F.max("page_id").alias("id"))
    shape = lambda df, first: df.select("path", F.lit(False).alias("is_directory"), F.col("id").alias("mtime"), F.col("id").alias("crtime"), F.array((F.col("id") * 2 + first).cast("string"), (F.col("id") % 7).cast("string")).alias("chunks"))
    return shape(old, 0), shape(new, 1)


_PUT = """pages2 AS (SELECT page_id, regexp_replace('/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/$', '') AS path FROM pages),
old AS (SELECT path, max(page_id) AS id FROM pages2 WHERE page_id % 3 <> 0 GROUP BY path),
new AS (SELECT CASE WHEN page_id % 5 = 0 THEN path || '/under' ELSE path END AS p, max(page_id) AS id FROM pages2 WHERE page_id % 3 <> 1 GROUP BY p),
newp AS (SELECT p AS path, id, list_filter(string_split(p, '/'), lambda x: x <> '') AS parts FROM new),
ups AS (SELECT path, id, '/' || array_to_string(parts[1:i], '/') AS up FROM newp, LATERAL (SELECT unnest(range(0, len(parts))) AS i)),
bad AS (SELECT DISTINCT path FROM ups WHERE up IN (SELECT path FROM old) OR up IN (SELECT path FROM newp)),
fine AS (SELECT * FROM newp WHERE path NOT IN (SELECT path FROM bad)),
dirs AS (SELECT up AS path, min(id) AS id FROM ups WHERE path IN (SELECT path FROM fine) AND up <> '/' GROUP BY up)"""


@query(f"""WITH {_PUT} SELECT path, 'conflict' AS kind, NULL::BIGINT AS mtime, NULL::BIGINT AS crtime, '' AS chunks FROM bad
UNION ALL SELECT f.path, 'file', f.id, coalesce(o.id, f.id), (f.id * 2 + 1) || ',' || (f.id % 7) FROM fine f LEFT JOIN old o ON o.path = f.path
UNION ALL SELECT path, 'file', id, id, (id * 2) || ',' || (id % 7) FROM old WHERE path NOT IN (SELECT path FROM fine)
UNION ALL SELECT path, 'directory', id, id, '' FROM dirs
UNION ALL SELECT o.path, 'unused', NULL, NULL, unnest(list_filter([CAST(o.id * 2 AS VARCHAR), CAST(o.id % 7 AS VARCHAR)], lambda c: NOT list_contains([CAST(f.id * 2 + 1 AS VARCHAR), CAST(f.id % 7 AS VARCHAR)], c))) FROM old o JOIN fine f ON f.path = o.path""")
def namespace_create(spark, sf_dir):
    old, new = _put_entries(spark, sf_dir)
    tree, conflicts, unused = namespace.create(old, new)
    none = F.lit(None).cast("bigint")
    rows = tree.select("path", F.when(F.col("is_directory"), "directory").otherwise("file").alias("kind"), "mtime", "crtime", F.array_join("chunks", ",").alias("chunks"))
    rows = rows.unionByName(conflicts.select("path", F.lit("conflict").alias("kind"), none.alias("mtime"), none.alias("crtime"), F.lit("").alias("chunks")))
    return rows.unionByName(unused.select("path", F.lit("unused").alias("kind"), none.alias("mtime"), none.alias("crtime"), F.col("chunk").alias("chunks")))


@query(f"WITH {ad.PATHS}, {ad.TREE}, asked AS (SELECT DISTINCT path FROM tree UNION SELECT '/' UNION SELECT '/none') SELECT a.path, coalesce(t.is_directory, a.path = '/') AS is_directory, a.path = '/' OR t.path IS NOT NULL AS found FROM asked a LEFT JOIN tree t USING (path)")
def namespace_get(spark, sf_dir):
    tree = namespace.with_parents(ad.paths(spark, sf_dir))
    asked = tree.select("path").union(spark.createDataFrame([("/",), ("/none",)], "path string")).distinct()
    return namespace.get(tree, asked)


# --- placement -----------------------------------------------------------------------------------------------------

_PLACE = f"""{USAGE}, racks AS (SELECT dc, rack, count(*) FILTER (free >= 1) AS open_nodes, sum(free) AS rack_free FROM usage GROUP BY dc, rack),
good_dc AS (SELECT dc FROM racks GROUP BY dc HAVING count(*) > 1 AND count(*) FILTER (open_nodes > 1) > 1 AND sum(rack_free) >= 3),
good_rack AS (SELECT dc, rack FROM racks WHERE open_nodes > 1 AND rack_free >= 2 AND dc IN (SELECT dc FROM good_dc)),
able AS (SELECT u.* FROM usage u JOIN good_rack USING (dc, rack) WHERE free >= 1), room AS (SELECT * FROM usage WHERE free >= 1),
main_dcs AS (SELECT list_sort(list_distinct(list(dc))) AS m FROM able), all_dcs AS (SELECT list_sort(list_distinct(list(dc))) AS a FROM room),
main_racks AS (SELECT dc, list_sort(list_distinct(list(rack))) AS m FROM able GROUP BY dc), all_racks AS (SELECT dc, list_sort(list_distinct(list(rack))) AS a FROM room GROUP BY dc),
all_nodes AS (SELECT dc, rack, list_sort(list(node)) AS a FROM room GROUP BY dc, rack),
r0 AS (SELECT o_orderkey AS request, o_orderkey AS seed FROM orders),
r1 AS (SELECT request, seed, m[1 + (seed * 7919 + 104729) % 1000003 % len(m)] AS dc, a FROM r0, main_dcs, all_dcs),
r2 AS (SELECT request, seed, dc, list_filter(a, lambda x: x <> dc) AS o FROM r1),
r3 AS (SELECT request, seed, r2.dc, o[1 + (seed * 7919 + 209458) % 1000003 % len(o)] AS other_dc, m[1 + (seed * 7919 + 314187) % 1000003 % len(m)] AS rack, a FROM r2 JOIN main_racks m ON m.dc = r2.dc JOIN all_racks b ON b.dc = r2.dc),
r4 AS (SELECT request, seed, dc, other_dc, rack, list_filter(a, lambda x: x <> rack) AS o FROM r3),
r5 AS (SELECT request, seed, r4.dc, other_dc, r4.rack, o[1 + (seed * 7919 + 418916) % 1000003 % len(o)] AS other_rack, a, a[1 + (seed * 7919 + 523645) % 1000003 % len(a)] AS node FROM r4 JOIN all_nodes n ON n.dc = r4.dc AND n.rack = r4.rack),
r6 AS (SELECT *, list_filter(a, lambda x: x <> node) AS o FROM r5),
r7 AS (SELECT request, seed, dc, rack, node, other_dc, other_rack, o[1 + (seed * 7919 + 628374) % 1000003 % len(o)] AS other_node FROM r6),
slots AS (SELECT g, node, upto - free AS after, upto, sum(free) OVER (PARTITION BY g) AS total FROM (SELECT *, sum(free) OVER (PARTITION BY g ORDER BY node) AS upto FROM (SELECT dc || '/' || rack AS g, node, free FROM room UNION ALL SELECT dc, node, free FROM room))),
far AS (SELECT request, 2 AS nth, dc || '/' || other_rack AS g, (seed * 7919 + 7 * 104729) % 1000003 AS draw FROM r7 UNION ALL SELECT request, 3, other_dc, (seed * 7919 + 8 * 104729) % 1000003 FROM r7),
placed AS (SELECT request, 0 AS nth, node FROM r7 UNION ALL SELECT request, 1, other_node FROM r7 UNION ALL SELECT request, nth, s.node FROM far JOIN slots s ON s.g = far.g AND draw % total >= after AND draw % total < upto)"""


@query(f"{_PLACE} SELECT request, nth, node FROM placed")
def place_copies(spark, sf_dir):
    """A volume for each order, with copies on another node, in another rack and in another centre."""
    requests = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderkey").alias("seed"))
    return topology.place(_usage(spark, sf_dir), requests, centres=1, racks=1, nodes=1)


@query(f"""{USAGE}, asked AS (SELECT p_partkey AS request, unnest(range(1, 7)) AS n FROM part), made AS (SELECT request, 1000 + row_number() OVER (ORDER BY request, n) - 1 AS vid, request * 8 + n AS seed FROM asked),
room AS (SELECT * FROM usage WHERE free >= 1), racks AS (SELECT dc, rack, count(*) FILTER (free >= 1) AS open_nodes, sum(free) AS rack_free FROM usage GROUP BY dc, rack),
good_dc AS (SELECT dc FROM racks GROUP BY dc HAVING count(*) > 0 AND count(*) FILTER (open_nodes > 1) > 0 AND sum(rack_free) >= 2), good_rack AS (SELECT dc, rack FROM racks WHERE open_nodes > 1 AND rack_free >= 2 AND dc IN (SELECT dc FROM good_dc)),
able AS (SELECT u.* FROM usage u JOIN good_rack USING (dc, rack) WHERE free >= 1), main_dcs AS (SELECT list_sort(list_distinct(list(dc))) AS m FROM able), main_racks AS (SELECT dc, list_sort(list_distinct(list(rack))) AS m FROM able GROUP BY dc),
all_nodes AS (SELECT dc, rack, list_sort(list(node)) AS a FROM room GROUP BY dc, rack),
r1 AS (SELECT *, m[1 + (seed * 7919 + 104729) % 1000003 % len(m)] AS dc FROM made, main_dcs),
r2 AS (SELECT request, vid, seed, r1.dc, k.m[1 + (seed * 7919 + 314187) % 1000003 % len(k.m)] AS rack FROM r1 JOIN main_racks k ON k.dc = r1.dc),
r3 AS (SELECT request, vid, seed, a, a[1 + (seed * 7919 + 523645) % 1000003 % len(a)] AS node FROM r2 JOIN all_nodes n ON n.dc = r2.dc AND n.rack = r2.rack),
r4 AS (SELECT *, list_filter(a, lambda x: x <> node) AS o FROM r3)
SELECT request, vid, node FROM r4 UNION ALL SELECT request, vid, o[1 + (seed * 7919 + 628374) % 1000003 % len(o)] FROM r4""")
def volume_growth(spark, sf_dir):
    """Six new volumes of two copies in one rack for each part."""
    requests = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request"), F.col("p_partkey").alias("seed"))
    return topology.grow(_usage(spark, sf_dir), requests, first_vid=1000, centres=0, racks=0, nodes=1)


@query(f"""{LAYOUT}, open AS (SELECT collection, list_sort(list(vid)) AS vids FROM layout WHERE writable GROUP BY collection), top AS (SELECT c_mktsegment AS g, max(c_custkey * 10) AS t FROM customer GROUP BY 1),
asked AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 50 = 0 THEN 'NONE' ELSE c_mktsegment END AS collection FROM orders JOIN customer ON c_custkey = o_custkey),
ids AS (SELECT request, a.collection, coalesce(t, 0) + row_number() OVER (PARTITION BY a.collection ORDER BY request) AS id, vids FROM asked a LEFT JOIN top ON g = a.collection LEFT JOIN open o ON o.collection = a.collection)
SELECT request, vids[1 + (request * 7919 + 11 * 104729) % 1000003 % len(vids)] || ',' || lower(to_hex(id)) || lpad(lower(to_hex((request * 7919 + 12 * 104729) % 1000003 * 4099 + 1)), 8, '0') AS fid FROM ids""")
def assign_ids(spark, sf_dir):
    layouts = topology.layout(ad.replicas(spark, sf_dir), copies=2, limit=9000)
    customer = ad.table(spark, sf_dir, "customer")
    asked = ad.table(spark, sf_dir, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("request"), F.when(F.col("o_orderkey") % 50 == 0, "NONE").otherwise(F.col("c_mktsegment")).alias("collection"))
    taken = customer.select(F.col("c_mktsegment").alias("collection"), (F.col("c_custkey") * 10).alias("id"))
    return topology.assign(asked, layouts.where("writable"), taken, "collection")


@query(f"""WITH {ad.REPLICAS}, fids AS (SELECT DISTINCT o_custkey * 2 AS vid, o_orderkey AS key, o_custkey * 2 || ',' || lower(to_hex(o_orderkey)) || '0000abcd' AS fid FROM orders),
one AS (SELECT fid, arg_min(node, ((node + key % 1000003) * 7919 + 13 * 104729) % 1000003 * 1000000 + node) AS node FROM fids LEFT JOIN replicas USING (vid) GROUP BY fid) SELECT fid, 'http://n' || node || ':8080/' || fid AS url FROM one""")
def file_urls(spark, sf_dir):
    fid = F.concat((F.col("o_custkey") * 2).cast("string"), F.lit(","), F.lower(F.hex("o_orderkey")), F.lit("0000abcd"))
    held = ad.replicas(spark, sf_dir).select("vid", "node", F.concat(F.lit("n"), F.col("node").cast("string"), F.lit(":8080")).alias("url")).distinct()
    return topology.file_urls(ad.table(spark, sf_dir, "orders").select(fid.alias("fid")), held)


@query(f"WITH {ad.REPLICAS} SELECT w.vid, array_to_string(list_sort(list_distinct(list(CAST(node AS VARCHAR)))), ',') AS nodes FROM (SELECT DISTINCT o_custkey * 2 AS vid FROM orders) w JOIN replicas USING (vid) GROUP BY w.vid")
def known_locations(spark, sf_dir):
    wanted = ad.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("vid"))
    return topology.known_locations(ad.replicas(spark, sf_dir), wanted)


@query(f"""WITH {ad.NODES}, {ad.REPLICAS}, placed AS (SELECT dc, rack, r.* FROM replicas r JOIN nodes n ON n.node = r.node) SELECT 'centre' AS scope, count(*) AS replicas FROM placed WHERE dc = 'ASIA' UNION ALL SELECT 'rack', count(*) FROM placed WHERE dc = 'ASIA' AND rack = 'CHINA'
UNION ALL SELECT 'all', count(*) FROM placed""")
def scoped_replicas(spark, sf_dir):
    placed = ad.replicas(spark, sf_dir).join(ad.nodes(spark, sf_dir).select("dc", "rack", "node"), "node")
    kinds = {"centre": ("ASIA",), "rack": ("ASIA", "CHINA"), "all": ("", "CHINA")}
    rows = [topology.in_scope(placed, *own).agg(F.count(F.lit(1)).alias("replicas")).select(F.lit(name).alias("scope"), "replicas") for name, own in kinds.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"{LAYOUT} SELECT collection, vid, replicas, CASE WHEN replicas = 2 THEN 'available' WHEN replicas < 2 THEN 'unavailable' ELSE 'surplus' END AS state FROM layout")
def volume_availability(spark, sf_dir):
    return topology.availability(topology.layout(ad.replicas(spark, sf_dir), copies=2, limit=9000), 2).select("collection", "vid", "replicas", "state")


@query(f"""WITH {ad.REPLICAS}, left_ AS (SELECT * FROM replicas WHERE node % 7 <> 3), marked AS (SELECT collection, vid, node, size, read_only OR vid IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS read_only FROM left_)
SELECT collection, vid, count(DISTINCT node) AS replicas, bool_or(read_only) AS read_only, max(size) AS size, max(size) >= 9000 AS oversize, count(DISTINCT node) >= 2 AND NOT bool_or(read_only) AND max(size) < 9000 AS writable FROM marked GROUP BY collection, vid""")
def layout_after_loss(spark, sf_dir):
    """The layout once some nodes have left and the volumes of pending orders are marked as read-only."""
    held = ad.replicas(spark, sf_dir)
    gone = held.where("node % 7 = 3").select("node")
    marked = ad.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("vid"))
    return topology.layout(topology.read_only(topology.unregister(held, gone), marked), copies=2, limit=9000)


@query(f"WITH {ad.NODES}, by_rack AS (SELECT dc, rack, rack || ':' || array_to_string(list_sort(list(node)), ',') AS t FROM nodes GROUP BY dc, rack) SELECT dc, array_to_string(list_sort(list(t)), ';') AS racks FROM by_rack GROUP BY dc")
def topology_map(spark, sf_dir):
    return topology.topology_map(ad.nodes(spark, sf_dir))


@query(f"WITH {ad.REPLICAS} SELECT vid, arg_min(node, node % 10 * 1000000 + node) AS disk FROM replicas GROUP BY vid")
def volume_disk(spark, sf_dir):
    return topology.first_disk(ad.replicas(spark, sf_dir).select("vid", F.col("node").alias("disk"), (F.col("node") % 10).alias("pos")))


@query(f"WITH {_SNAPSHOTS}, two AS (SELECT *, 1 AS turn FROM old UNION ALL SELECT *, 2 FROM new) SELECT node, vid, arg_max(size, turn) AS size, max(turn) AS turn FROM two GROUP BY node, vid")
def replica_upsert(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    rows = old.withColumn("turn", F.lit(1).cast("bigint")).unionByName(new.withColumn("turn", F.lit(2).cast("bigint")))
    return topology.upserted(rows, ["node", "vid"], "turn").select("node", "vid", "size", "turn")


# --- coded volumes -------------------------------------------------------------------------------------------------


@query(f"""WITH {ad.shards_sql('now')}, {ad.shards_sql('was', 7)}, bits AS (SELECT vid, CAST(bit_or(1::BIGINT << shard) AS BIGINT) AS bits FROM was WHERE vid % 11 <> 0 GROUP BY vid), came AS (SELECT vid, CAST(bit_or(1::BIGINT << shard) AS BIGINT) AS bits FROM now WHERE vid % 3 = 0 GROUP BY vid), went AS (SELECT vid, CAST(bit_or(1::BIGINT << shard) AS BIGINT) AS bits FROM now WHERE vid % 4 = 1 GROUP BY vid)
SELECT vid, (coalesce(b.bits, 0) | coalesce(c.bits, 0)) & ~coalesce(w.bits, 0) AS bits FROM bits b FULL JOIN came c USING (vid) LEFT JOIN went w USING (vid) WHERE (coalesce(b.bits, 0) | coalesce(c.bits, 0)) & ~coalesce(w.bits, 0) <> 0""")
def ec_delta_apply(spark, sf_dir):
    now, was = (ad.shards(spark, sf_dir, step) for step in (5, 7))
    bits = lambda df, rule: erasure.shard_bits(df.where(rule), ["vid"])
    return erasure.apply_delta(bits(was, "vid % 11 <> 0"), bits(now, "vid % 3 = 0"), bits(now, "vid % 4 = 1"), ["vid"])


@query(f"WITH {_HELD} SELECT vid, shard, array_to_string(list_sort(list_distinct(list(node))), ',') AS nodes FROM held WHERE NOT (vid % 5 = 2 AND node % 3 = 1) GROUP BY vid, shard")
def ec_shard_nodes(spark, sf_dir):
    held = _held(spark, sf_dir)
    return erasure.shard_nodes(held, held.where("vid % 5 = 2 AND node % 3 = 1"))


@query(f"WITH {_HELD} SELECT node, vid, CAST(bit_or(1::BIGINT << shard) AS BIGINT) AS bits FROM held GROUP BY node, vid")
def ec_node_report(spark, sf_dir):
    return erasure.shards_by_node(_held(spark, sf_dir))


@query(f"WITH {ad.shards_sql('now')}, rest AS (SELECT * FROM now WHERE NOT (vid % 6 = 1 OR shard > 9 AND vid % 2 = 0)) SELECT vid, 'left' AS kind, count(*) AS shards FROM rest GROUP BY vid UNION ALL SELECT DISTINCT vid, 'gone', 0 FROM now WHERE vid NOT IN (SELECT vid FROM rest)")
def ec_shards_deleted(spark, sf_dir):
    rows = ad.shards(spark, sf_dir)
    rest, gone = erasure.without(rows, rows.where("vid % 6 = 1 OR shard > 9 AND vid % 2 = 0"))
    left = rest.groupBy("vid").agg(F.count(F.lit(1)).alias("shards")).select("vid", F.lit("left").alias("kind"), "shards")
    return left.unionByName(gone.select("vid", F.lit("gone").alias("kind"), F.lit(0).cast("bigint").alias("shards")))


_STRIPED = """bodies AS (SELECT doc_id AS vid, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 0),
units AS (SELECT vid, h, n, (n - 1) // 640 AS big, unnest(range(0, (n + 7) // 8)) AS u FROM bodies),
placed AS (SELECT vid, n, big, substr(h, 16 * u + 1, 16) AS piece, CASE WHEN u < big * 80 THEN u // 8 % 10 ELSE (u - big * 80) % 10 END AS shard, CASE WHEN u < big * 80 THEN u // 80 * 64 + u % 8 * 8 ELSE big * 64 + (u - big * 80) // 10 * 8 END AS place FROM units)"""


@query(f"WITH {_STRIPED} SELECT vid, shard, CAST(sum(length(piece)) // 2 AS BIGINT) AS bytes, sha256(lower(string_agg(piece, '' ORDER BY place))) AS digest FROM placed GROUP BY vid, shard")
def ec_stripes(spark, sf_dir):
    """What each data shard of a volume holds, if every document is one, with blocks of 64 and 8 bytes."""
    docs = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vid"), F.col("text").cast("binary").alias("data"), F.octet_length(F.col("text").cast("binary")).cast("bigint").alias("volume_size"), F.lit(0).cast("bigint").alias("offset"))
    cut = erasure.stripes(docs.where("volume_size > 0"), large=64, small=8)
    parts = cut.groupBy("vid", "shard").agg(F.array_sort(F.collect_list(F.struct("shard_offset", F.lower(F.hex("data")).alias("hex")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["hex"]), "")
    return parts.select("vid", "shard", F.floor(F.length(text) / 2).alias("bytes"), F.sha2(text, 256).alias("digest"))


@query("SELECT doc_id AS vid, octet_length(encode(text)) AS bytes, sha256(lower(hex(encode(text)))) AS digest FROM documents WHERE octet_length(encode(text)) > 0")
def ec_volume_restored(spark, sf_dir):
    """Volumes striped and coded by the layout, that lose four shards, are rebuilt from ten, and put together again."""
    docs = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vid"), F.col("text").cast("binary").alias("data"), F.octet_length(F.col("text").cast("binary")).cast("bigint").alias("volume_size"), F.lit(0).cast("bigint").alias("offset"))
    sizes = {"large": 1024, "small": 128, "span": 4096}
    coded = erasure.encode_volumes(docs.where("volume_size > 0"), **sizes)
    left = coded.where("pmod(shard * 5 + vid * 3, 14) >= 4")
    whole = erasure.rebuild(left, ("vid", "volume_size", "span"), erasure.DATA)
    pieces = erasure.volume_pieces(whole, **sizes).groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("offset", F.lower(F.hex("data")).alias("hex")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["hex"]), "")
    return pieces.select("vid", F.floor(F.length(text) / 2).alias("bytes"), F.sha2(text, 256).alias("digest"))


_PLACED = f"""{LATEST}, sized AS (SELECT vid, key, seq, op, CASE WHEN op = 'put' THEN size ELSE 0 END AS size FROM needle_log), placed AS (SELECT vid, seq, CAST(8 + coalesce(sum(size + 28 - (size + 20) % 8) OVER (PARTITION BY vid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_offset FROM sized)"""


@query(f"{_PLACED} SELECT l.vid, l.key, p.data_offset, l.size FROM latest l JOIN placed p USING (vid, seq) WHERE l.op = 'put' UNION ALL SELECT DISTINCT vid, key, 0, -1 FROM needle_log WHERE key % 4 = 1")
def ec_index_restored(spark, sf_dir):
    log = ad.needle_log(spark, sf_dir)
    return erasure.index_of(keylog.sorted_index(log), log.where("key % 4 = 1")).withColumnRenamed("offset", "data_offset")


@query("""WITH cut AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n, doc_id * 37 % 500 AS s FROM documents WHERE octet_length(encode(text)) > 0)
SELECT doc_id AS request, least(700, n - s) AS bytes, sha256(lower(substr(h, 2 * s + 1, 2 * least(700, n - s)))) AS digest FROM cut WHERE s < n""")
def ec_range_read(spark, sf_dir):
    """A range of every volume, read from coded blocks of which four shards are lost."""
    docs = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vid"), F.col("text").cast("binary").alias("data"), F.octet_length(F.col("text").cast("binary")).cast("bigint").alias("volume_size"), F.lit(0).cast("bigint").alias("offset"))
    sizes = {"large": 1024, "small": 128, "span": 2048}
    left = erasure.encode_volumes(docs.where("volume_size > 0"), **sizes).where("pmod(shard * 5 + vid * 3, 14) >= 4")
    start = F.col("vid") * 37 % 500
    asked = docs.select(F.col("vid").alias("request"), "vid", "volume_size", start.alias("offset"), F.least(F.lit(700).cast("bigint"), F.col("volume_size") - start).alias("size")).where("size > 0")
    found = erasure.read_ranges(left, asked, **sizes)
    return found.select("request", F.octet_length("data").cast("bigint").alias("bytes"), F.sha2(F.lower(F.hex("data")), 256).alias("digest"))


# --- more codecs and catalogues ------------------------------------------------------------------------------------


@query("""SELECT p_partkey, lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS placement, p_partkey % 1000 // 100 AS centres, p_partkey % 100 // 10 AS racks, p_partkey % 10 AS nodes, p_partkey % 1000 AS byte, p_partkey % 1000 <> 0 AS copied,
CASE WHEN p_size % 6 = 0 THEN '' ELSE p_size || ['m', 'h', 'd', 'w', 'M'][p_size % 6] END AS ttl, CASE WHEN p_size % 4 = 0 THEN 'default' ELSE p_brand END AS collection, CASE WHEN p_size % 3 = 0 THEN p_partkey ELSE p_partkey + 7 END AS written,
p_size % 5 = 0 AS tombstone, p_size % 4 = 3 AS gzipped, CASE WHEN p_size % 2 = 0 THEN '/a/' || p_size ELSE '/' END AS path, CASE WHEN p_size % 3 = 0 THEN 'text/html' WHEN p_size % 3 = 1 THEN 'image/x-own' END AS mime FROM part""")
def codec_formats(spark, sf_dir):
    size, key = F.col("p_size").cast("bigint"), F.col("p_partkey")
    parts = codecs.replica_parts(F.col("placement"))
    rows = ad.table(spark, sf_dir, "part").withColumn("placement", codecs.replica_text(key % 1000))
    code = F.when(size % 6 == 0, 0).otherwise(size * 256 + size % 6)
    ext, posted = F.when(size % 3 == 0, "html").otherwise("bin"), F.when(size % 3 == 1, "image/x-own").when(size % 3 == 2, "application/octet-stream")
    return rows.select(
        "p_partkey",
        "placement",
        *(c.alias(n) for n, c in parts.items()),
        codecs.needs_copies(F.col("placement")).alias("copied"),
        codecs.ttl_text(code).alias("ttl"),
        codecs.or_default(F.when(size % 4 == 0, "").otherwise(F.col("p_brand"))).alias("collection"),
        codecs.entry_time(F.when(size % 3 == 0, F.lit((1 << 31) + 0o770)).otherwise(F.lit(0o660)), key, key + 7).alias("written"),
        codecs.is_tombstone(F.when(size % 5 == 0, -1).otherwise(size)).alias("tombstone"),
        codecs.has_flag((size % 4 + 4).cast("int"), "gzip").alias("__odd"),
        codecs.has_flag(F.when(size % 4 == 3, 5).otherwise(4), "gzip").alias("gzipped"),
        codecs.trim_slash(F.when(size % 2 == 0, F.concat(F.lit("/a/"), size.cast("string"), F.lit("/"))).otherwise("/")).alias("path"),
        codecs.upload_type(ext, posted).alias("mime"),
    ).drop("__odd")


@query(f"""{USAGE}, wanted AS (SELECT DISTINCT o_custkey * 3 % 4000 AS vid FROM orders), have AS (SELECT DISTINCT c_custkey AS vid FROM customer), fresh AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS nth FROM wanted WHERE vid NOT IN (SELECT vid FROM have)),
places AS (SELECT node, row_number() OVER (ORDER BY k DESC, node) - 1 AS nth FROM (SELECT node, unnest(range(1, free + 1)) AS k FROM usage WHERE free > 0))
SELECT f.vid, p.node AS disk, CASE WHEN p.node IS NULL THEN 'no room' ELSE 'created' END AS status FROM fresh f LEFT JOIN places p USING (nth) UNION ALL SELECT vid, NULL, 'exists' FROM wanted WHERE vid IN (SELECT vid FROM have)""")
def volume_create(spark, sf_dir):
    wanted = ad.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3 % 4000).alias("vid"))
    have = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"))
    return topology.created(have, wanted, _usage(spark, sf_dir).select(F.col("node").alias("disk"), "free"))


@query("""WITH have AS (SELECT c_custkey AS vid FROM customer), wanted AS (SELECT DISTINCT o_custkey AS vid FROM orders), busy AS (SELECT vid FROM wanted WHERE vid % 4 = 1)
SELECT vid, 'stays' AS kind FROM have WHERE vid NOT IN (SELECT vid FROM wanted) OR vid IN (SELECT vid FROM busy) UNION ALL SELECT vid, 'refused' FROM busy""")
def volume_destroy(spark, sf_dir):
    have = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"))
    wanted = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vid"))
    rest, refused = topology.destroyed(have, wanted, have.where("vid % 4 = 1").union(wanted.where("vid % 4 = 1")))
    return rest.select("vid", F.lit("stays").alias("kind")).unionByName(refused.select("vid", F.lit("refused").alias("kind")))


@query(f"WITH {_PUT}, asked AS (SELECT path FROM old UNION SELECT path FROM newp UNION SELECT '/'), n AS (SELECT path, id % 3 AS k FROM old) SELECT a.path, CASE WHEN a.path = '/' THEN 'list' WHEN k IS NULL THEN 'not found' WHEN k = 0 THEN 'no content' WHEN k = 1 THEN 'pass on' ELSE 'assemble' END AS action FROM asked a LEFT JOIN n USING (path)")
def namespace_serve(spark, sf_dir):
    old, new = _put_entries(spark, sf_dir)
    tree = old.withColumn("chunks", F.slice("chunks", F.lit(1), (F.col("mtime") % 3).cast("int")))
    asked = old.select("path").union(new.select("path")).union(spark.createDataFrame([("/",)], "path string"))
    return namespace.served(tree, asked)


@query(f"WITH {ad.REPLICAS}, kinds AS (SELECT *, vid % 3 AS ttl FROM replicas) SELECT collection, ttl, vid, count(DISTINCT node) AS replicas, bool_or(read_only) AS read_only, max(size) AS size, max(size) >= 9000 AS oversize, count(DISTINCT node) >= 2 AND NOT bool_or(read_only) AND max(size) < 9000 AND vid % 7 <> 2 AS writable FROM kinds GROUP BY collection, ttl, vid")
def layout_by_ttl(spark, sf_dir):
    """Layouts of each collection and TTL; volumes of an older version are not written."""
    held = ad.replicas(spark, sf_dir).withColumn("ttl", F.col("vid") % 3).withColumn("version", F.when(F.col("vid") % 7 == 2, 1).otherwise(topology.VERSION))
    return topology.layout(held, copies=2, limit=9000, by=("collection", "ttl"))


@query(f"WITH {ad.shards_sql('now')} SELECT vid, array_to_string(list_sort(list_distinct(list(shard))), ',') AS shards FROM now GROUP BY vid")
def ec_shard_list(spark, sf_dir):
    rows = ad.shards(spark, sf_dir)
    return erasure.shard_list(rows.unionByName(rows.where("vid % 2 = 0")))


@query(f"WITH {ad.REPLICAS}, asked AS (SELECT DISTINCT o_custkey * 2 AS vid, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'BUILDING' END AS collection FROM orders) SELECT a.vid, a.collection, nullif(array_to_string(list_sort(list_distinct(list(node))), ','), '') AS nodes FROM asked a LEFT JOIN replicas r ON r.vid = a.vid AND (a.collection = '' OR a.collection = r.collection) GROUP BY a.vid, a.collection")
def collection_lookup(spark, sf_dir):
    asked = ad.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("vid"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("BUILDING").alias("collection"))
    return topology.lookup(ad.replicas(spark, sf_dir), asked)


@query(f"{LAYOUT}, nodes AS (SELECT r_name AS dc, s_suppkey AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), c AS (SELECT l.collection, dc, l.vid, r.node FROM layout l JOIN replicas r ON r.vid = l.vid AND r.collection = l.collection JOIN nodes n ON n.node = r.node WHERE writable) SELECT collection, dc, arg_min(vid, ((vid * 7919 + 9 * 104729) % 1000003) * 1000000000000 + vid * 1000000 + node) AS vid, arg_min(node, ((vid * 7919 + 9 * 104729) % 1000003) * 1000000000000 + vid * 1000000 + node) AS node FROM c GROUP BY collection, dc")
def pick_in_centre(spark, sf_dir):
    held = ad.replicas(spark, sf_dir)
    able = topology.layout(held, copies=2, limit=9000).where("writable").select("collection", "vid")
    placed = held.select("collection", "vid", "node").join(able, ["collection", "vid"], "left_semi").join(ad.nodes(spark, sf_dir).select("dc", "node"), "node")
    return topology.pick_replica(placed, ["collection", "dc"], seed=9)


@query(f"{METRICS}, ends AS (SELECT vid, CAST(8 + sum(size + 28 - (size + 20) % 8) AS BIGINT) AS data_bytes FROM (SELECT vid, CASE WHEN op = 'put' THEN size ELSE 0 END AS size FROM needle_log) GROUP BY vid) SELECT m.*, data_bytes FROM metrics m JOIN ends USING (vid)")
def volume_status(spark, sf_dir):
    return keylog.status(ad.needle_log(spark, sf_dir))


@query(f"{LATEST} SELECT DISTINCT o_custkey % 16 AS vid, o_custkey AS key FROM orders WHERE o_custkey % 4 <> 1 AND (o_custkey % 16, o_custkey) IN (SELECT (vid, key) FROM latest WHERE op = 'put')")
def ec_blob_delete(spark, sf_dir):
    log = ad.needle_log(spark, sf_dir)
    wanted = ad.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 16).alias("vid"), F.col("o_custkey").alias("key"))
    return keylog.journalled(keylog.live(log), log.where("key % 4 = 1"), wanted)
