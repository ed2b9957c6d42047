"""Placement, layouts, codecs and ranges on hand-made values."""

import gzip
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import codecs
from quern.operators import chunks, erasure, objects, topology

CLUSTER = [("dc1", "rack11", 111, 3, [1, 2, 3]), ("dc1", "rack11", 112, 10, [4, 5, 6]), ("dc1", "rack12", 121, 4, [4, 5, 6]), ("dc1", "rack12", 122, 4, []), ("dc1", "rack12", 123, 5, [2, 3, 4]), ("dc3", "rack32", 321, 4, [1, 3, 5])]


def usage(spark):
    nodes = spark.createDataFrame([r[:4] for r in CLUSTER], "dc string, rack string, node bigint, slots bigint")
    held = spark.createDataFrame([(v, r[2]) for r in CLUSTER for v in r[4]], "vid bigint, node bigint")
    return topology.node_usage(nodes, held)


def test_counters_of_a_small_cluster(spark):
    got = {(r.dc, r.rack, r.node): (r.volumes, r.slots) for r in topology.rolled_up(usage(spark)).collect()}
    assert got[None, None, None] == (15, 30) and got["dc1", None, None] == (12, 26) and got["dc3", None, None] == (3, 4)
    assert got["dc1", "rack11", None] == (6, 13) and got["dc1", "rack12", None] == (6, 13) and got["dc1", "rack12", 122] == (0, 4)


def test_copies_are_placed_where_there_is_room(spark):
    requests = spark.createDataFrame([(i, i) for i in range(60)], "request bigint, seed bigint")
    rows = topology.place(usage(spark), requests, centres=0, racks=0, nodes=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.request, []).append((r.nth, r.node))
    # Only rack12 has three nodes with room.
    assert len(by) == 60 and all(sorted(n for _, n in x) == [121, 122, 123] for x in by.values()) and {min(x)[1] for x in by.values()} == {121, 122, 123}
    # A copy in another centre, then in another rack.
    for kind in ({"centres": 1, "racks": 0}, {"centres": 0, "racks": 1}):
        rows = topology.place(usage(spark), requests, nodes=0, **kind).collect()
        dc = {r[2]: r[0] if kind["centres"] else r[1] for r in CLUSTER}
        pairs = {}
        for r in rows:
            pairs.setdefault(r.request, []).append(r.node)
        assert len(pairs) == 60 and all(len(x) == 2 and dc[x[0]] != dc[x[1]] and 111 not in x for x in pairs.values())
    assert topology.place(usage(spark), requests, centres=2, racks=0, nodes=0).count() == 0
    grown = topology.grow(usage(spark), requests.limit(2), 10, centres=0, racks=0, nodes=0)
    assert sorted({r.vid for r in grown.collect()}) == list(range(10, 24))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_requests_meet_their_nodes_without_a_list_of_them(spark):
    nodes = spark.createDataFrame([(f"d{n % 2}", f"r{n % 6}", n * 3, 40) for n in range(60)], "dc string, rack string, node bigint, slots bigint")
    held = topology.node_usage(nodes, spark.createDataFrame([(1, 0), (2, 3)], "vid bigint, node bigint"))
    requests = spark.createDataFrame([(i, i * 7, f"x{i}") for i in range(300)], "request bigint, seed bigint, note string")
    df = topology.place(held, requests, centres=1, racks=1, nodes=2)
    assert not any(f"{f}(node" in _plan(df) for f in ("collect_set", "collect_list"))
    where, by = {r.node: (r.dc, r.rack) for r in nodes.collect()}, {}
    for r in df.collect():
        assert r.note == f"x{r.request}"
        by.setdefault(r.request, {})[r.nth] = r.node
    assert len(by) == 300
    for got in by.values():
        at = [where[got[i]] for i in range(5)]
        assert len({got[i] for i in range(3)}) == 3 and len(set(at[:3])) == 1 and at[3][0] == at[0][0] and at[3][1] != at[0][1] and at[4][0] != at[0][0]
    assert len({got[0] for got in by.values()}) == 60  # every node is drawn


def test_requests_meet_their_volume_without_a_list_of_them(spark):
    requests = spark.createDataFrame([(i, "abn"[i % 3]) for i in range(200)], "request bigint, collection string")
    writable = spark.createDataFrame([("ab"[v % 2], v * 5) for v in range(21)], "collection string, vid bigint")
    df = topology.assign(requests, writable, spark.createDataFrame([("a", 100)], "collection string, id bigint"), "collection")
    assert "collect_set(vid" not in _plan(df)
    got = {r.request: r.fid for r in df.collect()}
    vids = {c: sorted(r.vid for r in writable.collect() if r.collection == c) for c in "ab"}
    for i in range(200):
        c = "abn"[i % 3]
        assert got[i] is None if c == "n" else int(got[i].split(",")[0]) == vids[c][(i * 7919 + 11 * 104729) % 1_000_003 % len(vids[c])]


def test_draws_meet_the_same_nodes_whatever_the_buckets(spark):
    rng = random.Random(2)
    nodes = spark.createDataFrame([(f"d{n % 3}", n, rng.choice([0, 1, 5, 300])) for n in range(60)], "dc string, node bigint, free bigint")
    draws = spark.createDataFrame([(f"d{i % 3}", i * 37) for i in range(500)], "dc string, draw bigint")
    got = [sorted(map(tuple, topology.reserve(nodes, draws, width).collect())) for width in (1, 7, 64, 10**6)]
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == 500


def test_hashes_of_texts(spark):
    texts = {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codecs.fnv1a(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in rows} == texts


@pytest.mark.parametrize("header, want", [("", []), ("bytes=0-9", [(0, 10)]), ("bytes=5-", [(5, 95)]), ("bytes=-7", [(93, 7)]), ("bytes=-700", [(0, 100)]), ("bytes=90-200", [(90, 10)]), ("bytes= 0-0 , 99-99", [(0, 1), (99, 1)]), ("bytes=100-", None), ("bytes=100-,3-4", [(3, 2)]), ("bytes=4-3", None), ("bytes=x-3", None), ("bytes=-", None), ("rows=1-2", None)])
def test_range_headers(spark, header, want):
    got = spark.createDataFrame([(header,)], "h string").select(objects.parse_ranges(F.col("h"), F.lit(100).cast("bigint")).alias("r")).first().r
    assert (None if got is None else [tuple(x) for x in got]) == want


def test_kept_headers(spark):
    row = spark.range(1).select(codecs.pairs_of(F.create_map(F.lit("Own-A"), F.lit("1"), F.lit("Host"), F.lit("h"), F.lit("own-b"), F.lit("2")), "Own-").alias("m")).first()
    assert row.m == {"Own-A": "1", "own-b": "2"}


@pytest.mark.parametrize("bucket", [7, 64])
def test_a_range_is_resolved_from_its_chunks_alone(spark, bucket):
    rng = random.Random(bucket)
    rows = [(f, p, rng.randrange(300), rng.randrange(80), p) for f in range(3) for p in range(40)]
    df = spark.createDataFrame(rows, "file bigint, pos bigint, offset bigint, size bigint, fid bigint")
    for offset, size in ((0, 50), (90, 120), (200, 500)):
        whole = chunks.view(chunks.visible(df, bucket), offset, size)
        assert sorted(map(tuple, chunks.range_view(df, offset, size, bucket).collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("span", [8, 16, 40])
def test_volumes_come_back_from_any_ten_shards(spark, span):
    rng = random.Random(span)
    bodies = {v: bytes(rng.randrange(256) for _ in range(n)) for v, n in enumerate((1, 79, 80, 81, 640, 641, 1500))}
    pieces = [(v, len(b), at, b[at : at + 37]) for v, b in bodies.items() for at in range(0, len(b), 37)]
    df = spark.createDataFrame(pieces, "vid bigint, volume_size bigint, offset bigint, data binary")
    sizes = {"large": 64 if span != 40 else 80, "small": 8, "span": span}
    coded = erasure.encode_volumes(df, **sizes)
    sizes_of = {(r.vid, r.shard): r.n for r in coded.groupBy("vid", "shard").agg(F.sum(F.octet_length("block")).alias("n")).collect()}
    for v, b in bodies.items():
        rows = (len(b) - 1) // (10 * sizes["large"])
        assert {sizes_of[v, s] for s in range(14)} == {rows * sizes["large"] + -(-(len(b) - rows * 10 * sizes["large"]) // 80) * 8}
    lost = coded.where("pmod(shard * 3 + vid, 14) >= 4")
    whole = erasure.rebuild(lost.select((F.col("vid") * 1000 + F.col("span")).alias("key"), "shard", "block")).select(F.floor(F.col("key") / 1000).alias("vid"), (F.col("key") % 1000).alias("span"), "shard", "block")
    back = erasure.volume_pieces(whole.join(df.select("vid", "volume_size").distinct(), "vid"), **sizes).collect()
    got = {}
    for r in sorted(back, key=lambda r: (r.vid, r.offset)):
        assert r.offset == len(got.get(r.vid, b""))
        got[r.vid] = got.get(r.vid, b"") + bytes(r.data)
    assert got == bodies
    asked = [(i, v, len(b), rng.randrange(len(b)), 0) for i, (v, b) in enumerate(bodies.items())]
    asked = [(i, v, n, o, min(n - o, 111)) for i, v, n, o, _ in asked]
    found = erasure.read_ranges(lost, spark.createDataFrame(asked, "request bigint, vid bigint, volume_size bigint, offset bigint, size bigint"), **sizes)
    assert {r.request: bytes(r.data) for r in found.collect()} == {i: bodies[v][o : o + z] for i, v, _, o, z in asked}
    assert erasure.read_ranges(lost.where("shard > 4"), spark.createDataFrame(asked, "request bigint, vid bigint, volume_size bigint, offset bigint, size bigint"), **sizes).where("request >= 0").count() < len(asked)


def test_blocks_are_coded_once_and_side_by_side(spark, monkeypatch):
    rng = random.Random(5)
    bodies = {v: bytes(rng.randrange(256) for _ in range(50 + v * 7)) for v in range(40)}
    df = spark.createDataFrame([(v, len(b), 0, b) for v, b in bodies.items()], "vid bigint, volume_size bigint, offset bigint, data binary")
    sizes = {"large": 64, "small": 8, "span": 16}
    left = erasure.encode_volumes(df, **sizes).where("pmod(shard * 5 + vid * 3, 14) >= 4")
    asked = spark.createDataFrame([(v * 2 + i, v, len(b), i * 20, 30) for v, b in bodies.items() for i in range(2)], "request bigint, vid bigint, volume_size bigint, offset bigint, size bigint")
    found = erasure.read_ranges(left, asked, **sizes)
    assert _plan(found).count("MapInArrow") == 2 and "MapGroups" not in _plan(found)
    assert {r.request: bytes(r.data) for r in found.collect()} == {v * 2 + i: b[i * 20 : i * 20 + 30] for v, b in bodies.items() for i in range(2)}
    # One flush of a batch holds many keys with different losses and widths; a flush for each key gives the same.
    whole = [erasure.rebuild(left, ("vid", "span")), erasure.rebuild(left, ("vid", "span"), erasure.DATA)]
    rows = [{(r.vid, r.span, r.shard): bytes(r.block) for r in w.collect()} for w in whole]
    assert rows[1] == {k: b for k, b in rows[0].items() if k[2] < erasure.DATA} and {k[2] for k in rows[0]} == set(range(14))
    coded = {(r.vid, r.span, r.shard): bytes(r.block) for r in erasure.encode_volumes(df, **sizes).collect()}
    assert rows[0] == coded


def test_shards_are_dealt_before_they_are_counted(spark):
    held = spark.createDataFrame([(v, s, (v + s * 3) % 23) for v in range(20) for s in range(14)], "vid bigint, shard bigint, node bigint")
    for df in (erasure.shards_by_node(held), erasure.read_plan(held.select("vid", "shard"), held, 7)):
        assert "RepartitionByExpression" in _plan(df)
    want = {}
    for v, s, n in ((v, s, (v + s * 3) % 23) for v in range(20) for s in range(14)):
        want[n, v] = want.get((n, v), 0) | 1 << s
    assert {(r.node, r.vid): r.bits for r in erasure.shards_by_node(held).collect()} == want


def test_bodies_are_zipped_and_unzipped_in_small_pieces(spark):
    bodies = [bytes([n % 251]) * (300_000 + n) for n in range(40)]
    plain = [None, b"", *bodies[:20], None, *bodies[20:]]
    stored = pa.array([None if x is None else gzip.compress(x, 6, mtime=0) for x in plain], pa.binary())
    found = list(objects.unzipped.func(iter([stored, stored.slice(0, 2), stored.slice(5, 1)])))
    assert [x for a in found for x in a.to_pylist()] == [*plain, *plain[:2], plain[5]]
    assert max(a.nbytes for a in found) < 2 * objects.PIECE_BYTES  # of 12 MB
    assert [x for a in objects.zipped.func(iter([pa.array(plain, pa.binary())])) for x in a.to_pylist()] == stored.to_pylist()
    rows = spark.createDataFrame([(n, bytearray(x) if x is not None else None, n % 2 == 0) for n, x in enumerate(plain)], "n int, data binary, accepts boolean").repartition(2)
    packed = objects.packed(rows).withColumn("sent", objects.served(F.col("data"), F.col("flags"), F.col("accepts"), F.lit("txt")))
    for r in packed.collect():
        zipped = plain[r.n] is not None and len(plain[r.n]) > 0
        assert (codecs.FLAGS["gzip"] == r.flags) == zipped
        assert (None if r.sent is None else bytes(r.sent)) == (gzip.compress(plain[r.n], 6, mtime=0) if zipped and r.accepts else plain[r.n])
