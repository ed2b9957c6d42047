"""Operators against sequential models."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import codecs
from quern.operators import chunks, erasure, keylog, namespace, topology


def test_replay_keeps_the_last_put(spark):
    rng, log = random.Random(1), []
    for seq in range(400):
        log.append((rng.randrange(3), rng.randrange(20), seq, rng.choice(["put", "put", "del"]), rng.randrange(1, 50)))
    state, counters = {}, {v: [0, 0, 0, 0, 0] for v in range(3)}
    for vid, key, seq, op, size in log:
        c = counters[vid]
        if (vid, key) in state:
            c[2], c[3] = c[2] + 1, c[3] + state[vid, key][1]
        c[4] = max(c[4], key)
        if op == "put":
            c[0], c[1] = c[0] + 1, c[1] + size
            state[vid, key] = (seq, size)
        else:
            state.pop((vid, key), None)
    df = spark.createDataFrame(log, "vid bigint, key bigint, seq bigint, op string, size bigint")
    assert {(r.vid, r.key): (r.seq, r["size"]) for r in keylog.live(df).collect()} == state
    assert {r.vid: list(r)[1:] for r in keylog.metrics(df).collect()} == counters
    for mark in (0, 150, 400):
        assert {(r.vid, r.key): (r.seq, r["size"]) for r in keylog.caught_up(df, mark).collect()} == state


def test_running_sum_is_the_same_for_every_stretch(spark):
    rows = [(k, i, (i * 7) % 11) for k in range(2) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, i bigint, v bigint")
    for stretch in (1, 7, 1000):
        got = {(r.k, r.i): r.s for r in keylog.running_sum(df, ["k"], "i", F.col("v"), "s", stretch).collect()}
        assert got == {(k, i): sum(v for a, j, v in rows if a == k and j < i) for k, i, _ in rows}


def test_ttl_and_expiry(spark):
    df = spark.createDataFrame([("",), ("5",), ("3h",), ("2d",), ("1w",), ("1M",), ("1y",), ("255m",), ("256m",), ("5x",), ("h",)], "t string")
    got = [r.m for r in df.select(codecs.ttl_minutes(F.col("t")).alias("m")).collect()]
    assert got == [0, 5, 180, 2880, 10080, 44640, 525600, 255, None, None, None]
    row = spark.range(1).select(
        *(keylog.is_expired(F.lit(ttl).cast("bigint"), F.lit(lm).cast("bigint"), F.lit(now)).alias(n) for n, ttl, lm, now in (("at", 1, 0, 60), ("before", 1, 0, 59), ("none", 0, 0, 10**9), ("never", 1, None, 10**9)))
    ).first()
    assert list(row) == [True, False, False, False]


def test_file_ids(spark):
    key = 0xFED4C8114ED4C811
    df = spark.createDataFrame([(3, Decimal(key), 0x01020304)], "vid bigint, key decimal(20,0), cookie bigint")
    assert df.select(codecs.format_fid(F.col("vid"), F.col("key"), F.col("cookie"))).first()[0] == "3,fed4c8114ed4c81101020304"
    texts = ["3,fed4c8114ed4c81101020304", "3,0101020304_5", "3,01020304", "x,0101020304", "3;0101020304", None, ""]
    parsed = codecs.parse_fid(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(*parsed.values()).collect()]
    assert (int(got[0][0]), int(got[0][1]), int(got[0][2])) == (3, key, 0x01020304)
    assert (int(got[1][0]), int(got[1][1])) == (3, 6)
    assert all(x == (None, None, None) for x in got[2:])


@pytest.mark.parametrize("bucket", [7, 64, 1 << 20])
def test_visible_chunks(spark, bucket):
    rng = random.Random(bucket)
    rows = [(f, p, rng.randrange(200), rng.randrange(0, 60), f * 1000 + p) for f in range(3) for p in range(25)]
    model = {f: {} for f in range(3)}
    for f, p, off, size, fid in rows:
        for b in range(off, off + size):
            model[f][b] = (fid, b - off)
    got = {f: {} for f in range(3)}
    runs = chunks.visible(spark.createDataFrame(rows, "file bigint, pos bigint, offset bigint, size bigint, fid bigint"), bucket).collect()
    for r in runs:
        for b in range(r.start, r.stop):
            assert b not in got[r.file]
            got[r.file][b] = (r.fid, r.chunk_offset + b - r.start)
    assert got == model
    by_file = sorted((r.file, r.start, r.stop, r.fid) for r in runs)
    assert all(a[0] != b[0] or a[2] < b[1] or a[3] != b[3] for a, b in zip(by_file, by_file[1:]))


def test_namespace(spark):
    df = spark.createDataFrame([("/a/b/c",), ("/a/bb",), ("/d",)], "path string")
    tree = namespace.with_parents(df)
    assert sorted(r.path for r in tree.collect()) == ["/", "/a", "/a/b", "/a/b/c", "/a/bb", "/d"]
    assert [r.name for r in namespace.list_page(tree, "/a").collect()] == ["b", "bb"]
    assert [r.name for r in namespace.list_page(tree, "/a", after="b").collect()] == ["bb"]
    assert sorted(r.path for r in namespace.delete_recursive(tree, "/a/b").collect()) == ["/", "/a", "/a/bb", "/d"]
    old = spark.createDataFrame([("/a", 1, 1), ("/b", 2, 2)], "path string, mtime bigint, crtime bigint")
    new = spark.createDataFrame([("/a", 9, 9), ("/c", 9, 9)], "path string, mtime bigint, crtime bigint")
    assert sorted(map(tuple, namespace.upsert(old, new).collect())) == [("/a", 9, 1), ("/b", 2, 2), ("/c", 9, 9)]


def test_stripes_read_back_every_byte(spark):
    large, small, cases = 16, 4, []
    for size in (1, 39, 40, 41, 159, 160, 161, 320, 321, 500):
        cases += [(size, o, n) for o in range(0, size, 37) for n in (1, 5, 90) if o + n <= size]
    df = spark.createDataFrame(cases, "volume_size bigint, offset bigint, size bigint")
    layout = {}
    for size in {c[0] for c in cases}:
        at, place = 0, {}
        rows = (size - 1) // (10 * large)
        base = 0
        while at < size:
            block = large if base < rows * large else small
            for s in range(10):
                for b in range(block):
                    place[s, base + b] = at
                    at += 1
            base += block
        layout[size] = place
    for r in erasure.intervals(df, large, small).collect():
        for b in range(r["length"]):
            assert layout[r.volume_size][r.shard, r.shard_offset + b] == r.offset + r.range_offset + b
    total = erasure.intervals(df, large, small).agg(F.sum("length")).first()[0]
    assert total == sum(c[2] for c in cases)


def test_any_four_shards_may_be_lost(spark):
    import itertools

    matrix = erasure.coding_matrix()
    assert (matrix[:10] == np.eye(10, dtype=np.uint8)).all()
    data = np.frombuffer(random.Random(5).randbytes(10 * 33), np.uint8).reshape(10, 33)
    every = np.concatenate([data, erasure.combine(matrix[10:], data)])
    for lost in list(itertools.combinations(range(14), 4))[::13]:
        have = [i for i in range(14) if i not in lost]
        assert (erasure.combine(erasure.invert(matrix[have]), every[have]) == data).all()
    stripes = spark.createDataFrame([(1, b"abc" * 50), (2, b""), (3, b"x")], "key bigint, body binary")
    coded = erasure.encode(stripes)
    whole = {(r.key, r.shard): bytes(r.block) for r in coded.collect()}
    back = erasure.rebuild(coded.where("shard NOT IN (0, 5, 11, 13)"))
    assert {(r.key, r.shard): bytes(r.block) for r in back.collect()} == whole
    assert erasure.rebuild(coded.where("shard > 4")).count() == 0


def test_shard_sets(spark):
    old = spark.createDataFrame([(1, 0b0111), (2, 0b1)], "vid bigint, bits bigint")
    new = spark.createDataFrame([(1, 0b1101), (3, 0b10)], "vid bigint, bits bigint")
    assert sorted(map(tuple, erasure.bits_diff(old, new, ["vid"]).collect())) == [(1, 0b1000, 0b10), (2, 0, 1), (3, 2, 0)]
    row = erasure.missing(new.where("vid = 3")).first()
    assert (row.held, row.repairable, row.missing) == (1, False, "0,2,3,4,5,6,7,8,9,10,11,12,13")


def test_snapshots_and_placement(spark):
    old = spark.createDataFrame([(1, 1), (1, 2)], "node bigint, vid bigint")
    new = spark.createDataFrame([(1, 2), (1, 3)], "node bigint, vid bigint")
    assert sorted(map(tuple, topology.snapshot_diff(old, new, ["node", "vid"]).collect())) == [(1, 1, "deleted"), (1, 3, "new")]
    usage = spark.createDataFrame([("d1", "r1", 1, 1), ("d1", "r1", 2, 1), ("d1", "r2", 3, 1), ("d1", "r2", 4, 2), ("d2", "r3", 5, 9)], "dc string, rack string, node bigint, free bigint")
    assert sorted(r.node for r in topology.placements(usage, racks=1, nodes=1).collect()) == [1, 2, 3, 4]
    assert sorted(r.node for r in topology.placements(usage, racks=0, nodes=0).collect()) == [1, 2, 3, 4, 5]
