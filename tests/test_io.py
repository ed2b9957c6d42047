"""Binary logs and streams: what is written is read back."""

import json
import struct

from pyspark.sql import functions as F

from quern.operators import keylog
from quern.sources import logs
from quern.streaming import heartbeats


def test_index_log(spark, tmp_path):
    logs.register(spark)
    rows = [(3, i, 0xFFFFFFFFFFFFFFF0 + i % 3 if i % 2 else i, i * 8, -1 if i % 5 == 0 else i) for i in range(100)]
    df = spark.createDataFrame([(v, s, str(k), o, z) for v, s, k, o, z in rows], "vid bigint, seq bigint, key string, offset bigint, size int").withColumn("key", F.col("key").cast("decimal(20,0)"))
    parts = logs.encode_index(df).orderBy("part").collect()
    (tmp_path / "c_3.idx").write_bytes(b"".join(bytes(p.content) for p in parts))
    back = spark.read.format("needle_index").option("stretch_rows", "7").load(str(tmp_path))
    assert sorted((r.vid, r.seq, int(r.key), r.offset, r["size"]) for r in back.collect()) == rows


def test_journal_log(spark, tmp_path):
    logs.register(spark)
    (tmp_path / "9.ecj").write_bytes(struct.pack(">3Q", 5, 1 << 63, 7))
    assert [int(r.key) for r in spark.read.format("needle_journal").load(str(tmp_path)).orderBy("seq").collect()] == [5, 1 << 63, 7]
    assert spark.read.format("needle_journal").load(str(tmp_path / "none.ecj")).count() == 0


def test_data_log(spark, tmp_path):
    logs.register(spark)
    rows = [(4, i, i + 1, i * 3, bytes([i]) * (i * 5 % 23), f"n{i}" if i % 2 else None, "text/plain" if i % 3 else None, 1700000000 + i if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "vid bigint, seq bigint, key bigint, cookie bigint, data binary, name string, mime string, last_modified bigint")
    made = logs.encode_data(df).orderBy("seq").collect()
    at = 8
    for r in made:
        assert r.offset == at and len(r.content) % 8 == 0
        at += len(r.content)
    whole = logs.encode_super_block("010", (3, 2), 7) + b"".join(bytes(r.content) for r in made)
    (tmp_path / "4.dat").write_bytes(whole + b"\0\0\0\1cut off")
    back = spark.read.format("needle_data").load(str(tmp_path)).orderBy("seq").collect()
    some = lambda x, full: x if full else None
    assert [(r.vid, r.seq, int(r.key), r.cookie, bytes(r.data), r.name, r.mime, r.last_modified) for r in back] == [(v, s, k, c, d, some(n, d), some(m, d), some(t, d)) for v, s, k, c, d, n, m, t in rows]
    assert all(r.intact for r in back) and [r.offset for r in back] == [r.offset for r in made]
    head = spark.createDataFrame([(whole[:8],)], "c binary").select(*(x.alias(n) for n, x in logs.super_block(F.col("c")).items())).first()
    assert tuple(head) == (2, "010", 3, 2, 7)


def test_heartbeat_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    beats = spark.readStream.schema("node bigint, ts bigint, vids array<bigint>").json(str(source))
    send = lambda n, rows: (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("node", "ts", "vids"), r))) for r in rows))
    send(1, [(1, 1, [1, 2]), (2, 1, [2]), (1, 2, [1, 3])])
    heartbeats.follow(beats, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(map(tuple, heartbeats.read_state(spark, str(tmp_path / "out")).collect())) == [(1, 1), (1, 3), (2, 2)]
    send(2, [(1, 3, [3])])
    heartbeats.follow(beats, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(map(tuple, heartbeats.read_state(spark, str(tmp_path / "out")).collect())) == [(1, 3), (2, 2)]
    changes = spark.read.parquet(str(tmp_path / "out" / "changes"))
    assert [(r.node, r.vid) for r in changes.where("change = 'deleted'").collect()] == [(1, 1)]


def test_streaming_replay(spark, tmp_path):
    log = [(1, k % 3, s, "del" if s % 4 == 3 else "put", s) for s, k in enumerate(range(12))]
    df = spark.createDataFrame(log, "vid bigint, key bigint, seq bigint, op string, size bigint")
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    query = heartbeats.live_keys(stream).writeStream.format("memory").queryName("replayed").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.vid, r.key): (r.seq, r.op) for r in spark.table("replayed").collect()}
    assert got == {(r.vid, r.key): (r.seq, r.op) for r in keylog.latest(df).collect()}


RECORDS = [(4 + i % 2, i, i + 1, i * 3, bytes([i]) * (i * 5 % 23 + 1), f"n{i}" if i % 2 else None, "text/plain" if i % 3 else None, 1700000000 + i if i % 4 else None, 3 if i % 5 == 0 else None, 2 if i % 5 == 0 else None, None, 0) for i in range(40)]
RECORD = "vid bigint, seq bigint, key bigint, cookie bigint, data binary, name string, mime string, last_modified bigint, ttl_count int, ttl_unit int, pairs string, flags int"


def test_sinks_write_what_the_sources_read(spark, tmp_path):
    logs.register(spark)
    rows = spark.createDataFrame(RECORDS, RECORD)
    logs.by_volume(rows.repartition(3)).write.format("needle_data").mode("append").save(str(tmp_path))
    back = spark.read.format("needle_data").load(str(tmp_path))
    want = sorted((v, k, c, bytes(d), t) for v, _, k, c, d, _, _, _, t, _, _, _ in RECORDS)
    assert sorted((r.vid, int(r.key), r.cookie, bytes(r.data), r.ttl_count) for r in back.collect()) == want and {r.intact for r in back.collect()} == {True}
    index = back.select("vid", "seq", "key", "offset", "size")
    logs.by_volume(index).write.format("needle_index").mode("append").save(str(tmp_path))
    read = spark.read.format("needle_index").load(str(tmp_path))
    assert sorted(map(tuple, read.select("vid", "seq", "key", "offset", "size").collect())) == sorted(map(tuple, index.collect()))
    logs.by_volume(read.where("seq < 3")).select("vid", "seq", "key").write.format("needle_journal").mode("append").save(str(tmp_path))
    assert spark.read.format("needle_journal").load(str(tmp_path)).count() == 6
    assert {(r.collection, r.vid) for r in logs.discovered(spark, str(tmp_path)).collect()} == {("", 4), ("", 5)}
    # What is there isn't written over, and nothing is left of the attempt.
    try:
        logs.by_volume(index).write.format("needle_index").mode("append").save(str(tmp_path))
        raise AssertionError("written twice")
    except Exception as e:
        assert "there already" in str(e)
    assert not [x for x in tmp_path.iterdir() if x.name.startswith(".")]


def test_records_are_read_by_their_place_and_checked(spark, tmp_path):
    logs.register(spark)
    logs.by_volume(spark.createDataFrame(RECORDS, RECORD)).write.format("needle_data").mode("append").save(str(tmp_path))
    index = spark.read.format("needle_data").load(str(tmp_path)).select("vid", "seq", "key", "offset", "size").cache()
    asked = index.where("seq % 3 = 1")
    got = {(r.vid, int(r.key)): bytes(r.data) for r in logs.fetch(asked, str(tmp_path)).collect()}
    assert got == {(v, k): d for v, _, k, _, d, *_ in RECORDS if (v, k) in {(r.vid, int(r.key)) for r in asked.collect()}} and len(got) > 10
    assert logs.fetch(spark.createDataFrame([(9, 8), (4, 10**9)], "vid bigint, offset bigint"), str(tmp_path)).count() == 0
    assert logs.integrity(index, str(tmp_path)).count() == 0
    last = index.where("vid = 4").orderBy(F.desc("seq")).first()
    path = tmp_path / "4.dat"
    raw = bytearray(path.read_bytes())
    raw[last.offset + 16 + 4] ^= 1  # a byte of its data
    path.write_bytes(raw)
    assert [(r.vid, r.reason) for r in logs.integrity(index, str(tmp_path)).collect()] == [(4, "checksum")]
    path.write_bytes(raw[: last.offset + 5])
    assert [(r.vid, r.reason) for r in logs.integrity(index, str(tmp_path)).collect()] == [(4, "unreadable")]
    wrong = index.withColumn("key", F.when((F.col("vid") == 5) & (F.col("seq") == 19), F.col("key") + 1).otherwise(F.col("key")).cast("decimal(20,0)"))
    assert {(r.vid, r.reason) for r in logs.integrity(wrong, str(tmp_path)).collect()} == {(4, "unreadable"), (5, "other key")}


def test_shards_and_information_files_are_found(spark, tmp_path):
    for shard in (0, 3, 13):
        (tmp_path / f"pics_7.ec{shard:02d}").write_bytes(b"x" * 40)
    (tmp_path / "pics_7.ecx").write_bytes(bytes(16))
    (tmp_path / "8.ec01").write_bytes(b"y")  # without an index
    assert [tuple(r) for r in logs.discovered_shards(spark, str(tmp_path)).collect()] == [("pics", 7, 1 | 1 << 3 | 1 << 13, 3, 40, True)]
    shards = spark.createDataFrame([(7, 0, bytes(range(40)))], "vid bigint, shard bigint, content binary")
    wanted = spark.createDataFrame([(1, 7, 0, 5, 20), (2, 7, 0, 30, 99), (3, 7, 0, 40, 5)], "request bigint, vid bigint, shard bigint, offset bigint, size bigint")
    got = {}
    for r in logs.shard_ranges(shards, wanted, buffer=8).orderBy("request", "nth").collect():
        got[r.request] = got.get(r.request, b"") + bytes(r.data)
    assert got == {1: bytes(range(5, 25)), 2: bytes(range(30, 40))}
    info = spark.createDataFrame([(7, [("s3", "a", "k", 0, 9, 1, ".dat")], 2, "001"), (8, [], 2, "000")], f"vid bigint, {logs.VOLUME_INFO}")
    for r in logs.encode_volume_info(info).collect():
        (tmp_path / f"{r.vid}.vif").write_text(r.content)
    assert [tuple(r) for r in logs.volume_info(spark, str(tmp_path)).collect()] == [tuple(info.first())]


def test_heartbeats_rewrite_the_parts_they_touch(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    beats = spark.readStream.schema("node bigint, ts bigint, vids array<bigint>").json(str(source))
    send = lambda n, rows: (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("node", "ts", "vids"), r))) for r in rows))
    run = lambda **k: heartbeats.follow(beats, str(out), str(tmp_path / "cp"), parts=4, **k).awaitTermination(120)
    state = lambda: sorted(map(tuple, heartbeats.read_state(spark, str(out)).collect()))
    send(1, [(n, 10, [n, n + 100]) for n in range(8)])
    run()
    for turn in range(2, 6):
        send(turn, [(1, turn * 10, [turn]), (2, turn * 10, [])])
        run()
    want = sorted([(n, v) for n in (0, *range(3, 8)) for v in (n, n + 100)] + [(1, 5)])
    assert state() == want
    kept = [len(list(p.iterdir())) for p in (out / "state").iterdir() if p.name.startswith("part=")]
    assert max(kept) <= 2
    send(6, [(3, 60, [3])])
    run(silent=15)  # all but 1 and 3 have been silent since 10
    assert state() == [(1, 5), (3, 3)]
    changes = spark.read.parquet(str(out / "changes")).where("batch = 5")
    assert changes.where("change = 'deleted'").count() == 11


def test_sessions_stream(spark, tmp_path):
    rows = [(1, f"2024-01-01T00:{m:02d}:00Z") for m in (0, 10, 55)] + [(2, "2024-01-01T00:05:00Z"), (3, "2024-01-03T00:00:00Z")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"node": n, "ts": t}) for n, t in rows))
    stream = spark.readStream.schema("node bigint, ts timestamp").json(str(tmp_path / "in"))
    query = heartbeats.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.node, r.beats) for r in spark.table("sessions").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]  # the last one isn't over yet


def test_vacuum_and_deletion_loops(spark, tmp_path):
    log = [(v, s % 4, s, "put", 10) for v in (1, 2) for s in range(12 if v == 1 else 4)]
    df = spark.createDataFrame(log, "vid bigint, key bigint, seq bigint, op string, size bigint")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"vid": v, "key": k}) for v, k in [(1, 0), (1, 0), (2, 3), (2, 9)]))
    queue = spark.readStream.schema("vid bigint, key bigint").json(str(tmp_path / "in"))
    heartbeats.vacuum_loop(queue, lambda: df, str(tmp_path / "vacuum"), str(tmp_path / "cp1")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "vacuum"))
    assert {(r.vid, r.key, r.seq) for r in got.collect()} == {(1, k, 8 + k) for k in range(4)}  # volume 2 has no garbage
    heartbeats.deletion_loop(queue, lambda: df, str(tmp_path / "gone"), str(tmp_path / "cp2")).awaitTermination(120)
    gone = spark.read.parquet(str(tmp_path / "gone"))
    assert sorted((r.vid, r.key, r.seq, r.op) for r in gone.collect()) == [(1, 0, 12, "del"), (2, 3, 4, "del")]
