"""Operators over the cluster: nodes (dc, rack, node, slots) and volume replicas (vid, node, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import codecs
from quern.operators.keylog import running_sum

#: Free slots of a centre that are looked through together.
SLOTS = 64


def free_slots(slots: Column, volumes: Column, shards: Column | None = None) -> Column:
    """Volumes a node still has room for; ten shards or a part of that take one slot."""
    used = volumes if shards is None else volumes + F.when(shards > 0, F.floor(shards / 10) + 1).otherwise(0)
    return slots - used


def node_usage(nodes: DataFrame, replicas: DataFrame) -> DataFrame:
    """Nodes with how many volumes they hold, the largest id and the room left."""
    held = replicas.groupBy("node").agg(F.count(F.lit(1)).alias("volumes"), F.max("vid").alias("max_vid"))
    usage = nodes.join(held, "node", "left").withColumn("volumes", F.coalesce("volumes", F.lit(0)))
    return usage.withColumn("free", free_slots(F.col("slots"), F.col("volumes")))


def rolled_up(usage: DataFrame) -> DataFrame:
    """Counters of every node, rack, data centre and of the whole, null above their level."""
    return usage.rollup("dc", "rack", "node").agg(F.sum("volumes").alias("volumes"), F.sum("slots").alias("slots"), F.max("max_vid").alias("max_vid"))


def _rack_room(usage: DataFrame, racks: int, nodes: int) -> DataFrame:
    """(dc, rack, open_nodes, good), a row for each rack: how many of its nodes have room, and whether it can take the main copy of ``placements``."""
    there = F.when(F.col("free") >= 1, F.col("node"))
    by_rack = usage.groupBy("dc", "rack").agg(F.count(there).alias("__rows"), F.count_distinct(there).alias("open_nodes"), F.sum("free").alias("rack_free"))
    dc = Window.partitionBy("dc")
    open_ = F.col("__rows") > nodes
    good_dc = (F.count(F.lit(1)).over(dc) > racks) & (F.count(F.when(open_, 1)).over(dc) > racks) & (F.sum("rack_free").over(dc) >= racks + nodes + 1)
    return by_rack.select("dc", "rack", "open_nodes", (good_dc & open_ & (F.col("rack_free") >= nodes + 1)).alias("good"))


def placements(usage: DataFrame, racks: int, nodes: int) -> DataFrame:
    """Nodes that can take the main copy of a volume with copies in ``racks`` other racks and on ``nodes`` other nodes of its rack."""
    good = _rack_room(usage, racks, nodes).where("good").select("dc", "rack")
    return usage.where("free >= 1").join(good, ["dc", "rack"], "left_semi").select("dc", "rack", "node", "free")


def _places(n: Column, seed: Column, own: Column, count: int) -> list[Column]:
    """``count`` of the places from 0 to ``n`` without ``own``, which follow each other from the one that ``seed`` names on, around the end."""
    rest = F.greatest(n - 1, F.lit(1))
    at = [F.pmod(seed + i, rest) for i in range(count)]
    return [(x + F.when(x >= own, 1).otherwise(0)).cast("bigint") for x in at]


def indexed(members: DataFrame, by: list[str], key: str) -> DataFrame:
    """Each group's different members (``key``, a whole number) with their place ``at`` in order, from 0."""
    return running_sum(members.select(*by, key).distinct(), by, key, F.lit(1), "at")


def place(usage: DataFrame, requests: DataFrame, centres: int, racks: int, nodes: int) -> DataFrame:
    """(request, ..., nth, node): the nodes of a volume's copies for requests (request, seed, ...), the main copy first.

    A main centre, rack and node are drawn from those of ``placements``; the
    rest of the rack's copies, the other racks and the other centres from all
    that have room, and in each of these a node by its free slots. ``seed``
    stands for chance. A request gets no row where any draw has too few to
    draw from.

    A request draws places only and meets its nodes by them, so its work
    doesn't grow with the nodes of a rack.
    """
    carried = [c for c in requests.columns if c != "seed"]
    room = _rack_room(usage, racks, nodes)
    # A row for each centre, with its racks in order and of the main ones their place among them.
    lists = room.groupBy("dc").agg(F.array_sort(F.collect_list(F.when(F.col("open_nodes") > 0, F.col("rack")))).alias("racks"), F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("rack", F.col("open_nodes").alias("n"))))).alias("main"))
    main = F.transform("main", lambda x: F.struct(x["rack"].alias("rack"), x["n"].alias("n"), F.array_position("racks", x["rack"]).alias("upto")))
    lists = lists.where(F.size("racks") > 0).select("dc", "racks", main.alias("main"))
    every = lists.agg(F.array_sort(F.collect_list("dc")).alias("dcs"), F.array_sort(F.collect_list(F.when(F.size("main") > 0, F.col("dc")))).alias("main_dcs"))
    every = every.select("dcs", F.transform("main_dcs", lambda x: F.struct(x.alias("dc"), F.array_position("dcs", x).alias("upto"))).alias("main_dcs"))
    draw = lambda k: spread(F.col("seed"), k)
    chosen = lambda name, k: F.get(name, F.pmod(draw(k), F.greatest(F.size(name), F.lit(1))).cast("int"))
    named = lambda name, own, k, n: F.array(*(F.get(name, x.cast("int")) for x in _places(F.size(name), draw(k), own, n))).cast("array<string>")
    rows = requests.join(F.broadcast(every)).withColumn("x", chosen("main_dcs", 1)).where(F.size("dcs") > centres)
    rows = rows.select(*carried, "seed", "x.dc", named("dcs", F.col("x.upto") - 1, 2, centres).alias("dcs"))
    rows = rows.join(F.broadcast(lists), "dc").withColumn("x", chosen("main", 3)).where((F.size("racks") > racks) & (F.col("x.n") > nodes))
    rows = rows.select(*carried, "seed", "dc", "dcs", "x.rack", "x.n", named("racks", F.col("x.upto") - 1, 4, racks).alias("racks")).withColumn("first", F.pmod(draw(5), F.col("n")))
    own = rows.select(*carried, "dc", "rack", F.posexplode(F.array(F.col("first"), *_places(F.col("n"), draw(6), F.col("first"), nodes))).alias("nth", "at"))
    own = own.join(indexed(usage.where("free >= 1"), ["dc", "rack"], "node"), ["dc", "rack", "at"]).select(*carried, "nth", "node")
    if not centres + racks:
        return own
    group = lambda dc, rack: F.concat(dc, F.lit("/"), rack)
    # Other racks and centres draw a free slot, all at once.
    slots = usage.select(group(F.col("dc"), F.col("rack")).alias("dc"), "node", "free").unionByName(usage.select(F.col("dc").alias("dc"), "node", "free"))
    far = rows.select(*carried, "seed", F.posexplode(F.concat(F.transform("racks", lambda r: group(F.col("dc"), r)), "dcs")).alias("nth", "group"))
    far = far.select(*carried, (F.col("nth") + 1 + nodes).alias("nth"), F.col("group").alias("dc"), spread(F.col("seed"), F.col("nth") + 7).alias("draw"))
    return own.unionByName(reserve(slots, far).select(*carried, "nth", "node"))


def grow(usage: DataFrame, requests: DataFrame, first_vid: int, centres: int, racks: int, nodes: int) -> DataFrame:
    """(request, vid, node): new volumes for requests (request, seed), as many as ``growth`` says, with a row for each copy.

    Ids follow each other in the order of ``request``, a whole number.
    """
    count = growth(F.lit(centres + racks + nodes + 1))
    made = requests.select("request", "seed", F.explode(F.sequence(F.lit(1).cast("bigint"), count.cast("bigint"))).alias("n"))
    made = running_sum(made.withColumn("one", F.lit(0)).withColumn("place", F.col("request") * 8 + F.col("n")), ["one"], "place", F.lit(1), "before")
    made = made.select("request", (F.col("before") + first_vid).alias("vid"), (F.col("seed") * 8 + F.col("n")).alias("seed"))
    return place(usage, made, centres, racks, nodes).select("request", "vid", "node")


def in_scope(replicas: DataFrame, dc: str = "", rack: str = "", node: int | None = None) -> DataFrame:
    """Replicas (dc, rack, node, ...) within a centre, and within a rack and node of it if these are named too."""
    if not dc:
        return replicas
    out = replicas.where(F.col("dc") == dc)
    out = out.where(F.col("rack") == rack) if rack else out
    return out if node is None else out.where(F.col("node") == node)


def assign(requests: DataFrame, writable: DataFrame, taken: DataFrame, by: str) -> DataFrame:
    """(request, fid): a new file id in a writable volume (vid) of the request's group, null where there is none.

    The volume is drawn by the request's number, the key is the next above the
    largest taken ``id`` of the group, and the cookie is drawn too.
    """
    open_ = indexed(writable, [by], "vid").select(by, F.col("at").alias("__at"), F.col("vid").alias("__vid"))
    rows = numbered(requests, taken, by, "request").join(open_.groupBy(by).agg(F.count(F.lit(1)).alias("__open")), by, "left")
    rows = rows.withColumn("__at", F.pmod(spread(F.col("request"), 11), F.col("__open"))).join(open_, [by, "__at"], "left")
    cookie = spread(F.col("request"), 12) * 4099 + 1
    return rows.select("request", codecs.format_fid(F.col("__vid"), F.col("id"), cookie).alias("fid"))


def file_urls(fids: DataFrame, replicas: DataFrame) -> DataFrame:
    """File ids (fid) with the address (url) to read them at, on one of the volume's nodes (vid, node, url); null where it is unknown."""
    parsed = codecs.parse_fid(F.col("fid"))
    rows = fids.select("fid", parsed["vid"].alias("vid"), F.pmod(parsed["key"], F.lit(1_000_003)).cast("bigint").alias("__key")).distinct()
    both = rows.join(replicas.select("vid", "node", "url"), "vid", "left")
    one = both.groupBy("fid").agg(F.min_by("url", F.struct(spread(F.col("node") + F.col("__key"), 13), F.col("node"))).alias("__url"))
    return one.select("fid", F.concat(F.lit("http://"), "__url", F.lit("/"), "fid").alias("url"))


def known_locations(replicas: DataFrame, wanted: DataFrame) -> DataFrame:
    """As ``locations``, without the volumes that are unknown."""
    return locations(replicas, wanted).where("error IS NULL").drop("error")


def availability(layouts: DataFrame, copies: int) -> DataFrame:
    """Layout rows with ``state``: available with just as many replicas as asked for, unavailable with fewer."""
    return layouts.withColumn("state", F.when(F.col("replicas") == copies, "available").when(F.col("replicas") < copies, "unavailable").otherwise("surplus"))


def read_only(replicas: DataFrame, volumes: DataFrame) -> DataFrame:
    """Replicas of which those of ``volumes`` (vid) may no longer be written."""
    marked = volumes.select("vid").distinct().withColumn("__marked", F.lit(True))
    return replicas.join(marked, "vid", "left").withColumn("read_only", F.col("read_only") | F.coalesce("__marked", F.lit(False))).drop("__marked")


def unregister(replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replicas without those on the nodes that left (node)."""
    return replicas.join(nodes.select("node").distinct(), "node", "left_anti")


def topology_map(nodes: DataFrame) -> DataFrame:
    """(dc, racks): each centre's racks with their nodes, in order."""
    by_rack = nodes.groupBy("dc", "rack").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    text = F.concat(F.col("rack"), F.lit(":"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), ","))
    return by_rack.groupBy("dc").agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("racks"))


def first_disk(volumes: DataFrame) -> DataFrame:
    """Of each volume (vid, disk, pos) the first disk that has it."""
    return volumes.groupBy("vid").agg(F.min_by("disk", F.struct("pos", "disk")).alias("disk"))


def created(volumes: DataFrame, wanted: DataFrame, disks: DataFrame) -> DataFrame:
    """(vid, disk, status) of wanted volumes (vid): made on the disk (disk, free) with most room in turn, or 'exists', or 'no room'.

    New volumes in the order of their ids take the free slots of the disks from
    the freest on, slot by slot.
    """
    rows = wanted.select("vid").distinct().join(volumes.select("vid", F.lit(True).alias("__there")).distinct(), "vid", "left")
    fresh = running_sum(rows.where("__there IS NULL").withColumn("one", F.lit(0)), ["one"], "vid", F.lit(1), "nth").select("vid", "nth")
    # As many slots as free places: the first of every disk, then the second, the freest disk first.
    slots = disks.where("free > 0").select("disk", F.explode(F.sequence(F.col("free"), F.lit(1).cast("bigint"), F.lit(-1).cast("bigint"))).alias("left"))
    slots = slots.groupBy("left").agg(F.array_sort(F.collect_list("disk")).alias("disks"))
    sized = slots.withColumn("n", F.size("disks").cast("bigint")).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("left"))))
    places = sized.select(F.posexplode("disks").alias("at", "disk"), "upto", "n").select((F.col("upto") - F.col("n") + F.col("at")).alias("nth"), "disk")
    made = fresh.join(places, "nth", "left").select("vid", "disk", F.when(F.col("disk").isNull(), "no room").otherwise("created").alias("status"))
    return made.unionByName(rows.where("__there").select("vid", F.lit(None).cast("bigint").alias("disk"), F.lit("exists").alias("status")))


def destroyed(volumes: DataFrame, wanted: DataFrame, compacting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(volumes that stay, wanted ones that are refused because they are being compacted)."""
    busy = wanted.select("vid").distinct().join(compacting.select("vid").distinct(), "vid", "left_semi")
    gone = wanted.select("vid").distinct().join(busy, "vid", "left_anti")
    return volumes.join(gone, "vid", "left_anti"), busy


def upserted(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key: a replica that reports again replaces what it said before."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def growth(copies: Column) -> Column:
    """Logical volumes made at once for a number of copies."""
    return F.when(copies == 1, 7).when(copies == 2, 6).when(copies == 3, 3).otherwise(1)


#: The version of volumes that may still be written.
VERSION = 2


def layout(replicas: DataFrame, copies: int, limit: int, by: tuple[str, ...] = ("collection",)) -> DataFrame:
    """Of each volume: replicas, whether one is read-only or the volume is full, whether it may be written.

    Volumes of different groups ``by``, such as collection, placement and TTL, are told apart.

    Where replicas tell their ``version``, only volumes of the present one are written.
    """
    current = F.bool_and(F.col("version") == VERSION) if "version" in replicas.columns else F.lit(True)
    seen = replicas.groupBy(*by, "vid").agg(F.countDistinct("node").alias("replicas"), F.bool_or("read_only").alias("read_only"), F.max("size").alias("size"), current.alias("__current"))
    seen = seen.withColumn("oversize", F.col("size") >= limit)
    return seen.withColumn("writable", (F.col("replicas") >= copies) & ~F.col("read_only") & ~F.col("oversize") & F.col("__current")).drop("__current")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that came ('new') and went ('deleted') between two snapshots."""
    came, went = new.select(*keys).distinct(), old.select(*keys).distinct()
    return came.join(went, keys, "left_anti").withColumn("change", F.lit("new")).unionByName(went.join(came, keys, "left_anti").withColumn("change", F.lit("deleted")))


def apply_delta(state: DataFrame, new: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """The state after the deletions and then the upserts of a delta."""
    rest = state.join(deleted.select(*keys).distinct(), keys, "left_anti").join(new.select(*keys).distinct(), keys, "left_anti")
    return rest.unionByName(new)


def locations(replicas: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes of each wanted volume in order; an error text where it is unknown."""
    known = replicas.groupBy("vid").agg(F.array_join(F.array_sort(F.collect_set(F.col("node").cast("string"))), ",").alias("nodes"))
    return wanted.select("vid").distinct().join(known, "vid", "left").withColumn("error", F.when(F.col("nodes").isNull(), F.lit("volume not found")))


def spread(vid: Column, seed: int | Column) -> Column:
    """A deterministic number that stands in for a random one."""
    return F.pmod(vid * 7919 + seed * 104729, F.lit(1_000_003))


def lookup(replicas: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vid, collection, nodes) of wanted volumes (vid, collection): within a collection, or in any where it is ''; null where it is unknown."""
    asked = wanted.select("vid", "collection").distinct()
    same = (F.col("vid") == F.col("__vid")) & ((F.col("collection") == "") | (F.col("collection") == F.col("__collection")))
    both = asked.join(replicas.select(F.col("vid").alias("__vid"), F.col("collection").alias("__collection"), "node"), same, "left")
    nodes = F.array_join(F.transform(F.array_sort(F.collect_set("node")), lambda n: n.cast("string")), ",")
    return both.groupBy("vid", "collection").agg(nodes.alias("nodes")).withColumn("nodes", F.nullif(F.col("nodes"), F.lit("")))


def pick_replica(candidates: DataFrame, by: list[str], seed: int) -> DataFrame:
    """One writable volume of each group, such as a centre, and the first of its replicas (vid, node) there."""
    order = F.struct(spread(F.col("vid"), seed), F.col("vid"), F.col("node"))
    return candidates.groupBy(*by).agg(F.min_by(F.struct("vid", "node"), order).alias("x")).select(*by, "x.vid", "x.node")


def pick(candidates: DataFrame, by: list[str], seed: int) -> DataFrame:
    """One writable volume of each group, chosen by ``spread``."""
    return candidates.groupBy(*by).agg(F.min_by("vid", F.struct(spread(F.col("vid"), seed), F.col("vid"))).alias("vid"))


def reserve(usage: DataFrame, draws: DataFrame, width: int = SLOTS) -> DataFrame:
    """Of each draw (dc, draw, ...): the node whose stretch of the centre's cumulated free slots holds it.

    The slots of a centre are cut into buckets of ``width``, so a draw meets the
    nodes of its bucket only, however many the centre has.
    """
    order = Window.partitionBy("dc").orderBy("node")
    spans = usage.where("free > 0").withColumn("upto", F.sum("free").over(order)).withColumn("after", F.col("upto") - F.col("free"))
    bucket = lambda at: F.floor(at / width)
    own = spans.select(F.col("dc").alias("of_dc"), "node", "after", "upto", F.explode(F.sequence(bucket(F.col("after")), bucket(F.col("upto") - 1))).alias("of_bucket"))
    total = spans.groupBy(F.col("dc").alias("in_dc")).agg(F.sum("free").alias("total"))
    at = draws.join(F.broadcast(total), F.col("dc") == F.col("in_dc")).withColumn("at", F.pmod("draw", "total")).withColumn("bucket", bucket(F.col("at")))
    same = (F.col("dc") == F.col("of_dc")) & (F.col("bucket") == F.col("of_bucket"))
    return at.join(own, same & (F.col("at") >= F.col("after")) & (F.col("at") < F.col("upto"))).select(*draws.columns, "node")


def heartbeat(volumes: DataFrame) -> DataFrame:
    """What each node reports: volumes, bytes and the largest key of those that haven't expired."""
    return volumes.where("NOT expired").groupBy("node").agg(F.count(F.lit(1)).alias("volumes"), F.sum("size").alias("bytes"), F.max("max_key").alias("max_key"))


def freest(disks: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the disk with most free slots, the first of equals; none where all are full."""
    return disks.where("free > 0").groupBy(*by).agg(F.max_by(F.struct("disk", "free"), F.struct("free", -F.col("disk"))).alias("x")).select(*by, "x.disk", "x.free")


def held_volumes(replicas: DataFrame) -> DataFrame:
    """Each node with the ids of the volumes it holds, in order."""
    held = F.transform(F.array_sort(F.collect_set("vid")), lambda v: v.cast("string"))
    return replicas.groupBy("node").agg(F.array_join(held, ",").alias("vids"))


def numbered(requests: DataFrame, taken: DataFrame, by: str, order: str) -> DataFrame:
    """Requests with new ids: from one above the largest taken id of their group, in the order of ``order``, a whole number.

    Requests are counted by stretches, so a group with most of them fills many tasks.
    """
    top = taken.groupBy(by).agg(F.max("id").alias("__top"))
    line = running_sum(requests, [by], order, F.lit(1), "__before")
    return line.join(top, by, "left").withColumn("id", F.coalesce("__top", F.lit(0)) + F.col("__before") + 1).drop("__top", "__before")


def sessions(beats: DataFrame, gap: int) -> DataFrame:
    """(node, first_us, last_us, beats): stretches in which a node (node, us) reported with no pause above ``gap``.

    Reports within one gap of time are one stretch in any case, so they are
    summed first, and only a row for each gap of time is put in order.
    """
    slots = beats.groupBy("node", F.floor(F.col("us") / gap).alias("slot")).agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("node").orderBy("slot")
    fresh = F.coalesce(F.col("lo") - F.lag("hi").over(line) > gap, F.lit(True)).cast("bigint")
    runs = slots.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(line))
    return runs.groupBy("node", "session").agg(F.min("lo").alias("first_us"), F.max("hi").alias("last_us"), F.sum("n").alias("beats")).drop("session")
