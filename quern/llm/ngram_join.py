"""Exact Jaccard self-join of word n-gram sets over prefix trees.

1. Every batch of texts learns which of its n-grams other documents share
   (``exchange``). A document can have a partner only if at least three
   quarters of its set are shared; all others are settled here.
2. Equal sets become one class with its smallest id as representative.
3. The n-grams have one global order, rarest first. A representative can only
   match another that shares one of its rarest n-grams (its prefix), so those
   tell which blocks of representatives it has to be compared with.
4. Representatives sorted by their sets, most frequent n-gram first, are cut
   into blocks of bounded size; near copies are neighbours there. Each block is
   a trie. A set walks the trie from the root: what members share is counted
   once for all of them, and a subtree is left as soon as what remains of the
   set and of the subtree can't reach the overlap that is needed.
5. Links become components, and classes hand them to their members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import exchange, textcode
from quern.llm.common import written
from quern.llm.components import components

N = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Sets in a block at most, n-grams in a block at most, and sets compared with a block in one task.
BLOCK_SETS, BLOCK_GRAMS, QUERIES = 1024, 400_000, 1024
#: n-grams on one edge of a trie at most, so that a walk can stop inside a long tail.
EDGE = 32
_U = np.uint64
#: A gram's code: five bits of its document frequency's logarithm, then this many bits of its hash.
CODE_BITS = 58
#: Bits of a gram's hash that the exchange compares, to find the sets that may have a partner and to order their grams.
KEY_BITS = 48


def gram_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, and where each set starts, with the end."""
    values, sizes = [], []
    for a, b in textcode.chunks(texts):
        words, places = textcode.word_hashes(texts.slice(a, b - a), textcode.NOT_SPACE)
        grams, starts = textcode.grams(words, places, n)
        for i in range(b - a):
            own = grams[starts[i] : starts[i + 1]]
            if not len(own) and places[i + 1] > places[i]:  # fewer than n words: the whole sequence is one gram
                own = textcode.mix((words[places[i] : places[i + 1]] * textcode._GRAM_CODE[: places[i + 1] - places[i]]).sum(keepdims=True) + _U(places[i + 1] - places[i]))
            own = np.sort(own)
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            values.append(own)
            sizes.append(len(own))
    return np.concatenate(values) if values else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def shared_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, grams), one row per input row.

    ``grams`` holds the codes of the shared n-grams, rarest first, of documents
    that may have a partner, else null; ``set_key``, 128 bits made of the n-grams' hashes,
    and ``n_shingles`` are equal for equal sets and stand for them.
    """
    batches, n = exchange.batched(docs, id_col, text_col)
    bits = exchange.part_bits(n)

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        values, _ = gram_sets(table.column("text").combine_chunks())
        return np.unique(exchange.shorten(values, KEY_BITS), return_counts=True)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        values, places = gram_sets(table.column("text").combine_chunks()) if table.num_rows else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        short = exchange.shorten(values, KEY_BITS)
        keys, code, local = np.unique(short, return_inverse=True, return_counts=True)
        df = exchange.told(answers, keys, local, KEY_BITS, bits)[1]
        df = df[code] if len(values) else df
        shared = df > 1
        sizes = np.diff(places)
        had = np.concatenate([[0], np.cumsum(shared)])
        common = had[places[1:]] - had[places[:-1]]
        codes = (np.minimum(np.log2(np.maximum(df, 1)).astype(np.uint64), _U(31)) << _U(CODE_BITS)) | (values >> _U(64 - CODE_BITS))
        # Two sums of hashes, 128 bits, tell a set.
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(textcode.mix(values ^ _U(salt)))]) for salt in (0x5BD1E995, 0x9E3779B97F4A7C15)]
        pairs = np.column_stack([x[places[1:]] - x[places[:-1]] for x in sums])
        keys_of_sets = [row.tobytes() for row in pairs]
        grams = [np.sort(codes[a:b][shared[a:b]]).view(np.int64) if m and 100 * m >= PERCENT * s else None for a, b, m, s in zip(places[:-1], places[1:], common, sizes)]
        return pa.table({"doc_id": table.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(keys_of_sets, pa.binary()), "grams": pa.array(grams, pa.list_(pa.int64()))})

    answers = exchange.tell(batches, n, keys_of, KEY_BITS)
    return exchange.joined(batches, answers, finish, "doc_id bigint, n_shingles bigint, set_key binary, grams array<bigint>")


def _blocks(reps: DataFrame) -> DataFrame:
    """(block, doc_id, n, weight, grams): neighbours in the trie's order, cut into bounded blocks.

    Blocks are cut along the whole order, not within partitions: each partition
    adds up the cost of its sets, and what the partitions before it hold (one
    row for each partition) is added to place its sets.
    """
    unit = BLOCK_GRAMS // BLOCK_SETS

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = np.array([len(g) + unit for g in batch.column(3)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part)), pa.array(total + np.cumsum(own)), *batch.columns], ["part", "upto", "doc_id", "n", "weight", "grams"])
            total += int(own.sum())

    head = [F.coalesce(F.try_element_at("grams", F.lit(-i)), F.lit(-1)).alias(f"h{i}") for i in range(1, 7)]
    keyed = reps.select("doc_id", "n", "weight", "grams", *head)
    order = [f"h{i}" for i in range(1, 7)] + ["doc_id"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.select("doc_id", "n", "weight", "grams").mapInArrow(cost, "part bigint, upto bigint, doc_id bigint, n bigint, weight bigint, grams array<bigint>"), "ngram-order")
    sums = placed.groupBy("part").agg(F.max("upto").alias("cost"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("base"))
    return placed.join(bases, "part").select(F.floor((F.col("base") + F.col("upto") - 1) / BLOCK_GRAMS).alias("block"), "doc_id", "n", "weight", "grams")


class Trie:
    """Sets as paths from the root, most frequent n-gram first, with up to EDGE n-grams on an edge."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
        # Codes are rarest first; ranks count from the most frequent.
        ranks = len(self.vocabulary) - 1 - codes
        at, paths = 0, []
        for s in sets:
            paths.append(ranks[at : at + len(s)][::-1])
            at += len(s)
        order = sorted(range(len(sets)), key=lambda i: paths[i].tolist())
        lcp = [0]
        for a, b in zip(order, order[1:]):
            n = min(len(paths[a]), len(paths[b]))
            differ = np.flatnonzero(paths[a][:n] != paths[b][:n])
            lcp.append(int(differ[0]) if len(differ) else n)
        lcp.append(0)
        # Depths where a path branches off, so that edges end there.
        parents, edges, depths, ends, least, most, longest = [], [], [], [], [], [], []
        stack: list[tuple[int, int]] = []  # (depth, node) along the current path
        for k, i in enumerate(order):
            while stack and stack[-1][0] > lcp[k]:
                stack.pop()
            depth = stack[-1][0] if stack else 0
            cuts, low = set(), len(paths[i])
            for j in range(k + 1, len(order)):  # later branches off this path
                low = min(low, lcp[j])
                if low <= depth:
                    break
                cuts.add(low)
            stops = {*cuts, len(paths[i]), *range(depth + EDGE, len(paths[i]), EDGE)} - {depth}
            for stop in sorted(stops):
                parents.append(stack[-1][1] if stack else -1)
                edges.append(paths[i][depth:stop])
                depths.append(stop)
                ends.append([])
                least.append(0)
                most.append(0)
                longest.append(0)
                stack.append((stop, len(parents) - 1))
                depth = stop
            ends[stack[-1][1]].append(i)
            for d, node in stack:
                least[node] = min(least[node] or sizes[i], sizes[i])
                most[node] = max(most[node], sizes[i])
                longest[node] = max(longest[node], len(paths[i]) - d)
        self.edges = np.full((len(edges), max(map(len, edges))), len(self.vocabulary))
        for k, e in enumerate(edges):
            self.edges[k, : len(e)] = e
        self.last = np.array([e[-1] for e in edges])
        self.least, self.most, self.longest = (np.array(x) for x in (least, most, longest))
        children: list[list[int]] = [[] for _ in range(len(parents) + 1)]
        for node, parent in enumerate(parents):
            children[parent].append(node)
        counts = [len(c) for c in children]
        self.child_start = np.concatenate([[0], np.cumsum(counts)])
        self.child = np.array([c for own in children for c in own])
        self.roots = np.array(children[-1])
        self.ends = ends
        self.terminal = np.array([bool(e) for e in ends])
        self.flags = np.zeros(len(self.vocabulary) + 1, bool)

    def walk(self, grams: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(set, overlap) of the sets that may link with a set of ``size`` n-grams of which these are shared."""
        at = np.searchsorted(self.vocabulary, grams)
        at[at == len(self.vocabulary)] = 0
        own = np.sort(len(self.vocabulary) - 1 - at[self.vocabulary[at] == grams])
        self.flags[own] = True
        out = []
        nodes, before = self.roots, np.zeros(len(self.roots), int)
        while len(nodes):
            # Sizes that can't link, whatever the overlap.
            fit = (self.most[nodes] * 100 >= size * PERCENT) & (self.least[nodes] * PERCENT <= size * 100)
            nodes, before = nodes[fit], before[fit]
            overlap = before + self.flags[self.edges[nodes]].sum(axis=1)
            for k in np.flatnonzero(self.terminal[nodes]):
                out += [(i, int(overlap[k])) for i in self.ends[nodes[k]]]
            left = np.minimum(len(own) - np.searchsorted(own, self.last[nodes], "right"), self.longest[nodes])
            # 100 * o >= PERCENT * (size + other - o), at the smallest other set below.
            need = PERCENT * (size + self.least[nodes])
            go = (100 + PERCENT) * (overlap + left) >= need
            nodes, overlap = nodes[go], overlap[go]
            count = self.child_start[nodes + 1] - self.child_start[nodes]
            first = np.repeat(self.child_start[nodes] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(nodes) else np.zeros(0, int)
            nodes, before = self.child[first], np.repeat(overlap, count)
        self.flags[own] = False
        return out


def _compare(members: pa.Table, queries: pa.Table) -> pa.Table:
    """(doc_id, other, links): links within a block and with the sets sent to it, as stars."""
    schema = pa.schema([("doc_id", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])
    if not members.num_rows:
        return schema.empty_table()
    read = lambda t, c: t.column(c).to_numpy()
    lists = lambda t: [np.asarray(x.values) for x in t.column("grams")]
    ids, sizes, weights, sets = read(members, "doc_id"), read(members, "n"), read(members, "weight"), lists(members)
    trie = Trie(sets, sizes)
    more = lists(queries) if queries.num_rows else []
    inner = members.column("inner")[0].as_py()
    all_ids = np.concatenate([ids, read(queries, "doc_id")]) if more else ids
    all_weights = np.concatenate([weights, read(queries, "weight")]) if more else weights
    all_sizes = np.concatenate([sizes, read(queries, "n")]) if more else sizes
    root, links = list(range(len(all_ids))), np.zeros(len(all_ids), np.int64)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for q in range(0 if inner else len(ids), len(all_ids)):
        own = sets[q] if q < len(ids) else more[q - len(ids)]
        for i, overlap in trie.walk(own, int(all_sizes[q])):
            if q < len(ids) and i <= q:  # each pair of members once
                continue
            if 100 * overlap >= PERCENT * (all_sizes[q] + sizes[i] - overlap):
                links[q] += all_weights[i]
                links[i] += all_weights[q]
                a, b = find(q), find(i)
                if a != b:
                    root[max(a, b, key=lambda r: all_ids[r])] = min(a, b, key=lambda r: all_ids[r])
    hit = np.flatnonzero(links)
    return pa.table({"doc_id": all_ids[hit], "other": all_ids[[find(x) for x in hit]] if len(hit) else np.zeros(0, np.int64), "links": links[hit]}, schema=schema)


def links(reps: DataFrame) -> DataFrame:
    """(doc_id, other, links) of representatives (doc_id, n, weight, grams): stars whose components are those of all links."""
    blocks = written(_blocks(reps), "ngram-blocks")
    # The prefix: of the rarest n - ceil(0.75 n) + 1 n-grams those that are shared.
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.size("grams"))
    posts = blocks.select("block", "doc_id", "n", F.explode(F.slice("grams", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))).alias("gram"))
    held = posts.groupBy("gram", F.col("block").alias("to")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    ahead = posts.join(held, "gram").where((F.col("to") > F.col("block")) & (F.col("most") * 100 >= F.col("n") * PERCENT) & (F.col("least") * PERCENT <= F.col("n") * 100))
    probes = written(ahead.select("doc_id", "to").distinct(), "ngram-probes")
    chunks = probes.groupBy(F.col("to").alias("block")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"))
    members = blocks.join(chunks, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    members = members.select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc_id", "n", "weight", "grams").withColumn("inner", F.col("chunk") == 0)
    queries = probes.join(chunks.withColumnRenamed("block", "to"), "to").select(F.col("to").alias("block"), F.pmod(F.xxhash64("doc_id"), "chunks").cast("int").alias("chunk"), "doc_id")
    sets = blocks.select(*(F.col(c).alias(c) for c in ("doc_id", "n", "weight", "grams")))
    queries = queries.join(sets, "doc_id").select("block", "chunk", "doc_id", "n", "weight", "grams")
    return members.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(_compare, "doc_id bigint, other bigint, links bigint")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row per input row.

    ``component_id`` is the smallest id reachable by links, the row's own
    included; ``n_links`` counts the other rows that this row links with. Null
    or empty texts have an empty set, no links and their own id. Rows without an
    id take part in no link and have a null component. Rows repeated with the
    same id link with each other. Other columns are not read.
    """
    sets = written(shared_sets(docs, id_col, text_col), "ngram-sets")
    able = sets.where("grams IS NOT NULL AND doc_id IS NOT NULL")
    classes = able.groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = written(classes, "ngram-classes")
    first = able.join(classes.select(F.col("set_key").alias("k"), F.col("n_shingles").alias("s"), "rep", "weight"), (F.col("doc_id") == F.col("rep")) & (F.col("set_key") == F.col("k")) & (F.col("n_shingles") == F.col("s")))
    reps = first.select("doc_id", F.col("n_shingles").alias("n"), "weight", "grams").dropDuplicates(["doc_id", "n"])
    found = written(links(reps), "ngram-links")
    parts = components(found, "doc_id", "other")
    counts = found.groupBy("doc_id").agg(F.sum("links").alias("between"))
    known = classes.join(counts.withColumnRenamed("doc_id", "rep"), "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select(F.col("set_key").alias("k"), F.col("n_shingles").alias("s"), F.coalesce("component", "rep").alias("class_component"), (F.coalesce("between", F.lit(0)) + F.col("weight") - 1).alias("class_links"))
    same = (F.col("set_key") == F.col("k")) & (F.col("n_shingles") == F.col("s")) & F.col("grams").isNotNull() & F.col("doc_id").isNotNull()
    out = sets.join(known, same, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_component", "doc_id").alias("component_id"), F.coalesce("class_links", F.lit(0)).cast("bigint").alias("n_links"))
