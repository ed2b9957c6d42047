"""Duplicate detection and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup, exchange, ngram_join, suffix_dedup
from quern.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, batch int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, shared passages, short, empty, repeated and very long texts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7)))
    passage, out = " ".join(word() for _ in range(40)), []
    for i in range(60):
        own = [word() for _ in range(rng.choice([3, 30, 120]))]
        if i % 4 == 0:
            own[len(own) // 2 : len(own) // 2] = passage.split()
        out.append(own)
    for k in range(50):
        own = list(out[rng.randrange(12)])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            own[rng.randrange(len(own))] = word()
        out.append(own)
    texts = [(1000 - 7 * i, " ".join(own)) for i, own in enumerate(out)]
    texts += [(2000 + i, None) for i in range(3)] + [(2010 + i, "") for i in range(3)] + [(2020, " \t\n"), (2021, "one two"), (2022, "One  TWO"), (2023, "two one")]
    texts += [(2030, "aaaa" * 4000), (2031, "aaaa" * 4000), (2032, "aaaa" * 30), (2033, "ü漢" * 300), (2034, "x" + "ü漢" * 300)]
    texts += [(3000 + i, texts[3][1]) for i in range(40)]  # a large group of copies
    return texts


def test_content_sort(spark, corpus):
    rows = [*corpus, corpus[0], (None, corpus[5][1]), (None, "only here"), (4000, "Equal"), (4001, "equal"), (4002, "Equal "), (4003, "Equal")]
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.classes(frame(spark, rows), salts=4).collect()
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    dropped = exact_dedup.drop_copies(frame(spark, rows))
    assert dropped.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert Counter(r.doc_id for r in dropped.collect()) == Counter(best.values())
    assert exact_dedup.classes(frame(spark, [])).count() == 0


def test_head_ties_are_told_apart(spark):
    head = "same beginning of all these texts, longer than the key that splits them: "
    rows = [(i, head + str(i % 5)) for i in range(50)]
    got = exact_dedup.classes(frame(spark, rows)).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(45 + k, 10) for k in range(5)}


def model_of_join(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    links = {k: set() for k in range(len(sets))}
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                links[a].add(b)
                links[b].add(a)
    out = Counter()
    for k, (i, s) in enumerate(sets):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out[i, len(s), None if i is None else min(sets[n][0] for n in seen), len(links[k])] += 1
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_prefix_tree_join(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block * 400)
    monkeypatch.setattr(ngram_join, "QUERIES", block)
    monkeypatch.setattr(exchange.batched, "__defaults__", ("doc_id", "text", 20_000))
    rows = [*corpus, corpus[0], (None, corpus[5][1]), (None, "only here")]
    got = Counter(map(tuple, ngram_join.join(frame(spark, rows)).collect()))
    assert got == model_of_join(rows)
    assert ngram_join.join(frame(spark, [])).count() == 0


def test_links_at_the_threshold(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words[:11]))]  # 7 shingles
    rows += [(2, " ".join(words[:12])), (3, " ".join(words[:13])), (4, " ".join(words[:14]))]
    got = Counter(map(tuple, ngram_join.join(frame(spark, rows)).collect()))
    assert got == model_of_join(rows) and got[1, 7, 1, 2] == 1  # 7 of 9 links, 7 of 10 doesn't


def test_trie_walk_counts_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40))) for _ in range(40)] + [np.arange(30), np.arange(30), np.arange(31)]
    sizes = np.array([len(s) for s in sets])
    trie = ngram_join.Trie(sets, sizes)
    for q in sets:
        found = dict(trie.walk(q, len(q)))
        for i, s in enumerate(sets):
            overlap = len(np.intersect1d(q, s))
            if 100 * overlap >= 75 * (len(q) + len(s) - overlap):
                assert found[i] == overlap


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (102, 100), (None, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def model_of_suffixes(rows):
    first = {}
    for i, t in rows:
        raw, own = (t or "").encode(), np.inf if i is None else i
        for k in range(len(raw) - 49):
            key = raw[k : k + 50]
            first[key] = min(first.get(key, np.inf), own)
    out = Counter()
    for i, t in rows:
        raw, own = (t or "").encode(), np.inf if i is None else i
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < own:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("size", [20_000, 1 << 23])
def test_suffix_dedup(spark, corpus, monkeypatch, size):
    monkeypatch.setattr(exchange.batched, "__defaults__", ("doc_id", "text", size))
    rows = [*corpus, corpus[0], (None, corpus[5][1]), (5000, "zero \0\0\0 bytes " * 9), (5001, "a zero \0\0\0 bytes " * 9), (5002, "b" * 60 + "c" * 70), (5003, "c" * 70 + "b" * 60)]
    got = Counter(map(tuple, suffix_dedup.remove(frame(spark, rows)).drop("kept").collect()))
    assert got == model_of_suffixes(rows)
    assert suffix_dedup.remove(frame(spark, [])).count() == 0


def test_two_stage_sort_orders_suffixes():
    rng = random.Random(4)
    for alphabet in (b"ab", b"abcdefgh", bytes(range(1, 256))):
        pieces = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(50, 120))) for _ in range(30)]
        pieces += [pieces[0], pieces[1][:60], b"a" * 90, b"ab" * 40]
        data = b"\0".join(pieces) + bytes(60)
        wanted, ends, at = [], [], 0
        for p in pieces:
            wanted += range(at, at + len(p) - 49)
            ends += [at + len(p)] * (len(p) - 49)
            at += len(p) + 1
        ranked = suffix_dedup.sort_suffixes(np.frombuffer(data, np.uint8), np.array(wanted), np.array(ends))
        assert sorted(ranked.tolist()) == wanted
        heads = [data[i : i + 50] for i in ranked]
        assert heads == sorted(heads)


def test_pipeline_against_brute_force(spark, tmp_path, corpus):
    import tiktoken  # noqa: F401

    import corpus_pipeline
    from quern.llm import toxicity

    item = "zeta yotta xeno water violet umbra tango sierra romeo quebec papa oscar november mike lima kilo"
    rng = random.Random(8)
    bad = [(6000 + i, " ".join(rng.choice(["grubby", "alpha", f"q{rng.randrange(999)}"]) for _ in range(30)) + " grubby") for i in range(24)]
    texts = [x for x in corpus if x[0] is not None] + [(7000, "begin " + item + " end"), (7001, "nothing of that kind in here at all")] + bad
    docs = frame(spark, texts).drop("row", "batch")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    marks = [(i, 1, int(6000 <= i < 7000)) for i, _ in texts]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)

    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    stay = [(i, t) for i, t in texts if i not in {r.doc_id for r in scored if r.predicted}]
    assert not any(6000 <= i < 7000 for i, _ in stay) and len(stay) == len(texts) - len(bad)
    last = {}
    for i, t in stay:
        last[t or ""] = max(i, last.get(t or "", -1))
    stay = [(i, t) for i, t in stay if last[t or ""] == i]
    smallest = {i: c for i, _, c, _ in model_of_join(stay)}
    stay = [(i, t) for i, t in stay if smallest[i] == i and i != 7000]

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == sorted(i for i, _ in stay)
    for i, t in stay:
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        now = now.select("*").withColumn("lang", F.col("lang"))
