"""Corpus-wide totals over one round and over several, and the language model that counts by them."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import exchange, ngram_lm, textcode

DOCS = "doc_id bigint, text string"


@pytest.mark.parametrize("width", [0, 1, 7, 40, 56, 64])
def test_packed_keys_come_back(width):
    rng = np.random.default_rng(width)
    for n in (1, 2, 5, 300):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> np.uint64(64 - width) if width else np.zeros(1, np.uint64)
        keys = np.unique(keys)
        assert (exchange._unpack(exchange._pack(keys, width)) == keys).all()


def test_packed_counts_come_back():
    counts = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert exchange._numbers(exchange._small(counts)).tolist() == counts.tolist()


def counter():
    def words_of(table):  # inner functions reach the workers whole
        hashes, _ = textcode.word_hashes(table.column("text").combine_chunks(), textcode.NOT_SPACE)
        return np.unique(hashes, return_counts=True)

    return words_of


def totals(spark, texts, size, fan):
    """(word hash, total, batches that own it) of each batch's words, and the number of batches."""
    batches, n = exchange.batched(spark.createDataFrame(list(enumerate(texts)), DOCS), size=size)
    bits, words_of = exchange.part_bits(n, fan), counter()

    def finish(table, answers):
        keys, counts = words_of(table)
        _, total, owner = exchange.told(answers, keys, counts, 64, bits, owners=True)
        return pa.table({"key": pa.array(keys.view(np.int64)), "total": pa.array(total), "owner": pa.array(owner.astype(np.int64))})

    answers = exchange.tell(batches, n, words_of, 64, owner=True, fan=fan)
    return exchange.joined(batches, answers, finish, "key bigint, total bigint, owner bigint"), n


TEXTS = [" ".join(f"w{(i * k) % 97}" for k in range(1, 30)) + f" only{i} the the" for i in range(120)]


@pytest.mark.parametrize("fan", [8, 16, 8192])
def test_totals_by_any_number_of_rounds(spark, fan):
    found, n = totals(spark, TEXTS, 600, fan)
    assert n > 16
    counts = Counter(w for t in TEXTS for w in t.split())
    keys = {int(textcode.word_hashes(pa.array([w]), textcode.NOT_SPACE)[0].view(np.int64)[0]): c for w, c in counts.items()}
    got = found.groupBy("key").agg(F.min("total").alias("a"), F.max("total").alias("b"), F.sum("owner").alias("owners")).collect()
    assert {r["key"]: (r["a"], r["b"], r["owners"]) for r in got} == {k: (c, c, 1) for k, c in keys.items()}


def test_rows_sent_grow_with_the_input(spark, monkeypatch):
    """At 1, 4 and 16 times the input each batch sends no more rows, round by round, though there are more batches than the fan."""
    rows = []
    for times in (1, 4, 16):
        texts = [f"{t} x{i}" for i in range(times) for t in TEXTS[:40]]
        batches, n = exchange.batched(spark.createDataFrame(list(enumerate(texts)), DOCS), size=600)
        counted = []

        def settled(sent, *rest, inner=exchange._settled):
            counted.append(sent.count())
            return inner(sent, *rest)

        with monkeypatch.context() as m:
            m.setattr(exchange, "_settled", settled)
            exchange.tell(batches, n, counter(), 64, fan=8)
        rows.append([c / n for c in counted])
        assert len(counted) == max(1, math.ceil(math.log(n, 8)))
    assert all(x <= 2 * 8 for own in rows for x in own), rows


def model(rows):
    """Scores by plain dictionaries, with estimates that aren't rounded to bins."""
    tokens = [[*(w for w in (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).replace("\t", " ").replace("\n", " ").split(" ") if w), "</s>"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    one = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    two = Counter(p for t, h in zip(tokens, held) if not h for p in zip(t, t[1:]))
    n, v = one.total(), len(one)
    events = []
    for t, h in zip(tokens, held):
        if not h:
            own1, own2 = Counter(t), Counter(zip(t, t[1:]))
            for a, b in zip(t, t[1:]):
                context = one[a] - own1[a]
                events.append((min(int(math.log2(context + 1)), ngram_lm.BUCKETS - 1), (two[a, b] - own2[a, b]) / max(context, 1), (one[b] - own1[b]) / n))
    weights = np.tile([0.4, 0.5, 0.1], (ngram_lm.BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    bucket, parts = np.array([e[0] for e in events]), np.array([[e[1], e[2], 1 / (v + 1)] for e in events])
    for _ in range(ngram_lm.ITERATIONS):
        share = weights[bucket] * parts
        share /= share.sum(axis=1)[:, None]
        sums = np.column_stack([np.bincount(bucket, share[:, k], ngram_lm.BUCKETS) for k in range(3)]) + 0.01 * np.array([0.1, 0.5, 0.4])
        weights = sums / sums.sum(axis=1, keepdims=True)
    out = []
    for (i, _), t, h in zip(rows, tokens, held):
        total = 0.0
        for k, b in enumerate(t):
            a = t[k - 1] if k else None
            context = one[a] if k else 0
            w = weights[min(int(math.log2(context + 1)), ngram_lm.BUCKETS - 1)]
            total += math.log10(w[0] * (two[a, b] / context if context else 0) + w[1] * one[b] / n + w[2] / (v + 1))
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        out.append((i, h, len(t), sum(one[w] > 0 for w in t), n, base, total))
    return out


@pytest.mark.parametrize("limits", [{}, {"size": 3000, "fan": 8}])
def test_scores_of_the_language_model(spark, limits):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"W{x}" for x in np.minimum(rng.zipf(1.3, 40), 400))) for i in range(300)] + [(None, "w1 w2 w1 w2"), (7, None), (7, "w1"), (7, "w1")]
    got = sorted((r.asDict() for r in ngram_lm.score(spark.createDataFrame(rows, DOCS), **limits).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["base_score"]))
    want = sorted(model(rows), key=lambda r: (r[0] is None, r[0], r[5]))
    for g, w in zip(got, want, strict=True):
        assert [g[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")] == list(w[:5])
        assert math.isclose(g["base_score"], (w[5]), abs_tol=1e-6)
        assert math.isclose(g["score"], w[6], rel_tol=1e-3)
