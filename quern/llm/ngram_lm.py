"""Bigram language model by deleted interpolation.

P(w | h) = l2 * c(h w) / c(h) + l1 * c(w) / N + l0 / (V + 1)

with weights (l2, l1, l0) for each bucket of the context's frequency c(h). The
weights are learned by expectation-maximisation on held-out counts: each
training text is held out in turn, its own counts deleted from the totals, so a
weight says how far the counts of all other texts foretell a new text.

Counting is the corpus-wide exchange of ``exchange``: every word and word pair
of every training text counts, by a 64-bit hash of which the lowest bit tells
pairs from words, and what is sent grows with the input. Estimates enter EM
as the means of bins, STEP a decade; the tests hold the scores to 0.1 % of those
by EM on every single estimate. The first token of a text has no
context and takes the weights of a context that was never seen. Each
batch then resolves its words to their counts once, is written so (packed small
integers), and scoring is one narrow pass over that table. Only sums and a
histogram of bounded size reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import exchange, textcode
from quern.llm.common import written

#: Rows with crc32 of the id as text modulo this, equal to that, are never learned from.
FOLDS, HELD_OUT = 7, 2
#: Buckets of context frequency (by powers of two) and bins a decade of the estimates that enter EM.
BUCKETS, STEP, BINS = 24, 8, 80
ITERATIONS = 60
_U = np.uint64
_END = textcode.mix(np.array([0x0E0F], np.uint64))[0]
_SCHEMA = "ids array<bigint>, held array<boolean>, sizes array<int>, words binary, pairs binary, codes array<int>, counts array<bigint>, pair_sums array<double>, word_sums array<double>, types bigint, tokens bigint"


def held_out_ids(ids: list) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % FOLDS == HELD_OUT for x in ids], bool)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, an end after each text, and where each text starts, with the end."""
    out, sizes = [], []
    for a, b in textcode.chunks(texts):
        words, places = textcode.word_hashes(texts.slice(a, b - a), textcode.NOT_SPACE)
        n = np.diff(places)
        own = np.full(len(words) + len(n), _END, np.uint64)
        own[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
        out.append(own)
        sizes.append(n + 1)
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def pair_keys(words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each token with the token before it, and the places of these tokens: all but the first of a text."""
    inner = np.ones(len(words), bool)
    inner[places[:-1]] = False
    at = np.flatnonzero(inner)
    return textcode.mix(words[at - 1] * textcode._GRAM_CODE[8] + words[at] * textcode._GRAM_CODE[9]), at


class _Batch:
    """A batch's tokens and pairs: distinct keys (the lowest bit tells a pair), the code of each, training masks."""

    def __init__(self, table: pa.Table):
        words, self.places = tokens(table.column("text").combine_chunks())
        self.held = held_out_ids(table.column("doc_id").to_pylist())
        self.train = np.repeat(~self.held, np.diff(self.places))
        pairs, self.inner = pair_keys(words, self.places)
        self.keys, code = np.unique(np.concatenate([words & ~_U(1), pairs | _U(1)]), return_inverse=True)
        self.one, self.two = code[: len(words)], code[len(words) :]
        self.counts = np.bincount(code, np.concatenate([self.train, self.train[self.inner]]), len(self.keys)).astype(np.int64)


def _own_counts(codes: np.ndarray) -> np.ndarray:
    """How often each value occurs, at each of its places."""
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    return counts[inverse]


def resolved(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row for each batch: its texts with tokens resolved to training counts, and its share of all statistics.

    ``limits`` are those of the exchange (``size`` of a batch, ``fan``).
    """
    batches, n = exchange.batched(docs, id_col, text_col, limits.get("size"))
    fan = limits.get("fan", exchange.FAN)
    bits = exchange.part_bits(n, fan)

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = _Batch(table)
        return own.keys, own.counts

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Batch(table)
        _, total, owner = exchange.told(answers, own.keys, own.counts, 64, bits, owners=True)
        # Counts of a token's own text are deleted from the totals while that text is held out.
        text = np.repeat(np.arange(len(own.held)), np.diff(own.places)) * len(own.keys)
        rest1 = total[own.one] - _own_counts(text + own.one)
        rest2 = total[own.two] - _own_counts(text[own.inner] + own.two)
        use = own.train[own.inner]  # the first token of a text has no context
        where = own.inner[use]
        context = np.maximum(rest1[where - 1], 0)
        bucket = np.minimum(np.log2(context + 1).astype(int), BUCKETS - 1)
        ratio = rest2[use] / np.maximum(context, 1)
        two_bin, one_bin = _bin(ratio, BINS), _bin(rest1[where], 2 * BINS)
        codes, code, counts = np.unique((bucket * (BINS + 1) + two_bin) * (2 * BINS + 1) + one_bin, return_inverse=True, return_counts=True)
        pairs = np.zeros(len(own.one), np.int64)
        pairs[own.inner] = total[own.two]
        row = {
            "ids": [table.column("doc_id").to_pylist()],
            "held": [own.held.tolist()],
            "sizes": [np.diff(own.places).astype(np.int32)],
            "words": [_squeeze(total[own.one])],
            "pairs": [_squeeze(pairs)],
            "codes": [codes.astype(np.int32)],
            "counts": [counts.astype(np.int64)],
            "pair_sums": [np.bincount(code, ratio, len(codes))],
            "word_sums": [np.bincount(code, rest1[where], len(codes))],
            "types": [int((owner & ((own.keys & _U(1)) == 0)).sum())],
            "tokens": [int(own.train.sum())],
        }
        kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.int64()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(row.items(), kinds)})

    return exchange.joined(batches, exchange.tell(batches, n, keys_of, 64, owner=True, fan=fan), finish, _SCHEMA)


def _squeeze(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, compressed."""
    kind = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + zlib.compress(counts.astype(f"<u{kind.itemsize}").tobytes(), 1)


def _expand(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.float64)


def _bin(value: np.ndarray, bins: int) -> np.ndarray:
    """Logarithmic bin of ratios (up to 1) or counts (from 1); 0 for none."""
    size = np.abs(np.log10(np.where(value > 0, value, 1.0)))
    return np.where(value > 0, 1 + np.minimum((size * STEP).astype(int), bins - 1), 0)


def learn(histogram: list[tuple[int, int]], tokens_in_all: int, types: int, means: list[tuple[float, float]] | None = None) -> np.ndarray:
    """Weights (pair, word, even) of each bucket by EM over the histogram of held-out estimates.

    ``means`` has the mean estimate of the pair and the mean count of the word
    in each entry; without it the bin stands for them.
    """
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]  # a context that no other text has
    if not histogram or not tokens_in_all:
        return weights
    code, count = np.array(histogram, np.int64).T
    one_bin, rest = code % (2 * BINS + 1), code // (2 * BINS + 1)
    two_bin, bucket = rest % (BINS + 1), rest // (BINS + 1)
    pair = np.where(two_bin > 0, 10 ** ((1 - two_bin) / STEP), 0.0)
    word = np.where(one_bin > 0, np.minimum(10 ** ((one_bin - 1) / STEP) / tokens_in_all, 1.0), 0.0)
    if means:
        pair, word = np.array(means).T / [[1], [tokens_in_all]]
    parts = np.column_stack([pair, word, np.full(len(code), 1 / (types + 1))])
    for _ in range(ITERATIONS):
        share = weights[bucket] * parts
        share *= (count / share.sum(axis=1))[:, None]
        sums = np.column_stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)])
        sums += 0.01 * np.array([0.1, 0.5, 0.4])  # keeps every weight above 0
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Null and empty texts are one end token. A row without an id is training
    text. An empty table, or one without training rows, has the even
    distribution for a model. Other columns are not read.
    """
    table = written(resolved(docs, id_col, text_col, **limits), "lm-resolved")
    sums = table.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)
    histogram = table.select(F.explode(F.arrays_zip("codes", "counts", "pair_sums", "word_sums")).alias("x")).groupBy("x.codes")
    histogram = histogram.agg(F.sum("x.counts").alias("n"), F.sum("x.pair_sums").alias("pairs"), F.sum("x.word_sums").alias("words")).orderBy("codes").collect()
    weights = learn([(r["codes"], r["n"]) for r in histogram], n, v, [(r["pairs"] / r["n"], r["words"] / r["n"]) for r in histogram])
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held, sizes, words, pairs in zip(*batch.columns):
                size = np.asarray(sizes.values, np.int64)
                places = np.concatenate([[0], np.cumsum(size)])
                one, two = _expand(words.as_py()), _expand(pairs.as_py())
                context = np.empty_like(one)
                context[1:] = one[:-1]
                context[places[:-1]] = 0
                w = weights[np.minimum(np.log2(context + 1).astype(int), BUCKETS - 1)]
                p = w[:, 0] * np.where(context > 0, two / np.maximum(context, 1), 0.0) + w[:, 1] * (one / max(n, 1)) + w[:, 2] / (v + 1)
                if not n:
                    p = np.ones_like(p)
                base = np.log10((one + 1) / (n + (v + 1)))
                add = lambda x: np.add.reduceat(x, places[:-1])
                columns = [ids.values, held.values, pa.array(size), pa.array(add((one > 0).astype(np.int64))), pa.array(np.full(len(size), n)), pa.array(add(base)), pa.array(add(np.log10(p)))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return table.select("ids", "held", "sizes", "words", "pairs").mapInArrow(run, schema)
