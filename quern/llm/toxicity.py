"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic, over the words of a text. Labels exist for whole
documents only, so words are labelled first: a greedy cover picks the words and
word beginnings that explain the toxic documents of the training sample, and
their occurrences in toxic documents are the labelled tokens. The field is then
fitted to those tokens, forward-backward gives each word's marginal, and a
logistic layer over the marginals gives the document's score.

Fitting uses a bounded sample of labelled rows (TRAIN_ROWS of each class,
TRAIN_CHARS in all);
scoring runs over every whole text as one narrow pass without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import textcode
from quern.llm.common import keyed_text

#: At most this many labelled rows of each class are fitted, of at most so many characters in all and in one text.
TRAIN_ROWS, TRAIN_CHARS, LONGEST_TEXT = 2000, 10_000_000, 500_000
#: Lengths in bytes of the word beginnings that serve as features beside the word.
PREFIXES = (4, 5)
#: A cover feature explains at least so many toxic documents, with at least this precision; a document is explained up to COVERS times.
MIN_COVER, MIN_PRECISION, COVERS = 3, 0.95, 4
SEGMENT, STEPS, RATE, L2 = 64, 90, 0.15, 0.3
THRESHOLD = 0.3
#: Runs of ordinary words beyond this length have converged and share one matrix.
LONGEST_GAP = 256


@dataclass
class Model:
    """Fitted parameters; ``features`` is sorted and ``weights`` follows it."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    layer: np.ndarray

    def gaps(self) -> np.ndarray:
        """Powers of the transition matrix of an ordinary word, each scaled to sum 1."""
        step = np.exp(self.trans + np.array([0.0, self.bias]))
        out = [np.eye(2)]
        for _ in range(LONGEST_GAP):
            out.append(out[-1] @ step)
            out[-1] /= out[-1].sum()
        return np.array(out)


def held_out(id_column, parts: int = 4, part: int = 2):
    """Whether a row is kept from training: crc32 of the id as text."""
    return F.coalesce(F.crc32(id_column.cast("string")) % parts == part, F.lit(False))


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, places, starts, ends): a row of feature hashes for each word; 0 where the word is too short."""
    data, offsets = textcode.text_bytes(texts)
    words, places = textcode.word_hashes(texts, textcode.ALNUM)
    if not len(words):
        return np.zeros((0, 1 + len(PREFIXES)), np.uint64), places, np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = textcode.ALNUM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    out = [words]
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    for k in PREFIXES:
        h = np.zeros(len(starts), np.uint64)
        for j in range(k):
            h = h * np.uint64(257) + low[np.minimum(starts + j, len(low) - 1)]
        out.append(np.where(ends - starts > k, textcode.mix(h + np.uint64(k << 56)), np.uint64(0)))
    return np.stack(out, axis=1), places, starts, ends


def _cover(docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Features that explain the toxic documents, most explaining first."""
    pairs = [(f, np.full(len(f), i)) for i, f in enumerate(docs)]
    feature, doc = (np.concatenate(x) for x in zip(*pairs))
    names, code = np.unique(feature, return_inverse=True)
    bad = np.bincount(code, toxic[doc], len(names))
    every = np.bincount(code, minlength=len(names))
    good = (names != 0) & (bad >= MIN_COVER) & (bad >= MIN_PRECISION * every)
    use = good[code] & (toxic[doc] == 1)
    code, doc, need, picked = code[use], doc[use], np.where(toxic == 1, COVERS, 0), []
    while True:
        count = np.bincount(code[need[doc] > 0], minlength=len(names))
        if not len(count) or count.max() < MIN_COVER:
            return np.array(picked, np.uint64)
        best = int(count.argmax())
        picked.append(names[best])
        own = code == best
        need[doc[own]] -= 1
        code, doc = code[~own], doc[~own]


def _fit_chain(x: np.ndarray, y: np.ndarray, n_features: int, lengths: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions by gradient ascent on the conditional likelihood.

    x: (segments, SEGMENT, slots) feature numbers, ``n_features`` where none; y: states.
    """
    size = n_features + 1 + 4
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    theta[n_features] = -3.0
    mask = np.arange(SEGMENT)[None, :] < lengths[:, None]
    scale = weight[:, None] * mask
    prev = np.concatenate([np.zeros((len(y), 1), int), y[:, :-1]], axis=1)
    seen = np.zeros(size)
    for s in range(x.shape[2]):
        seen[: n_features + 1] += np.bincount(x[:, :, s].ravel(), (scale * y).ravel(), n_features + 1)
    seen[n_features] = (scale * y).sum()
    seen[n_features + 1 :] = np.bincount((prev * 2 + y).ravel(), scale.ravel(), 4)
    for step in range(1, STEPS + 1):
        w = np.append(theta[:n_features], 0.0)
        emit = theta[n_features] + w[x].sum(axis=2)
        trans = theta[n_features + 1 :].reshape(2, 2)
        forward = np.empty((SEGMENT, len(y), 2))
        moves = np.exp(trans)
        e = np.exp(np.clip(emit, -30, 30))
        now = np.zeros((len(y), 2))
        now[:, 0] = 1.0
        for t in range(SEGMENT):
            nxt = now @ moves
            nxt[:, 1] *= e[:, t]
            nxt /= nxt.sum(axis=1, keepdims=True)
            now = np.where(mask[:, t, None], nxt, now)
            forward[t] = now
        back = np.ones((len(y), 2))
        expected = np.zeros(size)
        node = np.empty_like(emit)
        for t in range(SEGMENT - 1, -1, -1):
            p = forward[t] * back
            node[:, t] = p[:, 1] / p.sum(axis=1)
            before = forward[t - 1] if t else np.tile([1.0, 0.0], (len(y), 1))
            tail = back.copy()
            tail[:, 1] *= e[:, t]
            edge = before[:, :, None] * moves[None] * tail[:, None, :]
            edge /= edge.sum(axis=(1, 2), keepdims=True)
            expected[n_features + 1 :] += (edge * scale[:, t, None, None]).sum(axis=0).ravel()
            moved = tail @ moves.T
            moved /= moved.sum(axis=1, keepdims=True)
            back = np.where(mask[:, t, None], moved, back)
        node *= scale
        for s in range(x.shape[2]):
            expected[: n_features + 1] += np.bincount(x[:, :, s].ravel(), node.ravel(), n_features + 1)
        expected[n_features] = node.sum()
        grad = seen - expected - L2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 :].reshape(2, 2)


def _among(kinds: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each feature among sorted ``kinds``, and whether it is there."""
    at = np.searchsorted(kinds, column)
    at[at == len(kinds)] = 0
    return at, kinds[at] == column if len(kinds) else np.zeros(len(column), bool)


def _sample_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, places) of all words of a sample, made a chunk at a time, as hashing takes many times the bytes of a text."""
    parts = [word_features(texts.slice(a, b - a))[:2] for a, b in textcode.chunks(texts)]
    places = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p) for _, p in parts]))])
    return np.concatenate([f for f, _ in parts]), places.astype(np.int64)


def fit(texts: list[str], toxic: list[int], share: float) -> Model | None:
    """The model of a labelled sample; ``share``: toxic rows among all training rows. None without both classes."""
    labels = np.array(toxic)
    if not len(labels) or labels.min() == labels.max():
        return None
    features, places = _sample_features(pa.array(texts, pa.string()))
    docs = [np.unique(features[a:b]) for a, b in zip(places[:-1], places[1:])]
    seeds = _cover(docs, labels)
    del docs
    of_doc = np.repeat(np.arange(len(texts)), np.diff(places))
    # A column at a time, so that no copy of all features is made.
    seeded = np.zeros(len(features), bool)
    for column in features.T:
        seeded |= _among(np.sort(seeds), column)[1]
    state = (seeded & (labels[of_doc] == 1)).astype(int)
    kinds, counts = np.unique(features[state == 1], return_counts=True)
    kinds = kinds[(counts >= 2) & (kinds != 0)]
    if not len(kinds):
        return None
    number = np.full(features.shape, len(kinds), np.int32)
    for k, column in enumerate(features.T):
        at, hit = _among(kinds, column)
        number[hit, k] = at[hit]
    # Segments of a document; those of ordinary words only are all alike and kept once with their count.
    segments: list[tuple[int, int]] = [(a, min(a + SEGMENT, e)) for s, e in zip(places[:-1], places[1:]) for a in range(s, e, SEGMENT)]
    marked = np.concatenate([[0], np.cumsum((number < len(kinds)).any(axis=1) | (state == 1))])
    plain: dict[int, int] = {}
    rows = []
    for a, b in segments:
        if marked[b] == marked[a]:
            plain[b - a] = plain.get(b - a, 0) + 1
        else:
            rows.append((a, b))
    x = np.full((len(rows) + len(plain), SEGMENT, features.shape[1]), len(kinds), np.int32)
    y = np.zeros((len(x), SEGMENT), int)
    lengths, weight = np.array([b - a for a, b in rows] + [*plain]), np.array([1.0] * len(rows) + [*map(float, plain.values())])
    for i, (a, b) in enumerate(rows):
        x[i, : b - a], y[i, : b - a] = number[a:b], state[a:b]
    weights, bias, trans = _fit_chain(x, y, len(kinds), lengths, weight)
    model = Model(kinds, weights, bias, trans, np.zeros(3))
    signals = np.array([[s, top] for s, top, _ in marginals(model, features, places)])
    model.layer = _fit_layer(signals, labels, share)
    return model


def _signals(raw: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(raw)), np.minimum(raw[:, 0], 5.0), raw[:, 1]])


def _fit_layer(raw: np.ndarray, labels: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression on expected toxic words and the largest marginal, classes weighted to their true share."""
    x, y = _signals(raw), labels.astype(float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    layer = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ layer))
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ layer)
        layer += np.clip(step, -2, 2)
    return layer


def marginals(model: Model, features: np.ndarray, places: np.ndarray) -> Iterator[tuple[float, float, list[tuple[int, float]]]]:
    """For each text: expected toxic words, the largest marginal, and (word, marginal) of the words with features.

    Between words that have features all words are alike, so forward and
    backward steps over them are one product with a power of their matrix.
    """
    gaps, moves = model.gaps(), np.exp(model.trans)
    scores, any_found = np.zeros(len(features)), np.zeros(len(features), bool)
    for column in features.T:
        at, hit = _among(model.features, column)
        scores[hit] += model.weights[at[hit]]
        any_found |= hit
    marked = np.flatnonzero(any_found)
    emits = np.exp(np.clip(scores[marked] + model.bias, -30, 30))
    bounds = np.searchsorted(marked, places)
    for i in range(len(places) - 1):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            yield 0.0, 0.0, []
            continue
        own, e = marked[a:b] - places[i], emits[a:b]
        lead = np.minimum(np.diff(own, prepend=-1) - 1, LONGEST_GAP)
        steps = [gaps[g] @ (moves * [1.0, x]) for g, x in zip(lead, e)]
        forward, now = [], np.array([1.0, 0.0])
        for step in steps:
            now = now @ step
            now = now / now.sum()
            forward.append(now)
        back = gaps[min(places[i + 1] - places[i] - 1 - own[-1], LONGEST_GAP)].sum(axis=1)
        out = [0.0] * len(own)
        for k in range(len(own) - 1, -1, -1):
            p = forward[k] * back
            out[k] = float(p[1] / p.sum())
            back = steps[k] @ back
            back = back / back.sum()
        yield sum(out), max(out), list(zip(own.tolist(), out))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model | None:
    """Fit on at most ``rows`` labelled training rows of each class, in the order of a hash of the id.

    Texts over LONGEST_TEXT characters are left out, and so is what comes after
    ``chars`` characters in all. An id with several labels has the least, one
    with several texts the least text. None without both classes.
    """
    own = labels.select(F.col("doc_id").cast("bigint").alias("__label_id"), F.col("toxic").cast("int").alias("__toxic")).where("__label_id IS NOT NULL AND __toxic IN (0, 1)")
    own = own.where(~held_out(F.col("__label_id"))).groupBy("__label_id").agg(F.min("__toxic").alias("__toxic"))
    totals = {r["__toxic"]: r["count"] for r in own.groupBy("__toxic").count().collect()}
    order = [F.xxhash64("__label_id"), F.col("__label_id")]
    sample = own.where("__toxic = 1").orderBy(*order).limit(rows).unionAll(own.where("__toxic = 0").orderBy(*order).limit(rows))
    text = keyed_text(docs, id_col, text_col)
    sizes = text.select("doc_id", F.length("text").alias("size")).where(F.col("size") <= LONGEST_TEXT).join(F.broadcast(sample), F.col("doc_id") == F.col("__label_id"))
    sizes = sizes.groupBy("__label_id", "__toxic").agg(F.max("size").alias("size"))  # as many rows as the sample at most, in one window
    fits = sizes.withColumn("upto", F.sum("size").over(Window.orderBy(*order))).where(F.col("upto") <= chars).select("__label_id", "__toxic")
    found = text.where(F.length("text") <= LONGEST_TEXT).join(F.broadcast(fits), F.col("doc_id") == F.col("__label_id")).groupBy("doc_id", "__toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "__toxic")
    share = totals.get(1, 0) / max(1, sum(totals.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns)))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows], share))]})

    # The bounded sample meets in one task; only the fitted parameters come to the driver.
    fitted = found.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(fitted[0]) if fitted else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans), one row per input row.

    ``spans`` lists runs of words whose marginal is 1/2 or more, as character
    offsets. Null and empty texts have the score of a text without toxic words;
    without a model every score is 0. Very long texts are scored whole, repeated
    rows each get their row, an empty table gives an empty result. Other columns
    are read only with ``carry``, which adds the input row as ``row``.
    """
    extra = [F.struct("*").alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *extra)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("toxicity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in textcode.chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                scores, spans = _scored(model, part.column(1))
                columns = [part.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "spans", *["row"] * carry])

    row = f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    out = rows.mapInArrow(run, f"doc_id bigint, score double, spans array<struct<start:bigint,end:bigint,toxicity:double>>{row}")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans", *["row"] * carry)


def _scored(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, list]:
    if model is None:
        return np.zeros(len(texts)), [[]] * len(texts)
    features, places, starts, ends = word_features(texts)
    data, offsets = textcode.text_bytes(texts)
    raw, spans = [], []
    for i, (total, top, words) in enumerate(marginals(model, features, places)):
        raw.append((total, top))
        own: list[dict] = []
        for word, p in words:
            if p < 0.5:
                continue
            a, b = (int(x[places[i] + word] - offsets[i]) for x in (starts, ends))
            if own and own[-1]["word"] + 1 == word:
                own[-1].update(word=word, end=b, toxicity=max(p, own[-1]["toxicity"]))
            else:
                own.append({"word": word, "start": a, "end": b, "toxicity": p})
        if own:  # bytes to characters
            chars = np.concatenate([[0], np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])
            own = [{"start": int(chars[x["start"]]), "end": int(chars[x["end"]]), "toxicity": x["toxicity"]} for x in own]
        spans.append(own)
    z = _signals(np.array(raw, float).reshape(-1, 2)) @ model.layer
    return 1 / (1 + np.exp(-z)), spans
