"""Corpus-wide totals of hashed keys, without a row for each occurrence.

A corpus of n words has about n distinct 5-grams, and a shuffle row for each
would be many times the input. Here the texts are dealt to batches of bounded
size by a hash of the row; each batch reduces its keys to distinct ones with
counts (so a key of a third of all texts is sent once by each batch, never once
for each text), and sends them as packed arrays to the partition of their
leading bits. That partition adds up the counts and answers each batch with one
bit for each key that it sent, and a total for each key that others have too; of
all other keys the batch knows the total already.

A batch sends at most FAN rows, so rows grow with the input and not with its
square. Up to FAN batches every partition hears from every batch. Beyond that
the batches are divided into sets of FAN, a partition hears from one set, and
what it has gathered is a batch of its own in the next round, whose answers it
hands down: each round moves the keys once more and multiplies what fits by FAN.

The texts are shuffled once: both uses of the batches share one exchange.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import keyed_text

#: Bytes of text in a batch on small executors; what a task holds is a small multiple of it, or of the longest text.
BATCH_BYTES = 6 << 20
#: A batch may have this share of an executor core's memory, if that is more.
MEMORY_SHARE = 1 / 150
#: Rows that a batch sends at most.
FAN = 8192
_U = np.uint64
_SENT = "batch bigint, part bigint, area bigint, keys binary, counts binary"
_ANSWER = "batch bigint, part bigint, shared binary, totals binary, owner binary"


def batch_bytes(spark: SparkSession) -> int:
    """Bytes of text in a batch: BATCH_BYTES, and more on executors with more memory to a core."""
    sizes = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    told = re.fullmatch(r"(\d+)([kmgt])b?", spark.conf.get("spark.executor.memory", "1g").lower())
    memory = int(told[1]) * sizes[told[2]] if told else 1 << 30
    return max(BATCH_BYTES, int(memory / int(spark.conf.get("spark.executor.cores", "2")) * MEMORY_SHARE))


def batched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> tuple[DataFrame, int]:
    """(batch, doc_id, text) and the number of batches. A null text counts as empty."""
    text = keyed_text(docs, id_col, text_col)
    total = text.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / (size or batch_bytes(docs.sparkSession))))
    return text.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("batch"), "doc_id", "text"), n


def part_bits(batches: int, fan: int = FAN) -> int:
    """Leading bits of a key that choose its partition: about as many partitions as batches, FAN at most."""
    return max(3, math.ceil(math.log2(min(batches, fan))))


def shorten(keys: np.ndarray, bits: int) -> np.ndarray:
    """Leading bits of 64-bit keys."""
    return keys >> _U(64 - bits)


def _small(values: np.ndarray) -> bytes:
    """Whole numbers in a byte each; those from 255 on follow in eight."""
    over = values[values >= 255].astype("<u8").tobytes()
    return len(over).to_bytes(4, "little") + over + np.minimum(values, 255).astype(np.uint8).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    over = int.from_bytes(data[:4], "little")
    out = np.frombuffer(data, np.uint8, offset=4 + over).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", over // 8, 4)
    return out


def _pack(keys: np.ndarray, width: int) -> bytes:
    """Ascending distinct keys of ``width`` bits: the low bits as they are, the high bits in unary, about two bits a key."""
    n = len(keys)
    low = max(0, width - max(0, (n - 1).bit_length()))
    bits = np.unpackbits(keys.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - low :]
    high = (keys >> _U(low)).astype(np.int64) if low < 64 else np.zeros(n, np.int64)
    unary = np.zeros(int(high[-1]) + n if n else 0, np.uint8)
    unary[high + np.arange(n)] = 1
    return low.to_bytes(1, "little") + n.to_bytes(4, "little") + np.packbits(bits).tobytes() + np.packbits(unary).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    low, n = data[0], int.from_bytes(data[1:5], "little")
    raw = np.frombuffer(data, np.uint8, offset=5)
    split = (n * low + 7) // 8
    full = np.zeros((n, 64), np.uint8)
    full[:, 64 - low :] = np.unpackbits(raw[:split], count=n * low).reshape(n, low)
    lows = np.packbits(full, axis=1).view(">u8").ravel().astype(np.uint64)
    high = np.flatnonzero(np.unpackbits(raw[split:]))[:n] - np.arange(n)
    return lows | (high.astype(np.uint64) << _U(low)) if low < 64 else lows


def _spans(keys: np.ndarray, width: int, bits: int) -> list[tuple[int, int, int]]:
    """(part, first, end) of the ascending keys of each part."""
    parts = (keys >> _U(width - bits)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
    return [(int(parts[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def _outgoing(batch: int, keys: np.ndarray, counts: np.ndarray, width: int, bits: int, area: Callable[[int], int]) -> pa.Table:
    """A row for each part of a batch's ascending keys of ``width`` bits."""
    spans, rest = _spans(keys, width, bits), _U((1 << (width - bits)) - 1)
    count = lambda c: b"" if c.min() == c.max() == 1 else _small(c)
    columns = [[batch] * len(spans), [p for p, _, _ in spans], [area(p) for p, _, _ in spans], [_pack(keys[a:b] & rest, width - bits) for _, a, b in spans], [count(counts[a:b]) for _, a, b in spans]]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({name.split()[0]: pa.array(v, t) for name, v, t in zip(_SENT.split(", "), columns, kinds)})


class _Gathered:
    """What an area was sent: ``keys`` in order with their ``sums``, and of each row where its keys are among them."""

    def __init__(self, table: pa.Table):
        order = pa.array(np.lexsort((table.column("part").to_numpy(), table.column("batch").to_numpy())))
        self.table = table.take(order)
        own = [_unpack(x.as_py()) for x in self.table.column("keys")]
        counts = [_numbers(c) if c else np.ones(len(k), np.int64) for k, c in zip(own, (x.as_py() for x in self.table.column("counts")))]
        self.ends = np.cumsum([len(x) for x in own])
        keys, count = np.concatenate(own), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group, begin = np.cumsum(first) - 1, np.flatnonzero(first)
        self.keys, self.sums = ordered[begin], np.add.reduceat(count[order], begin)
        self.several = np.diff(np.append(begin, len(keys))) > 1
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = group
        # The first row with a count above 0 owns the key here.
        has = count[order] > 0
        seen = np.cumsum(has)
        before = np.where(begin > 0, seen[begin - 1], 0)
        self.first = np.zeros(len(keys), bool)
        self.first[order] = has & (seen - before[group] == 1)

    def answers(self, shared: np.ndarray, totals: np.ndarray | None, owned: np.ndarray | None) -> pa.Table:
        """A row for each row sent of which a key is shared; ``owned``: keys that belong to this area."""
        columns: dict[str, list] = {name.split()[0]: [] for name in _ANSWER.split(", ")}
        start = 0
        for batch, part, end in zip(self.table.column("batch").to_pylist(), self.table.column("part").to_pylist(), self.ends.tolist()):
            place, own = self.place[start:end], self.first[start:end]
            start, mask = end, shared[place]
            if mask.any():
                columns["batch"].append(batch)
                columns["part"].append(part)
                columns["shared"].append(np.packbits(mask).tobytes())
                columns["totals"].append(b"" if totals is None else _small(totals[place[mask]]))
                columns["owner"].append(b"" if owned is None else np.packbits((own & owned[place])[mask]).tobytes())
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), kinds)})


def tell(batches: DataFrame, n: int, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], key_bits: int, totals: bool = True, owner: bool = False, fan: int = FAN) -> DataFrame:
    """(batch, part, shared, totals, owner): what other batches add to the keys of each of the ``n`` batches, to be read by ``told``.

    ``keys_of`` gives the distinct keys of a batch, of ``key_bits`` bits, in
    ascending order and a count of each. ``shared`` marks those of two batches
    or more, of which alone there are ``totals``. ``owner`` marks those of which
    this batch is the first with a count above 0, so that a sum over batches
    counts each key once. Totals and owners are sent only if asked for.
    """
    bits, sets = part_bits(n, fan), math.ceil(n / fan)

    def send(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        return _outgoing(batch, *keys_of(table), key_bits, bits, lambda part: part * sets + batch % sets)

    sent = batches.groupBy("batch").applyInArrow(send, _SENT)
    return _settled(sent, key_bits - bits, sets, totals, owner, fan)


def _settled(sent: DataFrame, width: int, sets: int, totals: bool, owner: bool, fan: int) -> DataFrame:
    """Answers to what was sent: keys of ``width`` bits more, by areas of which ``sets`` have the same leading bits."""
    if sets == 1:

        def total(table: pa.Table) -> pa.Table:
            own = _Gathered(table)
            return own.answers(own.several, own.sums if totals else None, np.ones(len(own.keys), bool) if owner else None)

        return sent.groupBy("area").applyInArrow(total, _ANSWER)
    bits, more = part_bits(sets, fan), math.ceil(sets / fan)

    def gather(table: pa.Table) -> pa.Table:
        area, own = table.column("area")[0].as_py(), _Gathered(table)
        return _outgoing(area, own.keys, own.sums, width, bits, lambda part: (((area // sets) << bits) + part) * more + area % sets % more)

    def hand_down(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Gathered(table)
        shared, sums, owned = told(answers, own.keys, own.sums, width, bits, sums=totals, owners=owner)
        return own.answers(own.several | shared, sums if totals else None, owned if owner else None)

    answers = _settled(sent.groupBy("area").applyInArrow(gather, _SENT), width - bits, more, totals, owner, fan)
    return sent.groupBy("area").cogroup(answers.groupBy("batch")).applyInArrow(hand_down, _ANSWER)


def told(answers: pa.Table, keys: np.ndarray, counts: np.ndarray, width: int, bits: int, sums: bool = True, owners: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shared, totals, owner) of each of a batch's ascending keys of ``width`` bits."""
    shared, totals, owner = np.zeros(len(keys), bool), counts.astype(np.int64), counts > 0
    own = {part: (a, b) for part, a, b in _spans(keys, width, bits)}
    for part, mask, total, mine in zip(*(answers.column(c).to_pylist() for c in ("part", "shared", "totals", "owner"))):
        a, b = own[part]
        at = a + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a))
        shared[at] = True
        if sums:
            totals[at] = _numbers(total)
        if owners:
            owner[at] = np.unpackbits(np.frombuffer(mine, np.uint8), count=len(at)).astype(bool)
    return shared, totals, owner


def joined(batches: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``finish(texts, answers)`` of each batch."""
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, schema)
