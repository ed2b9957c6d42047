"""Removal of repeated 50-byte strings by two-stage suffix sorting.

A byte goes if a string of WIDTH bytes that covers it also starts in a document
with a smaller id.

1. Anchors: of the GRAM-byte grams inside each window of WIDTH bytes the one
   with the smallest hash is its anchor, so equal windows have equal anchors.
   The corpus-wide exchange tells each batch which anchors other documents have.
2. Windows on shared anchors are sent, as the bytes they span, to the partition
   of their anchor: all equal windows meet there, and each has one anchor only.
3. There a suffix array is built in two stages. Suffixes smaller than their
   successors are sorted directly; the order of the rest is induced by scanning
   the buckets from the smallest first byte up, each suffix handing its rank to
   its predecessor. Common prefixes of neighbours then tell equal windows.
4. Repeats go back to the texts, which were shuffled once for all steps.

A batch sends each different stretch of bytes once, whatever the number of its
copies. The two ends of a shared passage have other neighbours in each document,
so these stretches, of up to 76 bytes, are sent for each document: a passage of a
third of all documents sends its ends to two parts as often as it occurs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm import exchange, textcode

WIDTH, GRAM = 50, 24
#: Bits of an anchor's hash that the exchange compares; windows are told apart by their bytes.
KEY_BITS = 48
_U = np.uint64
_NO_ID = np.iinfo(np.int64).max
_rng = np.random.default_rng(50)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * _U(2) + _U(1)


def _squeeze(values: np.ndarray | bytes) -> bytes:
    import zstandard

    return zstandard.compress(values if isinstance(values, bytes) else values.tobytes(), 1)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def ordered(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts of a batch in an order that is the same each time; rows without an id come last."""
    ids = table.column("doc_id").combine_chunks().fill_null(_NO_ID).to_numpy().astype(np.int64)
    texts = table.column("text").combine_chunks()
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(np.diff(ids[order]) == 0)
    if len(same):  # rows of one id: by text
        keys = texts.to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], keys[i])))
    return ids[order], texts.take(pa.array(order))


def windows(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor: (text, first window, last window, anchor hash, hash of the bytes spanned)."""
    out = []
    for a, b in textcode.chunks(texts):
        data, offsets = textcode.text_bytes(texts.slice(a, b - a))
        n = len(data) - WIDTH + 1
        if n < 1:
            continue
        h = [_CODE[data]]
        for k in range(4):  # hashes of 2, 4, 8 and 16 bytes
            w = 1 << k
            h.append(h[-1][:-w] * _STEP[k] + h[-1][w:])
        gram = h[4][: len(data) - GRAM + 1] * _STEP[4] + h[3][16 : len(data) - GRAM + 17]
        gram = (gram ^ (gram >> _U(29))) * _STEP[5]
        low = (gram & ~_U(0xFFFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
        span = WIDTH - GRAM + 1
        done, size = low, 1
        while size * 2 <= span:
            done, size = np.minimum(done[:-size], done[size:]), size * 2
        done = np.minimum(done[:n], done[span - size : span - size + n])
        anchor = (done & _U(0xFFFFFFFF)).astype(np.int64)
        # Windows that lie within one text, in stretches of one anchor.
        sizes = np.maximum(np.diff(offsets) - WIDTH + 1, 0)
        text = np.repeat(np.arange(b - a), sizes)
        at = np.arange(len(text)) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        if not len(at):
            continue
        own = anchor[at]
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])
        start = np.flatnonzero(first)
        stop = np.append(start[1:], len(at)) - 1
        up, down = textcode._powers(1 << max(10, (len(data) - 1).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * up[: len(data)])])
        p, q = at[start], at[stop] + WIDTH
        body = textcode.mix((total[q] - total[p]) * down[p] + (q - p).astype(np.uint64))
        base = offsets[text[start]]
        out.append((text[start] + a, p - base, at[stop] - base, textcode.mix(gram[own[start]]), body))
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))
    return tuple(np.concatenate(x) for x in zip(*out))


def sort_suffixes(data: np.ndarray, wanted: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The wanted places of ``data`` in the order of their suffixes' first WIDTH bytes, by two-stage sorting.

    ``ends`` has for each wanted place the end of its stretch, where data is 0;
    places are ascending and data is padded with WIDTH zeros at least.
    """
    n = len(data)
    # A place is smaller than its successor if the first byte that differs from its own is larger.
    change = np.flatnonzero(data[1:] != data[:-1])
    small = np.zeros(n, bool)
    if len(change):
        runs = np.diff(np.concatenate([[-1], change]))
        small[: change[-1] + 1] = np.repeat(data[change] < data[change + 1], runs)
    # What the rest is induced from: places up to the next that is sorted directly, or the end.
    direct = np.flatnonzero(small)
    follow = np.searchsorted(direct, wanted)
    after = np.where(follow < len(direct), direct[np.minimum(follow, len(direct) - 1)] if len(direct) else n, n)
    reach = np.minimum(after, ends)
    member = np.zeros(n + 1, np.int32)
    np.add.at(member, wanted, 1)
    np.add.at(member, reach + 1, -1)
    member = np.cumsum(member[:-1]) > 0
    member_small = member & small
    stops = np.unique(ends[reach == ends])
    member_small[stops] = True
    small[stops] = True
    member[stops] = True
    # First stage: sort the small ones by eight bytes at a time, going on only where neighbours are equal.
    word = data.astype(np.uint64)
    for shift, w in ((8, 1), (16, 2), (32, 4)):
        word = (word << _U(shift)) | np.concatenate([word[w:], np.zeros(w, np.uint64)])
    order = np.flatnonzero(member_small)
    order = order[np.argsort(word[order], kind="stable")]
    edge = np.concatenate([[True], word[order[1:]] != word[order[:-1]]]) if len(order) else np.zeros(0, bool)
    for depth in range(8, WIDTH, 8):
        if not len(order):
            break
        value = word[np.minimum(order + depth, n - 1)]
        if WIDTH - depth < 8:
            value = value >> _U(64 - 8 * (WIDTH - depth))
        differs = np.concatenate([[True], value[1:] != value[:-1]])
        group = np.cumsum(edge) - 1
        mixed = np.bincount(group, differs & ~edge) > 0
        part = np.flatnonzero(mixed[group])
        if len(part):
            moved = part[np.lexsort((value[part], group[part]))]
            order[part], value[part] = order[moved], value[moved]
            differs = np.concatenate([[True], value[1:] != value[:-1]])
        edge = edge | differs
    # Second stage: bucket by bucket, each place hands its rank on to the place before it.
    large = member & ~small
    first = data[order]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        own = waiting[c]
        now = np.concatenate(own) if own else np.zeros(0, np.int64)
        pieces = [now]
        while len(now):  # runs of this byte
            now = now[now > 0] - 1
            now = now[large[now] & (data[now] == c)]
            pieces.append(now)
        pieces.append(order[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(pieces)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[large[before] & (data[before] > c)]
        if len(before):
            byte = data[before]
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            cuts = np.flatnonzero(np.diff(byte)) + 1
            for piece in np.split(before, cuts):
                waiting[int(data[piece[0]])].append(piece)
    ranked = np.concatenate(out) if out else np.zeros(0, np.int64)
    is_wanted = np.zeros(n, bool)
    is_wanted[wanted] = True
    return ranked[is_wanted[ranked]]


def repeats(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window): windows that also start in a stretch with a smaller id. ``data`` has a 0 after each stretch."""
    count = sizes - WIDTH + 1
    owner = np.repeat(np.arange(len(starts)), count)
    window = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    wanted = starts[owner] + window
    ranked = sort_suffixes(data, wanted, (starts + sizes)[owner])
    word = data.astype(np.uint64)
    for shift, w in ((8, 1), (16, 2), (32, 4)):
        word = (word << _U(shift)) | np.concatenate([word[w:], np.zeros(w, np.uint64)])
    # Neighbours with a common prefix of WIDTH bytes are one class.
    same = np.ones(max(len(ranked) - 1, 0), bool)
    for depth in [*range(0, WIDTH - 7, 8), WIDTH - 8]:
        value = word[ranked + depth]
        same &= value[1:] == value[:-1]
    begin = np.concatenate([[0], np.flatnonzero(~same) + 1])
    place = np.empty(len(data), np.int64)
    place[wanted] = np.arange(len(wanted))
    at = place[ranked]
    own = ids[owner[at]]
    least = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.append(begin, len(own)))) if len(own) else own
    gone = np.sort(at[own > least])
    return owner[gone], window[gone]


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per input row.

    ``kept`` has the bytes that stay. Null and empty texts and texts under WIDTH
    bytes lose nothing. A row without an id counts as later than all others, and
    repeated rows of one id as one document. Other columns are not read.
    """
    batches, n = exchange.batched(docs, id_col, text_col)
    bits = exchange.part_bits(n)
    part_shift = _U(64 - bits - 1)

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, texts = ordered(table)
        keys = np.unique(exchange.shorten(windows(texts)[3], KEY_BITS))
        return keys, np.ones(len(keys), np.int64)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        columns: dict[str, list] = {k: [] for k in ("part", "batch", "rows", "starts", "sizes", "ids", "data", "gone")}
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
        if table.num_rows:
            batch = table.column("batch")[0].as_py()
            ids, texts = ordered(table)
            text, first, last, anchor, body = windows(texts)
            short = exchange.shorten(anchor, KEY_BITS)
            # Shared with another batch, or between documents of this one.
            names, code = np.unique(short, return_inverse=True)
            low, high = np.full(len(names), _NO_ID), np.full(len(names), -1)
            own_id = ids[text] if len(text) else np.zeros(0, np.int64)
            rank = np.searchsorted(np.unique(ids), own_id)
            np.minimum.at(low, code, rank)
            np.maximum.at(high, code, rank)
            shared = high > low
            shared |= exchange.told(answers, names, np.ones(len(names), np.int64), KEY_BITS, bits, sums=False)[0]
            pick = np.flatnonzero(shared[code]) if len(code) else np.zeros(0, np.int64)
            text, first, last, anchor, body, own_id = (x[pick] for x in (text, first, last, anchor, body, own_id))
            # Each different stretch is sent for its smallest id; later ids here lose it in any case.
            _, at, inverse = np.unique(body, return_index=True, return_inverse=True)
            later = own_id > own_id[at][inverse]
            parts = (anchor >> part_shift).astype(np.int64)
            data, offsets = textcode.text_bytes(texts)
            raw = data.tobytes()
            # A hash finds equal stretches, their bytes decide.
            begin, size = offsets[text] + first, last - first + WIDTH
            for i in np.flatnonzero(later).tolist():
                k = at[inverse[i]]
                later[i] = size[i] == size[k] and raw[begin[i] : begin[i] + size[i]] == raw[begin[k] : begin[k] + size[k]]
            order = np.argsort(parts, kind="stable")
            edges = np.flatnonzero(np.diff(parts[order])) + 1
            for piece in np.split(order, edges) if len(order) else []:
                go, gone = piece[~later[piece]], piece[later[piece]]
                begin = offsets[text[go]] + first[go]
                size = last[go] - first[go] + WIDTH
                columns["part"].append(int(parts[piece[0]]))
                columns["batch"].append(batch)
                # Texts are in order here, so rows and ids go as differences.
                columns["rows"].append(_squeeze(np.diff(text[go], prepend=0).astype("<u4")))
                columns["starts"].append(_squeeze(first[go].astype("<u4")))
                columns["sizes"].append(_squeeze(size.astype("<u2")))
                columns["ids"].append(_squeeze(np.diff(ids[text[go]], prepend=0).astype("<i8")))
                columns["data"].append(_squeeze(b"\0".join([raw[p : p + s] for p, s in zip(begin.tolist(), size.tolist())]) + b"\0"))
                columns["gone"].append(_squeeze(np.column_stack([text[gone], first[gone], last[gone] + WIDTH]).astype("<u4")))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), kinds)})

    def resolve(table: pa.Table) -> pa.Table:
        cells = {k: list(map(_expand, table.column(k).to_pylist())) for k in ("rows", "starts", "sizes", "ids", "data", "gone")}
        read = lambda k, kind: [np.frombuffer(x, kind).astype(np.int64) for x in cells[k]]
        rows, starts, sizes, ids = list(map(np.cumsum, read("rows", "<u4"))), read("starts", "<u4"), read("sizes", "<u2"), list(map(np.cumsum, read("ids", "<i8")))
        of = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        row, start, size, doc = (np.concatenate(x) for x in (rows, starts, sizes, ids))
        data = np.frombuffer(b"".join(x for x, r in zip(cells["data"], rows) if len(r)) + bytes(WIDTH + 8), np.uint8)
        at = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(size) else size
        lost = [[] for _ in rows]
        if len(size):
            stretch, window = repeats(data, at, size, doc)
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(stretch) != 0) | (np.diff(window) != 1)])) if len(stretch) else stretch
            end = np.append(begin[1:], len(stretch)) - 1 if len(stretch) else stretch
            bounds = np.searchsorted(of[stretch[begin]], np.arange(len(rows) + 1))
            for b in range(len(rows)):
                mine = slice(bounds[b], bounds[b + 1])
                s, lo, hi = stretch[begin[mine]], window[begin[mine]], window[end[mine]]
                lost[b] = np.column_stack([row[s], start[s] + lo, start[s] + hi + WIDTH]).astype("<u4").tobytes() if len(s) else b""
        return pa.table({"batch": table.column("batch"), "gone": pa.array([_squeeze((x or b"") + y) for x, y in zip(lost, cells["gone"])], pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = ordered(table)
        data, offsets = textcode.text_bytes(texts)
        mark = np.zeros(len(data) + 1, np.int32)
        gone = np.frombuffer(b"".join(map(_expand, answers.column("gone").to_pylist())), "<u4").astype(np.int64).reshape(-1, 3) if answers.num_rows else np.zeros((0, 3), np.int64)
        np.add.at(mark, offsets[gone[:, 0]] + gone[:, 1], 1)
        np.add.at(mark, offsets[gone[:, 0]] + gone[:, 2], -1)
        drop = np.cumsum(mark[:-1]) > 0
        kept = [data[a:b][~drop[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        sizes = np.diff(offsets)
        runs = [int(np.count_nonzero(np.diff(np.concatenate([[0], drop[a:b].view(np.int8)])) == 1)) for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.table(
            {
                "doc_id": pa.array([None if x == _NO_ID else x for x in ids.tolist()], pa.int64()),
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_removed": pa.array([s - len(k) for s, k in zip(sizes.tolist(), kept)], pa.int64()),
                "n_spans": pa.array(runs, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    answers = exchange.tell(batches, n, keys_of, KEY_BITS, totals=False)
    names = ["part bigint", "batch bigint", *(f"{k} binary" for k in ("rows", "starts", "sizes", "ids", "data", "gone"))]
    sent = exchange.joined(batches, answers, send, ", ".join(names))
    back = sent.groupBy("part").applyInArrow(resolve, "batch bigint, gone binary")
    return exchange.joined(batches, back, finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
