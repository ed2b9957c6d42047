"""Byte-level BPE encoding and decoding with a local rank file.

The vocabulary is never trained here: ranks come from a file whose path is a
parameter, and the tiktoken library merges the bytes. Long texts are cut where
no match of the pattern can reach across, and long runs of white space go to the
merger as the one match that they are, so that the ids are those of the uncut
text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import keyed_text

#: Texts above this many characters are cut before they are split by the pattern.
PIECE_CHARS = 1 << 15
#: Rows are sent back to the JVM once this many bytes of output have gathered.
FLUSH_BYTES = 4 << 20
#: White space as the pattern has it, a fixed value: it is not all that Python calls white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")

@lru_cache(maxsize=4)
def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _long_run(limit: int) -> re.Pattern:
    return re.compile(f"[{_SPACE}]{{{limit},}}")


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """(piece, whether it is one match of the pattern) of ``text``, in order.

    A piece ends between a character that isn't white space and white space:
    every alternative of the pattern takes white space, if any, before its other
    characters, none looks behind, and the only look-ahead asks whether white
    space is followed by more text, which such a cut never separates. So no
    match spans a cut. A run of ``limit`` white-space characters, which the
    regular expression would go back over one by one, is a match as it is; if
    text follows, its last character belongs to what follows. A stretch without
    white space stays whole.
    """
    start = 0
    if len(text) > limit:
        for run in _long_run(limit).finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            yield from _cut(text, start, run.start(), limit)
            yield text[run.start() : end], True
            start = end
    yield from _cut(text, start, len(text), limit)


def _cut(text: str, start: int, end: int, limit: int) -> Iterator[tuple[str, bool]]:
    while end - start > limit:
        cut = _CUT.search(text, start + limit - 1, end)
        if cut is None:
            break
        yield text[start : cut.end()], False
        start = cut.end()
    if start < end:
        yield text[start:end], False


def encode_text(encoding, text: str) -> np.ndarray:
    """Ids of one text, as little-endian unsigned 32-bit integers."""
    parts = [np.array(encoding._encode_single_piece(piece), "<u4") if whole else encoding.encode_to_numpy(piece, disallowed_special=()).astype("<u4", copy=False) for piece, whole in safe_pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "<u4")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ``ids`` holds 4 little-endian bytes for each id.

    A null or empty text has no tokens and empty ``ids``; rows with the same id
    or text each keep their row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern)
        for batch in batches:
            ids, out, size, first = batch.column(0), [], 0, 0
            for i, text in enumerate(batch.column(1)):
                out.append(encode_text(encoding, text.as_py()).tobytes())
                size += len(out[-1])
                if size >= FLUSH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(out)), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])
                    out, size, first = [], 0, i + 1

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): raw bytes again, whether or not they are whole UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern)
        for batch in batches:
            out, size, first = [], 0, 0
            for i, ids in enumerate(batch.column(2)):
                out.append(encoding.decode_bytes(np.frombuffer(ids.as_py() or b"", "<u4").tolist()))
                size += len(out[-1])
                if size >= FLUSH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(out)) for k in range(3)), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
                    out, size, first = [], 0, i + 1

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; counts and SHA-256 digests of both sides."""
    whole = decode(encode(docs, ranks_path, pattern, id_col, text_col), ranks_path, pattern)
    return whole.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
