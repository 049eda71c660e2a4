"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is halved down to leaves of at most LEAF characters; every longer text is put together by joins. A leaf is encoded alone; two
neighbours are joined by re-encoding a window around their border and keeping the ids outside it.
The window grows, to both sides, until it starts and ends where a non-space character is followed by
white space. No match of the split pattern holds such a pair (it is one optional space before
non-spaces, or white space only), and matching looks at nothing to its left, so every encoding of the
text has a border there and the ids outside the window are final. If a side has no such place the
window takes all of that side. Decoding concatenates the bytes of the tokens up the same tree.

Null and empty texts give no ids. Repeated rows give equal rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAF = 128
WINDOW = 32


class TreeCodec:
    """Ranks and split pattern, with the tree reductions for encoding and decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        self.leaf, self.window = leaf, window
        library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._merge, self.piece = library.encode_ordinary, library._encode_single_piece  # piece: the ids of one match
        self._bytes = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text)) if text else []

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self._merge(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        start, end = self._stable_before(text, lo, mid), self._stable_after(text, mid, hi)
        redone = self._merge(text[start:end])
        cut_left = len(self._merge(text[start:mid]))
        cut_right = len(self._merge(text[mid:end]))
        return left[: len(left) - cut_left] + redone + right[cut_right:]

    def _stable_before(self, text: str, lo: int, mid: int) -> int:
        size = self.window
        while mid - size > lo:
            if p := next((p for p in range(mid - size + 1, mid) if _border(text, p)), 0):
                return p
            size *= 2
        return lo

    def _stable_after(self, text: str, mid: int, hi: int) -> int:
        size = self.window
        while mid + size < hi:
            if p := next((p for p in range(mid + size - 1, mid, -1) if _border(text, p)), 0):
                return p
            size *= 2
        return hi

    def decode(self, ids: list[int]) -> bytes:
        parts = [b"".join(map(self._bytes.__getitem__, ids[i : i + self.leaf])) for i in range(0, len(ids), self.leaf)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def _border(text: str, p: int) -> bool:
    """Surely white space after surely none, whichever engine's notion of white space holds."""
    return text[p] in " \t\n\r" and not text[p - 1].isspace()


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> TreeCodec:
    """One codec for each worker process; the file is part of the installed tokenizer package on every node."""
    with open(rank_file, "rb") as f:
        return TreeCodec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def ids_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ids (array<int>) and decoded (binary) of each row's text."""
    return _apply(docs, rank_file, pattern, text, keep, "ids array<int>, decoded binary", _full)


def digests(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens, ids_sha256 and decoded_sha256; ids do not leave the task."""
    return _apply(docs, rank_file, pattern, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _full(c: TreeCodec, texts: list[str | None]) -> list[pa.Array]:
    ids = [c.encode(t or "") for t in texts]
    return [pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.binary())]


def _digest(c: TreeCodec, texts: list[str | None]) -> list[pa.Array]:
    rows = []
    for t in texts:
        ids = c.encode(t or "")
        rows.append((len(ids), hashlib.sha256(ids_bytes(ids)).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
    n, i, d = zip(*rows, strict=True) if rows else ((), (), ())
    return [pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())]


def _apply(docs, rank_file, pattern, text, keep, columns, rows) -> DataFrame:
    given = docs.select(*keep, docs[text].cast("string").alias("text_to_encode"))

    def run(batches):
        c = codec(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                arrays = part.columns[:-1] + rows(c, part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    schema = f"{kept}, {columns}"
    names = [*given.columns[:-1], *[c.split()[0] for c in columns.split(", ")]]
    return given.mapInArrow(run, schema)
