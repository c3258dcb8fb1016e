"""Vectorised words and word-gram hashes over Arrow text batches.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
Hashes are polynomials modulo 2**64, taken from prefix sums, and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd multipliers; each gives an independent hash.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        have = _POWERS[base] = tuple(both)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[s:e] for each pair."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and offsets. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


class Words:
    """The words of a batch of texts: byte spans, 64-bit hashes and, for each text, the range of its words.

    space marks the bytes between words; fold, if given, maps each byte first.
    """

    def __init__(self, texts: pa.Array, space: np.ndarray = SPACE, fold: np.ndarray | None = None):
        self.data, self.offsets = text_bytes(texts)
        if fold is not None:
            self.data = fold[self.data]
        n = len(self.data)
        solid = ~space[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        return spans(self.data, self.starts, self.ends, base)

    def text_of(self) -> np.ndarray:
        """The index of the text that holds each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(hashes: np.ndarray, k: int, base: int = BASES[1]) -> np.ndarray:
    """Hashes of all runs of k words; runs across texts are for the caller to leave out."""
    at = np.arange(max(len(hashes) - k + 1, 0))
    return spans(hashes, at, at + k, base)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.asarray(_lengths(batch.column(column)), np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most)))
        yield batch.slice(at, end - at)
        at = end


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
