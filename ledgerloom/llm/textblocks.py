"""Vectorised word and shingle hashing over Arrow string columns.

Used inside mapInArrow tasks. Everything works on slices of a few MB of text, so the memory of a
task is bounded by the slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SLICE_BYTES = 3 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chain(words: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Hash of words[start:start + count] for every span of at most `most` words: each word is added to the
    mixed hash of those before it, so a hash depends on the order of the words in no simple way."""
    out = counts.astype(U64)
    last = max(0, len(words) - 1)
    for j in range(most):
        more = counts > j
        if more.all():
            out = mix(out + words[starts + j])
        elif more.any():
            out = np.where(more, mix(out + words[np.minimum(starts + j, last)]), out)
    return mix(out ^ U64(0x6A09E667F3BCC909))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text and at most 60,000 rows."""
    n = batch.num_rows
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    group = np.maximum((np.cumsum(sizes) - sizes) // most, np.arange(n) // 60_000)
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words of a slice of texts: byte spans, identities, and where each text's words begin.

    A word is a run of bytes other than the six ASCII white-space characters. Inside the slice `codes` are
    equal exactly where words are; across slices a word is known by its 128-bit hash, in two halves.
    """

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        data, offs = raw(column)
        if lower:
            data = LOWER[data]
        self.data, self.offs = data, offs
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.first = np.searchsorted(self.starts, offs)  # word index at which each text begins, with the end
        self.counts = np.diff(self.first)
        packed, bounds = data[inside[1:-1]], np.append(0, np.cumsum(self.ends - self.starts))
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
        coded = array.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
        self.halves = np.frombuffer(digests, U64).reshape(-1, 2)

    def half(self, i: int) -> np.ndarray:
        """One half of every word's hash."""
        return self.halves[self.codes, i] if len(self.codes) else np.zeros(0, U64)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles: (document index, two halves of a 128-bit hash) sorted by all, and the number for each document.

    A text of 1 to k - 1 words has its whole word sequence as its one shingle; an empty one has none.
    """
    n_docs, total = len(words.counts), len(words.codes)
    doc = words.doc_of()
    at = np.arange(total)
    last = words.first[1:][doc] if total else at
    keep = (at + k <= last) | ((at == words.first[:-1][doc]) if total else False)
    s = at[keep] if total else at
    d = doc[keep] if total else doc
    counts = np.minimum(k, last[keep] - s) if total else s
    high, low = (chain(words.half(i), s, counts, k) for i in (0, 1))
    order = np.argsort(high)
    order = order[np.argsort(d[order].astype(np.uint16 if n_docs <= 65_536 else np.int64), kind="stable")]
    d, high, low = d[order], high[order], low[order]
    same = (high[1:] == high[:-1]) & (d[1:] == d[:-1])
    if (low[1:][same] != low[:-1][same]).any():  # equal first halves of unequal shingles
        order = np.lexsort((low, high, d))
        d, high, low = d[order], high[order], low[order]
        same = (high[1:] == high[:-1]) & (d[1:] == d[:-1]) & (low[1:] == low[:-1])
    fresh = np.append(np.ones(min(1, len(d)), bool), ~same)
    d, high, low = d[fresh], high[fresh], low[fresh]
    return d, high, low, np.bincount(d, minlength=n_docs).astype(np.int64)
