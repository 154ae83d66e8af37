"""Alignment of two tokenizers over a corpus: byte-level BPE (A) against pieces with byte fallback (B).

Both encode a space and the text. Byte offsets at which tokens of both end cut the two sequences into
groups; the two tokens that end there are linked. A pair of ids counts as often as the corpus links it.

Method. First pass: every document is encoded once by both, and the ids are written to the shared folder.
The distinct pairs are numbered by a minimal perfect hash (perfect_hash); every task counts its links in
a dense vector by that number, and the vectors are summed in a tree, blocks of numbers apart. Second pass:
the documents are aligned again from their ids and look up the counts; a key is verified before its count
is read.

Bounds. Of two linked tokens one is the end of the other, as both end at one byte. So there are at most as
many distinct pairs as the tokens of both vocabularies have bytes (some 500,000 here), whatever the corpus: this
bounds the hash, the vectors, what reaches the driver (24 bytes a pair) and what goes back to the tasks. The
tree takes FAN vectors of a block at a time. Texts go through in slices of a few MB.

Edges. Texts that are null, empty, or that one of the two does not give back byte for byte (U+2581 in
the text) have no tokens: zeros and ''. Special tokens' own strings are plain text. Repeated rows count
each time and stay rows of their own; a null doc_id is kept. Only doc_id and text are read, so other columns do
not matter. An empty table gives an empty one; long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, Memo, _content, _gather
from .common import materialize
from .perfect_hash import PerfectHash
from .textblocks import raw, slices

#: Counts in a block of a task's vector, and blocks that a step of the tree adds up.
BLOCK, FAN = 1 << 15, 16
#: Bytes that a task encodes or aligns at once.
SLICE = 1 << 20
#: The character that pieces have for a space.
MARK = "▁"
FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Pieces:
    """Encoder of a sentence-piece BPE model with byte fallback, by cuts that no piece spans.

    No piece has a space after another character, so a text may be cut before every space that
    follows one; equal fragments of a slice are encoded once.
    """

    def __init__(self, content: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        ids = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in ids]
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("pieces that hold a space after another character are not supported")
        plain = lambda i: not (self.model.is_control(i) or self.model.is_unknown(i))
        parts = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() if plain(i) else b"" for i, p in zip(ids, names, strict=True)]
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.token_len = np.array([len(p) for p in parts], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.space, self.memo = self.model.piece_to_id(MARK), Memo()

    def _fresh(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode([f[1:].decode() for f in fragments], num_threads=1)  # the model puts the first space back
        got = [x or [self.space] for x in got]
        lens = np.array([len(x) for x in got], np.int64)
        return np.fromiter((i for x in got for i in x), np.int32, int(lens.sum())), lens

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts that begin with a space."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        cut = np.zeros(n + 1, bool)
        cut[1:n] = (data[1:] == 32) & (data[:-1] != 32)
        cut[offs] = True
        starts = np.flatnonzero(cut[:n])
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = whole.dictionary_encode()
        own = coded.dictionary
        where = self.memo.find(own)
        hit, new = np.flatnonzero(where >= 0), np.flatnonzero(where < 0)
        at, lens, base = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), len(self.memo.flat)
        lens[hit] = self.memo.lens[where[hit]]
        at[hit] = (np.cumsum(self.memo.lens) - self.memo.lens)[where[hit]]
        flats = [self.memo.flat]
        if len(new):
            fresh = own.take(pa.array(new))
            flat, lens[new] = self._fresh(fresh.to_pylist())
            at[new] = base + np.cumsum(lens[new]) - lens[new]
            flats.append(flat)
            self.memo.add(fresh, flat, lens[new])
        slot = coded.indices.to_numpy()
        ids, ends = _gather(np.concatenate(flats), at[slot], lens[slot])
        return ids, np.append(0, ends)[np.searchsorted(starts, offs)]


@lru_cache(maxsize=2)
def _both(a: bytes, b: bytes) -> tuple[Codec, Pieces]:
    """Encoders of a Python worker; the special tokens of A are plain text."""
    first = Codec(a)
    first.special = {}
    return first, Pieces(b)


def _spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a space and the text for each text, nothing for an empty one."""
    data, offs = raw(column)
    some = np.diff(offs) > 0
    return np.insert(data, offs[:-1][some], 32), offs + np.append(0, np.cumsum(some))


def _same(c: Codec | Pieces, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Do the tokens of each text join to its bytes?"""
    got, ends = _gather(c.token_bytes, c.token_at[ids], c.token_len[ids])
    where = np.append(0, ends)[at]
    if len(got) == len(data) and (where == offs).all() and (got == data).all():
        return np.ones(len(offs) - 1, bool)
    return np.array([got[x:y].tobytes() == data[s:e].tobytes() for x, y, s, e in zip(where[:-1], where[1:], offs[:-1], offs[1:], strict=True)], bool)


def _packed(ids: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Ids of each text as one binary value, four bytes an id or two where they suffice."""
    flat = np.ascontiguousarray(ids)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(data[int(offs[0]) : int(offs[-1])], kind) if data is not None and offs[-1] > offs[0] else np.zeros(0, kind)
    return flat.astype(np.int64), (offs - offs[0]) // size


def encode_both(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a, b): packed ids of every whole text under both tokenizers, empty where there are none."""
    a, b = _content(path_a), _content(path_b)
    kind = _kind(path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _both(a, b)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                data, offs = _spaced(part.column("text"))
                x, x_at = one.encode(data, offs)
                y, y_at = two.encode(data, offs)
                good = _same(one, x, x_at, data, offs) & _same(two, y, y_at, data, offs)
                if not good.all():
                    x, x_at = _only(x, x_at, good)
                    y, y_at = _only(y, y_at, good)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _packed(x.astype(kind), x_at), _packed(y.astype(kind), y_at)], ["doc_id", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, a binary, b binary")


def _only(ids: np.ndarray, offs: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = np.diff(offs)
    return ids[np.repeat(good, lens)], np.append(0, np.cumsum(lens * good))


@lru_cache(maxsize=4)
def _kind(path_a: str, path_b: str) -> str:
    one, two = _both(_content(path_a), _content(path_b))
    return "<u2" if max(len(one.token_len), len(two.token_len)) <= 1 << 16 else "<i4"


class Aligned:
    """Links of a block of documents: the tokens of both that end at one byte."""

    def __init__(self, part: pa.RecordBatch, kind: str, a_len: np.ndarray, b_len: np.ndarray) -> None:
        self.a, self.a_at = _unpacked(part.column("a"), kind)
        self.b, self.b_at = _unpacked(part.column("b"), kind)
        a_end, b_end = np.cumsum(a_len[self.a]), np.cumsum(b_len[self.b])
        n = int(a_end[-1]) if len(a_end) else 0
        ends = np.zeros(n + 1, bool)
        ends[b_end] = True
        self.a_last = np.flatnonzero(ends[a_end])  # the linked tokens, in order
        ends[:] = False
        ends[a_end] = True
        self.b_last = np.flatnonzero(ends[b_end])
        self.pair = self.a[self.a_last] << 20 | self.b[self.b_last]
        self.link_at = np.searchsorted(self.a_last, self.a_at)  # first link of each document

    def text(self, digits: np.ndarray, digit_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of `a1,a2|b1;a3|b2,b3` for each document, with a semicolon after it."""
        group_a = np.searchsorted(self.a_last, np.arange(len(self.a)))
        group_b = np.searchsorted(self.b_last, np.arange(len(self.b)))
        b_before, a_upto = np.append(0, self.b_last + 1), self.a_last + 1
        at_a, at_b = np.arange(len(self.a)) + b_before[group_a], np.arange(len(self.b)) + a_upto[group_b]
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[at_a[self.a_last]], mark[at_b[self.b_last]] = ord("|"), ord(";")
        lens = digit_len[ids]
        ends = np.cumsum(lens)
        out = digits[ids][np.arange(digits.shape[1]) < lens[:, None]]
        out[ends - 1] = mark
        return out, np.append(0, ends)[self.a_at + self.b_at]


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    texts = [str(i).encode() + b"," for i in range(n)]
    width = max(map(len, texts))
    return np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(n, width), np.array([len(t) for t in texts], np.int64)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return slices(batch, "a", SLICE)


class Alignment:
    """Both tokenizers over a corpus that is encoded once (the ids stay in the shared folder)."""

    def __init__(self, docs: DataFrame, path_a: str, path_b: str) -> None:
        self.spark = docs.sparkSession
        one, two = _both(_content(path_a), _content(path_b))
        self.kind, self.a_len, self.b_len = _kind(path_a, path_b), one.token_len, two.token_len
        self.encoded = materialize(encode_both(docs, path_a, path_b), "aligned")
        self.most_pairs = int(self.a_len.sum() + self.b_len.sum())

    def _each(self, body, schema: str) -> DataFrame:
        """body(iterator of Aligned) gives record batches, in each task."""
        kind, a_len, b_len = self.kind, self.a_len, self.b_len

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from body((part, Aligned(part, kind, a_len, b_len)) for batch in batches for part in _blocks(batch))

        return self.encoded.mapInArrow(run, schema)

    def distinct_pairs(self) -> DataFrame:
        """(pair): a << 20 | b for every pair of ids that is linked somewhere."""

        def body(parts) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(0, np.int64)
            for _, x in parts:
                seen = pd.unique(np.concatenate([seen, pd.unique(x.pair)]))
            yield pa.RecordBatch.from_arrays([pa.array(seen)], ["pair"])

        return self._each(body, "pair long").distinct()

    def hash_pairs(self) -> PerfectHash:
        """The perfect hash of the distinct pairs; most_pairs bounds what reaches the driver."""
        keys = np.asarray(self.distinct_pairs().toArrow().column("pair").to_numpy(), np.int64)
        if len(keys) > self.most_pairs:
            raise RuntimeError("more linked pairs than tokens have ends")
        return PerfectHash(keys)

    def counts(self, numbers: PerfectHash) -> np.ndarray:
        """Links of each pair by its number: dense vectors of the tasks, summed in a tree."""
        size = len(numbers)
        if not size:
            return np.zeros(0, np.int64)
        shared = self.spark.sparkContext.broadcast(numbers)

        def body(parts) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(size, np.int64)
            for _, x in parts:
                at = shared.value(x.pair)
                if (at < 0).any():
                    raise RuntimeError("a pair that the first pass did not see")
                total += np.bincount(at, minlength=size)
            starts = range(0, size, BLOCK)
            task = TaskContext.get().partitionId()
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(starts), pa.int64()), pa.array(list(starts), pa.int64()), pa.array([total[s : s + BLOCK].tobytes() for s in starts], pa.binary())], ["part", "start", "sums"])

        def add(table: pa.Table) -> pa.Table:
            rows = table.column("sums").to_pylist()
            total = np.frombuffer(rows[0], np.int64).copy()
            for r in rows[1:]:
                total += np.frombuffer(r, np.int64)
            return pa.table({"part": [table.column("part")[0].as_py() // FAN], "start": [table.column("start")[0].as_py()], "sums": pa.array([total.tobytes()], pa.binary())})

        schema = "part long, start long, sums binary"
        level, parts = self._each(body, schema), self.encoded.rdd.getNumPartitions()
        while parts > 1:
            level = level.groupBy(F.floor(F.col("part") / FAN).alias("_p"), "start").applyInArrow(add, schema)
            parts = -(-parts // FAN)
        out = np.zeros(size, np.int64)
        for r in level.toLocalIterator():
            out[r["start"] : r["start"] + len(r["sums"]) // 8] += np.frombuffer(r["sums"], np.int64)
        shared.unpersist()
        return out

    def pair_counts(self) -> DataFrame:
        """(a_id, b_id, n): how often the corpus links each pair."""
        numbers = self.hash_pairs()
        n = self.counts(numbers)
        table = pa.table({"a_id": (numbers.keys >> 20).astype(np.int32), "b_id": (numbers.keys & 0xFFFFF).astype(np.int32), "n": n})
        return self.spark.createDataFrame(table)

    def documents(self, groups: bool = False) -> DataFrame:
        """The contract's numbers for each document; groups adds the aligned groups themselves."""
        numbers = self.hash_pairs()
        n = self.counts(numbers)
        best = np.zeros(len(self.b_len), np.int64)
        np.maximum.at(best, numbers.keys & 0xFFFFF, n)
        shared = self.spark.sparkContext.broadcast((numbers, n, n == best[numbers.keys & 0xFFFFF]))
        size = max(len(self.a_len), len(self.b_len))

        def body(parts) -> Iterator[pa.RecordBatch]:
            digits, digit_len = _digits(size)
            of, counts, is_best = shared.value
            for part, x in parts:
                at = of(x.pair)
                if (at < 0).any():
                    raise RuntimeError("a pair that the first pass did not see")
                upto = lambda v: np.diff(np.append(0, np.cumsum(v.astype(np.int64)))[x.link_at])  # noqa: B023, E731
                text, text_at = x.text(digits, digit_len)
                own = [text[s : max(s, e - 1)].tobytes() for s, e in zip(text_at[:-1], text_at[1:], strict=True)]
                links = np.diff(x.link_at)
                cols = [part.column("doc_id"), *map(pa.array, (np.diff(x.a_at), np.diff(x.b_at), links, links, upto(is_best[at]), upto(counts[at]))), pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in own], pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array([t.decode() for t in own], pa.string())] * groups)], [*FIELDS, "groups_sha256", *(["groups"] * groups)])

        schema = f"doc_id {dict(self.encoded.dtypes)['doc_id']}, " + ", ".join(f"{f} long" for f in FIELDS[1:]) + ", groups_sha256 string" + ", groups string" * groups
        return self._each(body, schema)


def align(docs: DataFrame, path_a: str, path_b: str, groups: bool = False) -> DataFrame:
    """For each document (doc_id, text): numbers of its tokens, groups and links under both tokenizers, n_best (links
    whose pair is the most frequent one of its B id, ties included), count_sum (over its links) and the
    digest of its groups; with groups=True the groups as well, as `a1,a2|b1;a3|b2,b3`."""
    return Alignment(docs, path_a, path_b).documents(groups)
