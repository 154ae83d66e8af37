"""Token-id shards in training order.

Method. Documents become token ids, packed one after another into sequences of a fixed number of ids
(an end id after each document, no padding but in a task's last sequence). Every sequence has a
dense number; a keyed Feistel permutation over the smallest rectangle of that many cells, walked along
its cycle until it falls below the number of sequences, gives it a slot of the training order. Sequences are range
partitioned by slot and each shard is one file of fixed stride, so slot s is at byte
(s % shard_sequences) * stride of shard s // shard_sequences: reads are sequential and can resume
anywhere. The manifest has every sequence's documents and true length.

Scale. A first pass only counts ids: it leaves one row for each task, (task, its sequences, checksum of
its texts), from which the driver gives every task its first number. The second pass makes the ids
and sends each sequence once, by shard, to the task that writes it. So no copy of the ids is kept on
the way. The input has to give the same rows in the same tasks both times, as a table does; the second
pass compares checksums and fails rather than write shards that miss a row. A shard is written in the
task that holds its slots, under a name that depends on the shard alone, by writing a temporary file
and moving it: a task that runs twice gives the same file.

Nulls and edges: a null or empty text has no ids; null doc_ids stay as nulls in the lists; repeated
rows are packed each; a text of any length runs over as many sequences as it needs; an empty table gives
no shard. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import materialize, shared_dir
from .textblocks import raw, slices

ROUNDS = 6
#: Steps of the cycle walk. The rectangle has at most a third more cells than sequences (and about 1 / sqrt(n)
#: more for n sequences), so a number that needs more is not met: 3 ** -64 is the chance at worst.
WALK = 64
#: Tasks that write shards, at most; each writes its shards one after another.
WRITERS = 20_000


def slot_of(number: Column, total: int, key: str) -> Column:
    """Slot of a sequence number below total: a keyed permutation of 0 .. total - 1."""
    wide = max(1, math.isqrt(max(total, 1) - 1) + 1)
    high = max(1, -(-total // wide))

    def once(x: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            mask = lambda half, mod: F.pmod(F.xxhash64(F.lit(key), i, half), F.lit(mod))
            even = F.struct(F.pmod(s["l"] + mask(s["r"], high), F.lit(high)).alias("l"), s["r"].alias("r"))
            odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + mask(s["l"], wide), F.lit(wide)).alias("r"))
            return F.when(i % 2 == 0, even).otherwise(odd)

        start = F.struct(F.call_function("div", x, F.lit(wide)).alias("l"), F.pmod(x, F.lit(wide)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * wide + s["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(number.cast("long")), lambda x, _: F.when(x < total, x).otherwise(once(x)))
    return F.when(walk < total, walk).otherwise(F.raise_error(F.lit("cycle walk too long")))


class Packer:
    """Packs a task's documents into sequences of ids; only the task's last sequence may be short.

    Documents follow one another, each with the id `end` after it. Texts without ids leave nothing.
    """

    def __init__(self, content: bytes, sequence: int, dtype: str, end: int) -> None:
        self.codec, self.sequence, self.dtype, self.end = codec(content), sequence, np.dtype(dtype), end
        self.names: list = []  # of the documents of rest
        self.rest, self.rest_docs = np.zeros(0, dtype), np.zeros(0, np.int64)
        self.number, self.seen = 0, xxhash.xxh64()

    def add(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list, int]:
        """(ids, document of each, documents' names, full sequences) with this slice; a cut-off rest is kept."""
        data, at = raw(part.column("text"))
        self.seen.update(at.tobytes())
        self.seen.update(data)
        ids, offs = self.codec.encode(data, at)
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError(f"token ids don't fit {self.dtype}")
        lens = np.diff(offs)
        some = np.flatnonzero(lens)
        flat = np.insert(ids.astype(self.dtype), offs[1:][some], self.end)
        owner = np.repeat(np.arange(len(some)), lens[some] + 1) + len(self.names)
        names = self.names + part.column("doc_id").take(pa.array(some)).to_pylist()
        flat, owner = np.concatenate([self.rest, flat]), np.concatenate([self.rest_docs, owner])
        n = len(flat) // self.sequence
        low = int(owner[n * self.sequence]) if len(flat) > n * self.sequence else len(names)
        self.rest, self.rest_docs, self.names = flat[n * self.sequence :], owner[n * self.sequence :] - low, names[low:]
        return flat, owner, names, n

    def rows(self, flat: np.ndarray, owner: np.ndarray, names: list, n: int) -> pa.RecordBatch:
        """The first n sequences: their place in the task, documents and ids as little-endian bytes."""
        cut = np.arange(n + 1) * self.sequence
        cut[-1] = min(cut[-1], len(flat))
        new = np.ones(cut[-1], bool)
        new[1:] = owner[1 : cut[-1]] != owner[: cut[-1] - 1]
        new[cut[:-1]] = True
        at = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, cut), pa.int32()), pa.array(names, pa.int64()).take(pa.array(owner[at])))
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cut.astype(np.int64) * self.dtype.itemsize), pa.py_buffer(np.ascontiguousarray(flat[: cut[-1]]))])
        place = pa.array(np.arange(self.number, self.number + n))
        self.number += n
        return pa.RecordBatch.from_arrays([place, lists, data.cast(pa.binary())], ["number", "doc_ids", "tokens"])


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def task_counts(docs: DataFrame, path: str, sequence: int) -> DataFrame:
    """(task, sequences, checksum) for every task that reads docs: how its documents would be packed."""
    content = _content(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, ids, seen = codec(content), 0, xxhash.xxh64()
        for batch in batches:
            for part in slices(batch):
                data, offs = raw(part.column("text"))
                seen.update(offs.tobytes())
                seen.update(data)
                counts = c.count(data, offs)
                ids += int(counts.sum()) + int(np.count_nonzero(counts))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([-(-ids // sequence)], pa.int64()), pa.array([seen.intdigest()], pa.uint64()).view(pa.int64())], ["task", "sequences", "checksum"])

    return _texts(docs).mapInArrow(run, "task long, sequences long, checksum long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def numbered(docs: DataFrame, path: str, sequence: int, dtype: str, end: int) -> tuple[DataFrame, int]:
    """(number, doc_ids, tokens) of all sequences, number being dense from 0, and how many there are.

    What reaches the driver is one short row for each task.
    """
    content, first, total = _content(path), {}, 0
    for r in sorted(task_counts(docs, path, sequence).collect()):  # a row for each task
        first[r["task"]] = (total, r["checksum"])
        total += r["sequences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Packer(content, sequence, dtype, end)
        p.number, checksum = first.get(TaskContext.get().partitionId(), (0, None))
        for batch in batches:
            for part in slices(batch):
                *packed, n = p.add(part)
                if n:
                    yield p.rows(*packed, n)
        if len(p.rest):
            yield p.rows(p.rest, p.rest_docs, p.names, 1)
        if p.seen.intdigest() != (checksum or 0) % (1 << 64) and not (checksum is None and p.number == 0):
            raise RuntimeError("the documents came in another order than when they were counted: write them to a table first")

    return _texts(docs).mapInArrow(run, "number long, doc_ids array<long>, tokens binary"), total


def write_shards(docs: DataFrame, path: str, key: str, out: str | None = None, sequence: int = 1024, shard_sequences: int = 4096, dtype: str = "uint16", end: int = 50256) -> DataFrame:
    """Write all shards and return the manifest.

    Manifest: (slot, doc_ids, shard, byte_offset, n_tokens, checksum), one row for each sequence,
    checksum being the 64-bit xxHash of its bytes without padding, as written. The files are <out>/shard-<number>.bin;
    out is a folder that all executors can reach (by default a new one in the shared folder).
    """
    spark = docs.sparkSession
    width = np.dtype(dtype).itemsize
    stride = width * sequence
    out = out or f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    rows, total = numbered(docs, path, sequence, dtype, end)
    shards = max(1, -(-total // shard_sequences))
    each = -(-shards // WRITERS)  # consecutive shards of one task
    rows = rows.select(slot_of(F.col("number"), max(total, 1), key).alias("slot"), "doc_ids", "tokens").withColumn("shard", F.call_function("div", F.col("slot"), F.lit(shard_sequences)))
    # the ranges of slots are known, so nothing has to be sampled for them
    ordered = rows.repartitionById(-(-shards // each), F.call_function("div", F.col("shard"), F.lit(each)).cast("int")).sortWithinPartitions("slot")
    filler = np.full(sequence, end, dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(out)
        now, half, f = None, "", None

        def close() -> None:
            if f is not None:
                f.close()
                files.move(half, f"{root}/shard-{now:08d}.bin")

        for batch in batches:
            if not batch.num_rows:
                continue
            got = batch.column("tokens").to_pylist()
            for s, t in zip(batch.column("shard").to_pylist(), got, strict=True):
                if s != now:
                    close()
                    files.create_dir(root, recursive=True)
                    now, half = s, f"{root}/.{uuid.uuid4().hex}"
                    f = files.open_output_stream(half)
                f.write(t)
                f.write(filler[len(t) :])
            slot = batch.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("slot"), batch.column("doc_ids"), batch.column("shard"),
                    pa.array((slot % shard_sequences) * stride), pa.array(np.array([len(t) // width for t in got], np.int64)),
                    pa.array([xxhash.xxh64_intdigest(t) for t in got], pa.uint64()).view(pa.int64()),
                ],
                ["slot", "doc_ids", "shard", "byte_offset", "n_tokens", "checksum"],
            )
        close()

    manifest = ordered.mapInArrow(run, "slot long, doc_ids array<long>, shard long, byte_offset long, n_tokens long, checksum long")
    return materialize(manifest, "manifest")


def read_shard(out: str, shard: int, first: int = 0, count: int | None = None, sequence: int = 1024, dtype: str = "uint16") -> np.ndarray:
    """Sequences of one shard as a matrix, from row `first` on: how a trainer resumes."""
    files, root = fs.FileSystem.from_uri(out)
    stride = np.dtype(dtype).itemsize * sequence
    with files.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
        size = f.size() // stride
        n = size - first if count is None else min(count, size - first)
        f.seek(first * stride)
        return np.frombuffer(f.read(n * stride), dtype).reshape(n, sequence)
