"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging.

Method. Vectors are packed into tiles where they are read, queries into blocks. Each pair of a query block
and a tile is one bounded matrix product in a task, which keeps the k best of every query. The lists of a
query then merge as a tree: each level joins FAN_IN tiles, so a task never holds more than FAN_IN * k
entries of a query for each level.

Scale. Whole components are kept in the smallest integer type that holds a tile's values, else as
doubles. While all query blocks are at most `MOST_BROADCAST` bytes, by their counted size, they go to the
tiles and no vector is shuffled. Beyond that, blocks form groups of that size, and a tile is copied once
for each group. The work is that of the stated queries against all rows.

A component x counts as floor(scale * x) with x as double; the score is the integer inner product.
Products are taken in float64 while they are exact there (below 2**53), else in Python integers;
scores outside 64 bits are set to the nearest 64-bit value.

Nulls and edges: a vector that is null, empty, or holds a null or non-finite component takes no
part, nor does a row with a null id. Vectors of another length than the query's are no candidates.
Rows that repeat an id are vectors of their own, each a candidate for the queries of other ids; the
queries of a repeated id share one list, in which every pair of a query row and a candidate row counts.
Ties go to the smaller id. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

TILE_ROWS, QUERY_ROWS, FAN_IN = 4096, 1024, 16
#: Bytes of query blocks that may be broadcast, or that make up a group beyond that.
MOST_BROADCAST = 32 << 20
#: Query rows whose scores are looked at together.
STRIP = 128
LOW, HIGH = -(1 << 63), (1 << 63) - 1
_TYPES = ("int8", "int16", "int32", "float64")


def _bytes(m: np.ndarray) -> tuple[str, bytes]:
    """(type, bytes) of a matrix of whole doubles in the smallest of _TYPES."""
    top = float(np.abs(m).max(initial=0))
    kind = next((t for t in _TYPES[:3] if top <= np.iinfo(t).max), _TYPES[3])
    return kind, np.ascontiguousarray(m, kind).tobytes()


def _packed(vectors: DataFrame, most: int) -> DataFrame:
    """One row for at most `most` vectors of one length: dim, number, ids and matrix. Packed by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        held: dict[int, list] = {}

        def tile(dim: int, rows: list) -> pa.RecordBatch:
            nonlocal made
            ids, m = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            kind, data = _bytes(m)
            number = (TaskContext.get().partitionId() << 24) + made
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number]), pa.array([ids.tobytes()], pa.binary()), pa.array([kind]), pa.array([data], pa.binary())], ["dim", "number", "ids", "kind", "m"])

        for batch in batches:
            ids, dims = batch.column("id").to_numpy(), batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                m = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                for a in range(0, len(at), most):
                    rows = held.setdefault(dim, [])
                    rows.append((ids[at[a : a + most]], m[a : a + most]))
                    if sum(len(r[0]) for r in rows) >= most:
                        yield tile(dim, held.pop(dim))
        for dim, rows in held.items():
            yield tile(dim, rows)

    return vectors.select("id", "dim", "v").mapInArrow(run, "dim int, number long, ids binary, kind string, m binary")


def _matrix(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{name}_ids"], np.int64)
    return ids, np.frombuffer(row[f"{name}_m"], row[f"{name}_kind"]).reshape(len(ids), -1).astype(np.float64)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < 2.0**53:
        return (q @ v.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(q).dot(whole(v).T)
    return np.frompyfunc(lambda x: min(max(x, LOW), HIGH), 1, 1)(exact).astype(np.int64)


def _select(qi: np.ndarray, vi: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector id, score) of the k best of each row of s, the query's own id left out."""
    own = vi[None, :] == qi[:, None]
    if len(vi) > k:  # all that reach the k-th best of the others, ties included
        low = np.partition(np.where(own, LOW, s), len(vi) - k, axis=1)[:, len(vi) - k]
        r, c = np.nonzero((s >= low[:, None]) & ~own)
    else:
        r, c = np.nonzero(~own)
    score, vec = s[r, c], vi[c]
    order = np.lexsort((vec, ~score, r))
    r, score, vec = r[order], score[order], vec[order]
    starts = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    place = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
    keep = place < k
    return r[keep], vec[keep], score[keep]


def _best(pairs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (qi, q), (vi, v) = _matrix(row, "block"), _matrix(row, "tile")
                for a in range(0, len(qi), STRIP):
                    r, vec, score = _select(qi[a : a + STRIP], vi, _scores(q[a : a + STRIP], v), k)
                    yield pa.RecordBatch.from_arrays([pa.array(qi[a + r]), pa.array(np.full(len(r), row["tile"])), pa.array(vec), pa.array(score)], ["query_id", "tile", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, tile long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where is_query holds."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("is_query"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)

    def whole(x: Column) -> Column:  # floor() of a large double would leave 64 bits; it is whole as it is
        y = x * float(scale)
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    rows = rows.withColumn("v", F.transform("v", whole)).withColumn("dim", F.size("v"))
    named = lambda df, name: df.select("dim", F.col("number").alias(name), F.col("ids").alias(f"{name}_ids"), F.col("kind").alias(f"{name}_kind"), F.col("m").alias(f"{name}_m"))
    tiled = named(_packed(rows, TILE_ROWS), "tile")
    # few rows of each task are queries: they are gathered first, so that blocks are full
    chosen = rows.where("is_query").select("id", "dim", "v")
    asked = materialize(named(_packed(chosen.repartition("dim", F.pmod(F.xxhash64("id"), F.lit(64))), QUERY_ROWS), "block"), "queries")
    size = asked.agg(F.sum(F.length("block_m") + F.length("block_ids"))).first()[0] or 0
    if size <= most_broadcast:
        pairs = tiled.join(F.broadcast(asked), "dim")
    else:
        groups = -(-size // most_broadcast)
        asked = asked.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
        # the stated query blocks against all tiles, as an equi join on (dim, group)
        pairs = tiled.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1)))).join(asked, ["dim", "group"])
    lists = _best(pairs, k)
    entry = F.struct((-1 - F.col("score")).alias("s"), F.col("vec_id").alias("v"))  # -1 - s has no overflow
    best = F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("l")
    lists = lists.withColumn("tile", F.shiftright("tile", 24))  # the lists of one task's tiles are the tree's leaves
    for _ in range(3):  # 16 ** 3 tasks for each of the last lists
        lists = lists.groupBy("query_id", "tile").agg(best).select("query_id", F.call_function("div", F.col("tile"), F.lit(FAN_IN)).alias("tile"), F.explode("l").alias("e"))
        lists = lists.select("query_id", "tile", F.col("e.v").alias("vec_id"), (-1 - F.col("e.s")).alias("score"))
    merged = lists.groupBy("query_id").agg(best).select("query_id", F.posexplode("l").alias("place", "e"))
    return merged.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("e.v").alias("vec_id"), (-1 - F.col("e.s")).alias("score"))
