"""N-gram Jaccard join: documents whose sets of word n-grams overlap by at least a given share.

Method. The incidence matrix A of distinct documents by n-grams is stored sparsely and cut into blocks of
n-gram columns; the join asks for the large entries of A times its transpose, where an entry is an overlap.
Bounds derived from set sizes discard pairs before the product is formed: a document with n n-grams needs
an overlap of ceil(t * n), so one with fewer columns in common with anyone has no partner, and of two
linked documents with their columns in one order, rare ones first, one of the first r - ceil(t * n) + 1 of
r shared columns is common. Pairs that meet there and pass the bounds on sizes, places and parities (see
_bounded) are the product's mask. Under it the product is taken block by block: each block of columns adds
the overlap of the two rows in it, the sums over all blocks are the overlaps, and pairs below the bound go.

Identity. Documents with equal sets collapse first. A word is known by a 128-bit hash, an n-gram by a
128-bit hash of those, of which 96 bits travel beside its block; a block numbers its columns, so all
later steps use exact numbers. A set is known by 128 bits, whose first half names it unless two sets
share that half (set_names finds out).

Size. Of most documents few columns are shared, so a sample of columns (by hash, twice the share that linked
documents may differ in) is met first: a document with more columns of its own there than ceil(t * n) leaves
can't reach the bound with anyone, and only the others bring all their columns (_live_texts). Blocks are cut by the counted number of entries. N-grams of very many documents (hot ones, counted
in a first pass; their number is bounded by entries / hot_from) are ordered last and pass by the blocks.
In a column each document is first compared with one pivot; components of those links follow; only
documents of one column in different components are compared after that, in tiles of bounded size, so a
column of many unlike documents is many tasks of equal work. No link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, stored, unused
from .components import connected_components
from .textblocks import U64, Words, mix, shingle_sets, slices

#: Entries of a block, and those that a task collects before it writes its part of the blocks.
BLOCK_ENTRIES, FLUSH_ENTRIES = 1_000_000, 1_000_000
#: An n-gram is hot from so many sets on, at least; in large inputs from a millionth of all entries on.
HOT_FROM = 20_000
#: Times that an n-gram occurs in a slice to be counted as a candidate for a hot one.
HOT_IN_SLICE = 3
#: Percent in which linked documents may differ up to which a sample of columns comes first; beyond it would hold most columns.
MOST_APART = 25
#: Documents of a tile whose pairs come before all others.
SMALL_TILE = 32
#: Texts that may be broadcast.
MOST_BROADCAST = 300_000
#: Parts of a row in the masked product, 64-bit words of its parity vector, documents of a tile.
PARTS, PARITY, TILE = 8, 8, 2_048

ENTRY = np.dtype([("node", np.int64), ("g", np.int64), ("n", np.int32), ("rank", np.uint8)])
NEED = np.dtype([("node", np.int64), ("need", np.int32)])
#: Numbers of hot columns begin here, above those of all blocks.
HOT_IDS = 1 << 62


def _signatures(d: np.ndarray, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set of n-grams, in two halves."""
    ends, out = np.cumsum(n), []
    for h, seed in ((high, 0xA5A5_1234_77E1_0F0F), (low, 0x3C6E_F372_FE94_F82B)):
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(mix(h ^ U64(seed)), out=total[1:])
        out.append(mix(total[ends] - total[ends - n] + n.astype(U64)).view(np.int64))
    return out[0], out[1]


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """(counted, doc_id, n_shingles, k1, k2, t1, t2) of each document, k1 and k2 being its set's signature, null if
    it is empty, t1 and t2 its text's hash; and with counted true, n-grams (k1, k2) that a slice of texts has n_shingles times."""
    names = ["counted", "doc_id", "n_shingles", "k1", "k2", "t1", "t2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                d, high, low, n = shingle_sets(Words(part.column("text"), lower=True), k)
                k1, k2 = _signatures(d, high, low, n)
                none = n == 0
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), bool)), part.column("doc_id"), pa.array(n), pa.array(k1, mask=none), pa.array(k2, mask=none), part.column("t1"), part.column("t2")], names)
                _, firsts = np.unique(k1, return_index=True)
                one = np.zeros(len(n), bool)
                one[firsts] = True
                high, low = high[one[d]], low[one[d]]
                order = np.argsort(high)
                high, low = high[order], low[order]
                starts = np.flatnonzero(np.append(np.ones(min(1, len(high)), bool), high[1:] != high[:-1]))
                times = np.diff(np.append(starts, len(high)))
                often = starts[times >= HOT_IN_SLICE]
                empty = pa.nulls(len(often), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(often), bool)), empty, pa.array(times[times >= HOT_IN_SLICE]), pa.array(high[often].view(np.int64)), pa.array(low[often].view(np.int64)), empty, empty], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_text_hash()).mapInArrow(run, "counted boolean, doc_id long, n_shingles long, k1 long, k2 long, t1 long, t2 long")


def _text_hash() -> tuple[Column, Column]:
    return F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")


def set_names(sets: DataFrame) -> np.ndarray:
    """First halves of signatures that different sets share: such sets are named by the second half.

    Few are expected in any corpus (three at 10 billion sets); more than 10,000 is an error.
    """
    clash = sets.where("k1 is not null").groupBy("k1").agg(F.min("k2").alias("lo"), F.max("k2").alias("hi")).where("lo != hi").select("k1").limit(10_001).collect()
    if len(clash) > 10_000:
        raise RuntimeError("too many sets share half a signature")
    return np.array(sorted(r["k1"] for r in clash), np.int64)


def _named(k1: np.ndarray, k2: np.ndarray, clash: np.ndarray) -> np.ndarray:
    return np.where(np.isin(k1, clash), k2, k1) if len(clash) else k1


def _pack(keys: np.ndarray, parts: list[np.ndarray], most: int = 8 << 20) -> Iterator[tuple[list[int], list[bytes]]]:
    """(keys, payloads) in bounded lots: for every run of equal keys the bytes of the parts side by side."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    ids, out, size = [], [], 0
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        if b > a:
            ids.append(int(keys[a]))
            out.append(np.array([b - a], np.int64).tobytes() + b"".join(p[a:b].tobytes() for p in parts))
            size += len(out[-1])
        if size > most:
            yield ids, out
            ids, out, size = [], [], 0
    if ids:
        yield ids, out


def _planes(x: np.ndarray) -> bytes:
    """Small numbers byte by byte, first bytes first, so that the zeros compress."""
    return x.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(buf: pa.Buffer, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(buf, np.uint8, 4 * n, at).reshape(4, n).T).view(np.int32).ravel()


def _column_blocks(docs: DataFrame, k: int, blocks: int, clash: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray], percent: int = 0) -> DataFrame:
    """(block, payload): entries of the incidence matrix by block of columns, packed: the documents of the
    block (name, set size, number of entries) and their n-grams. Blocks below 0 are blocks of rows, with
    the entries of hot columns (hot: both halves, sorted by the first, and the place in the order).

    With percent only a sample of columns, hot ones not included, and in the blocks of rows how many of
    its sampled columns a document has to share with others if it is to reach the bound."""
    hot_high, hot_low, hot_place = hot

    def is_hot(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(hot_high):
            return np.zeros(len(high), bool), np.zeros(len(high), np.int64)
        at = np.minimum(np.searchsorted(hot_high, high), len(hot_high) - 1)
        return (hot_high[at] == high) & (hot_low[at] == low), at

    def batch_of(ids: list[int], out: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(out, pa.binary())], ["block", "payload"])

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *(len(p[3]) for p in parts)])
        d = np.concatenate([p[0] + b for p, b in zip(parts, base, strict=False)])
        high, low, node, n = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
        yes, at = is_hot(high, low)
        if percent:
            d, high, low = d[~yes], high[~yes], low[~yes]
            own = np.zeros(len(node), NEED)
            own["node"], own["need"] = node, np.bincount(d, minlength=len(node)) - (n - -(-percent * n // 100))
            to = _row_block(node, blocks)
            order = np.argsort(to, kind="stable")
            for ids, out in _pack(-1 - to[order], [own[order]]):
                yield batch_of(ids, [x[8:] for x in out])
        elif yes.any():
            own = np.zeros(int(yes.sum()), ENTRY)
            own["node"], own["n"], own["g"], own["rank"] = node[d[yes]], n[d[yes]], HOT_IDS + hot_place[at[yes]], 255
            to = _row_block(own["node"], blocks)
            order = np.argsort(to, kind="stable")
            for ids, out in _pack(-1 - to[order], [own[order]]):
                yield batch_of(ids, [x[8:] for x in out])
            d, high, low = d[~yes], high[~yes], low[~yes]
        block = (high % U64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        d, high, low, block = d[order], high[order], low[order], block[order]
        cuts = np.flatnonzero(np.diff(block)) + 1
        ids, out = [], []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            if b == a:
                continue
            starts = np.append(a, a + 1 + np.flatnonzero(d[a + 1 : b] != d[a : b - 1]))
            used = d[starts]
            ids.append(int(block[a]))
            out.append(np.array([len(used), b - a], np.int64).tobytes() + node[used].tobytes() + _planes(n[used]) + _planes(np.diff(np.append(starts, b))) + high[a:b].tobytes() + low[a:b].astype(np.uint32).tobytes())
            if sum(map(len, out)) > 8 << 20:
                yield batch_of(ids, out)
                ids, out = [], []
        if ids:
            yield batch_of(ids, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, known = [], 0, set()
        for batch in batches:
            for part in slices(batch):
                d, high, low, n = shingle_sets(Words(part.column("text"), lower=True), k)
                node = _named(*_signatures(d, high, low, n), clash)
                _, firsts = np.unique(node, return_index=True)
                fresh = np.zeros(len(n), bool)
                fresh[[i for i in firsts if n[i] and node[i] not in known]] = True
                known.update(node[fresh].tolist())
                take = fresh[d] & (low % U64(256) < U64(_sampled(percent))) if percent else fresh[d]
                parts.append(((np.cumsum(fresh) - 1)[d[take]], high[take], low[take], node[fresh], n[fresh]))
                held += int(take.sum())
                if held >= FLUSH_ENTRIES:
                    yield from flush(parts)
                    parts, held, known = [], 0, set()
        if parts:
            yield from flush(parts)

    return docs.select("text").mapInArrow(run, "block int, payload binary")


def _sampled(percent: int) -> int:
    """256ths of the columns that are sampled: twice the share in which linked documents may differ."""
    return 512 * (100 - percent) // 100 + 1


def _row_block(node: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(node.view(U64)) % U64(blocks)).astype(np.int64)


def _unpack(payload: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """(first half, 32 more bits, name, set size) of every entry of a block."""
    parts = []
    for x in payload:
        buf = x.as_buffer()
        docs, m = (int(i) for i in np.frombuffer(buf, np.int64, 2))
        node, n = np.frombuffer(buf, np.int64, docs, 16), _unplaned(buf, docs, 16 + 8 * docs)
        each = _unplaned(buf, docs, 16 + 12 * docs)
        at = 16 + 16 * docs
        parts.append((np.frombuffer(buf, U64, m, at), np.frombuffer(buf, np.uint32, m, at + 8 * m), np.repeat(node, each), np.repeat(n, each)))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def _shared_columns(payload: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """(column number, name, set size, documents of the column) of each entry of a block's shared columns."""
    high, low, node, n = _unpack(payload)
    order = np.argsort(high)
    same = high[order][1:] == high[order][:-1]
    many = np.zeros(len(high), bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    high, low, node, n = high[many], low[many], node[many], n[many]
    order = np.lexsort((node, low, high))
    high, low, node, n = high[order], low[order], node[order], n[order]
    column = np.append(np.ones(min(1, len(high)), bool), (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
    fresh = column.copy()  # copies in other tasks gave the same entry
    fresh[1:] |= node[1:] != node[:-1]
    column, node, n = np.cumsum(column)[fresh], node[fresh], n[fresh]
    df = np.bincount(column)[column] if len(column) else column
    keep = df > 1
    return column[keep], node[keep], n[keep], df[keep]


def _shared_entries(cut: DataFrame, rows: int) -> DataFrame:
    """(rows_block, payload): entries of columns that two or more documents share, by block of rows."""
    schema = pa.schema([("rows_block", pa.int32()), ("payload", pa.binary())])

    def run(key: tuple, tab: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # hot columns
            return pa.table([pa.array(np.full(len(tab), -1 - key[0].as_py(), np.int32)), tab.column("payload")], schema=schema)
        column, node, n, df = _shared_columns(tab.column("payload"))
        out = np.zeros(len(node), ENTRY)
        out["g"], out["node"], out["n"] = (key[0].as_py() << 32) + column, node, n
        out["rank"] = np.minimum(254, 8 * np.log2(df)).astype(np.uint8)
        to = _row_block(out["node"], rows)
        order = np.argsort(to, kind="stable")
        ids, lots = [], []
        for i, x in _pack(to[order], [out[order]]):
            ids += i
            lots += [y[8:] for y in x]
        return pa.table([pa.array(ids, pa.int32()), pa.array(lots, pa.binary())], schema=schema)

    return cut.groupBy("block").applyInArrow(run, "rows_block int, payload binary")


def _live(cut: DataFrame) -> DataFrame:
    """(node): the sets that share as many of their sampled columns as they have to."""

    def run(key: tuple, tab: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            x = np.concatenate([np.frombuffer(p.as_buffer(), NEED) for p in tab.column("payload")])
            return pa.table({"node": pa.array(x["node"]), "found": pa.array(np.zeros(len(x), np.int64)), "need": pa.array(x["need"].astype(np.int64))})
        node, found = np.unique(_shared_columns(tab.column("payload"))[1], return_counts=True)
        return pa.table({"node": pa.array(node, pa.int64()), "found": pa.array(found.astype(np.int64)), "need": pa.nulls(len(node), pa.int64())})

    met = cut.groupBy("block").applyInArrow(run, "node long, found long, need long")
    return met.groupBy("node").agg(F.sum("found").alias("found"), F.max("need").alias("need")).where("found >= need").select("node")


def _live_texts(docs: DataFrame, members: DataFrame, live: DataFrame) -> tuple[DataFrame, int]:
    """(texts of docs, one for each live set but for its copies; the number of entries of the live sets)."""
    chosen = members.join(live, "node").groupBy("node").agg(F.min(F.struct("t1", "t2")).alias("t"), F.max("n_shingles").alias("n"))
    chosen = materialize(chosen.select("t.*", "n"), "live")
    texts, entries = chosen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    chosen = chosen.select("t1", "t2")
    return docs.select("text", *_text_hash()).join(F.broadcast(chosen) if texts <= MOST_BROADCAST else chosen, ["t1", "t2"], "left_semi").select("text"), entries


def _candidate_rows(shared: DataFrame, percent: int) -> DataFrame:
    """(node, n, r, prefix, parity, parts): rows that can reach the bound, with r columns.

    prefix: its columns that a partner has to meet, from rare to frequent; parity: for each of
    64 * PARITY hash buckets, is the number of the row's columns in it odd? parts: the columns by part.
    """

    def run(tab: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(p.as_buffer(), ENTRY) for p in tab.column("payload")])
        _, start, r = np.unique(x["node"], return_inverse=True, return_counts=True)
        x = x[r[start] >= -(-percent * x["n"].astype(np.int64) // 100)]
        x = x[np.lexsort((x["g"], x["rank"], x["node"]))]
        nodes, at, r = np.unique(x["node"], return_index=True, return_counts=True)
        n = x["n"][at].astype(np.int64)
        ahead = r - (-(-percent * n // 100)) + 1
        row = np.repeat(np.arange(len(nodes)), r)
        place = np.arange(len(x)) - np.repeat(at, r)
        prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ahead)), pa.int32()), pa.array(x["g"][place < np.repeat(ahead, r)]))
        hashed = mix(x["g"].view(U64))
        odd = np.bincount(row * (64 * PARITY) + (hashed % U64(64 * PARITY)).astype(np.int64), minlength=len(nodes) * 64 * PARITY) & 1
        parity = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(odd.astype(np.uint8)).view(np.int64)), PARITY).cast(pa.list_(pa.int64()))
        part = row * PARTS + ((hashed >> U64(32)) % U64(PARTS)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(part, minlength=len(nodes) * PARTS))), pa.int32()), pa.array(x["g"][order]))
        parts = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * PARTS, pa.int32()), inner)
        return pa.table({"node": pa.array(nodes), "n": pa.array(n), "r": pa.array(r.astype(np.int64)), "prefix": prefix, "parity": parity, "parts": parts})

    return shared.groupBy("rows_block").applyInArrow(run, "node long, n long, r long, prefix array<long>, parity array<long>, parts array<array<long>>")


def _bounded(percent: int):
    """Keeps pairs whose sizes, places in the common column and parities leave the overlap possible.

    Columns of one row only, and every odd difference of a parity bucket, are in one row and not the
    other, so they bound the size of the symmetric difference from below.
    """
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    most = F.least(F.col("r_a") - F.col("pos_a"), F.col("r_b") - F.col("pos_b"))
    apart = F.col("n_a") - F.col("r_a") + F.col("n_b") - F.col("r_b")
    for i in range(PARITY):
        apart = apart + F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i]))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sizes & (most >= need) & (apart <= F.col("n_a") + F.col("n_b") - 2 * need)


def _side(side: str, *more: str) -> list:
    names = {"node": side, **{c: f"{c}_{side}" for c in ("n", "r", "pos", "parity", *more)}}
    return [F.col(c).alias(a) for c, a in names.items()]


def _product(mask: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, overlap) of the pairs of the mask that reach the bound: overlaps summed over the column parts."""
    parts = rows.select("node", "n", F.posexplode("parts").alias("part", "items")).where(F.size("items") > 0)
    side = lambda s: parts.select(F.col("node").alias(s), "part", F.col("n").alias(f"n_{s}"), F.col("items").alias(f"items_{s}"))
    met = mask.join(side("a"), "a").join(side("b"), ["b", "part"])
    summed = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("overlap")).groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return summed.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b", "overlap")


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80, block_entries: int = BLOCK_ENTRIES, hot_from: int = HOT_FROM, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(membership, components) of the join.

    membership: (doc_id, n_shingles, node) for every row of docs; documents with equal sets share a
    node, one with an empty set has none. components: (node, comp) for nodes with a link to another,
    comp being the component's smallest node.
    """
    spark = docs.sparkSession
    sets = materialize(document_sets(docs, k), "sets")
    members = sets.where("not counted").select("doc_id", "n_shingles", "k1", "k2", "t1", "t2")
    entries = members.agg(F.sum("n_shingles")).first()[0] or 0
    clash = set_names(members)
    blocks = max(1, -(-entries // block_entries))
    hot_from = max(hot_from, entries // 1_000_000)
    common = sets.where("counted").groupBy("k1", "k2").agg(F.sum("n_shingles").alias("c")).where(F.col("c") >= hot_from)
    common = sorted((r["k1"] % (1 << 64), r["k2"] % (1 << 64), r["c"]) for r in common.collect())  # entries / hot_from rows at most
    place = np.argsort(np.argsort([c for _, _, c in common], kind="stable"), kind="stable")
    hot = tuple(np.array([r[i] for r in common], U64) for i in (0, 1)) + (np.asarray(place, np.int64),)

    name = F.col("k1")
    if len(clash):
        name = F.when(F.col("k1").isin(clash.tolist()), F.col("k2")).otherwise(name)
    members = members.withColumn("node", name)
    if blocks > 1 and 100 - percent <= MOST_APART:
        sample = _column_blocks(docs, k, max(1, blocks * _sampled(percent) // 256), clash, hot, percent)
        docs, entries = _live_texts(docs, members, _live(sample))
        blocks = max(1, -(-entries // block_entries))

    blocked, path = stored(_candidate_rows(_shared_entries(_column_blocks(docs, k, blocks, clash, hot), blocks), percent), "rows")
    rows = blocked
    posts = rows.select("node", "n", "r", "parity", F.posexplode("prefix").alias("pos", "g"))

    # each document of a column against the column's pivot
    pivot = posts.groupBy("g").agg(F.min_by(F.struct("node", "n", "r", "pos", "parity"), F.xxhash64("node", "g")).alias("p"), F.count("*").alias("docs")).where("docs > 1")
    pivot = pivot.select("g", "p.*").select("g", *_side("b"))
    stars = posts.select("g", *_side("a")).join(pivot, "g").where((F.col("a") != F.col("b")) & _bounded(percent))
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialize(_product(stars, rows, percent), "stars")

    # then the documents of small tiles of a column among themselves, which is linear in them: most of a large group's links lie between
    # documents of one component after it
    def tiled(of: DataFrame, size: int) -> DataFrame:
        mixed = of.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("docs")).where("lo != hi")
        mixed = mixed.select("g", F.ceil(F.col("docs") / size).cast("int").alias("tiles"))
        return of.join(mixed, "g").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def apart(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where((F.col("comp_a") != F.col("comp_b")) & _bounded(percent))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    classed = lambda: posts.join(connected_components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    few = tiled(classed(), min(tile, SMALL_TILE))
    met = few.select("g", "tile", *_side("a", "comp")).join(few.select("g", "tile", *_side("b", "comp")), ["g", "tile"]).where("a < b")
    links = links.unionByName(materialize(_product(apart(met), rows, percent), "near"))

    # what is left: pairs of a column in different components, tile by tile
    open_ = tiled(classed(), tile)
    left = open_.select("g", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"), *_side("a", "comp"))
    right = open_.select("g", F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"), *_side("b", "comp"))
    once = (F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))
    rest = apart(left.join(right, ["g", "i", "j"]).where(once))
    second = materialize(_product(rest, rows, percent), "rest")
    discard(spark, path)
    return members.select("doc_id", "n_shingles", "node"), connected_components(links.unionByName(second))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, **size) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text, any others).

    component_id is the smallest doc_id that links reach, the document's own included. Two documents
    link when 100 * overlap >= percent * union of their sets of k-word shingles (words lower-cased
    A-Z, cut at the six ASCII white-space characters). Null or blank text: empty set, no link. Rows
    that repeat a doc_id are classed row by row, each by its own text. A row with a null doc_id
    takes part in links; its component_id is null if it reaches no doc_id. Texts of any length count
    whole; an empty table gives an empty one. Extra columns are ignored, whatever their names.
    """
    members, comps = jaccard_links(docs, k, percent, **size)
    members = members.join(comps, "node", "left").withColumn("class", F.coalesce("comp", "node"))
    per = members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    out = members.join(per, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; one of each group stays.

    Rows with a null doc_id stay. Of rows that repeat a doc_id all stay or go together. All columns stay.
    """
    (gone,) = unused(docs, "gone")
    copies = near_duplicates(docs, k, percent).where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(copies, F.col("doc_id") == F.col(gone), "left_anti")
