"""Repeated passages by sparse suffix arrays.

Method. Of all suffixes (one for each word) only those at minimiser positions stay: in each window of
w k-grams the leftmost with the smallest hash, so the choice depends on content alone, and two equal
passages of w + k - 1 words hold the same retained suffix at the same place. A retained suffix whose k-gram
occurs once can't be part of a repeat and goes. The others are sorted: buckets are ranges of their order,
which begins with a hash of the first k words and goes on word by word. In a bucket neighbours are
compared for the length of the match to the right; the same suffixes sorted by what stands before them
give the matches to the left. A window of w + k - 1 words that starts i words before its suffix occurs again
where another suffix matches i words to the left and the rest to the right: both orders have those in one
run, whatever stands between in either order alone. Windows that repeat join to maximal passages.

Size. Equal texts are compared once, by a 128-bit hash of the text; a copied text of enough words is one
passage as a whole. Suffixes with all the same words around them (an extent: all windows anchored there, by a
128-bit hash) are sorted once. Buckets are cut by the counted number of extents. A k-gram with more than
`most_suffixes` different extents would fill a bucket: its suffixes are split by their longer context, both
sides at once, as grouped windows (_by_windows), which Spark aggregates in parts.

Words are runs of bytes other than the six ASCII white-space characters and are compared by their bytes
in the buckets. Null or short texts hold no passage; texts of any length are read whole; an empty table
gives none. A null doc_id is a document of its own; repeated rows are copies. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, stored, unused
from .textblocks import U64, Words, chain, slices

LEAST_WORDS, K = 50, 16
#: Extents of a bucket; extents of one k-gram from which it is split further; texts and extents that a task remembers.
BUCKET_EXTENTS, MOST_SUFFIXES, REMEMBERED = 10_000, 5_000, 500_000
#: Hot k-grams that may be broadcast.
MOST_BROADCAST = 300_000


def _leftmost(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, where the leftmost of its smallest is: by windows of twice the width, again and again."""
    at, w = np.arange(len(values), dtype=np.int32), 1
    while w < width:
        step = min(w, width - w)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        w += step
    return at


def _anchors(words: Words, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows of `least` words inside one text, word at which each is anchored, hash of every k-gram)."""
    n = len(words.codes)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.arange(n - k + 1)
    grams = chain(words.half(0), at, np.full(len(at), k), k)
    low = _leftmost(grams, least - k + 1)
    start = np.arange(len(low))
    inside = start + least <= words.first[1:][words.doc_of()[start]]
    return start[inside], low[inside].astype(np.int64), grams


def _local(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, word index inside the text) of word positions."""
    doc = words.doc_of()[at]
    return doc, at - words.first[:-1][doc]


def _suffixes(keyed: DataFrame, k: int, least: int) -> DataFrame:
    """(gram, k1, k2, p): the retained suffixes, of equal texts that a task meets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for batch in batches:
            for part in slices(batch):
                names = list(zip(part.column("k1").to_pylist(), part.column("k2").to_pylist(), strict=True))
                fresh = [i for i, x in enumerate(names) if x not in known and not known.add(x)]
                if len(known) > REMEMBERED:
                    known.clear()
                part = part.take(pa.array(fresh, pa.int64()))
                words = Words(part.column("text"))
                _, anchor, grams = _anchors(words, k, least)
                at = np.unique(anchor)
                doc, p = _local(words, at)
                k1, k2 = (part.column(c).to_numpy()[doc] for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(k1), pa.array(k2), pa.array(p.astype(np.int32))], ["gram", "k1", "k2", "p"])

    return keyed.select("k1", "k2", "text").mapInArrow(run, "gram long, k1 long, k2 long, p int")


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] of every span, as binary values."""
    lens = ends - starts
    bounds = np.append(0, np.cumsum(lens))
    at = np.repeat(starts - bounds[:-1], lens)
    at += np.arange(bounds[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(bounds), pa.py_buffer(data[at])])


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(the words with one space after each, where each begins and the end)."""
    lens = words.ends - words.starts + 1
    bounds = np.append(0, np.cumsum(lens))
    at = np.repeat(words.starts - bounds[:-1], lens) + np.arange(bounds[-1])
    out = np.append(words.data, np.uint8(32))[np.minimum(at, len(words.data))]
    out[bounds[1:] - 1] = 32
    return out, bounds


def _extents(marked: DataFrame, k: int, least: int) -> DataFrame:
    """(k1, k2, doc, s0, e1, e2, ahead, n, gram, content): for each repeated suffix the n windows anchored there.

    marked: (k1, k2, doc, text, at), at being the places of the text's repeated suffixes. s0 is the first
    window's start, ahead the words from there to the suffix, content the words of all windows (null where the
    task has given it already), (e1, e2) the extent's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for part in slices(batch):
                words = Words(part.column("text"))
                start, anchor, grams = _anchors(words, k, least)
                if not len(start):
                    continue
                at = part.column("at")
                rows = np.repeat(np.arange(len(at)), np.asarray(at.value_lengths().fill_null(0)))
                chosen = np.zeros(len(words.codes) + 1, bool)
                chosen[words.first[:-1][rows] + at.flatten().to_numpy()] = True
                start, anchor = start[chosen[anchor]], anchor[chosen[anchor]]
                runs = np.flatnonzero(np.append(np.ones(min(1, len(anchor)), bool), anchor[1:] != anchor[:-1]))
                ends = np.append(runs[1:], len(anchor))[: len(runs)]
                s, e, a = start[runs], start[ends - 1] + least, anchor[runs]
                data, bounds = _spaced(words)
                content = _gather(data, bounds[s], bounds[e])
                coded = content.dictionary_encode()
                # the suffix's place is part of the extent: the same words with other windows anchored are another one
                digests = [xxhash.xxh3_128_digest(x) for x in coded.dictionary.to_pylist()]
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)[coded.indices.to_numpy()]
                e1, e2 = halves[:, 0] ^ ((a - s) * np.int64(0x5851F42D4C957F2D)), halves[:, 1]
                names = list(zip(e1.tolist(), e2.tolist(), strict=True))
                told = np.array([x in known or bool(known.add(x)) for x in names], bool)
                if len(known) > REMEMBERED:
                    known.clear()
                content = pa.array(content.to_pylist(), pa.binary(), mask=told) if told.any() else content.cast(pa.binary())
                doc, s0 = _local(words, s)
                columns = [part.column(c).take(pa.array(doc)) for c in ("k1", "k2", "doc")]
                small = lambda x: pa.array(x.astype(np.int32))
                gram = pa.array(grams[a].view(np.int64))
                del words, data, coded, digests, halves, grams
                yield pa.RecordBatch.from_arrays([*columns, small(s0), pa.array(e1), pa.array(e2), small(a - s), small(ends - runs), gram, content], ["k1", "k2", "doc", "s0", "e1", "e2", "ahead", "n", "gram", "content"])

    return marked.select("k1", "k2", "doc", "text", "at").mapInArrow(run, "k1 long, k2 long, doc long, s0 int, e1 long, e2 long, ahead int, n int, gram long, content binary")


def _order(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted order of the rows, number of equal first columns of neighbours)."""
    width = m.shape[1]
    order = np.argsort(np.ascontiguousarray(m, ">u4").view(f"S{4 * width}").ravel(), kind="stable")
    same = m[order[1:]] == m[order[:-1]]
    return order, np.where(same.all(axis=1), width, same.argmin(axis=1))


def _runs(order: np.ndarray, match: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the run of rows that are equal in the first `depth` columns."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.append(0, np.cumsum(match < depth))[: len(order)]
    return out


def _bucket(gram: str, buckets: int) -> Column:
    """Ranges of the order by a hash of the first k words: not that by which minimisers are chosen, as they are the
    smallest of `least` - k + 1 hashes each, and the first range would hold as many times its share."""
    return F.call_function("div", F.shiftrightunsigned(F.xxhash64(gram), 33), F.lit(-(-(1 << 31) // buckets)))


_FOUND = "e1 long, e2 long, wins array<struct<off:int,again:boolean,doc:long,pos:int>>"


def _by_suffixes(extents: DataFrame, k: int, least: int, firsts: bool) -> DataFrame:
    """(e1, e2, wins): the windows of each extent, by their place in it, that occur in another one too; with
    firsts all windows, and the first place (doc, pos) at which each occurs.

    extents: (bucket, e1, e2, ahead, n, content, doc, pos), (doc, pos) being the extent's first place.
    """
    wins = pa.list_(pa.struct([("off", pa.int32()), ("again", pa.bool_()), ("doc", pa.int64()), ("pos", pa.int32())]))

    def run(tab: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what the groups before left
        a, n = (tab.column(c).to_numpy().astype(np.int64) for c in ("ahead", "n"))
        words = Words(tab.column("content").combine_chunks().cast(pa.string()))
        codes, suffix, low = words.codes + np.int32(1), words.first[:-1] + a, a - n + 1
        # the words from the suffix on and, backwards, those before it; 0 where the extent ends
        j = np.arange(least)
        right = np.where(j < (least - low)[:, None], codes[np.minimum(suffix[:, None] + j, len(codes) - 1)], np.int32(0))
        j = np.arange(max(1, least - k))
        left = np.where(j < a[:, None], codes[np.maximum(suffix[:, None] - 1 - j, 0)], np.int32(0))
        by_right, by_left = _order(right), _order(left)
        doc, pos = tab.column("doc").combine_chunks(), tab.column("pos").to_numpy()
        rank = np.asarray(doc.fill_null(-(1 << 63)))
        found = []
        for i in range(int(a.max(initial=0)) + 1):  # windows that start i words before the suffix
            some = np.flatnonzero((low <= i) & (i <= a))
            if not len(some):
                continue
            key = _runs(*by_left, i)[some] * len(a) + _runs(*by_right, least - i)[some]
            _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
            again, off = times[inverse] > 1, a[some] - i
            first = some
            if firsts:
                order = np.lexsort((pos[some] + off, rank[some], inverse))
                start = np.flatnonzero(np.append(True, np.diff(inverse[order]) != 0))
                head = order[start][inverse]
                first, first_pos = some[head], pos[some[head]] + off[head]
            else:
                some, off, first, first_pos = some[again], off[again], some[again], pos[some[again]]
                again = again[again]
            found.append((some, off, again, first, first_pos))
        some, off, again, first, first_pos = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(5))
        order = np.argsort(some, kind="stable")
        rows, counts = np.unique(some, return_counts=True)
        flat = pa.StructArray.from_arrays([pa.array(off[order].astype(np.int32)), pa.array(again[order].astype(bool)), doc.take(pa.array(first[order])), pa.array(first_pos[order].astype(np.int32))], fields=list(wins.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), flat)
        e1, e2 = (tab.column(c).combine_chunks().take(pa.array(rows)) for c in ("e1", "e2"))
        return pa.table({"e1": e1, "e2": e2, "wins": lists})

    return extents.groupBy("bucket").applyInArrow(run, _FOUND)


def _by_windows(extents: DataFrame, least: int, firsts: bool) -> DataFrame:
    """The same for k-grams of very many extents: windows are grouped by 128-bit hashes of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                words = Words(part.column("content").cast(pa.string()))
                n = part.column("n").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = words.first[:-1][row] + off
                w = [chain(words.half(i), start, np.full(len(start), least), least).view(np.int64) for i in (0, 1)]
                kept = [part.column(c).take(pa.array(row)) for c in ("e1", "e2", "doc")]
                pos = part.column("pos").to_numpy()[row] + off
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pos.astype(np.int32)), pa.array(off.astype(np.int32)), *map(pa.array, w)], ["e1", "e2", "doc", "pos", "off", "w1", "w2"])

    windows = materialize(extents.select("e1", "e2", "n", "content", "doc", "pos").mapInArrow(run, "e1 long, e2 long, doc long, pos int, off int, w1 long, w2 long"), "windows")
    own = F.xxhash64("e1", "e2", "off")
    classes = windows.groupBy("w1", "w2").agg((F.min(own) != F.max(own)).alias("again"), F.min(F.struct("doc", "pos")).alias("first"))
    classes = materialize(classes if firsts else classes.where("again"), "classes")
    win = F.struct("off", "again", F.col("first.doc").alias("doc"), F.col("first.pos").alias("pos"))
    return windows.join(classes, ["w1", "w2"]).groupBy("e1", "e2").agg(F.collect_list(win).alias("wins"))


def _merge(starts: Column, least: int) -> Column:
    """Sorted window starts to an array of (start_word, end_word)."""
    none = F.array().cast("array<struct<start_word:int,end_word:int>>")
    zero = F.struct(none.alias("done"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    span = lambda s: F.array(F.struct(s["a"].alias("start_word"), s["b"].alias("end_word")))

    def step(s: Column, x: Column) -> Column:
        grown = F.struct(s["done"].alias("done"), s["a"].alias("a"), (x + least).alias("b"))
        fresh = F.struct(F.when(s["a"] < 0, s["done"]).otherwise(F.concat(s["done"], span(s))).alias("done"), x.alias("a"), (x + least).alias("b"))
        return F.when((s["a"] >= 0) & (x <= s["b"]), grown).otherwise(fresh)

    return F.aggregate(starts, zero, step, lambda s: F.concat(s["done"], span(s)))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.where(text.isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))


def _text_spans(keyed: DataFrame, least: int, k: int, later_only: bool, bucket_extents: int, most_suffixes: int) -> DataFrame:
    """(k1, k2, spans): the maximal passages of each distinct text, as a written table; with later_only of
    windows that have an earlier place, by the text's smallest doc_id (nulls first) and the word."""
    spark = keyed.sparkSession
    suffixes, suffixes_at = stored(_suffixes(keyed, k, least), "suffixes")
    place = F.xxhash64("k1", "k2", "p")
    grams = materialize(suffixes.groupBy("gram").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("gram"), "grams")
    again = suffixes.join(grams, "gram").groupBy("k1", "k2").agg(F.collect_set("p").alias("at"))
    texts = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.first("text").alias("text"))
    rows, rows_at = stored(_extents(texts.join(again, ["k1", "k2"]), k, least), "extents")
    discard(spark, suffixes_at)

    place = F.struct("doc", "s0")
    grouped = rows.groupBy("e1", "e2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("places"), F.max("content").alias("content"), *[F.first(c).alias(c) for c in ("ahead", "n", "gram")])
    extents, extents_at = stored(grouped.select("e1", "e2", "ahead", "n", "gram", "content", F.col("lo.doc").alias("doc"), F.col("lo.s0").alias("pos"), (F.col("places") > 1).alias("whole")), "distinct")
    sizes = extents.groupBy("gram").agg(F.count("*").alias("size"))
    hot = materialize(sizes.where(F.col("size") > most_suffixes).select("gram"), "hot")
    n_hot = hot.count()
    chosen = F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot
    buckets = max(1, -(-extents.count() // bucket_extents))
    plain = extents.join(chosen, "gram", "left_anti") if n_hot else extents
    found = _by_suffixes(plain.withColumn("bucket", _bucket("gram", buckets)), k, least, later_only)
    if n_hot:
        found = found.unionByName(_by_windows(extents.join(chosen, "gram", "left_semi"), least, later_only))
    found = extents.select("e1", "e2", "whole").join(found, ["e1", "e2"], "left").where("whole or wins is not null")
    found, found_at = stored(found, "found")
    places = rows.select("k1", "k2", "doc", "s0", "n", "e1", "e2").join(found, ["e1", "e2"])
    if later_only:
        first = lambda w: w["doc"].eqNullSafe(F.col("doc")) & (w["pos"] == F.col("s0") + w["off"])
        starts = F.transform(F.filter("wins", lambda w: ~first(w)), lambda w: F.col("s0") + w["off"])
    else:
        starts = F.when(F.col("whole"), F.sequence(F.col("s0"), F.col("s0") + F.col("n") - 1)).otherwise(F.transform("wins", lambda w: F.col("s0") + w["off"]))
    spans = places.select("k1", "k2", starts.alias("starts")).where(F.size("starts") > 0).groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))
    spans = materialize(spans.select("k1", "k2", _merge(F.col("starts"), least).alias("spans")), "spans")
    for at in (rows_at, extents_at, found_at):
        discard(spark, at)
    return spans


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, k: int = K, bucket_extents: int = BUCKET_EXTENTS, most_suffixes: int = MOST_SUFFIXES) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the maximal runs of words of each document of which
    every window of least_words words occurs again, in this or another document."""
    keyed = _keyed(docs)
    spans = _text_spans(keyed, least_words, k, False, bucket_extents, most_suffixes)
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    copies = materialize(keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    out = keyed.select("doc_id", "k1", "k2", n.alias("n")).join(copies, ["k1", "k2"], "left").join(spans, ["k1", "k2"], "left")
    whole = F.array(F.struct(F.lit(0).alias("start_word"), F.col("n").alias("end_word")))
    out = out.select("doc_id", F.explode(F.when((F.col("copies") > 1) & (F.col("n") >= least_words), whole).otherwise(F.col("spans"))).alias("s"))
    return out.select("doc_id", "s.start_word", "s.end_word", (F.col("s.end_word") - F.col("s.start_word")).alias("n_words"))


def _without(docs: DataFrame, spans: str) -> DataFrame:
    """docs with the words of the spans (start_word, end_word) out of their texts, and the white space after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, texts = Words(part.column("text")), part.column("text").to_pylist()
                for i, cuts in enumerate(part.column(spans).to_pylist()):
                    if not cuts:
                        continue
                    at = np.append(words.starts[words.first[i] : words.first[i + 1]], words.offs[i + 1]) - words.offs[i]
                    raw, left, last = texts[i].encode(), [], 0
                    for c in cuts:
                        left.append(raw[last : at[c["start_word"]]])
                        last = at[min(c["end_word"], len(at) - 1)]
                    texts[i] = b"".join([*left, raw[last:]]).decode()
                columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def keep_first(docs: DataFrame, least_words: int = LEAST_WORDS, k: int = K, bucket_extents: int = BUCKET_EXTENTS, most_suffixes: int = MOST_SUFFIXES) -> DataFrame:
    """docs without repeated passages but for the first copy of each.

    Of a window of least_words words the first place stays, by doc_id (null first) and place in the text;
    every word that only later places cover goes, with the white space after it. Of equal texts of
    least_words words or more the one with the smallest doc_id stays, and the others become empty. All
    rows and columns stay; n_chars, if docs has it, follows the text. Rows that repeat doc_id and text are alike.
    """
    spans_, one, k1, k2 = unused(docs, "spans", "one", "k1", "k2")
    keyed = _keyed(docs)
    spans = _text_spans(keyed, least_words, k, True, bucket_extents, most_suffixes).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans_))
    firsts = materialize(keyed.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.struct(F.min(F.struct("doc_id")).alias("doc")).alias(one)), "firsts")
    text = F.col("text")
    out = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit("second"), text)}).join(spans, [k1, k2], "left").join(firsts, [k1, k2], "left")
    copy = ~F.col("doc_id").cast("long").eqNullSafe(F.col(f"{one}.doc.doc_id")) & (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= least_words)
    out = out.withColumn("text", F.when(copy, F.lit("")).otherwise(text)).withColumn(spans_, F.when(F.col("text") != "", F.col(spans_))).drop(k1, k2, one)
    out = _without(out, spans_).drop(spans_)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
