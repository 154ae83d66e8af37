"""Spelling variants: words of a corpus that differ by one code point, by a variable-length gram index.

Method. Grams of SHORT to LONG code points are counted over all words; a gram is in the dictionary if it has
the least length, or if the gram without its last code point occurs more often than a bound, so frequent grams
give way to longer ones and rare ones stay short. A word is decomposed into the longest dictionary gram at each
position, less those inside an earlier one. For each word the number of its grams that one edit can affect
is bounded (affected()); two words that are one edit apart share all grams but so many, in aligned places. Ordered
by rarity, the first `bound + 1` grams of both then share an aligned one: only those are listed, by gram, length
of the word and what stands on one side of the gram (the edit is on the other). Where lists meet, the overlap of all
grams has to reach the larger bound of the two (by 64-bit signatures, which never count too many grams as lacking), and the pair
is verified. Words whose bound exceeds their grams are compared among each other by the strings that one deletion leaves.

Bounds. The dictionary has at most 90^2 grams of the least length and, for each further length, 90 for every gram
above the bound; as the bound is total / FREQUENT, that is FREQUENT x 90 x (LONG - SHORT), whatever the corpus.
Words are counted in slices before the shuffle and are distinct after it, so no word is a hot key. A chain of
forms grows tenfold at each step, so it is followed by doubling in a handful of joins.

Edges. Null and empty texts have no words; a null doc_id is written as an empty one; repeated rows
count again; columns beside doc_id and text do not matter. An empty table gives an empty one. Words of any length
are whole.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textblocks import LOWER, raw, slices

#: Shortest and longest grams, and how many grams of one length may be extended.
SHORT, LONG, FREQUENT = 2, 4, 2000
#: Longest run whose checksum is found by tables.
TABLED = 48


@lru_cache(maxsize=TABLED)
def _shift(length: int) -> np.ndarray:
    """Tables by byte for the checksum of a text that is followed by `length` bytes (crc32 is linear)."""
    zeros = bytes(length)
    base = zlib.crc32(zeros)
    return np.array([[zlib.crc32(zeros, b << 8 * k) ^ base for b in range(256)] for k in range(4)], np.uint32)


def _checksums(before: np.ndarray, words: list[bytes], own: np.ndarray, code: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """crc32 of prefix and word for each (prefix checksum, word's number); own: checksums of the words."""
    out = own[code]
    size = lens[code]
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        if n > TABLED:
            out[at] = [zlib.crc32(words[c], int(b)) for c, b in zip(code[at].tolist(), before[at].tolist(), strict=True)]
            continue
        t, x = _shift(n), before[at]
        out[at] ^= t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return out


def count_words(docs: DataFrame, least: int = 7, every: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters with A-Z lower-cased, of `least` code points or more.

    every: runs whose crc32 of `<doc_id>:<run>` it divides lose the code point at crc32 % length before
    they are counted (a reproducible share of misspellings).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = _slice_counts(part, least, every)
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["word", "n"])

    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def _slice_counts(part: pa.RecordBatch, least: int, every: int | None) -> Counter:
    data, offs = raw(part.column("text"))
    data = LOWER[data]
    n = len(data)
    letter = (data >= 97) & (data <= 122) | (data == 0xC3)
    letter[1:] |= data[:-1] == 0xC3  # U+00C0 to U+00FF: 0xC3 and one more byte
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = letter
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    upto = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    long = upto[ends] - upto[starts] >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return Counter()
    doc = np.searchsorted(offs, starts, side="right") - 1
    lens = ends - starts
    bounds = np.append(0, np.cumsum(lens))
    packed = data[np.repeat(starts - bounds[:-1], lens) + np.arange(bounds[-1])]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    total = np.bincount(code, minlength=len(words))
    out: Counter = Counter()
    if every:
        of, times = np.unique(doc * len(words) + code, return_counts=True)
        d, c = np.divmod(of, len(words))
        before = np.array([zlib.crc32(f"{x}:".encode()) for x in part.column("doc_id").to_pylist()], np.uint32)
        h = _checksums(before[d], words, np.array([zlib.crc32(w) for w in words], np.uint32), c, np.array([len(w) for w in words]))
        for i in np.flatnonzero(h % every == 0).tolist():
            w = words[c[i]].decode()
            at = int(h[i]) % len(w)
            total[c[i]] -= times[i]
            if len(w) > least:
                out[w[:at] + w[at + 1 :]] += int(times[i])
    for w, k in zip(words, total.tolist(), strict=True):
        if k:
            out[w.decode()] += k
    return out


class Grams:
    """The gram dictionary: frequencies, and what can stand before or after in a gram."""

    def __init__(self, frequency: dict[str, int]) -> None:
        self.frequency = frequency
        self.longer = {g for g in frequency if len(g) > SHORT}
        self.heads = {g[:k] for g in self.longer for k in range(SHORT, len(g))}
        self.tails = {g[-k:] for g in self.longer for k in range(SHORT, len(g))}

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """(begin, end) of the longest gram at each position that is not inside an earlier one."""
        out, end, n = [], 0, len(word)
        for p in range(n - SHORT + 1):
            e = p + SHORT
            while e < min(n, p + LONG) and word[p : e + 1] in self.longer:
                e += 1
            if e > end:
                out.append((p, e))
                end = e
        return out

    def affected(self, word: str, spans: list[tuple[int, int]]) -> int:
        """Most of the spans that one edit may take from the word's decomposition.

        An edit leaves word[:l] and word[r:] as they are. A gram before it stays unless a gram that begins
        no later could now reach past l; one behind it stays unless a gram from before r could now end with it.
        """
        begins, ends, n, most = [p for p, _ in spans], [e for _, e in spans], len(word), 0
        first = []  # by l: from which begin on grams before l may change
        for at in range(n + 1):
            p = max(0, at - LONG + 1)
            while p <= at - SHORT and word[p:at] not in self.heads:
                p += 1
            first.append(p)
        last = []  # by r: grams behind it that may change
        for at in range(n + 1):
            i, k = bisect_left(begins, at), 0
            while i < len(spans) and ends[i] < at + LONG:
                k += word[at : ends[i]] in self.tails
                i += 1
            last.append(k)
        for left in range(n + 1):
            before = max(0, bisect_right(ends, left) - bisect_left(begins, first[left]))
            for right in (left, left + 1) if left < n else (left,):
                across = bisect_left(begins, right) - bisect_right(ends, left)
                most = max(most, before + across + last[right])
        return most


def gram_dictionary(words: DataFrame) -> Grams:
    """Grams of SHORT code points, and longer ones whose shorter form is frequent, with their numbers."""
    size = F.length("word")
    all_ = lambda k: F.transform(F.sequence(F.lit(1), size - (k - 1)), lambda i: F.substring(F.col("word"), i, F.lit(k)))
    total = words.agg(F.sum(size - 1).alias("t")).first()["t"] or 0
    bound = max(1, total // FREQUENT)
    frequency: dict[str, int] = {}
    grams = words.where(size >= SHORT).select(F.explode(all_(SHORT)).alias("g"))
    for k in range(SHORT, LONG + 1):
        level = {r["g"]: r["n"] for r in grams.groupBy("g").agg(F.count("*").alias("n")).toLocalIterator()}
        frequency |= level
        often = [g for g, n in level.items() if n > bound]
        if not often or k == LONG:
            break
        known = words.sparkSession.createDataFrame([(g,) for g in often], "h string")  # at most FREQUENT rows
        grams = words.where(size > k).select(F.explode(all_(k + 1)).alias("g")).join(F.broadcast(known), F.expr(f"substring(g, 1, {k})") == F.col("h"), "left_semi")
    return Grams(frequency)


def _listed(words: DataFrame, grams: Grams) -> DataFrame:
    """(word, n, size, m, least, sign, lists): m is the number of the word's grams, least the overlap that a near word
    has with them, sign one of 64 bits for each gram, lists the begins and ends of the grams to list."""
    shared = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for pdf in batches:
            rows = []
            for w in pdf["word"]:
                spans = g.decompose(w)
                k, sign = g.affected(w, spans), 0
                for p, e in spans:
                    sign |= 1 << (zlib.crc32(w[p:e].encode()) & 63)
                rare = sorted(spans, key=lambda s: (g.frequency.get(w[s[0] : s[1]], 0), w[s[0] : s[1]], s[0]))[: k + 1]  # noqa: B023
                rows.append((len(w), len(spans), len(spans) - k, sign - (sign >> 63 << 64), [{"p": p, "e": e} for p, e in rare]))
            size, m, least, sign, lists = zip(*rows, strict=True) if rows else ((),) * 5
            yield pdf.assign(size=size, m=m, least=least, sign=sign, lists=lists)

    return words.mapInPandas(run, "word string, n long, size int, m int, least int, sign long, lists array<struct<p:int,e:int>>")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two of the words (word, n; distinct) that differ by one code point inserted,
    deleted or replaced, once: the shorter first, of equal length the smaller."""
    listed = materialize(_listed(words, gram_dictionary(words)), "grams")
    c = F.col
    # the edit lies on one side of an aligned gram, so with the gram all on the other side is equal
    before = F.struct(F.lit(0).alias("side"), (c("l.e") - c("l.p")).alias("k"), F.substring(c("word"), F.lit(1), c("l.e")).alias("part"))
    behind = F.struct(F.lit(1).alias("side"), (c("l.e") - c("l.p")).alias("k"), F.substring(c("word"), c("l.p") + 1, c("size")).alias("part"))
    lists = listed.select("word", "n", "size", "m", "least", "sign", F.explode("lists").alias("l"))
    lists = lists.select("word", "n", "size", "m", "least", "sign", F.explode(F.array(before, behind)).alias("g"))
    lists = lists.withColumn("whole", c("g.part") == c("word"))  # no two words of one length have such a list in common
    listed_at = lambda size: F.xxhash64("g.side", "g.k", "g.part", size).alias("at")  # noqa: E731  equal hashes of unequal lists only add candidates
    cols = ("word", "n", "size", "m", "least", "sign")
    asked = lists.withColumn("to", F.explode(F.array(c("size"), c("size") + 1))).where(~c("whole") | (c("to") > c("size"))).select(*[c(x).alias(f"a_{x}") for x in cols], listed_at(c("to")))
    lists = lists.where(~c("whole")).select(*[c(x).alias(f"b_{x}") for x in cols], listed_at(c("size")))
    once = (c("b_size") > c("a_size")) | (c("a_word") < c("b_word"))
    least = F.greatest("a_least", "b_least")  # of both, the grams that the other lacks are so few:
    enough = (F.bit_count(c("a_sign").bitwiseAND(F.bitwise_not("b_sign"))) <= c("a_m") - least) & (F.bit_count(c("b_sign").bitwiseAND(F.bitwise_not("a_sign"))) <= c("b_m") - least)
    met = asked.join(lists, "at").where((c("b_size") - c("a_size")).isin(0, 1) & once & enough & (F.levenshtein("a_word", "b_word", 1) == 1))
    met = met.select(c("a_word").alias("a"), "a_n", c("b_word").alias("b"), "b_n")
    return met.unionByName(_unbounded(listed)).distinct()


def _unbounded(listed: DataFrame) -> DataFrame:
    """Near pairs among the words that may share no gram with a near one, by what one deletion leaves."""
    few = listed.where("least <= 0").select("word", "n", "size")
    left = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.col("size")))))
    keys = few.select("word", "n", "size", F.explode(F.array_distinct(F.concat(left, F.array("word")))).alias("key"))
    x = keys.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("size").alias("a_size"), "key")
    y = keys.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("size").alias("b_size"), "key")
    once = (F.col("b_size") > F.col("a_size")) | (F.col("b_size") == F.col("a_size")) & (F.col("a") < F.col("b"))  # as near_pairs() orders the two
    return x.join(y, "key").where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def group_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """words (word, n) with form, root, n_near and form_n.

    form: the near word of largest n, the smallest of those, if it has factor times the word's n or more. root: the
    last form that forms lead to, the word itself without one.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("top"))
    good: Column = -F.col("top.m") >= factor * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("top.w")).alias("form"), F.when(good, -F.col("top.m")).alias("form_n"))
    out = materialize(out, "forms")
    step = out.where("form is not null").select("word", F.col("form").alias("root"))
    most = out.agg(F.max("n")).first()[0] or 1
    length = int(math.log(most, factor)) + 1  # longest chain
    for _ in range(max(0, math.ceil(math.log2(max(1, length))))):
        further = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(step.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return out.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
