"""Byte-level BPE encoding and decoding by forced-boundary splitting.

Method. A merge can only make a vocabulary token, so two neighbouring bytes that stand side by side in
no token are never merged: a cut between them is certain. Such a pair is a cut where it lies between two
characters (of any script) and leaves the pre-tokeniser's matches as they are (see Codec.cuts); cuts
split a text into fragments that are encoded one by one and concatenated. All texts of an Arrow slice are
cut at once with numpy. Equal fragments of a slice are found by their bytes (a dictionary of the slice)
and encoded once; short ones are remembered, bytes and all, in a memo of bounded size for each worker.

The tokenizer file is a parameter; its bytes travel with the task (about 2 MB, a fixed size).

Edges. Null and empty texts have no ids, an empty table gives an empty one, repeated rows are encoded
alike. A text of any length is encoded whole: it is cut first, and a piece without cuts takes n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused
from .textblocks import raw, slices

#: Fixed value: the byte-level pre-tokeniser's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MATCH = regex.compile(PATTERN)
#: Bytes that a worker's memo may take in keys and ids, and the longest fragment that it keeps.
MEMO_BYTES, MEMO_LONGEST = 32 << 20, 64
#: Kinds of characters as the pre-tokeniser sees them.
OTHER, LETTER, NUMBER, SPACE = range(4)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """Kind of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return kinds


def joined_bytes(tokens: list[bytes]) -> np.ndarray:
    """For bytes a * 256 + b: do they stand side by side in a token?"""
    joined = np.zeros((256, 256), bool)
    for t in tokens:
        joined[list(t[:-1]), list(t[1:])] = True
    for a, b in ("re", "ve", "ll"):  # of the contractions, which the pre-tokeniser keeps together
        joined[ord(a), ord(b)] = True
    return joined.ravel()


class Memo:
    """Fragments by their bytes, with their ids. Begins anew when it is full."""

    def __init__(self) -> None:
        self.keys = pa.array([], pa.large_binary())
        self.flat, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def find(self, fragments: pa.Array) -> np.ndarray:
        """Place of each fragment, -1 if it isn't here."""
        return np.asarray(pc.fill_null(pc.index_in(fragments, value_set=self.keys), -1).to_numpy(zero_copy_only=False), np.int64)

    def add(self, fragments: pa.Array, flat: np.ndarray, lens: np.ndarray) -> None:
        short = np.asarray(pc.binary_length(fragments).to_numpy()) <= MEMO_LONGEST
        if self.keys.nbytes + self.flat.nbytes + self.lens.nbytes > MEMO_BYTES:
            self.__init__()
        self.keys = pa.concat_arrays([self.keys, fragments.filter(pa.array(short))])
        self.flat, self.lens = np.append(self.flat, flat[np.repeat(short, lens)]), np.append(self.lens, lens[short])


class Codec:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        letter = byte_letters()
        as_bytes = lambda s: bytes(letter[c] for c in s)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(s): i for s, i in model["vocab"].items() if s.encode() not in self.special}
        merges = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.pair = {self.ids[x] << 20 | self.ids[y]: r for r, (x, y) in enumerate(merges)}
        self.made, self.no_rank = [self.ids[x + y] for x, y in merges], len(merges)
        pairs = np.array(list(self.pair), np.int64)
        self.order = np.argsort(pairs)
        self.pairs, self.made_ids, self.byte_ids = pairs[self.order], np.array(self.made, np.int32), np.array(self.byte_id, np.int32)
        self.joined = joined_bytes(list(self.ids))
        self.byte_kinds = np.append(character_kinds()[:128], np.zeros(128, np.uint8))
        left, right = np.divmod(np.arange(1 << 16), 256)
        self.ascii_cuts = self._may_cut(left, right, self.byte_kinds[left], self.byte_kinds[right]) & (left < 128) & (right < 128)
        self._special = regex.compile(b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or b"(?!)")
        table = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        size = max(table) + 1
        parts = [table.get(i, b"") for i in range(size)]
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.token_len = np.array([len(p) for p in parts], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        digits = [str(i).encode() + b"," for i in range(size)]
        self.digit_len = np.array([len(d) for d in digits], np.int64)
        self.digits = np.frombuffer(b"".join(d.ljust(8) for d in digits), np.uint8).reshape(-1, 8)
        self.memos = (Memo(), Memo())

    def _merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: merges of the lowest rank first, the leftmost of those first."""
        ids = [self.byte_id[b] for b in piece]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, none = self.pair.get, self.no_rank
        ranks = [get(x << 20 | y, none) for x, y in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            ids[i] = new = self.made[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, so that a long piece takes n log n steps."""
        n, get = len(ids), self.pair.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (p := before[i]) >= 0 and (r := get(ids[p] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, p, ids[p], ids[i]))
        return [i for i in ids if i >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, no_rank if there is none (an id of -1 has none)."""
        pair = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (right >= 0), self.order[at], self.no_rank).astype(np.int32)

    def _merge_block(self, words: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of `width` bytes or fewer, all merged at once: in a round each piece makes
        its merge of the lowest rank, the leftmost of those."""
        lens = np.array([len(w) for w in words])
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        rows, j = np.arange(len(words)), np.arange(width)
        while True:
            best = rank[rows].argmin(axis=1)
            r = rank[rows, best]
            go = r < self.no_rank
            rows, best, r = rows[go], best[go], r[go]
            if not len(rows):
                break
            here = np.take_along_axis(ids[rows], np.minimum(j + (j > best[:, None]), width - 1), axis=1)
            here[:, -1] = -1
            k = np.arange(len(rows))
            here[k, best] = self.made_ids[r]
            near = np.take_along_axis(rank[rows], np.minimum(j[:-1] + (j[:-1] >= best[:, None]), width - 2), axis=1)
            near[:, -1] = self.no_rank
            some = best < width - 1
            near[k[some], best[some]] = self._ranks(here[k[some], best[some]], here[k[some], best[some] + 1])
            some = best > 0
            near[k[some], best[some] - 1] = self._ranks(here[k[some], best[some] - 1], here[k[some], best[some]])
            ids[rows], rank[rows] = here, near
            lens[rows] -= 1
        flat, ends = ids[j < lens[:, None]].tobytes(), np.cumsum(lens) * 4
        return [flat[e - 4 * n : e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]

    def _merge_all(self, words: list[bytes]) -> list[bytes]:
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        for low, high in ((0, 8), (8, 16), (16, 32)):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high)).tolist()
            if chosen:
                for i, x in zip(chosen, self._merge_block([words[i] for i in chosen], high), strict=True):
                    out[i] = x
        return [array("i", self._merge(w)).tobytes() if x is None else x for w, x in zip(words, out, strict=True)]

    def encode_fragments(self, fragments: list[bytes], goes_on: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each) of new fragments. goes_on: a character that is no white space follows,
        which the pre-tokeniser looks at."""
        words, counts = [], []
        for f in fragments:
            if not goes_on and (f[1:] if f[:1] == b" " else f).isalpha():
                words.append(f)
                counts.append(1)
                continue
            own = _MATCH.findall(f.decode() + "x" if goes_on else f.decode())
            if goes_on:
                own[-1] = own[-1][:-1]
            own = [w.encode() for w in own if w]
            words += own
            counts.append(len(own))
        merged = self._merge_all(words)
        ends = np.append(0, np.cumsum([len(x) >> 2 for x in merged]))[np.cumsum(counts)] if fragments else np.zeros(0, np.int64)
        return np.frombuffer(b"".join(merged), np.int32), np.diff(ends, prepend=0)

    def cuts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(certain cuts, ends of characters that are white space), both by the byte they stand before.

        The byte pair must occur in no token, and the cut must not change a match of the pre-tokeniser:
        a match ends, in any context, between characters of different kinds and may be cut inside a run
        of letters or of numbers. Runs of white space or of other characters are left whole, nothing is
        cut after an apostrophe, nor before one that follows white space, as a contraction may begin there.
        """
        n = len(data)
        cut, spaced = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        cut[1:n] = self.ascii_cuts[data[:-1].astype(np.uint16) << 8 | data[1:]]
        kind = self.byte_kinds[data]
        spaced[1:] = kind == SPACE
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int32)
            width = 2 + (first >= 0xE0) + (first >= 0xF0)
            tail = [(data[np.minimum(lead + i, n - 1)] & 0x3F).astype(np.int32) for i in (1, 2, 3)]
            point = np.where(width == 2, (first & 0x1F) << 6 | tail[0], np.where(width == 3, (first & 0x0F) << 12 | tail[0] << 6 | tail[1], (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
            wide = character_kinds()[np.minimum(point, 0x10FFFF)]
            end = np.minimum(lead + width, n)
            spaced[end[wide == SPACE]] = True
            for i in range(4):
                some = width > i
                kind[np.minimum(lead[some] + i, n - 1)] = wide[some]
            at = np.concatenate([lead, end])
            at = at[(at > 0) & (at < n)]
            cut[at] = self._may_cut(data[at - 1], data[at], kind[at - 1], kind[at])
        return cut, spaced

    def _may_cut(self, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """May a cut lie between these bytes, of characters of these kinds?"""
        ok = (before != after) | (before == LETTER) | (before == NUMBER)
        ok &= ~((left == 39) & (after != SPACE)) & ~((before == SPACE) & (right == 39))
        return ok & ~self.joined[left.astype(np.int32) << 8 | right]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts data[offs[i]:offs[i + 1]]."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        flat, at, lens, where = self._looked_up(data, offs)
        ids, ends = _gather(flat, at, lens)
        return ids, np.append(0, ends)[where]

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of ids of each text data[offs[i]:offs[i + 1]], without making the ids of every text."""
        if not len(data):
            return np.zeros(len(offs) - 1, np.int64)
        _, _, lens, where = self._looked_up(data, offs)
        return np.diff(np.append(0, np.cumsum(lens))[where])

    def _looked_up(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the fragments that differ, where in them each fragment has its own, how many, first fragment of each text)."""
        n = len(data)
        data = np.ascontiguousarray(data)
        cut, spaced = self.cuts(data)
        hard = np.zeros(n + 1, bool)
        hard[offs] = True
        specials: list[int] = []
        if self.special:
            for m in self._special.finditer(data):
                s, e = m.span()
                if not hard[s + 1 : e].any():
                    cut[s + 1 : e] = False
                    hard[[s, e]] = True
                    specials.append(s)
        cut |= hard
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        # equal fragments by their bytes; a fragment's ids depend on the bytes and on its variant
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n)), pa.py_buffer(data)])
        coded = whole.dictionary_encode()
        variant = (spaced[ends] & ~hard[ends]).astype(np.int64)
        variant[np.searchsorted(starts, specials)] = 2
        key = coded.indices.to_numpy().astype(np.int64) * 3 + variant
        used = np.flatnonzero(np.bincount(key))
        place = np.zeros(int(used[-1]) + 1, np.int64)
        place[used] = np.arange(len(used))
        found, kind = coded.dictionary.take(pa.array(used // 3)), used % 3
        flats, at, lens, base = [], np.zeros(len(used), np.int64), np.zeros(len(used), np.int64), 0
        for v, memo in enumerate(self.memos):
            some = np.flatnonzero(kind == v)
            own = found.take(pa.array(some))
            where = memo.find(own)
            hit, new = some[where >= 0], some[where < 0]
            lens[hit] = memo.lens[where[where >= 0]]
            at[hit] = base + (np.cumsum(memo.lens) - memo.lens)[where[where >= 0]]
            base += len(memo.flat)
            flats.append(memo.flat)
            if len(new):
                fresh = found.take(pa.array(new))
                flat, lens[new] = self.encode_fragments(fresh.to_pylist(), bool(v))
                at[new] = base + np.cumsum(lens[new]) - lens[new]
                base += len(flat)
                flats.append(flat)
                memo.add(fresh, flat, lens[new])
        if len(some := np.flatnonzero(kind == 2)):
            flats.append(np.array([self.special[f] for f in found.take(pa.array(some)).to_pylist()], np.int32))
            at[some], lens[some] = base + np.arange(len(some)), 1
        slot = place[key]
        return np.concatenate(flats), at[slot], lens[slot], np.searchsorted(starts, offs)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts whose ids are ids[offs[i]:offs[i + 1]]."""
        data, ends = _gather(self.token_bytes, self.token_at[ids], self.token_len[ids])
        return data, np.append(0, ends)[offs]

    def decimal(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets): the ids as decimals, each with a comma after it."""
        lens = self.digit_len[ids]
        return self.digits[ids][np.arange(8) < lens[:, None]], np.append(0, np.cumsum(lens))[offs]


def _gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[at[i]:at[i] + lens[i]] for all i, one after the other, and where each ends."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(at - (ends - lens), lens) + np.arange(total)], ends


@lru_cache(maxsize=2)
def codec(content: bytes) -> Codec:
    """One codec for each file and Python worker."""
    return Codec(content)


def _replaced(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + fields)


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", verify: bool = False) -> DataFrame:
    """docs with ids (array<int>) and n_tokens (long) for each whole text.

    As the tokenizers library encodes without added special tokens; a special token's own string in a
    text is that token. Null or empty text: no ids. Columns named ids or n_tokens are replaced, all
    others stay; repeated rows are encoded alike. verify adds `exact`: do the ids decode to the text?
    """
    content = _content(path)
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), *([T.StructField("exact", T.BooleanType())] * verify)]
    schema = _replaced(docs.schema, fields)
    keep = [f.name for f in schema.fields[: -len(fields)]]
    (own,) = unused(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content)
        for batch in batches:
            for part in slices(batch, own):
                data, at = raw(part.column(own))
                ids, offs = c.encode(data, at)
                new = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids)), pa.array(np.diff(offs))]
                if verify:
                    back, back_at = c.decode(ids, offs)
                    new.append(pa.array([data[a:b].tobytes() == back[x:y].tobytes() for a, b, x, y in zip(at[:-1], at[1:], back_at[:-1], back_at[1:], strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *new], schema.names)

    return docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias(own)).mapInArrow(run, schema)


def _texts(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Strings of a decoded block; where ids break a character, its bytes become replacement marks."""
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        return whole.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the decoded text of each list of ids; a null or empty list gives an empty text."""
    content = _content(path)
    schema = _replaced(encoded.schema, [T.StructField(out, T.StringType())])
    keep = [f.name for f in schema.fields[:-1]]
    (own,) = unused(encoded, "_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content)
        for batch in batches:
            col = batch.column(own)
            lens = np.asarray(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
            data, offs = c.decode(np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.int64), np.append(0, np.cumsum(lens)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), _texts(data, offs)], [*keep, out])

    return encoded.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{ids}`").alias(own)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode from the ids, digest both.

    The ids stay in the task as arrays, so nothing but the digests goes back to the JVM.
    """
    content = _content(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in slices(batch):
                ids, offs = c.encode(*raw(part.column("text")))
                dec, dec_at = c.decimal(ids, offs)
                back, back_at = c.decode(ids, offs)
                a = [sha(dec[s : max(s, e - 1)]) for s, e in zip(dec_at[:-1], dec_at[1:], strict=True)]
                b = [sha(back[s:e]) for s, e in zip(back_at[:-1], back_at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(offs)), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
