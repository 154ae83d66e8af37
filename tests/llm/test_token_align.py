"""Cross-tokenizer alignment against a plain version with the two libraries; the perfect hash."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import token_align
from ledgerloom.llm.bpe import byte_letters
from ledgerloom.llm.perfect_hash import PerfectHash
from ledgerloom.llm.registry import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def plain(rows):
    """{row: numbers} by the libraries, one document after the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.no_padding()
    t.no_truncation()
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    letter = byte_letters()
    b_bytes = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    links, groups = [], []
    for text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        xa, xb = [bytes(letter[c] for c in t.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
            links.append([])
            groups.append([])
            continue
        ends = lambda parts: list(np.cumsum([len(p) for p in parts]))
        ea, eb = ends(xa), ends(xb)
        both = sorted(set(ea) & set(eb))
        place_a, place_b = ({e: i for i, e in enumerate(x)} for x in (ea, eb))
        links.append([(a[place_a[e]], b[place_b[e]]) for e in both])
        own, i, j = [], 0, 0
        for e in both:
            u, v = place_a[e] + 1, place_b[e] + 1
            own.append((a[i:u], b[j:v]))
            i, j = u, v
        groups.append(own)
    count = Counter(x for own in links for x in own)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for own, g in zip(links, groups, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, count


def texts():
    rng = random.Random(5)
    parts = ["the", "The", "  ", " ", "\n", "\t", "Straße", "ñandú", "été", "日本語", "😀", "é́", "'s", "don't", "1234", "<|endoftext|>", "</s>", "<s>", "<0x41>", "ﬁ", "a b", "!!", "...", "tionwh", "erbleing", "x" * 90, "　", "_", "हिन्दी", "عربي", "\x00", "\r\n"]
    out = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    return [None, "", " ", "  ", "a", "a ", "▁x", "plain ▁ mark", "the idea the idea", *out, out[0], out[0], "wordy text " * 30_000]


def test_equals_libraries(spark):
    rows = texts()
    docs = spark.createDataFrame([(i if i else None, t, i) for i, t in enumerate(rows)], "doc_id long, text string, `a` int").repartition(7)
    got = {(-1 if r["doc_id"] is None else r["doc_id"]): tuple(r[c] for c in [*token_align.FIELDS[1:], "groups_sha256"]) for r in token_align.align(docs, A, B).collect()}
    want, count = plain(rows)
    assert len(got) == len(rows)
    for i, w in enumerate(want):
        assert got[i or -1] == w, rows[i] and rows[i][:80]
    pairs = token_align.Alignment(docs, A, B).pair_counts()
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == dict(count)


def test_groups_and_copies(spark):
    docs = spark.createDataFrame([(7, "one two"), (7, "one two"), (8, None)], "doc_id int, text string")
    rows = token_align.align(docs, A, B, groups=True).orderBy("doc_id").collect()
    assert rows[0] == rows[1] and rows[0]["n_links"] == 2 and rows[0]["count_sum"] == 4
    assert hashlib.sha256(rows[0]["groups"].encode()).hexdigest() == rows[0]["groups_sha256"]
    assert rows[2]["groups"] == "" and rows[2]["groups_sha256"] == "" and rows[2]["n_a"] == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align(docs, A, B).collect() == []
    only_empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {r["n_links"] for r in token_align.align(only_empty, A, B).collect()} == {0}


def test_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(token_align, "FAN", 2)
    monkeypatch.setattr(token_align, "BLOCK", 8)
    rows = [f"some {i} words and numbers {i * i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(12)
    got = {r["doc_id"]: r["count_sum"] for r in token_align.align(docs, A, B).collect()}
    assert got == {i: w[5] for i, w in enumerate(plain(rows)[0])}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 200_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    of = PerfectHash(np.concatenate([keys, keys]))
    assert len(of) == len(keys) and sorted(of(keys)) == list(range(len(keys)))
    assert (of.keys[of(keys)] == keys).all()
    other = np.setdiff1d(np.arange(1 << 41, (1 << 41) + 5000), keys)
    assert (of(other) == -1).all()
