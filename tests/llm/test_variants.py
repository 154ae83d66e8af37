"""Spelling variants against plain versions: counting, near pairs, forms and roots."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import registry, variants


def counted(rows, least=7, every=31):
    out = Counter()
    for doc, text in rows:
        for x in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = x.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if every and h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


def near(words):
    """{word: near words}, by what one deletion leaves."""
    by, out = defaultdict(set), defaultdict(set)
    for w in words:
        for k in {w[:j] + w[j + 1 :] for j in range(len(w))} | {w}:
            by[k].add(w)
    for own in by.values():
        for a in own:
            out[a] |= {b for b in own if one_edit(a, b)}
    return out


def grouped(n, factor=10):
    close, out = near(n), {}
    form = {}
    for w in n:
        top = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= factor * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None)
    return out


def made_words(seed, many, letters="abeinrst", lens=(7, 14)):
    rng = random.Random(seed)
    out = set()
    parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(12)]
    while len(out) < many:
        w = "".join(rng.choice(parts) for _ in range(8))[: rng.randrange(*lens)]
        out.add(w)
        at = rng.randrange(len(w) + 1)
        out.add(rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :]]))
    return sorted(x for x in out if len(x) >= 1)


def test_counting(spark):
    rng = random.Random(3)
    parts = ["STRASSE", "Straße", "naïveté", "château", "Āgathist", "x×y÷zabcd", "don't", "wonderful-Wonderful", "a1bcdefgh", " ", "日本語abcdefgh", "Ünderground", "word " * 3, "y" * 70, "Z" * 300]
    rows = [(i if i % 7 else None, "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(30))) for i in range(400)]
    rows += [(1, None), (2, ""), rows[5], rows[5], (9, "abcdefghij " * 20_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string").repartition(5)
    for least, every in ((7, 31), (7, 2), (1, None)):
        got = {r["word"]: r["n"] for r in variants.count_words(docs, least, every).collect()}
        assert got == counted(rows, least, every)


@pytest.mark.parametrize(("short", "long", "frequent", "letters", "lens"), [(2, 4, 2000, "abeinrst", (7, 14)), (2, 4, 40, "ab", (7, 11)), (3, 6, 400, "aé", (4, 9)), (2, 6, 4000, "abc", (2, 8)), (2, 3, 20, "xy", (30, 40))])
def test_pairs_are_whole(spark, monkeypatch, short, long, frequent, letters, lens):
    for name, v in (("SHORT", short), ("LONG", long), ("FREQUENT", frequent)):
        monkeypatch.setattr(variants, name, v)
    words = made_words(f"{short}{long}{letters}", 700, letters, lens)
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(3)
    # the dictionary and the bounds as the tasks have them, on the driver
    g = variants.gram_dictionary(df)
    close = near(words)
    for a in words[::5]:
        spans = g.decompose(a)
        k = g.affected(a, spans)
        own = Counter(a[p:e] for p, e in spans)
        for b in close[a]:
            assert sum((own & Counter(b[p:e] for p, e in g.decompose(b))).values()) >= len(spans) - k
    if short == 2 and long == 4:
        got = [(r["a"], r["b"]) for r in variants.near_pairs(df).collect()]
        assert len(got) == len(set(got))
        assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in close[a]}


def test_forms_and_roots(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    n = {w: 10**i for i, w in enumerate(chain)} | {"zzzzzzz": 5, "yyyyyyy": 50, "zzzzzzy": 50, "zzzzzza": 50, "zzzzzzb": 49, "lonely-word": 3, "short": 9}
    n |= {w: 1 + i % 30 for i, w in enumerate(made_words(9, 300))}
    df = spark.createDataFrame([(*x, 0) for x in n.items()], "word string, n long, form int")
    rows = variants.group_variants(df.select("word", "n")).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(rows) == len(n) and got == grouped(n)
    assert got["abcdefg"][1] == "abcdefghijk" and got["zzzzzzz"][0] == "zzzzzza"


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(variants.count_words(docs)).collect() == []
    nothing = spark.createDataFrame([(1, None), (None, "a b c")], "doc_id long, text string")
    assert variants.group_variants(variants.count_words(nothing)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n = {w: k for w, k in counted([tuple(r) for r in docs]).items() if k >= 2}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in registry.op13_spelling_variants(spark, sf).collect()}
    assert got == grouped(n)
