"""Corpus operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats,
empty tables, extra columns with clashing names."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, chat, line_dedup, mixing, ngram_join, pii, quality, suffix_dedup, token_shards, topk
from ledgerloom.llm.registry import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lines string, node long, quality string"


def frame(spark, texts, sources=None):
    rows = [(i if t is not ... else None, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t or ""), "x", 7, "q") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Élan", "ß.", "A"]
    base = [" ".join(r.choices(vocab, k=r.randint(1, 120))) for _ in range(n // 3)]
    texts = list(base)
    for t in base:
        w = t.split()
        for _ in range(r.randint(0, 3)):
            x = list(w)
            for _ in range(r.randint(0, max(1, len(x) // 25))):
                x[r.randrange(len(x))] = r.choice(vocab)
            texts.append(("\n" if r.random() < 0.3 else " ").join(x))
    return [*texts, None, "", "   \n", "one", "one", "x y z", "X Y Z"]


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2), (2, 50, 3)])
def test_ngram_join(spark, k, percent, seed):
    texts = corpus(seed)
    sets = [shingles(t, k) for t in texts]
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = [lo if c == hi else c for c in comp]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, texts), k, percent).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
    kept = {r["doc_id"] for r in ngram_join.drop_near_duplicates(frame(spark, texts), k, percent).collect()}
    assert kept == set(comp)


def test_ngram_join_edges(spark):
    empty = frame(spark, ["a"]).where("false")
    assert ngram_join.near_duplicates(empty).count() == 0
    rows = frame(spark, ["a b c", "a b c"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["component_id"] for r in ngram_join.near_duplicates(rows, 4, 85).collect()] == [None, None]


def test_repeated_passages(spark):
    r = random.Random(5)
    vocab = [f"v{i}" for i in range(30)]
    some = [r.choices(vocab, k=25) for _ in range(6)]
    texts = []
    for _ in range(30):
        parts = [r.choice(some) if r.random() < 0.5 else r.choices(vocab, k=r.randint(1, 20)) for _ in range(r.randint(1, 6))]
        texts.append(" ".join(w for p in parts for w in p))
    texts += [texts[0], None, "", "v1 " * 60]
    least, k = 20, 6
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for i, w in enumerate(words):
        for s in range(len(w) - least + 1):
            seen.setdefault(tuple(w[s : s + least]), []).append((i, s))
    want = set()
    for i in range(len(texts)):
        starts = sorted(s for v in seen.values() if len(v) > 1 for d, s in v if d == i)
        spans = []
        for s in starts:
            if spans and s <= spans[-1][1]:
                spans[-1][1] = s + least
            else:
                spans.append([s, s + least])
        want |= {(i, a, b) for a, b in spans}
    got = {(x["doc_id"], x["start_word"], x["end_word"]) for x in suffix_dedup.repeated_passages(frame(spark, texts), least, k).collect()}
    assert got == want and want
    assert suffix_dedup.repeated_passages(frame(spark, ["a"]).where("false")).count() == 0


def test_suffix_buckets_are_even(spark, monkeypatch):
    """Minimisers have small hashes; ranges of those gave half of the extents to one bucket."""
    r = random.Random(3)
    texts = []
    for _ in range(25):
        w = [f"q{r.randrange(10**9)}" for _ in range(400)]
        texts += [" ".join(w), " ".join(["x", *w])]
    counts, by_suffixes = [], suffix_dedup._by_suffixes

    def counted(extents, *more):
        counts.extend(x["count"] for x in extents.groupBy("bucket").count().collect())
        return by_suffixes(extents, *more)

    monkeypatch.setattr(suffix_dedup, "_by_suffixes", counted)
    got = suffix_dedup.repeated_passages(frame(spark, texts), bucket_extents=40)
    assert got.groupBy().sum("n_words").first()[0] == 50 * 400
    assert sum(counts) > 400 and max(counts) < 80


@pytest.mark.parametrize("width", [1, 2, 3, 7, 35])
def test_leftmost(width):
    import numpy as np

    values = np.random.default_rng(width).integers(0, 9, 500).astype(np.uint64)
    assert (suffix_dedup._leftmost(values, width) == np.arange(501 - width) + np.lib.stride_tricks.sliding_window_view(values, width).argmin(axis=1)).all()


def test_bpe_equals_tokenizers(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    r = random.Random(3)
    alphabet = [*"aabehinstrzXQ019  \n\n\t\r'',.!?-*#é中 　ß😀\x1c\x85\x00", "'s", "'re", " '", "<|endoftext|>", "é "]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(300)] + [None, "", "<|endoftext|>", "a" * 5000, "The cat's 12 hats\n\n  sat."]
    df = frame(spark, texts).withColumn("ids", F.lit("clash"))
    got = {x["doc_id"]: x for x in bpe.encode(df, tokenizer_path(), verify=True).collect()}
    want = [tk.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert all(got[i]["ids"] == want[i] and got[i]["n_tokens"] == len(want[i]) and got[i]["exact"] and got[i]["source"] == "a" for i in range(len(texts)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    trip = {x["doc_id"]: x for x in bpe.round_trip(frame(spark, texts), tokenizer_path()).collect()}
    assert all(trip[i]["ids_sha256"] == sha(",".join(map(str, want[i]))) and trip[i]["decoded_sha256"] == sha(tk.decode(want[i], skip_special_tokens=False)) for i in range(len(texts)))
    back = bpe.decode(bpe.encode(frame(spark, texts), tokenizer_path()).drop("text"), tokenizer_path())
    assert {x["doc_id"]: x["text"] for x in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_top_k(spark):
    r = random.Random(4)
    vectors = [(i, [r.choice([-1.0, -0.5, 0.25, 0.3, 2.0]) for _ in range(6)], "x") for i in range(400)]
    vectors += [(400, None, "x"), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (402, [float("nan")] * 6, "x"), (403, [1.0] * 5, "x"), (None, [1.0] * 6, "x"), (404, [1e30] * 6, "x"), (50, [0.25] * 6, "x"), (7, [2.0] * 6, "x"), (7, [0.3] * 6, "x")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string")
    import math

    fine = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = []
    for q in {i for i, _ in fine if i % 50 == 0}:
        s = sorted((-clip(sum(a * b for a, b in zip(u, v, strict=True))), i) for j, u in fine if j == q for i, v in fine if i != q and len(v) == len(u))[:5]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    for most in (1 << 25, 100):  # all query blocks broadcast, or in groups
        assert sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0, most_broadcast=most).collect()) == sorted(want)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "</s>[INST] ok [/INST] <|end|>"), (1, 1, "assistant", None), (1, 2, "assistant", "a<\\|x <s>"), (1, 2, "assistant", "a<\\|x <s>"), (1, 3, None, "z"), (2, 0, "system", ""), (None, 0, "user", "q")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    assert out.where("formatted rlike '</s>|\\\\[/?INST\\\\]'").count() == 0
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in (1, 2, None):  # one turn has no conversation
        mine = [(r or "", t or "") for x, _, r, t in turns if x == c]
        said = "".join(t for r, t in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in mine))
        assert got[c]["loss_chars"] == len(said) and got[c]["loss_sha256"] == sha(said)
    assert chat.digest(chat.format_conversations(df.where("false"))).count() == 0


def test_pii(spark):
    card, other = "4111 1111 1111 1111", "4111111111111112"
    texts = [f"a.b7@x.org {card} {other} 2020-02-29 2021-02-29 10.0.0.1 300.1.1.1", f"again a.b7@x.org {card.replace(' ', '')} +1 (887) 555-2355 123-45-6789 25/12/1999", None, "", "clean words 12 345", "x " * 20000]
    rows = {r["doc_id"]: r for r in pii.pseudonymize(frame(spark, texts).withColumn("n_replaced", F.lit("clash")), "k").collect()}
    a, b = rows[0]["text"].split(), rows[1]["text"].split()
    assert rows[0]["n_replaced"] == 4 and rows[1]["n_replaced"] == 5 and a[0] == b[1] and a[0].endswith("@x.org") and a[0] != "a.b7@x.org"
    new = "".join(a[1:5])
    assert new == b[2] and new != card.replace(" ", "") and a[5] == other and a[7] == "2021-02-29" and a[9] == "300.1.1.1"
    digits = [int(c) for c in new][::-1]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert [rows[i]["text"] for i in (2, 3, 4, 5)] == texts[2:]


def test_digit_permutation_is_one_to_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    out = {r[0] for r in df.select(pii.permute_digits(F.col("s"), "k", F.lit("t"))).collect()}
    assert len(out) == 1000 and all(len(x) == 3 for x in out)
    days = spark.range(0, 146097, 7).select(F.date_format(F.expr("date_add(date'1700-01-01', cast(id as int))"), "yyyy-MM-dd").alias("d"))
    assert days.select(pii.pseudonym(F.col("d"), "k")).distinct().count() == days.count()


def test_quality(spark):
    good = " ".join(f"Word{i} goes here." for i in range(30))
    texts = [good, good + "\nHome | About | Us", "\n".join(["a### b&&& c$$$ d!!"] * 30), "De " * 100, "short", None, "", "\n\n", good + "\n" + good, "x y z " * 10 + "p q"]
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        hit = {j + d for j, x in enumerate(tri) if tri.count(x) > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), len(hit), len(lines) - len(set(lines)))
        assert got[i]["word_chars"] == sum(map(len, w)) and got[i]["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert got[0]["kept"] and got[1]["kept"] and not got[2]["kept"]
    kept = {r["doc_id"]: r for r in quality.clean(frame(spark, texts)).collect()}
    assert "Home" not in kept[1]["text"] and kept[1]["quality"] == "q" and kept[1]["n_chars"] == len(kept[1]["text"])


def test_line_dedup(spark):
    sites = [f"s{i}" for i in range(12)]
    texts = [f"own line {i}\n  Shared footer. \nless {i % 2}\n\nend {i}" for i in range(24)] + [None, "", "Shared footer.\nShared footer."]
    df = frame(spark, texts, sites)
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(df, 6).collect()}
    count = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            count.setdefault(x.strip(), set()).add(sites[i % 12])
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for x in t.split("\n") if not x.strip() or len(count[x.strip()]) < 6)
        assert got[i]["text"] == want and got[i]["_lines"] == "x"
    assert line_dedup.drop_boilerplate(df.where("false")).count() == 0


def test_token_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    texts = [f"Text number {i} " + "word " * (i % 37) for i in range(50)] + [None, "", "x" * 3000]
    out = f"file://{tmp_path}/shards"
    m = token_shards.write_shards(frame(spark, texts).repartition(3), tokenizer_path(), "key", out, sequence=16, shard_sequences=8).collect()
    assert sorted(r["slot"] for r in m) == list(range(len(m)))
    assert sum(r["n_tokens"] for r in m) == sum(len(tk.encode(t).ids) + 1 for t in texts if t)
    for r in m:
        row = token_shards.read_shard(out, r["shard"], r["slot"] % 8, 1, 16)[0]
        assert (row[r["n_tokens"] :] == 50256).all() and r["byte_offset"] == r["slot"] % 8 * 32
    one = next(r for r in m if r["doc_ids"][0] == 52 and len(r["doc_ids"]) == 1)
    assert set(tk.decode(token_shards.read_shard(out, one["shard"], one["slot"] % 8, 1, 16)[0].tolist())) == {"x"}
    assert token_shards.write_shards(frame(spark, [None, ""]), tokenizer_path(), "key", f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("total", [1, 2, 5, 64, 1000])
def test_slots_are_a_permutation(spark, total):
    got = [r[0] for r in spark.range(total).select(token_shards.slot_of(F.col("id"), total, "k")).collect()]
    assert sorted(got) == list(range(total))


def test_mixing(spark):
    r = random.Random(8)
    kinds = {0: "bad### junk$$$ ", 1: "idiot bad### ", 2: "fine words here ", 3: "idiot fine words "}
    rows = [(i, kinds[i % 4] * r.randint(5, 40), "en", "s", 0, "x", 7, "q") for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None, "en", "s", 0, "x", 7, "q"), (1000, "", "en", "s", 0, "x", 7, "q")], SCHEMA)
    labels = spark.createDataFrame([(i, i % 4 // 2, i % 2) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    shares = {"good": 0.7, "good_toxic": 0.1, "low": 0.1, "low_toxic": 0.1}
    got = mixing.rate_table(docs, labels, shares)
    t = got.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in mixing.DOMAINS], F.sum("tokens").alias("all")).first()
    assert all(abs(t[d] / t["all"] - shares[d]) < 0.01 for d in mixing.DOMAINS) and got.where("rate < 0").count() == 0
    held = got.where("doc_id between 200 and 399").collect()
    best = [max(range(4), key=lambda j, x=x: x[f"p_{mixing.DOMAINS[j]}"]) for x in held]
    assert sum(b == x["doc_id"] % 4 for b, x in zip(best, held, strict=True)) / len(held) > 0.95
    rows = mixing.mixed(docs, labels, factors={"low": 0.0, "low_toxic": 0.0, "good_toxic": 0.0})
    kept = [x["doc_id"] for x in mixing.take_by_rate(rows).collect()]
    good = {i for i in range(400) if i % 4 == 2}
    assert len(good - set(kept)) <= 5 and len({i for i in kept if i < 400} - good) <= 5  # the fractions are drawn
    assert mixing.rate_table(docs.where("false"), labels.where("false"), shares).count() == 0
