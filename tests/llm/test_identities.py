"""Identities, hot groups and exact inverses: what hashes, blocks and permutations must not get wrong."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, ngram_join, pii, quality, suffix_dedup, token_shards
from ledgerloom.llm.registry import tokenizer_path

from test_operators import WORD, corpus, frame, shingles

#: Words that a polynomial hash modulo 2 ** 64 takes for one another.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
TWIN = THUE.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    around = [" ".join(f"{c}{i}" for i in range(25)) for c in "vw"]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(frame(spark, [THUE, TWIN, THUE + " x y z", TWIN + " x y z"]), 4, 85).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}
    assert suffix_dedup.repeated_passages(frame(spark, [f"{around[0]} {x} {around[1]}" for x in (THUE, TWIN)]), 40, 6).count() == 0
    tk = Tokenizer.from_file(tokenizer_path())
    rows = {r["doc_id"]: r["ids"] for r in bpe.encode(frame(spark, [THUE, TWIN]).repartition(1), tokenizer_path()).collect()}
    assert rows == {i: tk.encode(t).ids for i, t in enumerate((THUE, TWIN))}


def test_uncut_scripts_equal_tokenizers():
    """Mixed and uncut scripts, and a memo that is full all the time."""
    tk = Tokenizer.from_file(tokenizer_path())
    r = random.Random(2)
    mixed = "ab '1 \n\t\u00e9\u6f22\U0001f600\u3000\u00a0|<sZ.!\u0301\u0663"
    texts = ["".join(r.choice(mixed) for _ in range(r.randint(0, 30))) for _ in range(300)]
    texts += ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(r.randint(1, 400))) for _ in range(60)] + ["\u0915\u094d\u0937" * 30, "\u0418 \u043c\u0438\u0440" * 9, "a\u0301e" * 20]
    most, bpe.MEMO_BYTES = bpe.MEMO_BYTES, 1000
    try:
        with open(tokenizer_path(), "rb") as f:
            c = bpe.Codec(f.read())
        for part in (texts[:20], texts[20:], texts[:20]):
            raw = [t.encode() for t in part]
            data, at = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))
            ids, offs = c.encode(data, at)
            assert c.count(data, at).tolist() == np.diff(offs).tolist()
            assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [tk.encode(t).ids for t in part]  # noqa: B905
    finally:
        bpe.MEMO_BYTES = most


@pytest.mark.parametrize("size", [{"block_entries": 50}, {"hot_from": 2, "block_entries": 200}, {"tile": 1}])
def test_join_is_the_same_in_small_blocks(spark, size):
    """Blocks of a few entries, hot columns beside the blocks, and a tile for each document."""
    texts = corpus(4, 90)
    plain = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(frame(spark, texts), 3, 60).collect()}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(frame(spark, texts), 3, 60, **size).collect()} == plain
    assert len(set(plain.values())) < len([t for t in texts if shingles(t, 3)])


@pytest.mark.parametrize("k,percent,size", [(4, 85, {"block_entries": 50}), (5, 80, {"hot_from": 2, "block_entries": 200}), (2, 85, {"block_entries": 100})])
def test_join_sends_the_columns_of_live_documents(spark, monkeypatch, k, percent, size):
    """A sample of columns rules out documents that can't link; the others bring all columns, with the same result."""
    r = random.Random(9)
    texts = corpus(6, 90) + [" ".join(r.choices([f"z{i}" for i in range(5_000)], k=80)) for _ in range(100)]
    sent, blocks = [], ngram_join._column_blocks
    monkeypatch.setattr(ngram_join, "_column_blocks", lambda docs, *a: sent.append(docs.count()) or blocks(docs, *a))
    plain = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(frame(spark, texts), k, percent).collect()}
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(frame(spark, texts), k, percent, **size).collect()}
    assert got == plain and len(set(plain.values())) < len({t for t in texts if shingles(t, k)})
    assert sent[-1] < len(texts) - 90


def passages(texts, least):
    """(doc, start) of every window by its words."""
    seen = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        for s in range(len(w) - least + 1):
            seen.setdefault(tuple(w[s : s + least]), []).append((i, s))
    return seen


@pytest.mark.parametrize("most", [1, 100_000])
def test_first_copies_stay(spark, most):
    """Every word that only later windows cover goes; hot suffixes are split (most = 1) with the same result."""
    r = random.Random(6)
    some = [" ".join(r.choices([f"v{i}" for i in range(50)], k=24)) for _ in range(4)]
    texts = [" ".join(r.choice(some) if r.random() < 0.5 else f"u{i}a u{i}b u{r.randrange(9)}" for _ in range(4)) for i in range(24)]
    texts += [texts[3], None, "", "short text"]
    least = 12
    spans = {(x["doc_id"], x["start_word"], x["end_word"]) for x in suffix_dedup.repeated_passages(frame(spark, texts), least, 4, most_suffixes=most).collect()}
    assert spans == {(x["doc_id"], x["start_word"], x["end_word"]) for x in suffix_dedup.repeated_passages(frame(spark, texts), least, 4, bucket_extents=3).collect()}
    gone = {(i, s + j) for v in passages([t if i != 24 else None for i, t in enumerate(texts)], least).values() for i, s in sorted(v)[1:] for j in range(least)}
    df = frame(spark, texts).withColumn("spans", F.lit("mine"))
    got = {x["doc_id"]: x for x in suffix_dedup.keep_first(df, least, 4, most_suffixes=most).collect()}
    for i, t in enumerate(texts):
        want = "" if i == 24 else " ".join(w for j, w in enumerate(WORD.findall(t or "")) if (i, j) not in gone)
        assert " ".join(WORD.findall(got[i]["text"] or "")) == want and got[i]["spans"] == "mine"
    assert (got[25]["text"], got[26]["text"]) == (None, "")


def test_pseudonyms_are_undone(spark):
    mail = ["".join(str((i * j) % 10) for j in range(1, 43)) + "@x.org" for i in range(1, 5)]
    texts = ["Anna.b7@x.org 4111 1111 1111 1111 2020-02-29 10.0.0.1 123-45-6789 25/12/1999 5/6/2020 05/6/2020 12/31/2020", "+44 20 7946 0958, DE89 3704 0044 0532 0130 00 GB82WEST12345698765432", *mail, "no 31/2/2020 DE88370400440532013000", None, ""]
    df = frame(spark, texts).withColumns({"found": F.lit(1), "new": F.lit("n"), "n_replaced": F.lit("clash")})
    out = pii.pseudonymize(df, "key")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["n_replaced"] == 9 and rows[1]["n_replaced"] == 3 and rows[0]["found"] == 1 and rows[0]["new"] == "n"
    assert len({rows[i]["text"] for i in range(2, 6)}) == 4 and all(len(rows[i]["text"]) == 48 for i in range(2, 6))
    assert rows[6]["n_replaced"] == 0 and rows[0]["text"] != texts[0]
    assert {r["doc_id"]: r["text"] for r in pii.reidentify(out, "key").collect()} == dict(enumerate(texts))
    assert pii.pseudonymize(df.where("false"), "key").count() == 0


def luhn(digits):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(digits))) % 10 == 0


def test_cards_in_long_runs(spark):
    card, other = "4111 1111 1111 1111", "378282246310005"
    cases = {
        f"9999 1234 {card}": [card], f"12 34 56 78 {card}": [card], f"ref 2024 0101 {card}": [card], f"{card} 123 12/26 and more": [card],
        f"7 {card} 12 {other} 2020-02-29 55": [card, other, "2020-02-29"], f"1-2-3 {card}-{card.replace(' ', '-')} 5": [card], "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16": [], "12345678901234567890123": [],
        "11 22 33 44 55 66 77 88 99 11 555 123 4567": ["555 123 4567"],
    }
    got = {r["doc_id"]: r for r in pii.pseudonymize(frame(spark, list(cases)), "k").collect()}
    for i, (text, values) in enumerate(cases.items()):
        new = got[i]["text"]
        assert not [v for v in values if v in new], (text, new)
        assert len(new) == len(text) and (values or new == text) and [c if not c.isdigit() else "0" for c in new] == [c if not c.isdigit() else "0" for c in text], (text, new)
    assert got[4]["n_replaced"] == 2 and luhn(got[0]["text"][10:].replace(" ", "")) and got[0]["text"].startswith("9999 1234 ")
    long = "17 " * 20000 + card + " 5" * 20000
    new = pii.pseudonymize(frame(spark, [long]), "k").first()["text"]
    assert card not in new and new[:60000] == long[:60000] and new[60019:] == long[60019:]


@pytest.mark.parametrize("form", ["d/M/yyyy", "MM/dd/yyyy", "dd/M/yyyy", "yyyy-MM-dd"])
def test_dates_stay_dates_of_their_form(spark, form):
    days = spark.range(0, 146097, 11).select(F.date_format(F.expr("date_add(date'1700-01-01', cast(id as int))"), form).alias("t")).distinct()
    got = days.select("t", pii.pseudonym(F.col("t"), "k").alias("p")).select("t", "p", pii.pseudonym(F.col("p"), "k", True).alias("b"))
    n, distinct, wrong = got.agg(F.count("*"), F.count_distinct("p"), F.count(F.when(~((F.col("t") == F.col("b")) & (F.length("t") == F.length("p"))), 1))).first()
    assert n == distinct and not wrong


def test_national_ids_keep_their_plan(spark):
    ids = spark.range(5000).select(F.format_string("%03d-%02d-%04d", (F.col("id") * 7 % 899 + 1).cast("int"), (F.col("id") % 99 + 1).cast("int"), (F.col("id") % 9999 + 1).cast("int")).alias("t")).where("t not like '666%'").distinct()
    got = ids.select("t", pii.pseudonym(F.col("t"), "k").alias("p"))
    assert got.where(~F.coalesce(F.col("p").rlike(f"^(?:{pii.NATIONAL})\\z"), F.lit(False))).count() == 0
    assert got.select("p").distinct().count() == ids.count()


def test_all_sequences_come_back_as_the_ids(spark, tmp_path):
    """Every task's documents in their order: shards hold the same ids as encode(), and nothing else."""
    texts = corpus(3, 60) + ["x" * 3000, "again", "again"]
    df = frame(spark, texts).withColumns({"number": F.lit(1), "slot": F.lit("x")}).repartition(3)
    df.write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    out = f"file://{tmp_path}/shards"
    rows = token_shards.write_shards(df, tokenizer_path(), "k", out, sequence=16, shard_sequences=8).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(df, tokenizer_path()).collect()}
    held = {}
    for r in rows:
        got = token_shards.read_shard(out, r["shard"], r["slot"] % 8, 1, 16)[0][: r["n_tokens"]].tolist()
        parts, at = [], 0
        for _ in r["doc_ids"]:
            end = got.index(50256, at) + 1 if 50256 in got[at:] else len(got)
            parts.append(tuple(got[at:end]))
            at = end
        assert at == len(got)
        for d, p in zip(r["doc_ids"], parts, strict=True):
            held.setdefault(d, []).append(p)
    for d, want in ids.items():
        assert sorted(t for p in held.get(d, []) for t in p) == sorted([*want, 50256] if want else [])


def test_rates_say_whether_targets_are_met(spark):
    from ledgerloom.llm import mixing

    r = random.Random(1)
    rows = [(r.randint(10, 90), (lambda p: [x / sum(p) for x in p])([r.random() + (3 if i % 4 == j else 0) for j in range(4)])) for i in range(400)]
    df = spark.createDataFrame(rows, "tokens long, posterior array<double>")
    p, t = np.array([x[1] for x in rows]), np.array([x[0] for x in rows], float)
    for shares, reachable in (({"good": 0.4, "low": 0.3, "low_toxic": 0.2, "good_toxic": 0.1}, True), ({"good": 1.0}, False)):
        fit = mixing.fit_rates(df, shares=shares, iterations=25)
        rates = np.array([x[0] for x in df.select(fit.rate()).collect()])
        np.testing.assert_allclose((rates * t) @ p, fit.totals, rtol=1e-6)
        assert (rates >= 0).all() and fit.met == reachable
        if not reachable:
            with pytest.raises(ValueError):
                mixing.fit_rates(df, shares=shares, iterations=3, strict=True)
            target, g = np.array([shares.get(d, 0.0) for d in mixing.DOMAINS]) * t.sum(), np.linalg.inv((p * t[:, None]).T @ p)
            squared = lambda x: ((x * t) @ p - target) @ g @ ((x * t) @ p - target)  # noqa: E731, B023
            assert squared(rates) < 0.5 * squared(np.ones(len(t)))


def least_miss(p, t, target):
    """Least squared miss over nonnegative rates, in the metric of the fit, by active sets (Lawson and Hanson)."""
    root = np.linalg.cholesky(np.linalg.inv((p * t[:, None]).T @ p))
    a, b = root.T @ (p * t[:, None]).T, root.T @ target
    x, held = np.zeros(len(t)), np.zeros(len(t), bool)
    for _ in range(500):
        pull = a.T @ (b - a @ x)
        if held.all() or pull[~held].max() <= 1e-9 * np.abs(a.T @ b).max():
            break
        held[np.flatnonzero(~held)[np.argmax(pull[~held])]] = True
        while True:
            s = np.zeros(len(t))
            s[held] = np.linalg.lstsq(a[:, held], b, rcond=None)[0]
            if s[held].min() > 0:
                break
            down = held & (s <= 0)
            x = x + np.min(x[down] / (x[down] - s[down])) * (s - x)
            held &= x > 1e-12 * x.max()
        x = s
    return float(np.sum((a @ x - b) ** 2))


@pytest.mark.parametrize("many", [7, 300])
def test_rates_against_active_sets(spark, many):
    """Short fits end; what is in reach is met, what is proved out of reach is so, no fit beats the least miss."""
    import time

    from ledgerloom.llm import mixing

    r = np.random.default_rng(many)
    proved = 0
    for sharp, shares in ((1, {"good": 1.0}), (1, {"good": 0.3, "low": 0.3, "low_toxic": 0.2, "good_toxic": 0.2}), (3, {"good": 0.5, "low": 0.5})):
        z = np.exp(r.normal(size=(many, 4)) * sharp)
        p, t = z / z.sum(1, keepdims=True), r.integers(5, 400, many).astype(float)
        df = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p, strict=True)], "tokens long, posterior array<double>").repartition(2)
        began = time.monotonic()
        fit = mixing.fit_rates(df, shares=shares)
        assert time.monotonic() - began < 60 and len(fit.steps) <= 40
        target = np.array([shares.get(d, 0.0) for d in mixing.DOMAINS]) * t.sum()
        metric = np.linalg.inv((p * t[:, None]).T @ p)
        squared = lambda x: float((x - target) @ metric @ (x - target))  # noqa: E731, B023
        least = least_miss(p, t, target)
        assert squared(fit.totals) >= least - 1e-6 * (target @ metric @ target)
        if fit.out_of_reach:
            assert least > 1e-12 * (target @ metric @ target)
            proved += 1
        if least < 1e-9 * squared(t @ p) and sharp == 1:
            assert fit.met
        rates = np.array([x[0] for x in df.select(fit.rate()).collect()])
        assert (rates >= 0).all()
    assert proved


def test_labels_other_than_0_and_1_are_not_used(spark):
    from ledgerloom.llm import mixing

    docs = frame(spark, ["good clean words here", "bad # # $ words", None, "good clean words there"])
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (3, 7, 0), (2, None, 1), (3, 1, -1)], "doc_id long, quality int, toxic int")
    got = mixing.posteriors(docs, labels).collect()
    assert len(got) == 4 and all(abs(sum(r["posterior"]) - 1) < 1e-9 and len(r["posterior"]) == 4 for r in got)


def test_quality_by_form(spark):
    prose = " ".join(f"Wort{i}" for i in range(70)) + "."
    menu = "Start\nProdukte\nKontakt"
    texts = [f"{menu}\n{prose}", f"{prose}\nAlle Rechte vorbehalten.\nThis line stands here twice.\nThis line stands here twice.", f"Start\n{prose}\nKontakt"]
    got = {r["doc_id"]: r["text"] for r in quality.clean(frame(spark, texts).withColumn("verdict", F.lit("v"))).collect()}
    assert got == {0: prose, 1: f"{prose}\nThis line stands here twice.", 2: texts[2]}
    # a number in each word, so that no three words stand twice
    scripts = ["\n".join(line.replace("~", str(i)) for i in range(60)) for line in ("这是~一个完整的句子，说的是天气。", "यह~ एक~ वाक्य~ है~।", "هل~ هذه~ جملة~ كاملة~؟", "文章は~ここで終わります！", "Ça~ va~ bien~ ?")]
    assert {r["doc_id"]: r["text"] for r in quality.clean(frame(spark, scripts), least_words=1).collect()} == dict(enumerate(scripts))
