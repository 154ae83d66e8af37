"""Toxicity: the network against a plain version, its gradients, held-out accuracy, edges."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import registry, toxicity
from ledgerloom.llm.toxicity import ATTEND, STATE, STRIDE, WINDOW, Network, Words


def plain_logit(net, xs):
    """One window's logit, word by word. xs: inputs of its words."""
    p, sig = net.p, lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((len(xs), 2 * STATE))
    for k, order in ((0, range(len(xs))), (1, range(len(xs) - 1, -1, -1))):
        h = np.zeros(STATE)
        for t in order:
            g, u = xs[t] @ p["wx"][k] + p["bx"][k][0], h @ p["wh"][k]
            r, z = sig(g[:STATE] + u[:STATE]), sig(g[STATE : 2 * STATE] + u[STATE : 2 * STATE])
            h = (1 - z) * np.tanh(g[2 * STATE :] + r * u[2 * STATE :]) + z * h
            states[t, k * STATE : (k + 1) * STATE] = h
    e = np.tanh(states @ p["wa"]) @ p["va"]
    a = np.exp(e - e.max())
    return float((a / a.sum()) @ states @ p["wo"] + p["bo"][0])


@pytest.mark.parametrize("n", [1, 5, WINDOW - 1, WINDOW, WINDOW + 1, WINDOW + STRIDE, 3 * WINDOW + 7])
def test_forward_is_the_plain_network(n):
    net = Network(3)
    rng = random.Random(n)
    text = " ".join("".join(rng.choice("abcdéß") for _ in range(rng.randrange(1, 12))) for _ in range(n))
    words = Words(pa.array(["", text, None, "other words here"]))
    logit, doc = net.logits(words)
    x = net.inputs(*words.buckets())[words.ids[words.offs[1] : words.offs[2]]]
    begins = sorted({*range(0, max(1, n - WINDOW + 1), STRIDE), max(0, n - WINDOW)})
    want = [plain_logit(net, x[b : b + WINDOW]) for b in begins]
    np.testing.assert_allclose(sorted(logit[doc == 1]), sorted(want), rtol=2e-4, atol=2e-4)
    assert set(range(n)) == {i for b in begins for i in range(b, min(n, b + WINDOW))}  # every word is in a window
    assert (doc == 0).sum() == 0 and (doc == 2).sum() == 0 and (doc == 3).sum() == 1


def test_gradients():
    net, rng = Network(5), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = Words(pa.array(["one two three one four", "five six " * 40]))
    ids, _ = words.windows()
    d = rng.normal(size=len(ids))

    def loss(x):
        return float(net.forward(net.projected(x), ids) @ d)

    x = net.inputs(*words.buckets()).astype(float)
    proj = net.projected(x)
    _, kept = net.forward(proj, ids, keep=True)
    grads, dx = net.gradients(proj, ids, x, kept, d)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in net.p[name].shape)
            old, e = net.p[name][at], 2e-3
            net.p[name][at] = old + e
            up = loss(x)
            net.p[name][at] = old - e
            down = loss(x)
            net.p[name][at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 5e-3 * max(1, abs(g[at])), name
    for _ in range(6):
        at = tuple(rng.integers(0, s) for s in x.shape)
        y, z = x.copy(), x.copy()
        y[at] += 2e-3
        z[at] -= 2e-3
        assert abs((loss(y) - loss(z)) / 4e-3 - dx[at]) < 5e-3 * max(1, abs(dx[at]))
    assert ATTEND > 0


def made(n=700, seed=4):
    """Texts with labels: toxic ones hold words that begin with a certain pair of syllables, or listed words."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ne", "tu", "ra", "so", "vi"]
    plain = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        words = [plain() for _ in range(rng.choice([6, 30, 80, 300]))]
        if bad:
            for _ in range(max(3, len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(["zarko" + plain(), "grumpf", "blitzer"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_learns_and_holds_out(spark):
    rows = made()
    # held-out rows carry wrong labels: learning from them would show
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, i % 2) for i, _, y in rows]
    docs = spark.createDataFrame([(i, t, "src", y) for i, t, y in rows], "doc_id long, text string, score string, predicted int").repartition(5)
    labels = spark.createDataFrame(wrong, "doc_id long, toxic int, text int")
    got = toxicity.score(docs, labels).collect()
    y = {i: v for i, _, v in rows}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) and {r["doc_id"] for r in held} == {i for i in y if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["predicted"] == y[r["doc_id"]] for r in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs.repartition(3), labels.repartition(2)).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-4 for r in got)


def test_edges(spark):
    rows = made(120)
    odd = [(None, "grumpf grumpf"), (1000, None), (1001, ""), (1002, " ,;. "), (1003, rows[0][1]), (1003, rows[0][1]), (1004, "kalomi grumpf " * 30_000)]
    docs = spark.createDataFrame([r[:2] for r in rows] + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (1000, 7)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["score"] == by[1001]["score"] == by[1002]["score"] and not by[None]["held_out"]
    a, b = (r["score"] for r in got if r["doc_id"] == 1003)
    assert a == b
    none = toxicity.score(docs, labels.where("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["score"], y[r["doc_id"]], r["predicted"]) for r in registry.op11_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in y]
    assert len(got) > 900
    assert sum(p == t for _, t, p in got) >= 0.95 * len(got)  # 88 % are clean
    toxic, clean = [s for s, t, _ in got if t], [s for s, t, _ in got if not t]
    assert sum(s > c for s in toxic for c in clean) >= 0.93 * len(toxic) * len(clean)
    assert sum(p for _, t, p in got if t) >= 0.8 * len(toxic) and sum(p for _, t, p in got if not t) <= 0.04 * len(clean)
