"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs. A word's input is the sum of a learned vector of the word and the scaled sum of learned vectors of its
character grams (2 to 6 code points, with marks at both ends), all hashed. Words are the runs of letters, digits
and marks other than white space, lower-cased; a slice's distinct words get their inputs once.

Scoring. A text is read in overlapping windows of WINDOW words, every STRIDE, the last one at the text's end, so all
words of a text of any length are read in both directions, and a third of a window in the next one again. All windows of a slice go
through the network side by side; attention pools the states of a window to its logit. A text's score is a logistic
function of its windows' logits: the largest, the second largest, their mean and the logarithm of their number.

Training. Labels come from at most MOST_TOXIC + MOST_CLEAN rows and MOST_CHARS characters of whole texts, the
first by a hash of doc_id, so the sample and its cost are bounded whatever the corpus; the network is fitted on four
fifths of it by Adam on a soft maximum over a text's windows, the logistic function on the last fifth. The classes are
weighted by their numbers. Training runs on the driver on one thread, on this bounded sample only; the weights (some MB, a
fixed size) go to the tasks. Everything is seeded, so two runs over one table give the same scores.

Edges. Null and empty texts, and such without words, score the share of toxic labels; repeated rows score alike; a null doc_id is never a training row and not held out. Without any label of both
classes every score is the share of toxic labels (0 without labels). Columns beside doc_id and text are not read. An
empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import U64, mix, slices

#: Words of a window, and words from one window's begin to the next one's.
WINDOW, STRIDE = 48, 32
#: Size of an input, of a direction's state and of the attention's hidden layer; buckets of words and of grams.
INPUT, STATE, ATTEND, BUCKETS = 20, 16, 12, 1 << 15
#: Bounds of the labelled sample.
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1000, 1600, 5_000_000
#: Windows that go through the network at once.
BLOCK = 1024
#: Preactivation with which a gate keeps the state as it is (of a place after a text's end).
KEEP = 30.0
#: Passes over the sample, least and most windows of a step (a longer text is a step of its own), steps of a pass
#: between these, rate of the first steps.
EPOCHS, BATCH, STEPS, RATE = 5, (24, 600), 80, 0.004
_WORDS = r"[\p{L}\p{N}\p{M}'’]+"


def _f(x) -> np.ndarray:
    return np.asarray(x, np.float32)


class Words:
    """Words of a list of texts: numbers of the distinct words, and for these the buckets of word and grams."""

    def __init__(self, texts: pa.Array) -> None:
        import regex

        find = regex.compile(_WORDS).findall
        known: dict[str, int] = {}
        ids, counts = [], []
        for t in texts.to_pylist():
            own = find(t.lower()) if t else []
            ids.extend([known.setdefault(w, len(known)) for w in own])
            counts.append(len(own))
        self.ids = np.array(ids, np.int64)
        self.offs = np.append(0, np.cumsum(counts)).astype(np.int64)
        self.distinct = list(known)

    def buckets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each distinct word, buckets of all their grams, where each word's grams begin, with the end)."""
        sizes = np.array([len(w) + 2 for w in self.distinct], np.int64)
        points = np.frombuffer("".join(f"^{w}$" for w in self.distinct).encode("utf-32-le"), np.uint32).astype(U64)
        starts = np.append(0, np.cumsum(sizes))
        word_of = np.repeat(np.arange(len(sizes)), sizes)
        rest = starts[word_of + 1] - np.arange(len(points))  # code points up to the word's end
        hashed, at, of = np.zeros(len(points), U64), [], []
        for k in range(1, 7):
            ok = np.flatnonzero(rest >= k)
            hashed[ok] = mix(hashed[ok] * U64(31) + points[ok + k - 1] + U64(k))
            if k >= 2:
                at.append((hashed[ok] % U64(BUCKETS)).astype(np.int64))
                of.append(word_of[ok])
        at, of = np.concatenate(at), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        word = np.array([zlib.crc32(w.encode()) % BUCKETS for w in self.distinct], np.int64)
        return word, at[order], np.searchsorted(of[order], np.arange(len(sizes) + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of a distinct word for each place of each window, -1 after a text's end; text of each window)."""
        counts = np.diff(self.offs)
        n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(counts)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.minimum(k * STRIDE, np.maximum(0, counts[doc] - WINDOW))
        place = begin[:, None] + np.arange(WINDOW)
        at = np.minimum(self.offs[doc][:, None] + place, max(0, len(self.ids) - 1))
        return np.where(place < counts[doc][:, None], self.ids[at] if len(self.ids) else -1, -1), doc


class Network:
    """Weights, forward pass, gradients. Gates in the order reset, update, candidate."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s, by: _f(rng.normal(size=s) * by)
        self.p = {
            "word": draw(BUCKETS, INPUT, by=0.05), "gram": draw(BUCKETS, INPUT, by=0.05),
            "wx": draw(2, INPUT, 3 * STATE, by=INPUT**-0.5), "wh": draw(2, STATE, 3 * STATE, by=STATE**-0.5), "bx": np.zeros((2, 1, 3 * STATE), np.float32),
            "wa": draw(2 * STATE, ATTEND, by=(2 * STATE) ** -0.5), "va": draw(ATTEND, by=ATTEND**-0.5), "wo": draw(2 * STATE, by=(2 * STATE) ** -0.5), "bo": _f([-2.0]),
        }
        self.head = HEAD

    def inputs(self, word: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Input of each distinct word."""
        if not len(word):
            return np.zeros((0, INPUT), np.float32)
        by_part = np.ascontiguousarray(self.p["gram"].T)  # a part at a time, as a part's column stays in the cache
        total = np.stack([np.add.reduceat(part[grams], first[:-1]) for part in by_part], axis=1)
        return self.p["word"][word] + total * _f(np.diff(first) ** -0.5)[:, None]

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of both directions; the last row is that of no word."""
        out = np.empty((2, len(x) + 1, 3 * STATE), np.float32)
        out[:, :-1] = np.matmul(x, self.p["wx"]) + self.p["bx"]
        out[:, -1] = 0
        out[:, -1, STATE : 2 * STATE] = KEEP
        return out

    def forward(self, proj: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of the windows; keep: also what the gradients need."""
        n, s, p = len(ids), STATE, self.p
        h = np.zeros((2, n, s), np.float32)
        states = np.empty((2, WINDOW, n, s), np.float32)
        held = []
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            g = np.stack([proj[0][ids[:, t]], proj[1][ids[:, back]]])
            u = np.matmul(h, p["wh"])
            gates = g[..., : 2 * s] + u[..., : 2 * s]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            r, z = gates[..., :s], gates[..., s:]
            c = np.tanh(g[..., 2 * s :] + r * u[..., 2 * s :])
            new = c + z * (h - c)
            if keep:
                held.append((h, r, z, c, u[..., 2 * s :]))
            h = new
            states[0, t], states[1, back] = h[0], h[1]
        both = np.concatenate([states[0], states[1]], axis=2)
        hidden = np.tanh(both @ p["wa"])
        e = hidden @ p["va"]
        e[(ids < 0).T] = -1e9
        e -= e.max(axis=0)
        a = np.exp(e)
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tns->ns", a, both)
        logits = pooled @ p["wo"] + p["bo"]
        return (logits, (held, both, hidden, a, pooled)) if keep else logits

    def gradients(self, proj: np.ndarray, ids: np.ndarray, x: np.ndarray, kept, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense weights and of the inputs of the distinct words, for d(loss)/d(logits)."""
        held, both, hidden, a, pooled = kept
        p, s, n = self.p, STATE, len(ids)
        out = {"wo": pooled.T @ d, "bo": _f([d.sum()])}
        d_pool = d[:, None] * p["wo"]
        d_a = np.einsum("ns,tns->tn", d_pool, both)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        d_hid = d_e[..., None] * p["va"] * (1 - hidden**2)
        out["va"] = np.einsum("tn,tnk->k", d_e, hidden)
        out["wa"] = both.reshape(-1, 2 * s).T @ d_hid.reshape(-1, ATTEND)
        d_both = a[..., None] * d_pool + d_hid @ p["wa"].T
        d_h = np.zeros((2, n, s), np.float32)
        d_proj = np.zeros_like(proj)
        out["wh"] = np.zeros_like(p["wh"])
        wh_t = np.swapaxes(p["wh"], 1, 2)
        gate = np.empty((2, WINDOW, n, 3 * s), np.float32)
        for t in reversed(range(WINDOW)):
            back = WINDOW - 1 - t
            h, r, z, c, uc = held[t]
            d_h[0] += d_both[t, :, :s]
            d_h[1] += d_both[back, :, s:]
            d_c = d_h * (1 - z) * (1 - c**2)
            d_z = d_h * (h - c) * z * (1 - z)
            d_r = d_c * uc * r * (1 - r)
            up = np.concatenate([d_r, d_z, d_c * r], axis=2)
            out["wh"] += np.matmul(np.swapaxes(h, 1, 2), up)
            d_h = d_h * z + np.matmul(up, wh_t)
            gate[0, t], gate[1, back] = np.concatenate([d_r, d_z, d_c], axis=2)
        flat = ids.T.ravel()
        used = flat >= 0
        order = np.argsort(flat[used], kind="stable")
        at = flat[used][order]
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        for k in (0, 1):
            d_proj[k][at[begins]] = np.add.reduceat(gate[k].reshape(-1, 3 * s)[used][order], begins, axis=0)
        real = d_proj[:, :-1]
        out["bx"] = real.sum(axis=1, keepdims=True)
        out["wx"] = np.stack([x.T @ real[k] for k in (0, 1)])
        return out, real[0] @ p["wx"][0].T + real[1] @ p["wx"][1].T

    def logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(logit, text) of every window."""
        ids, doc = words.windows()
        if not len(ids):
            return np.zeros(0, np.float32), doc
        proj = self.projected(self.inputs(*words.buckets()))
        return np.concatenate([self.forward(proj, ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]), doc

    def features(self, texts: pa.Array) -> np.ndarray:
        """What the score depends on, for each text; nan without words."""
        n = len(texts)
        logit, doc = self.logits(Words(texts))
        out = np.full((n, 5), np.nan)
        out[:, 0] = 1
        if len(logit):
            order = np.lexsort((-logit, doc))
            logit, doc = logit[order].astype(float), doc[order]
            count = np.bincount(doc, minlength=n)
            first = np.cumsum(count) - count
            some, more = count > 0, count > 1
            out[some, 1] = logit[first[some]]
            out[some, 2] = logit[first[some] + more[some]]
            out[some, 3] = np.bincount(doc, logit, n)[some] / count[some]
            out[some, 4] = np.log(count[some])
        return out

    def scores(self, texts: pa.Array, empty: float = 0.0) -> np.ndarray:
        """Score of each text; empty: that of a text without words."""
        x = self.features(texts)
        return np.where(np.isnan(x[:, 1]), empty, 1 / (1 + np.exp(-np.clip(x @ self.head, -40, 40))))


#: What a head without rows to learn from is: bias, largest logit, second, mean, logarithm of the number.
HEAD = np.array([0.0, 0.7, 0.1, 0.1, -0.2])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps, its slopes drawn to HEAD and held to zero or more but for the last (more windows may count either way)."""
    free = np.ones(x.shape[1], bool)
    b = np.zeros(x.shape[1])
    for _ in range(x.shape[1]):
        b = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            g = x.T @ (w * (p - y)) + penalty * np.append(0, (b - HEAD)[1:])
            h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.diag([1e-3, 1, 1, 1, 1])
            step = np.zeros(len(b))
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            b -= step
            if np.abs(step).max() < 1e-7:
                break
        wrong = (b < 0) & free & np.array([False, True, True, True, False])
        if not wrong.any():
            break
        free &= ~wrong
    return b


def train(texts: list[str], labels: np.ndarray, share: float, seed: int = 7) -> Network:
    """The network and its head, fitted on whole texts. share: of toxic ones among all labelled, which the
    score's level follows."""
    rng = np.random.default_rng(seed)
    net, order = Network(seed), rng.permutation(len(texts))
    texts, labels = [texts[i] for i in order], labels[order].astype(np.float32)
    last = np.arange(len(texts)) % 5 == 4
    first = np.flatnonzero(~last)
    if not 0 < labels[first].sum() < len(first):
        first = np.arange(len(texts))
    words = Words(pa.array([texts[i] for i in first], pa.string()))
    word, grams, starts = words.buckets()
    ids, doc = words.windows()
    y = labels[first]
    by = np.append(np.searchsorted(doc, np.arange(len(y))), len(doc))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, size = 0, min(max(BATCH[0], len(doc) // STEPS), BATCH[1])
    for epoch in range(EPOCHS):
        mixed = rng.permutation(len(y))
        steps = np.split(mixed, np.flatnonzero(np.diff(np.cumsum(np.diff(by)[mixed]) // size)) + 1)
        for place, part in enumerate(steps):
            rows = np.concatenate([np.arange(by[i], by[i + 1]) for i in np.sort(part)])
            if not len(rows):
                continue
            own, back = np.unique(ids[rows], return_inverse=True)
            none = int(own[0] < 0)
            back = back.reshape(len(rows), WINDOW) - none
            own = own[none:]
            lens = starts[own + 1] - starts[own]
            begin = np.append(0, np.cumsum(lens))
            flat = grams[np.repeat(starts[own] - begin[:-1], lens) + np.arange(begin[-1])]
            drop = (rng.random(len(own)) < 0.9)[:, None]  # a word is left out now and then, so none is learned by heart
            x = net.inputs(word[own], flat, begin) * drop
            proj = net.projected(x)
            logit, kept = net.forward(proj, back, keep=True)
            who = np.sort(part)
            of = np.searchsorted(who, doc[rows])
            top = np.full(len(who), -np.inf, np.float32)
            np.maximum.at(top, of, logit)
            soft = np.exp(logit - top[of])
            soft /= np.bincount(of, soft, len(who))[of]
            z = np.bincount(of, soft * logit, len(who))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[who]) * weight[who] / len(who)
            d = _f(err[of] * soft)
            grad, dx = net.gradients(proj, back, x, kept, d)
            dx *= drop
            step += 1
            rate = RATE * min(1.0, step / 20) * (1 - 0.9 * (epoch + place / len(steps)) / EPOCHS)
            for name, v in grad.items():
                m1[name] += 0.1 * (v - m1[name])
                m2[name] += 0.01 * (v * v - m2[name])
                net.p[name] -= _f(rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-7))
            for name, at, value in (("word", word[own], dx), ("gram", flat, np.repeat(dx * _f(lens**-0.5)[:, None], lens, axis=0))):
                o = np.argsort(at, kind="stable")
                b = np.flatnonzero(np.diff(at[o], prepend=-1))
                rows_ = at[o][b]
                v = np.add.reduceat(value[o], b, axis=0)
                m2[name][rows_] += v * v  # sparse rows: AdaGrad
                net.p[name][rows_] -= _f(8 * rate * v / (np.sqrt(m2[name][rows_]) + 1e-7))
    held = np.flatnonzero(last) if 0 < labels[last].sum() < last.sum() else np.arange(len(texts))
    x, t = net.features(pa.array([texts[i] for i in held], pa.string())), labels[held]
    x, t = x[~np.isnan(x[:, 1])], t[~np.isnan(x[:, 1])]
    level = np.where(t == 1, share / max(1, t.sum()), (1 - share) / max(1, (1 - t).sum())) * len(t)
    net.head = _logistic(x, t, level)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, use: Column, key: str = "doc_id", target: str = "toxic") -> tuple[list[str], np.ndarray, float]:
    """(whole texts, labels, share of toxic ones among all usable labels): the bounded sample of the module's docstring.

    use: which rows may be learned from."""
    usable = labels.where(use & F.col(target).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(target).alias("_y"))
    n = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    hashed = F.xxhash64(F.col(key).cast("string"))
    # of each class the first by hash: TakeOrdered, so no more than the bound reaches the driver
    first = [r[key] for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)) for r in usable.where(F.col("_y") == y).orderBy(hashed, key).limit(most).select(key).collect()]
    chosen = docs.sparkSession.createDataFrame([(k,) for k in first], f"{key} {dict(labels.dtypes)[key]}")
    own = docs.select(key, "text").join(F.broadcast(chosen), key, "left_semi")  # at most MOST_TOXIC + MOST_CLEAN rows
    sizes = own.select(key, F.coalesce(F.length("text"), F.lit(0)).alias("_n")).groupBy(key).agg(F.min("_n").alias("_n")).join(F.broadcast(usable.join(F.broadcast(chosen), key, "left_semi")), key).orderBy(hashed, key).collect()
    keep, total = {}, 0
    for r in sizes:
        total += r["_n"]
        if total <= MOST_CHARS:
            keep[r[key]] = r["_y"]
    few = docs.sparkSession.createDataFrame([(k,) for k in keep], f"{key} {dict(labels.dtypes)[key]}")
    got = own.join(F.broadcast(few), key, "left_semi").groupBy(key).agg(F.min("text").alias("text")).orderBy(hashed, key).collect()
    return [r["text"] or "" for r in got], np.array([keep[r[key]] for r in got], np.int64), share


def score(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; rows whose crc32(doc_id as text) mod 4 is 2 are held
    out, the others may be learned from."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    texts, y, share = labelled_sample(docs, labels, remainder != 2)
    net = train(texts, y, share) if 0 < y.sum() < len(y) else None
    shared = docs.sparkSession.sparkContext.broadcast((net, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, level = shared.value
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                text = pc.fill_null(part.column("text"), "")
                got = model.scores(text, level) if model else np.full(len(text), level)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got.astype(float)), part.column("held_out")], ["doc_id", "score", "held_out"])

    rows = docs.select("doc_id", "text", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"))
    got = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, held_out boolean")
    return got.select("doc_id", "held_out", "score", (F.col("score") >= limit).cast("int").alias("predicted"))
