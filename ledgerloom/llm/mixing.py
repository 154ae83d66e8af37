"""Mixing to target weights with soft membership; DataFrame operations only.

Method. A multinomial logistic classifier, fitted on labelled documents, gives every document a
posterior over the domains (quality x toxic). A document with t tokens and posterior p adds
rate * t * p to the domains' expected tokens. Nonnegative rates are fitted by projected-gradient least
squares so that the totals meet their targets: from rate 1, rate <- max(0, rate - p . u) with
u = G^-1 (totals - targets), G = sum of t p p^T over the documents with a rate above 0. In the metric of
token counts this is a gradient step, exact where no further rate is clipped. If such a step does not lower
the squared miss it is taken back, and from then on G covers all documents, with which every step descends, and steps
carry momentum (Nesterov's, begun anew whenever the miss rises). An iteration is one aggregate of a few sums; the
driver keeps one short vector for each iteration and no document's state. Each pass also gives a proof of how much has
to be missed: no mix of the documents crosses the plane that the present miss defines, moved past the outermost
document. Steps end when the totals meet the targets, when the miss is within 2 % of that least one, when it stops
falling, or after `iterations` passes; Rates.met tells whether targets are met, Rates.out_of_reach whether they are
proved to be beyond any rates, Rates.missed by how much they are missed, and fit_rates(strict=True) fails instead.

The classifier is fitted on at most `most_labelled` labelled rows (those with the smallest hash of
doc_id); everything else covers all rows.

Nulls and edges: null text counts as empty, with 0 tokens: it gets a posterior and a rate but no
weight. Labels that are not 0 or 1 are not used; without labels, or with one class, every document is in
that one domain. Repeated rows count each; in draws, rows of one doc_id (null is one too) share their number. Texts of any length are read whole. Extra columns stay, whatever
their names, but for tokens, posterior and rate, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, bind, discard, materialize, stored, unused

#: Domains by 2 * quality + toxic.
DOMAINS = ("low", "low_toxic", "good", "good_toxic")
MOST_LABELLED, BUCKETS = 20_000, 1 << 13


def _words(text: Column) -> Column:
    core = F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS)))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, WS + "+"))


#: Working columns of the classifier.
_FEATURES = ("words", "size", "marks", "capitals", "distinct")
_ML = ("tf", "shares", "features", "raw", "probability", "class")


def featured(docs: DataFrame, names: dict[str, str], text: str = "text") -> DataFrame:
    """docs with words, their number, and a few shares of characters, under the given names."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    share = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]+", "")) / F.greatest(F.length(t), F.lit(1))
    words = names["words"]
    out = docs.withColumn(words, _words(F.col(f"`{text}`")))
    return out.withColumns({names["size"]: F.size(words).cast("long"), names["marks"]: share("#*$%&|<>!"), names["capitals"]: share("A-Z"), names["distinct"]: F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))})


def _names(docs: DataFrame) -> dict[str, str]:
    return dict(zip((*_FEATURES, *_ML), unused(docs, *(f"_{n}" for n in (*_FEATURES, *_ML))), strict=True))


def labelled_rows(docs: DataFrame, labels: DataFrame, names: dict[str, str], most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Features and `_label` of at most most_labelled labelled documents, as a written table."""
    known = labels.where("quality in (0, 1) and toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("_id"), (2 * F.col("quality") + F.col("toxic")).cast("double").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(most_labelled)
    rows = featured(docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")), names)
    return materialize(rows.select(names["words"], names["marks"], names["capitals"], names["distinct"], "_label"), "labelled")


def fit_classifier(labelled: DataFrame, names: dict[str, str]):
    """A pipeline model over featured() rows; its classes are the places of DOMAINS."""
    n = names
    steps = [
        HashingTF(inputCol=n["words"], outputCol=n["tf"], numFeatures=BUCKETS),
        Normalizer(inputCol=n["tf"], outputCol=n["shares"], p=1.0),
        VectorAssembler(inputCols=[n["shares"], n["marks"], n["capitals"], n["distinct"]], outputCol=n["features"]),
        LogisticRegression(featuresCol=n["features"], labelCol="_label", probabilityCol=n["probability"], predictionCol=n["class"], rawPredictionCol=n["raw"], family="multinomial", maxIter=40, regParam=0.003, aggregationDepth=2),
    ]
    return Pipeline(stages=steps).fit(labelled)


def posteriors(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """docs with `tokens` (words) and `posterior`, an array by DOMAINS."""
    docs = docs.drop("tokens", "posterior")
    names = _names(docs)
    labelled = labelled_rows(docs, labels, names, most_labelled)
    seen = labelled.select(F.col("_label").cast("int").alias("c")).distinct().collect()  # 4 rows at most
    out = featured(docs, names)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    if len(seen) < 2:
        sure = seen[0]["c"] if seen else 0
        return out.select(*keep, F.col(names["size"]).alias("tokens"), F.array(*[F.lit(float(i == sure)) for i in range(len(DOMAINS))]).alias("posterior"))
    model = fit_classifier(labelled, names)
    # one reference only: inside a lambda the whole chain from words to posterior would run again for each class
    posterior = F.slice(F.concat(vector_to_array(names["probability"]), F.array(*[F.lit(0.0)] * len(DOMAINS))), 1, len(DOMAINS))
    return model.transform(out).select(*keep, F.col(names["size"]).alias("tokens"), posterior.alias("posterior"))


@dataclass
class Rates:
    """Fitted steps, each a vector u and a momentum: a document's rate follows from its posterior alone."""

    steps: list[tuple[np.ndarray, float]]
    totals: np.ndarray
    targets: np.ndarray
    met: bool = False
    out_of_reach: bool = False

    @property
    def missed(self) -> float:
        """Sum of the totals' distances from their targets, as a share of all targets."""
        return float(np.abs(self.totals - self.targets).sum() / max(1.0, self.targets.sum()))

    def rate(self, posterior: str = "posterior") -> Column:
        """The rate after all steps as one small expression, whatever their number."""
        if not self.steps:
            return F.lit(1.0)
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in (*u, momentum)]) for u, momentum in self.steps])
        p = F.col(posterior)

        def step(s: Column, u: Column) -> Column:
            return F.struct(_stepped(s["now"], s["before"], [p[i] for i in range(len(DOMAINS))], [u[i] for i in range(len(DOMAINS))], u[len(DOMAINS)]).alias("now"), s["now"].alias("before"))

        return F.aggregate(steps, F.struct(F.lit(1.0).alias("now"), F.lit(1.0).alias("before")), step, lambda s: s["now"])


def _stepped(now: Column, before: Column, p: list[Column], u: list[Column], momentum: Column) -> Column:
    """The projected gradient step from the rate `now`, moved on by its last change."""
    return F.greatest(F.lit(0.0), now + momentum * (now - before) - sum((x * v for x, v in zip(p, u, strict=True)), F.lit(0.0)))


#: Steps after which the fit writes its rates, so that its plan stays short: a pass works out all steps since.
WRITE_EVERY = 4


def fit_rates(rows: DataFrame, factors: dict[str, float] | None = None, shares: dict[str, float] | None = None, iterations: int = 40, tolerance: float = 1e-4, strict: bool = False) -> Rates:
    """Rates for rows (tokens, posterior): totals meet shares of all tokens, or factors of the present totals.

    Ends when the totals are within tolerance of the targets (met), when the miss is proved to be within 2 % of the
    least one, when three steps in a row lower the squared miss by less than 0.5 %, or after so many passes over the
    rows as `iterations`. strict makes anything but met an error.
    """
    k = len(DOMAINS)
    p = [F.col("posterior")[i] for i in range(k)]
    t, now = F.col("tokens").cast("double"), F.col("now")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(rated: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(expected totals, gram over documents with a rate above 0, largest p . w of a document with tokens)."""
        some, along = F.when(now > 0, t), sum((x * F.lit(float(v)) for x, v in zip(p, w, strict=True)), F.lit(0.0))
        *row, far = rated.agg(*[F.sum(now * t * x) for x in p], *[F.sum(some * p[i] * p[j]) for i, j in pairs], F.max(F.when(t > 0, along))).first()
        row = [x or 0.0 for x in row]
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k:], strict=True):
            gram[i, j] = gram[j, i] = x
        return np.array(row[:k]), gram, far or 0.0

    work, path = rows.select("tokens", "posterior", F.lit(1.0).alias("now"), F.lit(1.0).alias("before")), None
    present, whole, _ = sums(work, np.zeros(k))
    if shares is not None:
        targets = np.where(present > 0, np.array([shares.get(d, 0.0) for d in DOMAINS]) * present.sum(), 0.0)
    else:
        targets = np.array([(factors or {}).get(d, 1.0) for d in DOMAINS]) * present
    invert = lambda g: np.linalg.pinv(g, rcond=1e-10, hermitian=True) if g.any() else g
    metric = invert(whole)
    seen = whole @ metric @ targets
    squared = lambda totals: float((totals - targets) @ metric @ (totals - targets))
    got, sure, slow, best, least = Rates([], present, targets), False, 0, squared(present), 0.0
    gram, last, speed, since = whole, present, 1.0, 0
    for _ in range(iterations):
        if got.missed <= tolerance or slow == 3 or (least > 0 and best**0.5 <= 1.02 * least):
            break
        next_speed = (1 + (1 + 4 * speed * speed) ** 0.5) / 2 if sure else 1.0
        momentum = (speed - 1) / next_speed if sure else 0.0
        u = (metric if sure else invert(gram)) @ (got.totals + momentum * (got.totals - last) - targets)
        rated = work.select("tokens", "posterior", _stepped(now, F.col("before"), p, [F.lit(float(x)) for x in u], F.lit(float(momentum))).alias("now"), now.alias("before"))
        against = -metric @ (got.totals - targets)
        totals, active, far = sums(rated, against)
        plane = against - max(far, 0.0)
        if (size := float(plane @ whole @ plane)) > 0:
            least = max(least, float(plane @ seen) / size**0.5)
        miss = squared(totals)
        if miss > best and (momentum or not sure):
            sure, speed = True, 1.0
            continue
        slow = slow + 1 if miss > 0.995 * best else 0
        got.steps.append((u, momentum))
        work, last, got.totals, gram, best, speed, since = rated, got.totals, totals, active, miss, next_speed, since + 1
        if since == WRITE_EVERY:
            work, new = stored(work, "rates")
            if path:
                discard(rows.sparkSession, path)
            since, path = 0, new
    if path:
        discard(rows.sparkSession, path)
    got.met = got.missed <= tolerance
    got.out_of_reach = not got.met and least > 1e-6 * max(1e-300, float(targets @ metric @ targets)) ** 0.5
    if strict and not got.met:
        raise ValueError(f"the targets are missed by {got.missed:.2%} of their sum" + (", and no rates meet them" if got.out_of_reach else ""))
    return got


def mixed(docs: DataFrame, labels: DataFrame, factors: dict[str, float] | None = None, shares: dict[str, float] | None = None, most_labelled: int = MOST_LABELLED, strict: bool = False) -> DataFrame:
    """docs with tokens, posterior and rate; only what the fit needs is written in between."""
    rows = materialize(posteriors(docs.drop("rate"), labels, most_labelled), "posteriors")
    fitted = fit_rates(rows, factors, shares, strict=strict)
    return rows.withColumn("rate", fitted.rate())


def rate_table(docs: DataFrame, labels: DataFrame, shares: dict[str, float], most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, tokens, posterior by domain, rate) for every row of docs."""
    rows = posteriors(docs.select("doc_id", "text"), labels, most_labelled).select("doc_id", "tokens", "posterior")
    rows = materialize(rows, "posteriors")  # without the texts
    rows = rows.withColumn("rate", fit_rates(rows, shares=shares).rate())
    return rows.select("doc_id", "tokens", *[F.round(F.col("posterior")[i], 6).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], F.round("rate", 6).alias("rate"))


def take_by_domain(rows: DataFrame, factors: dict[str, float], seed: str = "mix") -> tuple[DataFrame, list[dict]]:
    """rows (with tokens and posterior) by their most likely domain, and a dict for each domain: present,
    target and reached expected tokens.

    Domains of factor 1 (and those not named) stay, each row once; domains of factor 0 go. Only rows of the
    domains in between are drawn, by a keyed hash of doc_id and the row's own rate: fit_rates gives them rates
    by which those domains' expected tokens, with those of the rows that stay, meet factor x present. A rate
    above 1 counts as 1, as no row is taken twice; reached tells what comes of it.
    """
    k = len(DOMAINS)
    f = np.array([min(1.0, max(0.0, factors.get(d, 1.0))) for d in DOMAINS])
    p = F.col("posterior")
    best = F.array_position(p, F.array_max(p)).cast("int") - 1
    (likely,) = unused(rows, "likely")
    named = rows.withColumn(likely, best)

    def totals_of(df: DataFrame, share: Column) -> np.ndarray:
        """Expected tokens of domain j in the rows of most likely domain i, each row by its share."""
        sums = np.zeros((k, k))
        for r in df.groupBy(likely).agg(*[F.sum(share * F.col("tokens") * p[j]) for j in range(k)]).collect():  # 4 rows at most
            sums[r[0]] = [x or 0.0 for x in r[1:]]
        return sums

    sums = totals_of(named, F.lit(1.0))
    present = sums.sum(axis=0)
    drawn = [i for i in range(k) if 0 < f[i] < 1 and sums[i].any()]
    fixed = sum((f[i] * sums[i] for i in range(k) if i not in drawn), np.zeros(k))
    reached, chance = fixed, F.get(F.array(*[F.lit(float(x)) for x in f]), F.col(likely))
    if drawn:
        some = named.where(F.col(likely).isin(*drawn))
        there = sums[drawn].sum(axis=0)
        wanted = {DOMAINS[i]: float(max(0.0, f[i] * present[i] - fixed[i]) / there[i]) for i in drawn}
        # the other domains have no targets among these rows, so the fit leaves their tokens out
        only = some.withColumn("posterior", F.array(*[p[i] if i in drawn else F.lit(0.0) for i in range(k)]))
        rate = F.least(F.lit(1.0), fit_rates(only, factors=wanted, tolerance=1e-7).rate())
        reached = fixed + totals_of(some, rate).sum(axis=0)
        chance = F.when(F.col(likely).isin(*drawn), rate).otherwise(chance)
    unit = F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    out = named.where(F.coalesce(unit, F.lit(0.0)) < chance)
    totals = [{"domain": d, "present": present[i], "target": f[i] * present[i], "reached": float(reached[i])} for i, d in enumerate(DOMAINS)]
    return out.drop(likely, "tokens", "posterior"), totals


def take_by_rate(rows: DataFrame, seed: str = "mix") -> DataFrame:
    """Each row as often as its rate says: the whole part, and once more by a keyed hash of doc_id with the
    chance of the fraction, so that expected totals are the fitted ones. tokens, posterior and rate go."""
    unit = F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    (copy,) = unused(rows, "copy")
    times = lambda r: (F.floor(r) + F.when(unit < r - F.floor(r), 1).otherwise(0)).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), bind(F.col("rate"), times)))).drop(copy, "tokens", "posterior", "rate")
