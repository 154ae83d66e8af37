"""Price models against closed forms: ridge fits, folds by Gram matrices, refits per fold, blends and gates, weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.operators import gram, metrics, model

FEATURES = ["a", "b", "c"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(2)
    n = 600
    a, b, w = r.normal(50, 9, n), r.gamma(2, 3, n), r.uniform(0.5, 2, n)
    price = np.exp(4 + 0.03 * a - 0.1 * b + r.normal(0, 0.2, n))
    data = [(i, float(a[i]) if i % 11 else None, float(b[i]), 3.0, float(price[i]) if i % 97 else None, float(w[i])) for i in range(n)]
    return spark.createDataFrame(data, "key long, a double, b double, c double, price double, w double"), data


def closed_form(data, reg=1e-3, weighted=True):
    own = [x for x in data if x[4] is not None]
    x = np.array([[v or 0.0 for v in row[1:4]] for row in own])
    y, w = np.log1p([row[4] for row in own]), np.array([row[5] if weighted else 1.0 for row in own])
    w = w / w.sum()
    mx, my = w @ x, w @ y
    sx, sy = np.sqrt(w @ (x - mx) ** 2), np.sqrt(w @ (y - my) ** 2)
    live = sx > 1e-9
    z = (x - mx)[:, live] / sx[live]
    b = np.zeros(3)
    b[live] = np.linalg.solve((z * w[:, None]).T @ z + reg / sy * np.eye(live.sum()), (z * w[:, None]).T @ ((y - my) / sy)) * sy / sx[live]
    return lambda row: np.expm1(my - b @ mx + b @ np.array([v or 0.0 for v in row[1:4]]))


@pytest.mark.parametrize("weight", [None, "w"])
def test_ridge_is_the_closed_form(rows, weight):
    df, data = rows
    m = model.fit_price_model(df, FEATURES, "price", weight)
    want = closed_form(data, weighted=weight is not None)
    for x in model.score_batch(m, df, FEATURES).collect():
        assert x["prediction"] == pytest.approx(want(data[x["key"]]), rel=1e-5)


def made_folds(df):
    """Walk-forward and shuffled folds with gaps: rows train in some, are scored in some, or take no part."""
    k = F.col("key")
    parts = [df.select(F.lit(f).alias("fold"), "key", F.when(k < 150 * f, "train").when((k >= 150 * f + 20) & (k < 150 * f + 150), "val").otherwise("gap").alias("role")) for f in (1, 2, 3)]
    parts += [df.select(F.lit(10 + f).alias("fold"), "key", F.when(k % 3 == f, "val").otherwise("train").alias("role")) for f in (0, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pytest.mark.parametrize("weight", [None, "w"])
def test_folds_by_gram_equal_separate_fits(rows, weight):
    df, data = rows
    folds = made_folds(df)
    role = {(r["fold"], r["key"]): r["role"] for r in folds.collect()}
    got = model.cross_validate_ridge(df, folds, "key", FEATURES, "price", weight).collect()
    assert len(got) == sum(v == "val" for v in role.values())
    for f in (1, 2, 3, 10, 11):
        want = closed_form([x for x in data if role[f, x[0]] == "train"], weighted=weight is not None)
        own = [x for x in got if x["fold"] == f]
        assert own and all(x["prediction"] == pytest.approx(want(data[x["key"]]), rel=1e-7) for x in own)
    slow = model.cross_validate(df, folds.where("fold in (2, 10)"), "key", FEATURES, "price", weight)
    by = {(x["fold"], x["key"]): x["prediction"] for x in got}
    assert all(by[x["fold"], x["key"]] == pytest.approx(x["prediction"], rel=1e-5) for x in slow.collect())


def test_prepare_sees_training_rows_only(rows):
    df, _ = rows
    folds = made_folds(df).where("fold = 2")
    seen = []

    def prepare(train, part):
        seen.append((train.agg(F.max("key")).first()[0], part.agg(F.min("key")).first()[0]))
        return part.join(F.broadcast(train.agg(F.avg("b").alias("mean_b")))).withColumn("b", F.col("b") - F.col("mean_b")).drop("mean_b")

    a = model.cross_validate(df, folds, "key", FEATURES, "price", prepare=prepare).collect()
    assert seen == [(299, 0), (299, 320)]
    b = {x["key"]: x["prediction"] for x in model.cross_validate(df, folds, "key", FEATURES, "price").collect()}
    assert all(x["prediction"] == pytest.approx(b[x["key"]], rel=1e-6) for x in a)  # a shift changes no ridge prediction


def test_boosted_arm_beats_the_mean_and_seeds_average(rows):
    df, data = rows
    df = df.where("price is not null")
    one, two = (model.fit_price_model(df, FEATURES, "price", "w", kind="boosted", seed=s) for s in (1, 2))
    p = [{r["key"]: r["prediction"] for r in model.score_batch(m, df, FEATURES).collect()} for m in (one, two)]
    y = {x[0]: x[4] for x in data if x[4] is not None}
    mean = np.mean(list(y.values()))
    assert sum((p[0][k] - v) ** 2 for k, v in y.items()) < 0.4 * sum((mean - v) ** 2 for v in y.values())
    got = model.seed_average([one, two], df, FEATURES).collect()
    assert all(r["prediction"] == pytest.approx((p[0][r["key"]] + p[1][r["key"]]) / 2) for r in got)


def test_blend_gates(spark):
    df = spark.createDataFrame([(100.0, 120.0, True), (100.0, 140.0, True), (1000.0, 1301.0, True), (1000.0, 1300.0, True), (100.0, 120.0, False), (100.0, None, True)], "a double, b double, g boolean")
    assert [r["o"] for r in model.blend_two(df, "a", "b", 0.25, "o", F.col("g")).collect()] == [105.0, 100.0, 1000.0, 1075.0, 100.0, 100.0]


def test_domain_weights_follow_the_densities(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, 3000), r.normal(1, 1, 3000)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "key long, x double")
    train, test = df.where("key < 3000"), df.where("key >= 3000")
    # two unit normals one apart: the area is Phi(1 / sqrt 2) = 0.760, the odds are exp(x - 1/2)
    assert model.adversarial_auc(train, test, ["x"]).first()["auc"] == pytest.approx(0.760, abs=0.015)
    got = model.domain_importance_weights(train, test, ["x"], clip=(0.2, 5.0)).collect()
    want = [min(5.0, max(0.2, np.exp(v["x"] - 0.5))) for v in got]
    assert np.median(np.abs(np.log([v["domain_weight"] for v in got]) - np.log(want))) < 0.12


def test_correlations_of_many_columns(spark):
    r = np.random.default_rng(6)
    k = 500
    x = r.normal(size=(300, k)) + 1e4
    x[:, 1] = x[:, 0] * 2 + r.normal(size=300)
    x[:, 2] = 7.0
    x[r.random(x.shape) < 0.05] = np.nan
    df = spark.createDataFrame([[None if v != v else float(v) for v in row] for row in x], ", ".join(f"`c.{i}` double" for i in range(k))).repartition(3)
    got = {(v["x"], v["y"]): v["corr"] for v in gram.pair_correlations(df, [f"c.{i}" for i in range(k)]).collect()}
    assert len(got) == k * (k - 1) // 2
    for i, j in ((0, 1), (0, 2), (3, 499), (63, 64), (100, 400)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        value = got[f"c.{i}", f"c.{j}"]
        assert value is None if j == 2 else value == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-7)


def test_median_blend_applies_what_it_fitted(spark):
    """Truth is 80 % prediction and 20 % median; a null median leaves the prediction; of equal weights the smaller wins."""
    r = np.random.default_rng(3)
    p, m = r.uniform(100, 900, 200), r.uniform(100, 900, 200)
    rows = [(float(0.8 * a + 0.2 * b), float(a), float(b), 1.0) for a, b in zip(p, m, strict=True)]
    df = spark.createDataFrame([*rows, (50.0, 60.0, None, 2.0)], "y double, p double, m double, w double")
    fitted = metrics.fit_median_blend(df, "y", "p", "m", "w")
    by = {round(x["lam"], 2): x["wmae"] for x in fitted.collect()}
    for lam, got in by.items():
        want = sum(w * abs(a + lam * ((a if b is None else b) - a) - y) for y, a, b, w in [*rows, (50.0, 60.0, None, 2.0)]) / 202.0
        assert got == pytest.approx(want)
    assert min(by, key=by.get) == 0.2
    for x in metrics.apply_median_blend(df, fitted, "p", "m", "o").collect():
        assert x["o"] == pytest.approx(x["p"] if x["m"] is None else 0.8 * x["p"] + 0.2 * x["m"])
    flat = spark.createDataFrame([(5.0, 7.0, None, 1.0)], "y double, p double, m double, w double")
    assert metrics.apply_median_blend(flat, metrics.fit_median_blend(flat, "y", "p", "m", "w"), "p", "m", "o").first()["o"] == 7.0


def test_statistics_read_their_rows_once(spark):
    """Each statistic of these queries reads rows written once, not the joins of the tables again; ridge has no joins for each fold."""
    q = catalog.queries()
    plan = lambda name: q[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("f4_audit_filters", "o4_outlier_mask", "o5_outlier_report", "o7_support_vote_outliers"):
        assert "parquet" not in plan(name)
    assert plan("l3_cross_validate").count("Join") < 12
