"""Exact quantiles with brackets, as-of joins over days, holdouts, blends, folds and queries without SQL."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.operators import filters, joins, marts, metrics, quantiles, splits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("direct", [0, 10**6])
@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_equal_numpy(spark, by, direct, monkeypatch):
    """Brackets of a few values (accuracy 20) or one aggregate, ties, nulls, a null group and a group without values."""
    monkeypatch.setattr(quantiles, "MOST_DIRECT", direct)
    r = np.random.default_rng(3)
    rows = [(["a", "b", None][i % 3], None if i % 7 == 0 else float(r.integers(0, 400)) if i % 2 else 200.0) for i in range(1200)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {f"p{i}": (F.col("v"), p) for i, p in enumerate((0.0, 0.25, 0.5, 0.8, 0.995, 1.0))}
    got = quantiles.quantiles(df, by, wanted, {"n": F.count("*")}, accuracy=20).collect()
    assert len(got) == (4 if by else 1)
    for x in got:
        own = [v for g, v in rows if not by or g == x["g"]]
        v = [y for y in own if y is not None]
        assert x["n"] == len(own)
        for n, (_, p) in wanted.items():
            assert x[n] == (pytest.approx(np.quantile(v, p)) if v else None)


def test_asof_looks_up_times_of_a_day(spark):
    at = lambda h, d=1: dt.datetime(2020, 1, d, h)
    right = spark.createDataFrame([("a", at(3), 1.0), ("a", at(9), 2.0), ("a", at(1, 3), 3.0), (None, at(1), 9.0)], "g string, t timestamp, v double")
    left = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate([("a", at(3)), ("a", at(8)), ("a", at(2)), ("a", at(5, 2)), ("a", at(5, 9)), ("b", at(9)), (None, at(9)), ("a", None), ("a", at(8))])], "i int, g string, t timestamp")
    f = lambda strict: [r["v"] for r in joins.asof_join(left, right, ["g"], "t", "t", "v", strict=strict).orderBy("i").collect()]
    assert f(False) == [1.0, 1.0, None, 2.0, 3.0, None, None, None, 1.0]
    assert f(True) == [None, 1.0, None, 2.0, 3.0, None, None, None, 1.0]


def test_one_row_of_ties_stays(spark):
    df = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q"), ("x", 2, "q"), ("y", None, "r")], "k string, t int, v string")
    assert sorted(tuple(r) for r in filters.dedup_latest(df, ["k"], ["t"]).collect()) == [("x", 2, "q"), ("y", None, "r")]


def test_weighted_quantile_of_many_values(spark):
    r = np.random.default_rng(5)
    v, w = np.round(r.normal(0, 9, 3000), 2), r.integers(1, 5, 3000)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(v, w, strict=True)], "g int, v double, w double")
    order = np.argsort(v, kind="stable")
    for q in (0.1, 0.8):
        want = v[order][np.flatnonzero(np.cumsum(w[order]) > q * w.sum())[0]]
        assert metrics.weighted_quantile(df, ["g"], "v", "w", q, "v").first()["value"] == want


def test_comparable_interval_equals_its_quantile(spark):
    r = np.random.default_rng(6)
    rows = [(int(k), float(e), float(d), bool(b)) for k, e, d, b in zip(r.integers(0, 9, 60), r.integers(-9, 9, 60), r.uniform(0, 4, 60), r.integers(0, 2, 60), strict=True)] + [(50, None, 1.0, True)]
    comps = spark.createDataFrame(rows, "key long, err_pct double, distance_km double, same boolean")
    preds = spark.createDataFrame([(k, 100.0) for k in [*range(9), 50, 51]], "key long, pred double")
    got = {x["key"]: x for x in metrics.comparable_interval(preds, comps, "key", "pred").collect()}
    assert sorted(got) == sorted({x[0] for x in rows} - {50})
    for k, x in got.items():
        e, w = np.array([(abs(e), (1.25 if b else 1) / (1 + d)) for key, e, d, b in rows if key == k]).T
        order = np.argsort(e, kind="stable")
        assert x["half_q80_pct"] == e[order][np.flatnonzero(np.cumsum(w[order]) > 0.8 * w.sum())[0]]
        assert abs(x["half_mean_pct"] - (w * e).sum() / w.sum()) < 1e-9 and abs(x["lo"] - (100 - x["half_mean_pct"])) < 1e-9


def test_gates_of_holdout_and_blend(spark):
    df = spark.createDataFrame([("test",)] * 5 + [("train",)] * 9, "split string")
    assert splits.check_holdout(df).first()["ok"] is False and splits.check_holdout(df, min_test=5).first()["ok"] is True
    with pytest.raises(ValueError):
        splits.check_holdout(df, strict=True)
    assert splits.auto_gap_days([90, 365]) == 372
    rows = spark.createDataFrame([(float(y), y + 1.0, y * 2.0, 1.0, y % 2) for y in range(1, 40)], "y double, a double, b double, w double, g int")
    w = metrics.fit_nnls_2(rows, "y", "a", "b", "w", F.col("g") == 1, normalise=True)
    assert sum(w) == pytest.approx(1)
    assert metrics.blend_if_better(rows, "y", "a", "b", "w", (0.0, 1.0)) == (1.0, 0.0)
    assert metrics.blend_if_better(rows, "y", "b", "a", "w", (0.0, 1.0)) == (0.0, 1.0)


def test_anova_has_its_p(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", 6.0)], "g string, v double")
    r = marts.anova_oneway(df, "g", "v").first()
    assert r["f"] == pytest.approx(2.4) and r["p"] == pytest.approx(0.1963, abs=1e-3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_without_sql(spark):
    q = catalog.queries()
    orders = [r["o_totalprice"] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_totalprice").collect()]
    a, b = q["a17_dataset_fingerprint"](spark, SF).first(), marts.dataset_fingerprint(spark.createDataFrame([(x,) for x in reversed(orders)], "v double"), "v").first()
    assert tuple(a) == tuple(b) and a["n"] == len(orders)
    folds = q["v6_monte_carlo_folds"](spark, SF).join(spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("key"), splits.month_label(F.col("o_orderdate")).alias("m")), "key")
    months = {(r["fold"], r["role"]): (r["lo"], r["hi"]) for r in folds.groupBy("fold", "role").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).collect()}
    for f in {f for f, _ in months}:
        assert months[f, "val"][1] - months[f, "val"][0] <= 1 and months[f, "train"][1] < months[f, "val"][0] - 1
    scored = q["l1_l2_fit_and_score"](spark, SF)
    n, bad = scored.agg(F.count("*"), F.count(F.when(~F.col("prediction").between(1.0, 1e7), 1))).first()
    assert n == sum(1 for r in spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 5 = 0").collect()) and not bad
    assert 0.4 <= q["m8_adversarial_auc"](spark, SF).first()["auc"] <= 1.0
    w = q["m9_domain_importance_weights"](spark, SF).agg(F.min("domain_weight"), F.max("domain_weight")).first()
    assert 0.2 <= w[0] <= w[1] <= 5.0 and not math.isnan(w[0])
    oof = q["l3_cross_validate"](spark, SF)
    assert oof.count() == oof.select("fold", "key").distinct().count() > 0
