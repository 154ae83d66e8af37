"""Evaluation, calibration and drift: mergeable sums in grouped aggregates, and exact quantiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def regression_metrics(df: DataFrame, y: str, p: str, w: str | None = None, by: list[str] = ()) -> DataFrame:
    """n, mae, rmse, r2, r2_log, medae, mape (y > 0), safe_mape (weighted, |y| at least 1e-6), smape (the sum of both
    sides at least 1e-6), wmae, wrmse, by group. Logs use the global mean."""
    yc, pc = F.col(y).cast("double"), F.col(p).cast("double")
    e, wc = pc - yc, (F.col(w).cast("double") if w else F.lit(1.0))
    ly, lp = F.log1p(F.greatest(yc, F.lit(0.0))), F.log1p(F.greatest(pc, F.lit(0.0)))
    r2 = lambda a, err: 1 - F.try_divide(F.sum(err * err), F.sum(a * a) - F.sum(a) * F.sum(a) / F.count(a))
    rows = df.where(yc.isNotNull() & pc.isNotNull())
    floor = F.lit(1e-6)
    sums = {
        "n": F.count("*"), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "r2": r2(yc, e), "r2_log": r2(ly, lp - ly),
        "mape": F.avg(F.when(yc > 0, F.abs(e) / yc)) * 100, "safe_mape": F.sum(wc * F.abs(e) / F.greatest(F.abs(yc), floor)) / F.sum(wc),
        "smape": F.avg(2 * F.abs(e) / F.greatest(F.abs(yc) + F.abs(pc), floor)) * 100,
        "wmae": F.sum(wc * F.abs(e)) / F.sum(wc), "wrmse": F.sqrt(F.sum(wc * e * e) / F.sum(wc)),
    }
    return quantiles(rows, list(by), {"medae": (F.abs(e), 0.5)}, sums)


def fold_metrics(oof: DataFrame, y: str, p: str, w: str, fold: str = "fold") -> DataFrame:
    """wmae by fold with the mean and deviation over folds on each row."""
    e = F.abs(F.col(p) - F.col(y))
    m = oof.groupBy(fold).agg((F.sum(F.col(w) * e) / F.sum(w)).alias("wmae"), F.count("*").alias("n"))
    total = m.agg(F.avg("wmae").alias("mean_wmae"), F.stddev_samp("wmae").alias("std_wmae"))
    return m.join(F.broadcast(total))


def residual_table(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.withColumns({"residual": e, "abs_err": F.abs(e), "ape": F.when(F.col(y) > 0, F.abs(e) / F.col(y))})


def worst_errors(df: DataFrame, y: str, p: str, key: str, n: int = 100) -> DataFrame:
    return residual_table(df, y, p).orderBy(F.desc("abs_err"), key).limit(n)


def top_groups(df: DataFrame, by: str, n: int = 30) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def quantile_bins(df: DataFrame, col: str, q: int = 5) -> Column:
    """Right-closed quantile bin of col from 1, null if it is null; equal edges are one."""
    p = quantiles(df, [], {f"q{i}": (F.col(col), i / q) for i in range(q + 1)}).first()  # q + 1 numbers
    edges = sorted({x for x in p if x is not None})
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        out = F.when(F.col(col) <= edges[i], i).otherwise(out)
    return F.when(F.col(col).isNotNull(), out)


def error_segments(df: DataFrame, y: str, p: str, plain: list[str], large: str, floor: str, top: int = 30) -> DataFrame:
    """(group, segment, n, mae, medae, mape) by each plain column, the top segments of large, and floor quintiles."""
    r = residual_table(df, y, p).withColumn("_bin", quantile_bins(df, floor))
    names = [(c, c) for c in [*plain, large]] + [("floor_bin", "_bin")]
    x = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(c).cast("string").alias("segment")) for g, c in names]))
    rows = r.select("abs_err", "ape", x.alias("x")).select("abs_err", "ape", "x.*").where("segment is not null")
    s = quantiles(rows, ["group", "segment"], {"medae": (F.col("abs_err"), 0.5)}, {"n": F.count("*"), "mae": F.avg("abs_err"), "mape": F.avg("ape") * 100}).select("group", "segment", "n", "mae", "medae", "mape")
    best = s.where(F.col("group") == large).orderBy(F.desc("n"), "segment").limit(top)
    return s.where(F.col("group") != large).unionByName(best)


def drift_check(cv: DataFrame, test: DataFrame, metric: str, tol: float = 0.3) -> DataFrame:
    """One row: cross-validated and test value of a metric, their relative gap, and whether it is within tol."""
    j = cv.select(F.col(metric).alias("cv")).join(F.broadcast(test.select(F.col(metric).alias("test"))))
    gap = F.try_divide(F.col("test") - F.col("cv"), F.col("cv"))
    return j.select("cv", "test", gap.alias("gap"), (F.abs(gap) <= tol).alias("ok"))


def conformal_qhat(df: DataFrame, y: str, lo: str, hi: str, alpha: float = 0.1, by: list[str] = ()) -> DataFrame:
    score = F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi), F.lit(0.0))
    return quantiles(df, list(by), {"qhat": (score, 1 - alpha)})


def apply_interval(df: DataFrame, qhat: DataFrame, lo: str, hi: str) -> DataFrame:
    """Bounds widened by qhat; crossed bounds change places."""
    work = df.join(F.broadcast(qhat)).withColumns({"_lo": F.col(lo) - F.col("qhat"), "_hi": F.col(hi) + F.col("qhat")})
    return work.withColumns({lo: F.least("_lo", "_hi"), hi: F.greatest("_lo", "_hi")}).drop("_lo", "_hi", "qhat")


def fit_median_blend(df: DataFrame, y: str, p: str, median: str, w: str, grid: tuple[float, ...] = tuple(0.05 * i for i in range(8))) -> DataFrame:
    """(lam, wmae) for each weight of the group median in the blend; a null median leaves p as it is."""
    lam = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    rows = df.select(y, p, median, w, lam.alias("lam"))
    blend = F.col(p) + F.col("lam") * (F.coalesce(F.col(median), F.col(p)) - F.col(p))
    return rows.groupBy("lam").agg((F.sum(F.col(w) * F.abs(blend - F.col(y))) / F.sum(w)).alias("wmae"))


def apply_median_blend(df: DataFrame, fitted: DataFrame, p: str, median: str, out: str) -> DataFrame:
    best = fitted.agg(F.min_by("lam", F.struct("wmae", "lam")).alias("_lam"))
    return df.join(F.broadcast(best)).withColumn(out, F.col(p) + F.col("_lam") * (F.coalesce(F.col(median), F.col(p)) - F.col(p))).drop("_lam")


def fit_nnls_2(df: DataFrame, y: str, a: str, b: str, w: str, gate: Column | None = None, normalise: bool = False) -> tuple[float, float]:
    """Nonnegative weights of two predictors by weighted least squares: five sums, then a closed form.

    Where the gate doesn't hold the second predictor counts as the first; normalise: weights sum to 1.
    """
    ca, cy = F.col(a), F.col(y)
    cb = F.col(b) if gate is None else F.when(F.coalesce(gate, F.lit(False)), F.col(b)).otherwise(ca)
    s = lambda x, z: F.sum(F.col(w) * x * z)
    r = [float(v or 0) for v in df.agg(s(ca, ca), s(ca, cb), s(cb, cb), s(ca, cy), s(cb, cy)).first()]
    aa, ab, bb, ay, by = r
    options = [(0.0, 0.0), (max(0.0, ay / aa) if aa else 0.0, 0.0), (0.0, max(0.0, by / bb) if bb else 0.0)]
    if (det := aa * bb - ab * ab) > 1e-12 * max(aa * bb, 1e-300):
        u, v = (bb * ay - ab * by) / det, (aa * by - ab * ay) / det
        if u >= 0 and v >= 0:
            options.append((u, v))
    loss = lambda u, v: u * u * aa + 2 * u * v * ab + v * v * bb - 2 * u * ay - 2 * v * by
    best = min(options, key=lambda o: loss(*o))
    total = sum(best)
    return (best[0] / total, best[1] / total) if normalise and total > 0 else best


def blend_if_better(df: DataFrame, y: str, a: str, b: str, w: str, weights: tuple[float, float], gate: Column | None = None) -> tuple[float, float]:
    """The weights if the blend has the smaller weighted absolute error on df (early rows), else (1, 0)."""
    e = lambda p: F.sum(F.col(w) * F.abs(F.col(y) - F.col(p)))
    row = apply_blend(df, a, b, weights, "_blend", gate).agg(e(a), e("_blend")).first()
    return weights if row[0] is not None and row[1] < row[0] else (1.0, 0.0)


def apply_blend(df: DataFrame, a: str, b: str, weights: tuple[float, float], out: str, gate: Column | None = None) -> DataFrame:
    mixed = weights[0] * F.col(a) + weights[1] * F.col(b)
    return df.withColumn(out, mixed if gate is None else F.when(gate, mixed).otherwise(F.col(a)))


#: Value buckets of a group in weighted_quantile().
BUCKETS = 128


def weighted_quantile(df: DataFrame, by: list[str], v: str, w: str, q: float, key: str) -> DataFrame:
    """(by, value): the first value at which the share of weight exceeds q.

    Weights are summed by value, and by bucket between approximate quantiles; sums of buckets tell which
    bucket holds the value, and only the values of that one meet in a window.
    """
    weights = df.where(F.col(v).isNotNull()).groupBy(*by, F.col(v).alias("_v")).agg(F.sum(w).alias("_w"))
    marks = weights.groupBy(*by).agg(F.percentile_approx("_v", [i / BUCKETS for i in range(1, BUCKETS)], 4 * BUCKETS).alias("_cuts"), F.sum("_w").alias("_t"))
    placed = weights.join(marks, by).withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts")
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy(*by, "_b", "_t").agg(F.sum("_w").alias("_s")).withColumn("_end", F.sum("_s").over(upto))
    holds = sums.where(F.col("_end") > q * F.col("_t")).groupBy(*by).agg(F.min_by(F.struct("_b", (F.col("_end") - F.col("_s")).alias("_from")), "_b").alias("_h"))
    rows = placed.join(holds.select(*by, "_h.*"), [*by, "_b"])
    run = F.col("_from") + F.sum("_w").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_run", run).where(F.col("_run") > q * F.col("_t")).groupBy(*by).agg(F.min("_v").alias("value"))


def comparable_interval(preds: DataFrame, comps: DataFrame, key: str, pred: str) -> DataFrame:
    """For each request: weighted mean and 80 % quantile of its comparables' absolute percentage errors as
    half-widths. comps: (key, err_pct, distance_km, same); a weight is 1 / (1 + km), times 1.25 if same.

    A request has a few comparables, which meet in one array; for groups of any size there is weighted_quantile().
    """
    weighted = comps.withColumn("_w", 1 / (1 + F.col("distance_km")) * F.when(F.col("same"), 1.25).otherwise(1.0)).withColumn("_abs", F.abs("err_pct")).where(F.col("_abs").isNotNull())
    of = weighted.groupBy(key).agg(F.avg("err_pct").alias("mean_err_pct"), (F.sum(F.col("_w") * F.col("_abs")) / F.sum("_w")).alias("half_mean_pct"), F.sum("_w").alias("_t"), F.sort_array(F.collect_list(F.struct("_abs", F.coalesce("_w", F.lit(0.0)).alias("_w")))).alias("_rows"))

    def step(s: Column, x: Column) -> Column:
        run = s["run"] + x["_w"]
        return F.struct(run.alias("run"), F.coalesce(s["value"], F.when(run > 0.8 * F.col("_t"), x["_abs"])).alias("value"))

    zero = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("value"))
    of = of.withColumn("half_q80_pct", F.aggregate("_rows", zero, step, lambda s: s["value"])).drop("_rows", "_t")
    out = preds.join(of.where(F.col("half_q80_pct").isNotNull()), key)
    return out.withColumns({"lo": F.col(pred) * (1 - F.col("half_mean_pct") / 100), "hi": F.col(pred) * (1 + F.col("half_mean_pct") / 100)})


def nnls_frame(spark, weights: tuple[float, float]) -> DataFrame:
    return spark.createDataFrame([tuple(np.round(weights, 9).tolist())], "w_a double, w_b double")
