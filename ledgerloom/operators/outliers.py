"""Robust outlier scores, fences, masks and reports. Group statistics are aggregated, then joined."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .marts import rare_pairs
from .quantiles import largest_group, medians, quantiles
from .storage import cut


def chi2_quantile(p: float, k: int) -> float:
    """Chi-square quantile by bisection on the regularised lower gamma function."""

    def lower(x: float) -> float:
        a, x = k / 2, x / 2
        term = total = 1 / a
        for n in range(1, 2000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0

    lo, hi = 0.0, 10.0 * k + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if lower(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _join(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Null-safe join of group statistics; with no keys, of the one row."""
    if not by:
        return df.join(F.broadcast(stats))
    s = stats.select(*[F.col(b).alias(f"_k_{b}") for b in by], *[c for c in stats.columns if c not in by])
    test = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by])
    return df.join(s, test).drop(*[f"_k_{b}" for b in by])


def _scaled(work: DataFrame, by: list[str], cols: list[str], centre: dict[str, Column], prefix: str, most: int) -> DataFrame:
    """work with 0.6745 * (x - centre) / MAD for each column; a MAD of 0 counts as 1e-9."""
    dev = {c: F.abs(F.col(c).cast("double") - centre[c]) for c in cols}
    work = _join(work, medians(work, by, {f"_mad_{c}": dev[c] for c in cols}, most), by)
    z = {f"{prefix}{c}": 0.6745 * (F.col(c).cast("double") - centre[c]) / F.when(F.col(f"_mad_{c}") == 0, 1e-9).otherwise(F.col(f"_mad_{c}")) for c in cols}
    return work.withColumns(z).drop(*[f"_mad_{c}" for c in cols])


def modified_z(df: DataFrame, by: list[str], cols: list[str], prefix: str = "z_") -> DataFrame:
    """0.6745 * (x - median) / MAD for each column within the group; a MAD of 0 counts as 1e-9."""
    most = largest_group(df, by)
    work = _join(df, medians(df, by, {f"_med_{c}": F.col(c) for c in cols}, most), by)
    return _scaled(work, by, cols, {c: F.col(f"_med_{c}") for c in cols}, prefix, most).drop(*[f"_med_{c}" for c in cols])


def iqr_bounds(df: DataFrame, by: list[str], col: str, k: float = 1.5) -> DataFrame:
    """(by, low, high) fences; quartiles that are equal count as 1e-9 apart."""
    q = quantiles(df, by, {"_q1": (F.col(col), 0.25), "_q3": (F.col(col), 0.75)})
    width = F.col("_q3") - F.col("_q1")
    width = F.when(width == 0, 1e-9).otherwise(width)
    return q.select(*by, (F.col("_q1") - k * width).alias("low"), (F.col("_q3") + k * width).alias("high"))


def diag_mahalanobis(df: DataFrame, cols: list[str], p: float = 0.999, out: str = "maha", of: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Sum of squared robust deviations over the columns (nulls add nothing) and whether it is beyond the
    chi-square quantile. A MAD of 0 counts as 1e-9. of: where place and scale are taken, if that is
    cheaper to read than df and has the same rows."""
    base = df if of is None else of
    rows = largest_group(base, []) if rows is None else rows
    place = medians(base, [], {f"_mm_{c}": F.col(c) for c in cols}, rows)
    dev = {c: F.abs(F.col(c).cast("double") - F.col(f"_mm_{c}")) for c in cols}
    scale = medians(base.join(F.broadcast(place)), [], {f"_ms_{c}": dev[c] for c in cols}, rows)
    far = {c: dev[c] / F.when(F.col(f"_ms_{c}") == 0, 1e-9).otherwise(F.col(f"_ms_{c}")) for c in cols}
    total = sum((F.coalesce(F.pow(far[c], 2), F.lit(0.0)) for c in cols), F.lit(0.0))
    work = df.join(F.broadcast(place)).join(F.broadcast(scale))  # one row each
    return work.withColumn(out, total).withColumn(f"{out}_flag", F.col(out) > chi2_quantile(p, max(1, len(cols)))).drop(*[f"{x}{c}" for c in cols for x in ("_mm_", "_ms_")])


@dataclass
class OutlierRules:
    main_z: float = 5.0
    main_z_by_bed: dict[int, float] = field(default_factory=dict)
    low_bed: int = 4
    low_z: float = -1.0
    support_z: float = 2.0
    min_support: int = 2
    luxury_k: float = 3.0
    mahal_p: float = 0.999


def outlier_mask(df: DataFrame, bed: str, price: str, capital: str, cols: list[str], rules: OutlierRules | None = None) -> DataFrame:
    """df with z_price, z_capital, z_<col>, votes, maha, luxury, outlier.

    A candidate is far off by price or capital for its bed count, cheap with many beds, or far off over
    all columns; it is an outlier with enough supporting columns, unless its capital value is beyond the
    luxury fence of its bed count.
    """
    r = rules or OutlierRules()
    df = cut(df)  # each of the statistics reads it again
    work = df.withColumns({"price_": F.log1p(F.col(price)), "capital_": F.log1p(F.col(capital))})
    own, c = ["price_", "capital_", *cols], F.col
    rows = largest_group(df, [])  # bounds the groups of either kind
    fence = {"_q1": (c(capital), 0.25), "_q3": (c(capital), 0.75)}  # in the same pass as the medians of a bed count
    work = _join(work, quantiles(work, [bed], {f"_med_{x}": (c(x), 0.5) for x in own} | fence, most=rows), [bed])
    work = _scaled(work, [bed], own, {x: c(f"_med_{x}") for x in own}, "z_", rows)
    width = F.when(c("_q3") == c("_q1"), 1e-9).otherwise(c("_q3") - c("_q1"))
    work = work.withColumn("_fence", c("_q3") + r.luxury_k * width).drop(*[f"_med_{x}" for x in own], "_q1", "_q3", "price_", "capital_")
    work = work.withColumnsRenamed({"z_price_": "z_price", "z_capital_": "z_capital"})
    work = diag_mahalanobis(work, cols, r.mahal_p, of=df, rows=rows) if cols else work.withColumns({"maha": F.lit(0.0), "maha_flag": F.lit(False)})
    limit = F.lit(r.main_z)
    for b, z in r.main_z_by_bed.items():
        limit = F.when(F.col(bed) == b, z).otherwise(limit)
    yes = lambda test: F.coalesce(test, F.lit(False))
    main = yes(F.abs("z_price") >= limit) | yes(F.abs("z_capital") >= limit)
    low = yes((F.col(bed) >= r.low_bed) & (F.col("z_price") <= r.low_z))
    votes = sum((yes(F.abs(f"z_{c}") >= r.support_z).cast("int") for c in cols), F.lit(0))
    work = work.withColumns({"votes": votes, "luxury": yes(F.col(capital) > F.col("_fence")), "main_out": main, "low_out": low})
    hit = (F.col("main_out") | F.col("low_out") | F.col("maha_flag")) & (F.col("votes") >= r.min_support) & ~F.col("luxury")
    return work.withColumn("outlier", hit).drop("_fence")


def outlier_report(df: DataFrame, bed: str, price: str, capital: str, cols: list[str], rules: OutlierRules | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean rows with the columns of df, removed rows with scores, votes and a reason)."""
    m = outlier_mask(df, bed, price, capital, cols, rules)
    reason = F.when(F.col("main_out"), "main").when(F.col("low_out"), "low_for_beds").otherwise("mahalanobis")
    return m.where(~F.col("outlier")).select(*df.columns), m.where("outlier").withColumn("reason", reason)


def zscore_filter(df: DataFrame, by: list[str], col: str, k: float = 4) -> DataFrame:
    """Rows whose |x - mean| / population deviation within the group is below k; a deviation of 0 keeps none."""
    s = df.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    return _join(df, s, by).where(F.try_divide(F.abs(F.col(col) - F.col("_m")), F.col("_s")) < k).drop("_m", "_s")


def support_vote_outliers(df: DataFrame, bed: str, main: str, capital: str, cols: list[str], year: str, z: float = 1.8, min_votes: int = 2, rare_below: float = 0.01, exempt_z: float = 3.5) -> DataFrame:
    """df with votes and outlier: main is off by z and enough columns are beyond the larger of 1 and their
    group's 80th percentile; a rare (year, bed) pair votes too; a far-off capital value exempts."""
    df = cut(df)  # each of the statistics reads it again
    work = modified_z(df, [bed], [main, capital, *cols], "z_")
    edge = quantiles(work, [bed], {f"_e_{c}": (F.abs(f"z_{c}"), 0.8) for c in cols})
    work = _join(work, edge, [bed])
    rare = rare_pairs(df.where(F.col(year).isNotNull() & F.col(bed).isNotNull()), year, bed, rare_below).withColumn("_rare", F.lit(1)).drop("share")
    work = work.join(rare, [year, bed], "left")
    yes = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    votes = sum((yes(F.abs(f"z_{c}") > F.greatest(F.lit(1.0), F.col(f"_e_{c}"))) for c in cols), F.coalesce("_rare", F.lit(0)))
    work = work.withColumn("votes", votes)
    hit = (F.abs(f"z_{main}") > z) & (F.col("votes") >= min_votes) & ~F.coalesce(F.abs(f"z_{capital}") > exempt_z, F.lit(False))
    return work.withColumn("outlier", F.coalesce(hit, F.lit(False))).drop("_rare", *[f"_e_{c}" for c in cols])


def fit_outlier_scores(train: DataFrame, by: str, value: Column, min_n: int = 10) -> DataFrame:
    """(by, median, mad): robust place and scale (1.4826 * MAD) for groups of min_n rows; by null: all rows."""
    x = train.where(value.isNotNull()).select(F.col(by).alias("_g"), value.alias("_x"))

    def level(df: DataFrame, keys: list[str]) -> DataFrame:
        m = quantiles(df, keys, {"median": (F.col("_x"), 0.5)}, {"_n": F.count("*")})
        j = df.join(m, keys) if keys else df.join(F.broadcast(m))
        s = medians(j, [*keys, "median", "_n"], {"mad": F.abs(F.col("_x") - F.col("median"))})
        return s.withColumn("mad", 1.4826 * F.col("mad"))

    groups = level(x.where("_g is not null"), ["_g"]).where(F.col("_n") >= min_n).select(F.col("_g").alias(by), "median", "mad")
    return groups.unionByName(level(x, []).select(F.lit(None).cast(dict(train.dtypes)[by]).alias(by), "median", "mad"))


def apply_outlier_scores(df: DataFrame, params: DataFrame, by: str, value: Column, limit: float, out: str) -> DataFrame:
    """Robust z of value by group, else by all rows, and whether |z| is beyond limit."""
    own = params.where(F.col(by).isNotNull()).select(F.col(by).alias("_g"), F.col("median").alias("_m"), F.col("mad").alias("_s"))
    every = params.where(F.col(by).isNull()).select(F.col("median").alias("_m0"), F.col("mad").alias("_s0"))
    work = df.join(own, F.col(by) == F.col("_g"), "left").join(F.broadcast(every), how="left")
    scale = F.greatest(F.coalesce("_s", "_s0"), F.lit(1e-9))
    work = work.withColumn(out, (value - F.coalesce("_m", "_m0")) / scale)
    return work.withColumn(f"{out}_flag", F.coalesce(F.abs(out) > limit, F.lit(False))).drop("_g", "_m", "_s", "_m0", "_s0")
