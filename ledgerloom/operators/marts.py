"""Summary tables: grouped aggregates, calendars, correlations, profiles."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import medians, quantiles

#: Pairwise aggregates in one pass.
PAIRS_AT_ONCE = 400


def median_by_group(df: DataFrame, by: list[str], col: str, out: str = "median") -> DataFrame:
    return medians(df, by, {out: F.col(col)})


def monthly_average(df: DataFrame, date: str, col: str) -> DataFrame:
    return df.groupBy(F.to_date(F.trunc(date, "month")).alias("month")).agg(F.avg(col).alias("mean"))


def cumulative_change(df: DataFrame, date: str, col: str) -> DataFrame:
    """Monthly mean against the first month's, in percent; one row a month, so the window is small."""
    m = monthly_average(df.where(F.col(date).isNotNull()), date, col)
    first = m.agg(F.min_by("mean", "month").alias("_first"))
    return m.join(F.broadcast(first)).select("month", "mean", ((F.col("mean") / F.col("_first") - 1) * 100).alias("change_pct"))


def quarterly_median_by_group(df: DataFrame, by: str, date: str, col: str, min_n: int = 10) -> DataFrame:
    big = df.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_n).select(by)
    return medians(df.join(big, by, "left_semi").withColumn("quarter", F.to_date(F.trunc(date, "quarter"))), [by, "quarter"], {"median": F.col(col)})


def daily_mean_count(df: DataFrame, date: str, col: str, by: list[str] = ()) -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(*by, F.to_date(date).alias("day")).agg(F.avg(col).alias("mean"), F.count(col).alias("n"))


def weekly_volume(df: DataFrame, date: str, by: str) -> DataFrame:
    """Rows of each Sunday-ending week and group; weeks between a group's first and last without rows are 0."""
    week = F.next_day(F.date_sub(F.to_date(date), 1), "Sun")
    n = df.where(F.col(date).isNotNull()).groupBy(by, week.alias("week")).agg(F.count("*").alias("n"))
    weeks = n.groupBy(by).agg(F.explode(F.sequence(F.min("week"), F.max("week"), F.expr("interval 7 days"))).alias("week"))
    return weeks.join(n, [by, "week"], "left").select(by, "week", F.coalesce("n", F.lit(0)).alias("n"))


def group_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    return quantiles(df, by, {"median": (F.col(col), 0.5)}, {"mean": F.avg(col), "n": F.count(col)})


def count_by(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by outer and inner with the outer totals (inner null), by one rollup."""
    return df.rollup(outer, inner).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where("level < 3").select(outer, inner, "n", F.col("level").cast("int").alias("level"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) for a < b: Pearson over the rows where both are there; a chunk of pairs each pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    out = []
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        part = pairs[at : at + PAIRS_AT_ONCE]
        both = lambda a, b, x: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(x).cast("double"))
        wide = df.agg(*[F.corr(both(a, b, a), both(a, b, b)).alias(f"c{i}") for i, (a, b) in enumerate(part)])
        rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(part)])
        out.append(wide.select(F.explode(rows).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, out)


def encode_for_corr(df: DataFrame, cols: list[str], max_levels: int = 20) -> DataFrame:
    """Numbers for correlations: booleans 0/1, dates as days, texts one-hot, or by frequency if they have
    more than max_levels levels. Missing is a level of its own."""
    types = dict(df.dtypes)
    texts = [c for c in cols if types[c] == "string"]
    sizes = df.agg(*[F.count_distinct(F.coalesce(F.col(c), F.lit("MISSING"))).alias(c) for c in texts]).first() if texts else {}
    out, joins = [], df
    for c in cols:
        if types[c] == "boolean":
            out.append(F.col(c).cast("int").alias(c))
        elif types[c] in ("date", "timestamp"):
            out.append(F.unix_date(F.col(c).cast("date")).alias(c))
        elif c in texts and sizes[c] <= max_levels:
            level = F.coalesce(F.col(c), F.lit("MISSING"))
            out += [(level == v).cast("int").alias(f"{c}={v}") for v in sorted(r[0] for r in df.select(level).distinct().collect())]  # max_levels rows
        elif c in texts:
            freq = df.groupBy(c).agg(F.count("*").alias("_n")).select(F.col(c).alias("_k"), "_n")
            total = df.agg(F.count("*").alias("_t"))
            joins = joins.join(freq, F.col(c).eqNullSafe(F.col("_k")), "left").join(F.broadcast(total)).withColumn(f"{c}_freq", F.col("_n") / F.col("_t")).drop("_k", "_n", "_t")
            out.append(F.col(f"{c}_freq"))
        else:
            out.append(F.col(c))
    return joins.select(*out)


def top_k_correlated(df: DataFrame, target: str, cols: list[str], k: int, log_target: bool = False) -> DataFrame:
    y = F.log1p(F.col(target)) if log_target else F.col(target)
    work = df.withColumn("_y", y.cast("double"))
    got = [F.struct(F.lit(c).alias("feature"), F.abs(F.corr("_y", F.col(c).cast("double"))).alias("abs_corr")) for c in cols]
    ranked = work.agg(F.array(*got).alias("r")).select(F.explode("r").alias("r")).select("r.*").where("abs_corr is not null")
    return ranked.orderBy(F.desc("abs_corr"), "feature").limit(k)


def anova_oneway(df: DataFrame, by: str, col: str) -> DataFrame:
    """One row: F, degrees of freedom and p. Sums come from Spark, the tail probability is a scalar."""
    g = df.where(F.col(by).isNotNull() & F.col(col).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(col).alias("m"), F.var_pop(col).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    w = g.join(F.broadcast(t.select(F.col("n").alias("total"), "k", "mean")))
    s = w.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.max("k").alias("k"), F.max("total").alias("total"))
    s = s.select((F.col("k") - 1).alias("df_between"), (F.col("total") - F.col("k")).alias("df_within"), "between", "within")
    row = s.select("df_between", "df_within", F.try_divide(F.col("between") / F.col("df_between"), F.col("within") / F.col("df_within")).alias("f")).first()  # one row
    p = f_survival(row["f"], row["df_between"], row["df_within"]) if row["f"] is not None else None
    return df.sparkSession.createDataFrame([(*row, p)], "df_between long, df_within long, f double, p double")


def f_survival(f: float, d1: int, d2: int) -> float:
    """P(F > f): regularised incomplete beta by its continued fraction."""
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x <= 0 or x >= 1:
        return float(x >= 1)

    def tail(x: float, a: float, b: float) -> float:
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return front * h

    return tail(x, a, b) if x < (a + 1) / (a + b + 2) else 1 - tail(1 - x, b, a)


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Uncentred variance inflation of each column; nulls take the median. One pass of pair sums, a k x k inverse."""
    middle = medians(df, [], {c: F.col(c) for c in cols}).first()
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c] or 0.0)) for c in cols}
    row = df.agg(*[F.sum(x[a] * x[b]) for i, a in enumerate(cols) for b in cols[i:]]).first()
    gram, it = np.zeros((len(cols), len(cols))), iter(row)
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            gram[i, j] = gram[j, i] = next(it)
    scale = np.sqrt(np.diag(gram))
    inverse = np.linalg.inv(gram / np.outer(scale, scale))
    return df.sparkSession.createDataFrame([(c, float(inverse[i, i])) for i, c in enumerate(cols)], "feature string, vif double")


def profile_target(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    wanted = {f"p{round(100 * q)}": (F.col(col), q) for q in (0.25, 0.5, 0.75, 0.95)}
    return quantiles(df, list(by), wanted, {"n": F.count(col), "min": F.min(col), "max": F.max(col)}).select(*by, "n", "min", *wanted, "max")


def low_entropy_columns(df: DataFrame, cols: list[str], most: float = 0.85, min_levels: int = 2, keep: list[str] = ()) -> DataFrame:
    """Text columns with fewer than min_levels levels or one level above `most` of the rows."""
    wide = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("MISSING")).alias("level")) for c in cols if c not in keep]))
    n = df.select(wide.alias("x")).select("x.*").groupBy("feature", "level").agg(F.count("*").alias("n"))
    s = n.groupBy("feature").agg(F.count("*").alias("levels"), (F.max("n") / F.sum("n")).alias("top_share"))
    return s.where((F.col("levels") < min_levels) | (F.col("top_share") > most))


def importance_by_bucket(imp: DataFrame, feature: str, gain: str) -> DataFrame:
    """Gains summed by base feature, the part before the first '='."""
    return imp.groupBy(F.substring_index(feature, "=", 1).alias("base")).agg(F.sum(gain).alias("gain"))


def dataset_fingerprint(df: DataFrame, col: str) -> DataFrame:
    """Order-free digest of a column: a sum of hashes and the count, no sort."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.col(col)).cast("decimal(38,0)")).alias("digest"))


def rare_pairs(df: DataFrame, a: str, b: str, below: float = 0.01) -> DataFrame:
    """(a, b, share): combinations rarer within a than `below`."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a))).where(F.col("share") < below).select(a, b, "share")


def select_features(train: DataFrame, target: str, numerics: list[str], texts: list[str] = (), k: int = 28, pins: list[str] = (), forbid: list[str] = (), exclude_texts: list[str] = ()) -> list[str]:
    """Names of the k numerics most correlated with the log target, pins added, constants and the raw
    twins of chosen logs dropped, and the text columns that say something."""
    numerics = [c for c in numerics if c not in forbid]
    row = train.agg(*[F.count_distinct(c).alias(c) for c in numerics]).first()
    varied = [c for c in numerics if row[c] > 1]
    best = [r["feature"] for r in top_k_correlated(train, target, varied, k, log_target=True).collect()]  # k rows
    chosen = list(dict.fromkeys([*best, *[p for p in pins if p in varied]]))
    chosen = [c for c in chosen if f"log_{c}" not in chosen]
    flat = {r["feature"] for r in low_entropy_columns(train, list(texts)).collect()} if texts else set()
    return chosen + [c for c in texts if c not in flat and c not in exclude_texts]
