"""Fit and apply pairs: parameters are small tables; fit on train rows only, apply to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import safe_name

from .quantiles import medians, quantiles
from .storage import cut


def fit_winsor(df: DataFrame, cols: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(feature, low, high)."""
    wide = quantiles(df, [], {f"{s}{c}": (F.col(c), q) for c in cols for s, q in (("low_", low), ("high_", high))})
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high")) for c in cols])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def _by_feature(params: DataFrame, value: Column, name: str) -> DataFrame:
    """One row: a map from feature to value."""
    return params.agg(F.map_from_entries(F.collect_list(F.struct("feature", value))).alias(name))


def apply_winsor(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    p = _by_feature(params, F.struct("low", "high"), "_p")  # a row for each column
    work = df.join(F.broadcast(p))
    bound = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col("_p")[c]["low"], F.least(F.col("_p")[c]["high"], F.col(c).cast("double"))))
    return work.withColumns({c: bound(c) for c in cols}).drop("_p")


def fit_group_median_impute(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """(by, medians...); by null is the global row, missing medians there are 0."""
    kind = dict(df.dtypes)[by]
    every = medians(df, [], {c: F.col(c) for c in cols}).select(F.lit(None).cast(kind).alias(by), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])
    return medians(df.where(F.col(by).isNotNull()), [by], {c: F.col(c) for c in cols}).unionByName(every)


def apply_group_median_impute(df: DataFrame, params: DataFrame, by: str, cols: list[str]) -> DataFrame:
    own = params.where(F.col(by).isNotNull()).select(F.col(by).alias("_g"), *[F.col(c).alias(f"_o_{c}") for c in cols])
    every = params.where(F.col(by).isNull()).select(*[F.col(c).alias(f"_e_{c}") for c in cols])
    work = df.join(own, F.col(by) == F.col("_g"), "left").join(F.broadcast(every))
    return work.withColumns({c: F.coalesce(F.col(c).cast("double"), f"_o_{c}", f"_e_{c}") for c in cols}).drop("_g", *[f"{p}{c}" for c in cols for p in ("_o_", "_e_")])


def fit_rare_levels(df: DataFrame, cols: list[str], min_count: int = 20) -> DataFrame:
    """(feature, level): the levels that stay."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("MISSING")).alias("level")) for c in cols]))
    return df.select(x.alias("x")).select("x.*").groupBy("feature", "level").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("feature", "level")


def apply_rare_levels(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    """Null is MISSING first; levels that aren't in params are OTHER."""
    work = df
    for c in cols:
        known = params.where(F.col("feature") == c).select(F.col("level").alias("_level"))
        work = work.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("MISSING"))).join(known, F.col(c) == F.col("_level"), "left").withColumn(c, F.coalesce("_level", F.lit("OTHER"))).drop("_level")
    return work


def fit_ordinal(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, level, code): the place of each level in sorted order, from 0."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in cols]))
    levels = df.select(x.alias("x")).select("x.*").where("level is not null").distinct()
    return levels.withColumn("code", F.row_number().over(Window.partitionBy("feature").orderBy("level")) - 1)


def apply_ordinal(df: DataFrame, params: DataFrame, cols: list[str], suffix: str = "_code") -> DataFrame:
    """Unseen and null levels are -1."""
    work = df
    for c in cols:
        p = params.where(F.col("feature") == c).select(F.col("level").alias("_level"), F.col("code").alias("_code"))
        work = work.join(p, F.col(c).cast("string") == F.col("_level"), "left").withColumn(f"{c}{suffix}", F.coalesce("_code", F.lit(-1))).drop("_level", "_code")
    return work


def fit_topn_onehot(df: DataFrame, cols: list[str], max_levels: int = 15) -> dict[str, list[str]]:
    """The max_levels most frequent levels of each column, ties by name."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in cols]))
    n = df.select(x.alias("x")).select("x.*").where("level is not null").groupBy("feature", "level").agg(F.count("*").alias("n"))
    top = n.withColumn("_r", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "level"))).where(F.col("_r") <= max_levels)
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in top.orderBy("feature", "_r").collect():  # max_levels rows for each column
        out[r["feature"]].append(r["level"])
    return out


def apply_topn_onehot(df: DataFrame, levels: dict[str, list[str]], numeric: list[str] = ()) -> DataFrame:
    """0/1 columns <col>_<level> and <col>___OTHER; numeric nulls are 0."""
    out = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}
    for c, values in levels.items():
        s = F.col(c).cast("string")
        out |= {f"{safe_name(c)}_{safe_name(v)}": F.coalesce((s == v).cast("int"), F.lit(0)) for v in values}
        out[f"{safe_name(c)}___OTHER"] = F.coalesce((~s.isin(*values)).cast("int"), F.lit(1)) if values else F.lit(1)
    return df.withColumns(out)


def fit_scaler(df: DataFrame, cols: list[str], kind: str = "standard") -> DataFrame:
    """(feature, centre, scale); a scale of 0 is 1."""
    pair = (lambda c: (F.avg(c), F.stddev_pop(c))) if kind == "standard" else (lambda c: (F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")))
    wide = df.agg(*[F.struct(pair(c)[0].alias("centre"), pair(c)[1].alias("scale")).alias(c) for c in cols])
    one = lambda c: F.when(F.col(c)["scale"] == 0, 1.0).otherwise(F.col(c)["scale"])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["centre"].alias("centre"), one(c).alias("scale")) for c in cols])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def apply_scaler(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    work = df.join(F.broadcast(_by_feature(params, F.struct("centre", "scale"), "_p")))
    return work.withColumns({c: (F.col(c) - F.col("_p")[c]["centre"]) / F.col("_p")[c]["scale"] for c in cols}).drop("_p")


def loo_encode(df: DataFrame, by: list[str], target: str, train: Column, k: float = 10, out: str = "loo") -> DataFrame:
    """Smoothed group mean; a train row leaves itself out. Groups without other rows and unknown groups
    get the train mean."""
    from .outliers import _join

    y = F.when(train, F.col(target).cast("double"))
    s = df.groupBy(*by).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    g = df.agg(F.avg(y).alias("_g"))
    work = _join(df, s, by).join(F.broadcast(g))
    own = F.when(F.col("_n") > 1, (F.col("_s") - F.col(target) + k * F.col("_g")) / (F.col("_n") - 1 + k)).otherwise(F.col("_g"))
    rest = F.when(F.col("_n") > 0, (F.col("_s") + k * F.col("_g")) / (F.col("_n") + k)).otherwise(F.col("_g"))
    return work.withColumn(out, F.when(train, own).otherwise(rest)).drop("_s", "_n", "_g")


def fit_mean_encode(df: DataFrame, col: str, target: str) -> DataFrame:
    """(col, mean); col null is the global mean."""
    kind = dict(df.dtypes)[col]
    every = df.agg(F.avg(target).alias("mean")).select(F.lit(None).cast(kind).alias(col), "mean")
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.avg(target).alias("mean")).unionByName(every)


def apply_mean_encode(df: DataFrame, params: DataFrame, col: str, out: str) -> DataFrame:
    own = params.where(F.col(col).isNotNull()).select(F.col(col).alias("_g"), F.col("mean").alias("_m"))
    every = params.where(F.col(col).isNull()).select(F.col("mean").alias("_m0"))
    return df.join(own, F.col(col) == F.col("_g"), "left").join(F.broadcast(every)).withColumn(out, F.coalesce("_m", "_m0")).drop("_g", "_m", "_m0")


def asof_mean_encode(requests: DataFrame, history: DataFrame, date: str, price: str, suburb: str) -> DataFrame:
    """Means of all history before each request: by suburb; and by suburb and calendar month, falling back
    to suburb, to the month over all suburbs, to all. Daily running sums and as-of unions."""
    from .joins import asof_join

    hist = history.where(F.col(price).isNotNull()).select(suburb, F.month(date).alias("_month"), F.col(date).cast("date").alias("_day"), F.col(price).alias("_p")).withColumn("_one", F.lit(1))
    asked = requests.select(F.col(suburb).alias(suburb), F.col(date).cast("date").alias("_at")).distinct().withColumns({"_month": F.month("_at"), "_one": F.lit(1)})
    names = {"_s": [suburb], "_sm": [suburb, "_month"], "_m": ["_month"], "_g": ["_one"]}
    for name, keys in names.items():
        daily = hist.groupBy(*keys, "_day").agg(F.sum("_p").alias("s"), F.count("_p").alias("n"))
        w = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = daily.select(*keys, "_day", (F.sum("s").over(w) / F.sum("n").over(w)).alias("_v"))
        asked = cut(asof_join(asked, run, keys, "_at", "_day", "_v", strict=True, out=name))
    got = asked.select(F.col(suburb).alias("_g0"), F.col("_at").alias("_d0"), F.coalesce("_s", "_g").alias("mean_suburb"), F.coalesce("_sm", "_s", "_m", "_g").alias("mean_suburb_month"))
    same = F.col(suburb).eqNullSafe(F.col("_g0")) & F.col(date).cast("date").eqNullSafe(F.col("_d0"))
    return requests.join(got, same, "left").drop("_g0", "_d0")


def floor_to_group_median(df: DataFrame, floor: str, by: str, train: Column, out: str = "floor_ratio") -> DataFrame:
    """Floor size against the train median of the same group; missing gives 1."""
    m = medians(df.where(train & F.col(by).isNotNull()), [by], {"_m": F.col(floor)}).withColumnRenamed(by, "_g")
    return df.join(m, F.col(by) == F.col("_g"), "left").withColumn(out, F.coalesce(F.try_divide(F.col(floor), F.when(F.col("_m") != 0, F.col("_m"))), F.lit(1.0))).drop("_g", "_m")


def asof_floor_ratio(requests: DataFrame, history: DataFrame, floor: str, by: str, date: str, key: str, out: str = "floor_ratio") -> DataFrame:
    """Floor size of requests against the median of the same group's history before the request's day; without
    such history, against the group's whole; missing gives 1."""
    from .windows import rolling_medians

    both = history.select(by, date, key, floor).withColumn("_asked", F.lit(False)).unionByName(requests.select(by, date, key, F.lit(None).cast("double").alias(floor)).withColumn("_asked", F.lit(True)))
    before = rolling_medians(both, [by], date, key, floor, {"_m": (1_000_000, "left", 1)}).where("_asked").select(F.col(key).alias("_k"), "_m")
    every = medians(history, [by], {"_all": F.col(floor)}).withColumnRenamed(by, "_g")
    work = requests.join(before, F.col(key) == F.col("_k"), "left").join(every, F.col(by) == F.col("_g"), "left")
    m = F.coalesce("_m", "_all")
    return work.withColumn(out, F.coalesce(F.try_divide(F.col(floor), F.when(m != 0, m)), F.lit(1.0))).drop("_k", "_m", "_g", "_all")
