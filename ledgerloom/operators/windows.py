"""As-of features. Windows are in day numbers: (t - W, t] is -(W-1)..0, [t - W, t) is -W..-1."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import kth_in_windows, sliding_medians
from .quantiles import quantiles
from .storage import cut


def day_number(date: str) -> Column:
    return F.unix_date(F.col(date).cast("date"))


def vwap(df: DataFrame, by: list[str], date: str, key: str, price: str, days: int, min_n: int, weight: str = "dollar", out: str = "vwap") -> DataFrame:
    """Weighted mean of prices in (t - days, t], taken at the row before: a row never sees itself.

    weight "dollar" weighs a price by itself, "equal" by 1. Rows of a day count in the order of key.
    The long windows run on one row for each group and day, so a group of millions of rows, or one
    global group, is a short series; rows of a day are the only ones that meet in a window.
    """
    by = list(by)
    p = F.col(price).cast("double")
    num, den = (p * p, p) if weight == "dollar" else (p, F.when(p.isNotNull(), F.lit(1.0)))
    work = df.withColumns({"_day": day_number(date), "_num": num, "_den": den})
    daily = work.groupBy(*by, "_day").agg(*[F.sum(c).alias(c) for c in ("_num", "_den")], F.count(p).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_day")
    total = lambda c, a, b: F.coalesce(F.sum(c).over(w.rangeBetween(a, b)), F.lit(0))
    cols = ("_num", "_den", "_n")
    daily = daily.select(*by, "_day", *[total(c, -(days - 1), -1).alias(f"p{c}") for c in cols], *[total(c, -(days - 1), 0).alias(f"e{c}") for c in cols])
    daily = daily.withColumns({f"l{c}": F.lag(f"e{c}").over(w) for c in cols}).drop(*[f"e{c}" for c in cols])
    same = Window.partitionBy(*by, "_day").orderBy(key)
    run = same.rowsBetween(Window.unboundedPreceding, -1)
    inside = work.withColumns({"_place": F.row_number().over(same), "r_num": F.sum("_num").over(run), "r_den": F.sum("_den").over(run), "r_n": F.count(p).over(run)})
    got = inside.join(daily, [*by, "_day"])
    at = lambda c: F.when(F.col("_place") == 1, F.col(f"l{c}")).otherwise(F.col(f"p{c}") + F.coalesce(F.col(f"r{c}"), F.lit(0)))
    value = F.when(at("_n") >= min_n, F.try_divide(at("_num"), at("_den")))
    return got.withColumn(out, value).select(*[F.col(f"`{c}`") for c in df.columns], out)


#: Counts of one group's range of values that a task of rolling_medians is to hold.
MEDIAN_ROWS = 200_000


def _chunked_medians(df: DataFrame, by: list[str], date: str, key: str, value: str, frames: dict[str, tuple[int, str, int]]) -> DataFrame:
    """rolling_medians where a window ends at the row itself: it depends on the row, not on the day alone.

    Each group's time is cut into chunks as long as the longest window; a task holds two chunks of one
    group, so its rows grow with the rows of a day.
    """
    span = max(days for days, _, _ in frames.values())
    rows = df.select(*by, F.col(key).alias("_key"), day_number(date).alias("_day"), F.col(value).cast("double").alias("_value")).where("_day is not null")
    chunk = F.floor(F.col("_day") / span)
    spread = rows.withColumn("_chunk", F.explode(F.array(chunk, chunk + 1))).withColumn("_own", F.col("_chunk") == chunk)
    names = list(frames)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_day", "_key"], kind="stable")
        got = sliding_medians(pdf["_day"].to_numpy(), pdf["_value"].to_numpy(float), [frames[n] for n in names], "row")
        out = pd.DataFrame({"_key": pdf["_key"]} | dict(zip(names, got, strict=True)))
        return out[pdf["_own"].to_numpy(bool)]

    kind = dict(rows.dtypes)["_key"]
    got = spread.groupBy(*by, "_chunk").applyInPandas(run, f"_key {kind}, " + ", ".join(f"{n} double" for n in names))
    got = got.select(F.col("_key"), *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
    return df.join(got, df[key] == got["_key"], "left").drop("_key")


def _frame_days(days: int, closed: str) -> tuple[int, int]:
    return (-days, -1) if closed == "left" else (-(days - 1), 0)


def daily_medians(df: DataFrame, by: list[str], date: str, value: str, frames: dict[str, tuple[int, str, int]], task_rows: int = MEDIAN_ROWS) -> DataFrame:
    """(_by0, _by1, ... for `by`, _day, a column for each frame): exact medians as of each day that a group has.

    Values are counted by group and day, and the counts are dealt by ranges of (group, value), as many as their
    number asks for, so a range holds about task_rows counts and a group has as many buckets as ranges reach
    into it; nothing about the ranges is gathered or broadcast. Sums of the buckets' daily counts over
    each window tell which bucket holds the median and at which place, and only there a task looks at the
    values, for all days at once (order_stats). A value that is very common is one count a day. So a task's
    rows do not grow with the group.
    """
    g = [f"_by{i}" for i in range(len(by))]
    lower = [F.col(c).alias(n) for c, n in zip(by, g, strict=True)]
    v = F.col(value).cast("double")
    rows = df.select(*lower, day_number(date).alias("_day"), F.when(~F.isnan(v), v).alias("_v")).where("_day is not null")
    counts = cut(rows.groupBy(*g, "_day", "_v").agg(F.count("*").alias("_c")))
    held = counts.where("_v is not null")
    ranges = -(-held.count() // task_rows)
    if ranges > 1:
        placed = cut(held.repartitionByRange(ranges, *g, "_v").withColumn("_b", F.spark_partition_id()))
    else:
        placed = held.withColumn("_b", F.lit(0))
    days = counts.select(*g, "_day").distinct()
    if g and ranges > 1:
        ends = placed.groupBy(*[F.col(x).alias(f"{x}_") for x in g]).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))  # a group's ranges follow each other
        same = reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in g])
        of = days.join(ends, same).select(*g, "_day", F.explode(F.sequence("_lo", "_hi")).alias("_b"))
    else:
        of = days.select(*g, "_day", F.explode(F.sequence(F.lit(0), F.lit(max(1, ranges) - 1))).alias("_b"))
    grid = of.withColumn("_c", F.lit(0).cast("long"))
    daily = placed.select(*g, "_day", "_b", "_c").unionByName(grid).groupBy(*g, "_day", "_b").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy(*g, "_b").orderBy("_day")
    names = list(frames)
    seen = daily.select(*g, "_day", "_b", *[F.coalesce(F.sum("_c").over(w.rangeBetween(*_frame_days(*frames[n][:2]))), F.lit(0)).alias(f"n{i}") for i, n in enumerate(names)])
    upto = Window.partitionBy(*g, "_day").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*g, "_day")
    summed = seen.withColumns({f"e{i}": F.sum(f"n{i}").over(upto) for i in range(len(names))} | {f"t{i}": F.sum(f"n{i}").over(whole) for i in range(len(names))})
    asked = [F.struct(F.lit(i).alias("f"), F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("end"), F.col(f"t{i}").alias("total"), F.lit(frames[n][2]).alias("least")) for i, n in enumerate(names)]
    each = summed.select(*g, "_day", "_b", F.explode(F.array(*asked)).alias("_a")).select(*g, "_day", "_b", "_a.*").where("total >= greatest(least, 1)")
    place = F.explode(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))).alias("_k")
    wanted = each.select(*g, "_day", "_b", "f", (F.col("end") - F.col("n")).alias("_start"), "end", place.alias("_k")).where("_k >= _start and _k < end")
    wanted = cut(wanted.select(*g, "_b", "_day", "f", (F.col("_k") - F.col("_start")).alias("_k")))
    spans = [_frame_days(*frames[n][:2]) for n in names]

    def find(key: tuple, events: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        events = events.sort_values("_day", kind="stable")
        day, asked, f = events["_day"].to_numpy(), ask["_day"].to_numpy(), ask["f"].to_numpy()
        a, b = np.array([x for x, _ in spans]), np.array([x for _, x in spans])
        begin, end = np.searchsorted(day, asked + a[f], "left"), np.searchsorted(day, asked + b[f], "right")
        return ask[[*g, "_day", "f"]].assign(m=kth_in_windows(events["_v"].to_numpy(float), events["_c"].to_numpy(), begin, end, ask["_k"].to_numpy()))

    types = dict(wanted.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*g, "_day", "f"]) + ", m double"
    found = placed.groupBy(*g, "_b").cogroup(wanted.groupBy(*g, "_b")).applyInPandas(find, schema)
    return found.groupBy(*g, "_day").agg(*[F.avg(F.when(F.col("f") == i, F.col("m"))).alias(n) for i, n in enumerate(names)])


def _of_day(df: DataFrame, daily: DataFrame, by: list[str], date: str) -> DataFrame:
    """df with the columns of daily, by group and day; null groups meet."""
    day = daily.withColumnRenamed("_day", "_of")
    same = day_number(date).eqNullSafe(F.col("_of"))
    for i, c in enumerate(by):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}"))
    return df.join(day, same, "left").drop("_of", *[f"_by{i}" for i in range(len(by))])


def rolling_medians(df: DataFrame, by: list[str], date: str, key: str, value: str, frames: dict[str, tuple[int, str, int]], ties: str = "peers") -> DataFrame:
    """df with a column for each frame {name: (days, closed, min_n)}: the exact median of `value`.

    closed is "left" or "right"; a window takes whole days, so the rows of a day share one median
    (daily_medians). With ties "row" a right-closed window ends at the row. Null dates give nulls.
    """
    if ties == "row":
        return _chunked_medians(df, list(by), date, key, value, frames)
    return _of_day(df, daily_medians(df, list(by), date, value, frames), list(by), date)


def rolling_median(df: DataFrame, by: list[str], date: str, key: str, value: str, days: int, min_n: int, ties: str = "peers", out: str = "median") -> DataFrame:
    """Right-closed median, taken at the row before in (date, key) order of the group."""
    got = rolling_medians(df, by, date, key, value, {"_m": (days, "right", min_n)}, ties)
    return previous_row(got, by, date, key, "_m", out).drop("_m")


def previous_row(df: DataFrame, by: list[str], date: str, key: str, value: str, out: str) -> DataFrame:
    """df with the value of the row before in (date, key) order of the group: that of the same day, or for
    a day's first row the last of the day before. Only rows of a day meet in a window."""
    by = list(by)
    work = df.withColumn("_d", day_number(date))
    same = Window.partitionBy(*by, "_d").orderBy(key)
    work = work.withColumns({"_in": F.lag(value).over(same), "_place": F.row_number().over(same), "_end": F.row_number().over(Window.partitionBy(*by, "_d").orderBy(F.col(key).desc()))})
    g = [f"_by{i}" for i in range(len(by))]
    last = work.where("_end = 1").select(*[F.col(c).alias(n) for c, n in zip(by, g, strict=True)], "_d", F.col(value).alias("_last"))
    last = last.select(*g, F.col("_d").alias("_day"), F.lag("_last").over(Window.partitionBy(*g).orderBy("_d")).alias("_before"))
    got = _of_day(work, last, by, date)
    return got.withColumn(out, F.when(F.col("_place") == 1, F.col("_before")).otherwise(F.col("_in"))).drop("_d", "_in", "_place", "_end", "_before")


def asof_group_medians(df: DataFrame, by: list[str], date: str, key: str, price: str, frames: dict[str, tuple[int, int]], train: Column | None = None, log_domain: bool = False) -> DataFrame:
    """Left-closed medians {name: (days, min_n)} of the previous row's price, train rows only."""
    price_c = F.col(price).cast("double")
    value = price_c if train is None else F.when(train, price_c)
    value = F.log1p(value) if log_domain else value
    work = df.withColumn("_v", value)
    work = previous_row(work, by, date, key, "_v", "_prev")
    got = rolling_medians(work, by, date, key, "_prev", {n: (d, "left", m) for n, (d, m) in frames.items()}).drop("_v", "_prev")
    return got.withColumns({n: F.expm1(n) for n in frames}) if log_domain else got


def recency_medians(df: DataFrame, by: list[str], date: str, key: str, price: str, days: tuple[int, ...] = (30, 90, 180, 365), min_n: int = 1, prefix: str = "rec2") -> DataFrame:
    """Medians for each look-back and the ratios of 30 and 90 to 365 days (0 gives null)."""
    names = {f"{prefix}_{d}": (d, min_n) for d in days}
    out = asof_group_medians(df, by, date, key, price, names)
    ratio = lambda a, b: F.try_divide(F.col(f"{prefix}_{a}"), F.when(F.col(f"{prefix}_{b}") != 0, F.col(f"{prefix}_{b}")))
    return out.withColumns({f"{prefix}_ratio_{a}_365": ratio(a, 365) for a in (30, 90) if 365 in days and a in days})


def batch_recency(requests: DataFrame, history: DataFrame, by: list[str], date: str, key: str, price: str, days: tuple[int, ...] = (30, 90, 180, 365), min_n: int = 1) -> DataFrame:
    """recency_medians for requests over history and requests together; a request's price is not used."""
    both = history.withColumn("_asked", F.lit(False)).unionByName(requests.withColumn(price, F.lit(None).cast("double")).withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    frames = {f"rec2_{d}": (d, "left", min_n) for d in days}
    got = rolling_medians(both, by, date, key, price, frames).where("_asked")
    return got.drop("_asked", price)


def pct_spread(short: Column, long: Column) -> Column:
    return F.coalesce(F.try_divide(short - long, F.when(long != 0, long)) * 100, F.lit(0.0))


def momentum(short: Column, long: Column) -> Column:
    return F.try_divide(short, F.when(long != 0, long))


def rolling_daily_mean(daily: DataFrame, days: int = 365, min_n: int = 10) -> DataFrame:
    """Mean of daily means over (t - days, t] at the day before, null if it had fewer than min_n rows.
    daily: (day, mean, n), one row a day."""
    w = Window.orderBy(F.unix_date("day"))
    r = w.rangeBetween(-(days - 1), 0)
    work = daily.withColumns({"_m": F.avg("mean").over(r), "_c": F.sum("n").over(r)})
    return work.withColumns({"rolling_mean": F.lag("_m").over(w), "rolling_n": F.lag("_c").over(w)}).withColumn("rolling_mean", F.when(F.col("rolling_n") >= min_n, F.col("rolling_mean"))).drop("_m", "_c")


def anchored_vwap(daily: DataFrame, min_n: int = 10) -> DataFrame:
    """Running mean of all rows up to the day, null until min_n rows."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("n").over(w)
    return daily.withColumn("anchored_vwap", F.when(n >= min_n, F.sum(F.col("mean") * F.col("n")).over(w) / n))


def combined_daily_vwap(df: DataFrame, date: str, price: str, groups: Column, short: int = 90, long: int = 730, min_days: int = 3) -> DataFrame:
    """Daily sums of the chosen rows, ratio of sums over both windows at the day before, and the daily mean."""
    daily = df.where(groups & F.col(date).isNotNull()).groupBy(F.col(date).cast("date").alias("day")).agg(F.sum(price).alias("s"), F.count(price).alias("n"))
    w = Window.orderBy(F.unix_date("day"))
    ratio = lambda d, least: F.when(F.count("s").over(w.rangeBetween(-(d - 1), 0)) >= least, F.sum("s").over(w.rangeBetween(-(d - 1), 0)) / F.sum("n").over(w.rangeBetween(-(d - 1), 0)))
    work = daily.withColumns({"_a": ratio(short, min_days), "_b": ratio(long, 1)})
    return work.select("day", (F.col("s") / F.col("n")).alias("mean"), F.lag("_a").over(w).alias("vwap_short"), F.lag("_b").over(w).alias("vwap_long"))


def _least_factor(span: int) -> int:
    """Days of a block: its decay stays above a millionth, so that quotients by it keep their digits."""
    keep = 1 - 2 / (span + 1)
    return max(1, int(math.log(1e6) / -math.log(keep))) if keep > 0 else 1


def _carried(blocks: DataFrame, g: list[str]) -> DataFrame:
    """_e_in, the mean that enters each block: the blocks' maps e -> a e + b in order. A group's list has one item for
    each block of the calendar, and one fold walks it."""
    listed = blocks.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("_b", "_a", "_add"))).alias("_all"))
    start = F.struct(F.lit(0.0).alias("e"), F.array().cast("array<struct<_b:bigint,_e_in:double>>").alias("seen"))
    step = lambda s, x: F.struct((s["e"] * x["_a"] + x["_add"]).alias("e"), F.array_append(s["seen"], F.struct(x["_b"].alias("_b"), s["e"].alias("_e_in"))).alias("seen"))
    return listed.select(*g, F.explode(F.aggregate("_all", start, step, lambda s: s["seen"])).alias("_x")).select(*g, "_x.*")


def ema_daily(df: DataFrame, date: str, col: str, span: int = 365, min_periods: int = 30, by: list[str] = ()) -> DataFrame:
    """Exponential mean (adjust=False) of the daily mean over all calendar days; days without rows carry
    the mean on, and weaken its weight. Null groups are one group; days before min_periods means are null.

    Each day's mean is a map e -> a e + b of the mean before. Maps compose, so days are cut into blocks of the
    calendar, short enough for a running product of the factors a: inside a block a mean is that product times
    (the mean that enters + the sum of b over the product so far); blocks pass their composed map on. No task
    needs all days of a group.
    """
    if span < 1:
        raise ValueError("span has to be 1 or more")
    size, rate = _least_factor(span), 2 / (span + 1)
    g = [f"_by{i}" for i in range(len(by))]
    daily = df.where(F.col(date).isNotNull()).groupBy(*[F.col(c).alias(n) for c, n in zip(by, g, strict=True)], day_number(date).alias("_day")).agg(F.avg(col).cast("double").alias("_x"))
    daily = daily.select(*g, "_day", F.floor(F.col("_day") / size).cast("long").alias("_b"), F.when(~F.isnan("_x"), F.col("_x")).alias("_x"))
    daily = cut(daily)  # one row for each group and day, read for the blocks and for their days
    met = F.when(F.col("_x").isNotNull(), F.col("_day"))
    ends = daily.groupBy(*g, "_b").agg(F.min("_day").alias("_from"), F.max(met).alias("_to"), F.count("_x").alias("_n"))
    over_blocks = Window.partitionBy(*g).orderBy("_b")
    before = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(c).alias(f"{c}_") for c in g], F.col("_b").alias("_bb"), F.max("_to").over(before).alias("_last"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_had"), F.lead("_from").over(over_blocks).alias("_next"))
    same = lambda d: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in g], F.col(d) == F.col("_bb"))
    inside = Window.partitionBy(*g, "_b").orderBy("_day")
    upto, earlier = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = daily.join(ends, same("_b")).withColumns({"_own": F.max(met).over(earlier), "_k": F.count("_x").over(upto) + F.col("_had"), "_until": F.coalesce(F.lead("_day").over(inside), "_next")})
    fade = F.coalesce(F.pow(F.lit(1 - rate), F.col("_day") - F.coalesce("_own", "_last")), F.lit(0.0))
    rows = rows.withColumn("_f", F.when(met.isNotNull(), fade)).withColumns({"_factor": F.col("_f") / (F.col("_f") + rate), "_b0": F.col("_x") * rate / (F.col("_f") + rate)})
    enters = F.max(F.when(F.col("_own").isNull(), F.col("_factor"))).over(upto)  # the block's first mean meets the one that enters; it may be 0
    rows = rows.withColumns({"_enter": F.coalesce(enters, F.lit(1.0)), "_p": F.exp(F.coalesce(F.sum(F.when(F.col("_own").isNotNull(), F.ln("_factor"))).over(upto), F.lit(0.0)))})
    rows = rows.withColumn("_s", F.coalesce(F.sum(F.col("_b0") / F.col("_p")).over(upto), F.lit(0.0)))
    rows = rows.drop("_bb", *[f"{c}_" for c in g])
    last = rows.groupBy(*g, "_b").agg(F.max_by(F.struct((F.col("_p") * F.col("_enter")).alias("a"), (F.col("_p") * F.col("_s")).alias("add")), "_day").alias("_m"))
    carried = _carried(last.select(*g, "_b", F.col("_m.a").alias("_a"), F.col("_m.add").alias("_add")), g)
    carried = carried.select(*[F.col(c).alias(f"{c}_") for c in g], F.col("_b").alias("_bb"), "_e_in")
    value = F.col("_p") * (F.col("_enter") * F.col("_e_in") + F.col("_s"))
    rows = rows.join(carried, same("_b")).withColumn("ema", F.when(F.col("_k") >= max(1, min_periods), value))
    day = F.explode(F.sequence(F.col("_day"), F.coalesce(F.col("_until") - 1, F.col("_day")))).alias("_on")
    return rows.select(*[F.col(n).alias(c) for c, n in zip(by, g, strict=True)], day, "ema").select(*by, F.date_from_unix_date("_on").alias("day"), "ema")


def _prior(daily: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """Running sum and count of all history before each asked day, by as-of union."""
    from .joins import asof_join

    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = daily.withColumn("_run", F.struct(F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n")))
    return asof_join(asked, run, by, "at", "day", "_run", strict=True, out="run")


def lookback_means(requests: DataFrame, history: DataFrame, by: str, date: str, price: str, key: str) -> DataFrame:
    """Mean price of the same group in the 3 and 12 calendar months before each request (strictly before).

    Fewer than 5 (3 months) or 20 (12 months) rows: all rows before; a group without history: all
    groups. Sums up to two days are subtracted, both found as-of on daily sums, once for each group and
    day that is asked for: no range join.
    """
    hist = history.where(F.col(price).isNotNull()).withColumn("_all", F.lit(1))
    asked = requests.select(F.col(by), F.col(date).cast("date").alias("_d")).distinct().withColumn("_all", F.lit(1))
    for level, cols in (("g", [by]), ("a", ["_all"])):
        daily = hist.groupBy(*cols, F.col(date).cast("date").alias("day")).agg(F.sum(price).alias("s"), F.count(price).alias("n"))
        for name, at in (("now", F.col("_d")), ("m3", F.add_months("_d", -3)), ("m12", F.add_months("_d", -12))):
            asked = _prior(daily, asked.withColumn("at", at), cols).withColumns({f"{level}_{name}_s": F.coalesce("run.s", F.lit(0.0)), f"{level}_{name}_n": F.coalesce("run.n", F.lit(0))}).drop("run", "at")
            asked = cut(asked)  # each look-up reads the last one's rows twice
    c = F.col
    pick = lambda name, what: F.when(c("g_now_n") > 0, c(f"g_{name}_{what}")).otherwise(c(f"a_{name}_{what}"))
    out = []
    for name, least in (("m3", 5), ("m12", 20)):
        s, n = pick("now", "s") - pick(name, "s"), pick("now", "n") - pick(name, "n")
        out.append(F.when(n >= least, F.try_divide(s, n)).otherwise(F.try_divide(pick("now", "s"), pick("now", "n"))).alias(f"vwap_{name[1:]}m"))
    got = asked.select(c(by).alias("_g0"), c("_d").alias("_d0"), *out)
    return requests.join(got, c(by).eqNullSafe(c("_g0")) & c(date).cast("date").eqNullSafe(c("_d0")), "left").drop("_g0", "_d0")


def group_momentum(requests: DataFrame, history: DataFrame, by: list[str], date: str, key: str, price: str) -> DataFrame:
    """requests with momentum: the group's median price of the 30 days before the request's day against
    that of the 12 calendar months before it; null without prices or with a long median of 0."""
    frames = {"_m30": (30, "left", 1), "_m365": (365, "left", 1), "_m366": (366, "left", 1)}
    both = history.select(*by, date, key, price).withColumn("_asked", F.lit(False)).unionByName(requests.select(*by, date, key, F.lit(None).cast("double").alias(price)).withColumn("_asked", F.lit(True)))
    got = rolling_medians(both, by, date, key, price, frames).where("_asked")
    year = F.datediff(F.col(date), F.add_months(F.col(date).cast("date"), -12))
    long = F.when(year == 366, F.col("_m366")).otherwise(F.col("_m365"))
    return requests.join(got.select(F.col(key).alias("_k"), momentum(F.col("_m30"), long).alias("momentum")), F.col(key) == F.col("_k"), "left").drop("_k")


def momentum_30d_12m(requests: DataFrame, history: DataFrame, date: str, price: str) -> DataFrame:
    """30-day left-closed mean of daily means as of the request, against that of 365 days before, minus 1,
    within -1..1. daily covers every calendar day up to the history's end."""
    from .joins import asof_join

    daily = history.where(F.col(date).isNotNull()).groupBy(F.col(date).cast("date").alias("day")).agg(F.avg(price).alias("mean"))
    days = daily.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day")).join(daily, "day", "left")
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-30, -1)
    series = days.select("day", F.avg("mean").over(w).alias("rm")).where("rm is not null").withColumn("_one", F.lit(1))
    asked = requests.select(F.col(date).cast("date").alias("_d0")).distinct().withColumns({"_one": F.lit(1), "_d1": F.date_sub("_d0", 365)})
    got = asof_join(asof_join(asked, series, ["_one"], "_d0", "day", "rm", strict=True, out="_now"), series, ["_one"], "_d1", "day", "rm", out="_then")
    ratio = F.try_divide(F.col("_now"), F.when(F.col("_then") != 0, F.col("_then"))) - 1
    got = got.select("_d0", F.when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))).alias("momentum"))
    return requests.join(got, F.col(date).cast("date").eqNullSafe(F.col("_d0")), "left").drop("_d0")


def recency_weights(df: DataFrame, date: str, halflife: float, ref: Column) -> DataFrame:
    """exp(-ln 2 * age / halflife), the largest set to 1."""
    raw = F.exp(-F.log(F.lit(2.0)) * F.datediff(ref, F.col(date)) / halflife)
    work = df.withColumn("_w", raw)
    top = work.agg(F.max("_w").alias("_top"))
    return work.join(F.broadcast(top)).withColumn("recency_weight", F.col("_w") / F.col("_top")).drop("_w", "_top")


def sample_weights(df: DataFrame, target: str, cap: float | None = None, clip: tuple[float, float] | None = None, tail: tuple[float, float] | None = None, outlier: str | None = None, outlier_factor: float = 0.35) -> DataFrame:
    """1 / sqrt of the target within 1..cap (default: its 99.5th percentile), optionally clipped, with mean 1;
    times tail[1] above tail[0], times outlier_factor where the column outlier holds."""
    stats = quantiles(df, [], {"_cap": (F.col(target), 0.995)}) if cap is None else df.sparkSession.range(1).select(F.lit(float(cap)).alias("_cap"))
    y = F.greatest(F.lit(1.0), F.least(F.col("_cap"), F.col(target).cast("double")))
    w = 1 / F.sqrt(y)
    if clip:
        w = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), w))
    work = df.join(F.broadcast(stats)).withColumn("_w", w)
    out = work.join(F.broadcast(work.agg(F.avg("_w").alias("_mean")))).withColumn("_w", F.col("_w") / F.col("_mean"))
    if tail:
        out = out.withColumn("_w", F.when(F.col(target) > tail[0], F.col("_w") * tail[1]).otherwise(F.col("_w")))
    if outlier:
        out = out.withColumn("_w", F.when(F.col(outlier), F.col("_w") * outlier_factor).otherwise(F.col("_w")))
    return out.withColumn("sample_weight", F.col("_w")).drop("_w", "_cap", "_mean")
