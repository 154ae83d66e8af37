import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import filters, joins, splits, windows


def table(seed=0, n=300, days=120):
    r = np.random.default_rng(seed)
    day = np.sort(r.integers(0, days, n))
    return pd.DataFrame({"key": np.arange(n), "g": r.integers(0, 3, n), "date": pd.Timestamp("2020-01-01") + pd.to_timedelta(day, "D"), "price": np.round(r.uniform(100, 900, n), 2)})


def frame(spark, pdf):
    return spark.createDataFrame(pdf.assign(date=pdf["date"].dt.date))


def test_vwap_equals_pandas(spark):
    pdf = table()
    got = windows.vwap(frame(spark, pdf), ["g"], "date", "key", "price", 30, 3).toPandas().set_index("key")["vwap"].sort_index()
    want = []
    for _, x in pdf.groupby("g"):
        x = x.sort_values(["date", "key"]).set_index("date")
        num, den = (x["price"] ** 2).rolling("30D", min_periods=3).sum(), x["price"].rolling("30D", min_periods=3).sum()
        want.append(pd.Series((num / den).shift(1).to_numpy(), index=x["key"].to_numpy()))
    np.testing.assert_allclose(got.to_numpy(float), pd.concat(want).sort_index().to_numpy(), rtol=1e-9)


def test_fold_masks_equal_brute_force(spark):
    """A hot group, null groups and dates, folds that share months and groups; both forms of purge and check agree."""
    r = np.random.default_rng(8)
    day = [None if x < 6 else int(x) for x in r.integers(0, 900, 400)]
    rows = [(i, None if i % 17 == 0 else ("hot" if i % 3 == 0 else f"g{int(r.integers(0, 90))}"), d) for i, d in enumerate(day)]
    df = spark.createDataFrame(rows, "key int, g string, t int").withColumn("date", F.expr("date_add(date '2020-01-15', t)"))
    month = {x["key"]: x["m"] for x in df.select("key", splits.month_label(F.col("date")).alias("m")).collect()}
    first = min(m for m in month.values() if m is not None)
    specs = [(0, first, first + 3, first + 5, first + 6), (1, first, first + 9, first + 8, first + 9), (62, first, first + 11, first + 11, first + 14)]
    plain = {(n, k): "val" if v0 <= m <= v1 else "train" for n, t0, t1, v0, v1 in specs for k, m in month.items() if m is not None and (v0 <= m <= v1 or t0 <= m <= t1)}
    group = {k: g for k, g, _ in rows}
    held = {(n, group[k]) for (n, k), role in plain.items() if role == "val" and group[k] is not None}
    want = {k: role for k, role in plain.items() if role == "val" or (k[0], group[k[1]]) not in held}
    masked = splits.fold_masks(df, "date", specs)
    read = lambda x: {(y["fold"], y["key"]): y["role"] for y in x.collect()}
    folds = splits.mask_roles(masked, "key", [0, 1, 62])
    assert read(folds) == plain and folds.count() == len(plain)
    purged = splits.purge_masks(masked, "g")
    assert read(splits.mask_roles(purged, "key", [0, 1, 62])) == want == read(splits.purge_groups(folds, df, "g", "key"))
    for masks, roles in ((masked, plain), (purged, want)):
        shared = lambda n, of: len({of[k] for (f, k), role in roles.items() if f == n and role == "val"} & {of[k] for (f, k), role in roles.items() if f == n and role == "train"})  # noqa: B023, E731
        expect = [(n, *[sum(f == n and role == x for (f, _), role in roles.items()) for x in ("train", "val")], shared(n, month), shared(n, group)) for n in (0, 1, 62)]
        for got in (splits.check_masks(masks, "date", "g", [0, 1, 62]), splits.check_folds(splits.mask_roles(masks, "key", [0, 1, 62]), df, "date", "g", "key")):
            assert [tuple(x)[:5] for x in got.orderBy("fold").collect()] == expect
            assert all(x["ok"] == (x["shared_months"] == x["shared_groups"] == 0) for x in got.collect())
    assert splits.mask_roles(splits.fold_masks(df, "date", []), "key", []).count() == 0 == splits.check_masks(splits.fold_masks(df, "date", []), "date", "g", []).count()
    with pytest.raises(ValueError):
        splits.fold_masks(df, "date", [(63, 0, 1, 2, 3)])


def test_audit_filters_equal_the_chain(spark):
    """What the mask keeps is what the filters one after another keep; each step's bit and the first step by brute force."""
    r = np.random.default_rng(9)
    rows = [(None if i % 41 == 0 else f"g{int(x)}", None if i % 37 == 0 else float(np.round(p, 2)), int(b)) for i, (x, p, b) in enumerate(zip(r.integers(0, 30, 300), r.lognormal(6, 1, 300), r.integers(1, 6, 300), strict=True))]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "`a.g` string, price double, bed int").withColumnRenamed("a.g", "g").withColumn("a.g", F.lit("x"))
    steps = [("valid", filters.by_test(filters.valid_test(["price"], {"bed": 4}))), ("mean", filters.by_mean("price", 2)), ("median", filters.by_group_median("price", ["g"], 1.5)), ("group", filters.by_qualified_group("g", "price", 3, 0.8))]
    got = filters.audit_filters(df, steps)
    assert got.count() == len(rows) and got.columns == [*df.columns, "failed_steps", "removed_step"]
    chain = filters.drop_invalid(df, ["price"], {"bed": 4})
    kept = [chain]
    for step in (lambda x: filters.mean_multiple_filter(x, "price", 2), lambda x: filters.group_median_filter(x, "price", ["g"], 1.5), lambda x: filters.qualify_groups(x, "g", "price", 3, 0.8)):
        kept.append(step(kept[-1]))
    read = lambda x: sorted((a["g"] or "", a["price"] or -1.0, a["bed"]) for a in x.collect())
    for i, want in enumerate(kept):
        still = got.where(F.col("failed_steps").bitwiseAND(F.lit((2 << i) - 1)) == 0)
        assert read(still) == read(want)
    assert 0 < len(read(kept[-1])) < len(read(kept[0]))
    names = [n for n, _ in steps]
    for x in got.collect():
        bits = [n for i, n in enumerate(names) if x["failed_steps"] >> i & 1]
        assert x["removed_step"] == (bits[0] if bits else None)
    assert filters.audit_filters(df.limit(0), steps).count() == 0 and filters.audit_filters(df, []).where("removed_step is null").count() == len(rows)


def test_blocked_groups_equal_brute_force(spark):
    rows = [(i, None if i % 11 == 0 else f"g{i * i % 23}", ("train", "train", "train", "early", "test", "embargo", None)[i % 7] if i % 5 else "train") for i in range(200)]
    kept = {x["key"] for x in splits.block_split_groups(spark.createDataFrame(rows, "key int, g string, split string"), "g").collect()}
    roles = {r: {g for _, g, s in rows if s == r and g is not None} for r in ("early", "test")}
    gone = {k for k, g, s in rows if (s == "train" and g in roles["early"] | roles["test"]) or (s == "early" and g in roles["test"])}
    assert kept == {k for k, _, _ in rows} - gone and gone


@pytest.mark.parametrize("by", [["g"], []])
def test_asof_medians_equal_pandas(spark, by):
    pdf = table(1)
    got = windows.asof_group_medians(frame(spark, pdf), by, "date", "key", "price", {"m": (20, 3)}).toPandas().set_index("key")["m"].sort_index()
    want = []
    for _, x in pdf.groupby("g") if by else [(0, pdf)]:
        x = x.sort_values(["date", "key"]).set_index("date")
        want.append(pd.Series(x["price"].shift(1).rolling("20D", closed="left", min_periods=3).median().to_numpy(), index=x["key"].to_numpy()))
    np.testing.assert_allclose(got.to_numpy(float), pd.concat(want).sort_index().to_numpy())


def test_row_ties_equal_pandas(spark):
    pdf = table(2)
    got = windows.rolling_median(frame(spark, pdf), ["g"], "date", "key", "price", 15, 2, ties="row").toPandas().set_index("key")["median"].sort_index()
    want = []
    for _, x in pdf.groupby("g"):
        x = x.sort_values(["date", "key"]).set_index("date")
        want.append(pd.Series(x["price"].rolling("15D", min_periods=2).median().shift(1).to_numpy(), index=x["key"].to_numpy()))
    np.testing.assert_allclose(got.to_numpy(float), pd.concat(want).sort_index().to_numpy())


def test_helper_equals_percentile_frame(spark):
    from pyspark.sql import Window

    df = frame(spark, table(3)).withColumn("_d", F.unix_date("date"))
    w = Window.partitionBy("g").orderBy("_d").rangeBetween(-20, -1)
    a = df.withColumn("m", F.percentile("price", 0.5).over(w)).select("key", "m")
    b = windows.rolling_medians(df, ["g"], "date", "key", "price", {"m2": (20, "left", 1)}).select("key", "m2")
    assert a.join(b, "key").where("not (m <=> m2)").count() == 0


def test_no_future_leak(spark):
    pdf = table(4)
    cut = pd.Timestamp("2020-02-15")
    changed = pdf.assign(price=np.where(pdf["date"] >= cut, 1.0, pdf["price"]))
    f = lambda x: windows.recency_medians(windows.vwap(frame(spark, x), ["g"], "date", "key", "price", 30, 1), ["g"], "date", "key", "price").drop("price")
    a, b = f(pdf).where(F.col("date") < cut.date()), f(changed).where(F.col("date") < cut.date())
    assert a.exceptAll(b).count() == 0


def test_ema_equals_pandas(spark):
    pdf = table(5)
    got = windows.ema_daily(frame(spark, pdf), "date", "price", 30, 5).toPandas().sort_values("day")
    s = pdf.groupby("date")["price"].mean().asfreq("D").ewm(span=30, adjust=False, min_periods=5).mean()
    np.testing.assert_allclose(got["ema"].to_numpy(float), s.to_numpy())


@pytest.mark.parametrize("span,least", [(1, 1), (2, 3), (9, 1), (30, 5)])
def test_ema_across_blocks_and_groups_equals_pandas(spark, span, least):
    """Days span many blocks; gaps longer than a block, days without a value first, between and last, a null group."""
    r = np.random.default_rng(span)
    rows = [(g, int(d), float(np.round(r.uniform(-50, 900), 2))) for g in ("a", "b", None) for d in np.sort(r.choice(900, 60, replace=False))]
    rows += [("a", d, 5.0) for d in range(4_000, 4_040)] + [("c", 7, None), ("c", 9, 4.0), ("c", 400, None), ("d", 3, None)]
    df = spark.createDataFrame(rows, "g string, t int, price double").withColumn("date", F.date_add(F.to_date(F.lit("2001-01-01")), F.col("t"))).drop("t")
    got = windows.ema_daily(df, "date", "price", span, least, ["g"]).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "t", "price"])
    assert len(windows.ema_daily(df.limit(0), "date", "price", span, least, ["g"]).collect()) == 0
    for g, x in pdf.groupby("g", dropna=False):
        mine = got[got["g"].isna() if pd.isna(g) else got["g"] == g].sort_values("day")
        daily = x.groupby("t")["price"].mean()
        want = daily.reindex(range(daily.index.min(), daily.index.max() + 1)).ewm(span=span, adjust=False, min_periods=least).mean()
        assert list(pd.to_datetime(mine["day"])) == list(pd.Timestamp("2001-01-01") + pd.to_timedelta(want.index, "D"))
        np.testing.assert_allclose(mine["ema"].to_numpy(float), want.to_numpy(float), rtol=1e-9)


def test_asof_join_keeps_null_of_latest(spark):
    left = spark.createDataFrame([("a", 5), ("a", 2), ("b", 9)], "g string, t int").withColumn("d", F.date_add(F.to_date(F.lit("2020-01-01")), F.col("t")))
    right = spark.createDataFrame([("a", 1, 7.0), ("a", 5, None)], "g string, t int, v double").select("g", F.date_add(F.to_date(F.lit("2020-01-01")), F.col("t")).alias("d"), "v")
    f = lambda strict: {(r["g"], r["t"]): r["v"] for r in joins.asof_join(left, right, ["g"], "d", "d", "v", strict=strict).collect()}
    assert f(False) == {("a", 5): None, ("a", 2): 7.0, ("b", 9): None}
    assert f(True) == {("a", 5): 7.0, ("a", 2): 7.0, ("b", 9): None}


def test_split_parts_make_the_whole(spark):
    df = frame(spark, table(6, days=700))
    s = splits.split_by_months(df, "date")
    assert s.count() == df.count()
    kept = splits.block_split_groups(s, "g")
    assert kept.select("key").subtract(s.select("key")).count() == 0
    folds = splits.walk_forward_folds(df, "date", "key")
    assert splits.check_folds(splits.purge_groups(folds, df, "key", "key"), df, "date", "key", "key").where("not ok").count() == 0


@pytest.mark.parametrize("by", [["g"], []])
def test_value_buckets_give_the_same_medians(spark, by):
    """Buckets of a few rows, a value that half the rows share, null groups, values and dates, repeated keys."""
    pdf = table(7, 400, 90)
    pdf.loc[::2, "price"] = 500.0
    pdf.loc[::17, "price"] = np.nan
    df = frame(spark, pdf).withColumns({"g": F.when(F.col("g") != 2, F.col("g")), "price": F.when(F.col("key") % 34 != 0, F.col("price")), "date": F.when(F.col("key") % 41 != 0, F.col("date"))})
    frames = {"a": (20, "left", 3), "b": (45, "right", 1)}
    got = windows.daily_medians(df, by, "date", "price", frames, task_rows=25).collect()
    rows = [(r["g"] if by else None, r["date"], r["price"]) for r in df.collect() if r["date"]]
    assert len(got) == len({r[:2] for r in rows})
    for x in got:
        day, g = x["_day"], x["_by0"] if by else None
        for name, (days, closed, least) in frames.items():
            first, last = (day - days, day - 1) if closed == "left" else (day - days + 1, day)
            v = [p for h, d, p in rows if h == g and p is not None and p == p and first <= (d - pd.Timestamp("1970-01-01").date()).days <= last]
            assert x[name] == (pytest.approx(np.median(v)) if len(v) >= least else None)


def test_previous_row_equals_lag(spark):
    from pyspark.sql import Window

    df = frame(spark, table(8)).withColumns({"g": F.when(F.col("g") != 2, F.col("g")), "date": F.when(F.col("key") % 41 != 0, F.col("date"))})
    for by in (["g"], []):
        got = windows.previous_row(df, by, "date", "key", "price", "p").withColumn("q", F.lag("price").over(Window.partitionBy(*by).orderBy("date", "key")))
        assert got.count() == df.count() and got.where("not (p <=> q)").count() == 0


def test_kth_in_windows_equals_sorting():
    from ledgerloom.operators.order_stats import kth_in_windows, medians_of_windows

    r = np.random.default_rng(8)
    for n, top in ((1, 1), (2, 9), (300, 5), (300, 10**9), (257, 1)):
        value, weight = r.integers(0, top, n).astype(float) - top / 3, r.integers(0, 4, n)
        begin = r.integers(0, n, 400)
        end = np.minimum(n, begin + r.integers(1, n + 1, 400))
        total = np.array([weight[b:e].sum() for b, e in zip(begin, end, strict=True)])
        begin, end, total = begin[total > 0], end[total > 0], total[total > 0]
        place = r.integers(0, total)
        got = kth_in_windows(value, weight, begin, end, place)
        want = [np.sort(np.repeat(value[b:e], weight[b:e]))[k] for b, e, k in zip(begin, end, place, strict=True)]
        assert (got == want).all()
        value[::3] = np.nan
        got = medians_of_windows(value, begin, end, 2)
        want = [np.nanmedian(value[b:e]) if (~np.isnan(value[b:e])).sum() >= 2 else np.nan for b, e in zip(begin, end, strict=True)]
        np.testing.assert_allclose(got, want)


@pytest.mark.parametrize("by", [["g"], []])
def test_medians_of_many_ranges(spark, by):
    """One group holds most rows and a value that is on every day; ranges of 40 counts, null groups, null and nan values."""
    r = np.random.default_rng(11)
    n = 1500
    g = np.where(r.random(n) < 0.8, "hot", r.choice(["a", "b"], n)).astype(object)
    g[::50] = None
    price = np.round(r.gamma(2, 80, n), 1)
    price[r.random(n) < 0.2] = 77.0
    price[::41] = np.nan
    pdf = pd.DataFrame({"g": g, "day": r.integers(0, 60, n), "price": price})
    df = spark.createDataFrame([(None if x.g is None else str(x.g), int(x.day), None if x.price != x.price else float(x.price)) for x in pdf.itertuples()], "g string, d int, price double")
    df = df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    frames = {"a": (10, "left", 3), "b": (25, "right", 1)}
    got = windows.daily_medians(df, by, "date", "price", frames, task_rows=40).collect()
    assert len(got) == len(pdf[by + ["day"]].drop_duplicates())
    day0 = (pd.Timestamp("2020-01-01") - pd.Timestamp("1970-01-01")).days
    for x in got:
        own = pdf[pdf["g"].isna()] if by and x["_by0"] is None else pdf[pdf["g"] == x["_by0"]] if by else pdf
        d = x["_day"] - day0
        for name, lo, hi, least in (("a", d - 10, d - 1, 3), ("b", d - 24, d, 1)):
            v = own[(own["day"] >= lo) & (own["day"] <= hi)]["price"].dropna()
            assert x[name] == (pytest.approx(v.median()) if len(v) >= least else None)
    plan = windows.daily_medians(df, by, "date", "price", frames, task_rows=40)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
