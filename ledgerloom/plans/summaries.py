"""Queries over marts, outliers and fit/apply pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import encode, filters, gram, marts, metrics, outliers

from .base import TX, TXL, query, rounded, table, tx


@query("a1_median_by_group", f"WITH {TX} SELECT suburb, median(price) AS median FROM tx GROUP BY 1")
def a1(spark, sf):
    return marts.median_by_group(tx(spark, sf), ["suburb"], "price")


@query("a2_monthly_average", f"WITH {TX} SELECT date_trunc('month', date)::DATE AS month, round(avg(price), 4) AS mean FROM tx GROUP BY 1")
def a2(spark, sf):
    return rounded(marts.monthly_average(tx(spark, sf), "date", "price"), ["mean"])


@query("a3_cumulative_change", f"WITH {TX}, m AS (SELECT date_trunc('month', date)::DATE AS month, avg(price) AS mean FROM tx GROUP BY 1) SELECT month, round(mean, 4) AS mean, round((mean / (SELECT arg_min(mean, month) FROM m) - 1) * 100, 6) AS change_pct FROM m")
def a3(spark, sf):
    return rounded(rounded(marts.cumulative_change(tx(spark, sf), "date", "price"), ["mean"]), ["change_pct"], 6)


@query("a4_quarterly_median_by_group", f"WITH {TX} SELECT suburb, date_trunc('quarter', date)::DATE AS quarter, median(price) AS median FROM tx WHERE suburb IN (SELECT suburb FROM tx GROUP BY 1 HAVING count(*) >= 10) GROUP BY 1, 2")
def a4(spark, sf):
    return marts.quarterly_median_by_group(tx(spark, sf), "suburb", "date", "price", 10)


@query("a5_daily_mean_count", "SELECT ts::DATE AS day, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1")
def a5(spark, sf):
    return rounded(marts.daily_mean_count(table(spark, sf, "events"), "ts", "value"), ["mean"], 6)


_WEEK = "(date - (isodow(date) - 1)::INTEGER + 6)::DATE"


@query("a6_weekly_volume", f"WITH {TX}, n AS (SELECT suburb, {_WEEK} AS week, count(*) AS n FROM tx GROUP BY 1, 2), w AS (SELECT suburb, unnest(generate_series(min(week), max(week), INTERVAL 7 DAY))::DATE AS week FROM n GROUP BY 1) SELECT suburb, week, coalesce(n, 0)::BIGINT AS n FROM w LEFT JOIN n USING (suburb, week)")
def a6(spark, sf):
    return marts.weekly_volume(tx(spark, sf), "date", "suburb")


@query("a7_group_stats", f"WITH {TX} SELECT suburb, median(price) AS median, round(avg(price), 4) AS mean, count(price) AS n FROM tx GROUP BY 1")
def a7(spark, sf):
    return rounded(marts.group_stats(tx(spark, sf), ["suburb"], "price"), ["mean"])


@query("a8_count_by", f"WITH {TX} SELECT suburb, bed, count(*) AS n, (grouping_id(suburb, bed))::INTEGER AS level FROM tx GROUP BY ROLLUP (suburb, bed) HAVING grouping_id(suburb, bed) < 3")
def a8(spark, sf):
    return marts.count_by(tx(spark, sf), "suburb", "bed")


_NUM = ["price", "floor_size", "bath", "land_value"]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS corr FROM tx" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :])


@query("a9_correlation_matrix", f"WITH {TXL} {_CORR}")
def a9(spark, sf):
    return rounded(marts.correlation_matrix(tx(spark, sf, True), _NUM), ["corr"], 6)


@query("a9_pair_correlations", f"WITH {TXL} {_CORR}")
def a9_pairs(spark, sf):
    """The same by products of column blocks, for any number of columns."""
    got = gram.pair_correlations(tx(spark, sf, True), _NUM)
    return got.select(F.col("x").alias("a"), F.col("y").alias("b"), F.round("corr", 6).alias("corr"))


@query("a10_encode_for_corr", f"WITH {TX} SELECT key, CASE WHEN bed > 3 THEN 1 ELSE 0 END AS big, (date - DATE '1970-01-01')::INTEGER AS date, CASE WHEN coalesce(property_type, 'MISSING') = 'MISSING' THEN 1 ELSE 0 END AS missing_type, CASE WHEN property_type = 'HOUSE' THEN 1 ELSE 0 END AS house, round(count(*) OVER (PARTITION BY suburb) / count(*) OVER ()::DOUBLE, 6) AS suburb_freq FROM tx")
def a10(spark, sf):
    df = tx(spark, sf).select("key", (F.col("bed") > 3).alias("big"), "date", "property_type", "suburb")
    got = marts.encode_for_corr(df, ["key", "big", "date", "property_type", "suburb"], 20)
    return got.select("key", "big", "date", F.col("`property_type=MISSING`").alias("missing_type"), F.col("`property_type=HOUSE`").alias("house"), F.round("suburb_freq", 6).alias("suburb_freq"))


@query("a11_top_k_correlated", f"WITH {TXL}, c AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, abs(corr(ln(1 + price), {c}::DOUBLE)) AS x FROM tx''' for c in _NUM[1:])}) SELECT feature, round(x, 6) AS abs_corr FROM c ORDER BY x DESC LIMIT 2")
def a11(spark, sf):
    return rounded(marts.top_k_correlated(tx(spark, sf, True), "price", _NUM[1:], 2, log_target=True), ["abs_corr"], 6)


@query("a12_anova_oneway", f"WITH {TX}, g AS (SELECT suburb, count(*) AS n, avg(price) AS m, var_pop(price) AS v FROM tx GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean FROM g) SELECT (max(k) - 1)::BIGINT AS df_between, (max(t.n) - max(k))::BIGINT AS df_within, round((sum(g.n * power(m - mean, 2)) / (max(k) - 1)) / (sum(g.n * v) / (max(t.n) - max(k))), 6) AS f FROM g, t")
def a12(spark, sf):
    return rounded(marts.anova_oneway(tx(spark, sf), "suburb", "price").drop("p"), ["f"], 6)


@query("a13_vif", f"WITH {TX}, s AS (SELECT sum(price * price) AS aa, sum(price * bed) AS ab, sum(bed * bed) AS bb FROM tx) SELECT 'price' AS feature, round(1 / (1 - ab * ab / (aa * bb)), 6) AS vif FROM s UNION ALL SELECT 'bed', round(1 / (1 - ab * ab / (aa * bb)), 6) FROM s")
def a13(spark, sf):
    return rounded(marts.vif(tx(spark, sf), ["price", "bed"]), ["vif"], 6)


@query("a14_profile_target", f"WITH {TX} SELECT bed, count(price) AS n, min(price) AS min, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75, round(quantile_cont(price, 0.95), 4) AS p95, max(price) AS max FROM tx GROUP BY 1")
def a14(spark, sf):
    return rounded(marts.profile_target(tx(spark, sf), "price", ["bed"]), ["p25", "p50", "p75", "p95"])


@query("a15_low_entropy_columns", f"WITH {TX}, n AS (SELECT 'flag' AS feature, CASE WHEN key % 50 = 0 THEN 'b' ELSE 'a' END AS level, count(*) AS n FROM tx GROUP BY ALL UNION ALL SELECT 'one', 'x', count(*) FROM tx UNION ALL SELECT 'agency', agency, count(*) FROM tx GROUP BY ALL) SELECT feature, count(*) AS levels, round(max(n) / sum(n)::DOUBLE, 6) AS top_share FROM n GROUP BY 1 HAVING count(*) < 2 OR max(n) / sum(n) > 0.85")
def a15(spark, sf):
    df = tx(spark, sf).select("agency", F.when(F.col("key") % 50 == 0, "b").otherwise("a").alias("flag"), F.lit("x").alias("one"))
    return rounded(marts.low_entropy_columns(df, ["agency", "flag", "one"]), ["top_share"], 6)


@query("a16_importance_by_bucket", "SELECT CASE WHEN p_size > 25 THEN 'p_type' ELSE 'p_brand' END AS base, round(sum(p_retailprice), 4) AS gain FROM part GROUP BY 1 UNION ALL SELECT 'p_size', round(sum(p_size)::DOUBLE, 4) FROM part")
def a16(spark, sf):
    part = table(spark, sf, "part")
    level = F.when(F.col("p_size") > 25, F.concat(F.lit("p_type="), F.col("p_type"))).otherwise(F.concat(F.lit("p_brand="), F.col("p_brand")))
    imp = part.select(level.alias("feature"), F.col("p_retailprice").alias("gain")).unionByName(part.select(F.lit("p_size").alias("feature"), F.col("p_size").cast("double").alias("gain")))
    return rounded(marts.importance_by_bucket(imp, "feature", "gain"), ["gain"])


@query("a17_dataset_fingerprint")
def a17(spark, sf):
    return marts.dataset_fingerprint(tx(spark, sf), "price")


@query("a18_rare_pairs", f"WITH {TX}, n AS (SELECT year_built, bed, count(*) AS n FROM tx GROUP BY 1, 2) SELECT year_built, bed, round(share, 6) AS share FROM (SELECT *, n / sum(n) OVER (PARTITION BY year_built)::DOUBLE AS share FROM n) WHERE share < 0.15")
def a18(spark, sf):
    return rounded(marts.rare_pairs(tx(spark, sf), "year_built", "bed", 0.15), ["share"], 6)


@query("a19_select_features", f"WITH {TXL}, c AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, abs(corr(ln(1 + price), {c}::DOUBLE)) AS x FROM tx''' for c in _NUM[1:])}) SELECT feature FROM (SELECT feature FROM c ORDER BY x DESC, feature LIMIT 2) UNION SELECT 'land_value' UNION SELECT 'agency'")
def a19(spark, sf):
    df = tx(spark, sf, True).withColumn("one", F.lit("x"))
    names = marts.select_features(df, "price", _NUM[1:], ["agency", "one"], k=2, pins=["land_value"])
    return spark.createDataFrame([(n,) for n in names], "feature string")


def _z(col: str, by: str) -> str:
    return f"0.6745 * ({col} - median({col}) OVER (PARTITION BY {by}))"


_MODZ = "m AS (SELECT *, median({c}) OVER (PARTITION BY bed) AS med FROM tx), z AS (SELECT *, median(abs({c} - med)) OVER (PARTITION BY bed) AS mad FROM m)"


@query("o1_modified_z", f"WITH {TX}, {_MODZ.format(c='price')} SELECT key, round(0.6745 * (price - med) / CASE WHEN mad = 0 THEN 1e-9 ELSE mad END, 6) AS z_price FROM z")
def o1(spark, sf):
    return rounded(outliers.modified_z(tx(spark, sf).select("key", "bed", "price"), ["bed"], ["price"]), ["z_price"], 6).select("key", "z_price")


@query("o2_iqr_bounds", f"WITH {TX}, q AS (SELECT bed, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM tx GROUP BY 1) SELECT bed, round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high FROM q")
def o2(spark, sf):
    return rounded(outliers.iqr_bounds(tx(spark, sf), ["bed"], "price"), ["low", "high"])


def _maha(cols: list[str]) -> str:
    mads = ", ".join(f"(SELECT median(abs({c} - (SELECT median({c}) FROM tx))) FROM tx) AS d_{c}, (SELECT median({c}) FROM tx) AS m_{c}" for c in cols)
    return f"s AS (SELECT {mads}), mh AS (SELECT tx.*, {' + '.join(f'coalesce(power(({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1e-9 ELSE d_{c} END, 2), 0)' for c in cols)} AS maha FROM tx, s)"


@query("o3_diag_mahalanobis", f"WITH {TXL}, {_maha(['price', 'floor_size'])} SELECT key, round(maha, 6) AS maha, maha > 4.605170185988092 AS maha_flag FROM mh")
def o3(spark, sf):
    return rounded(outliers.diag_mahalanobis(tx(spark, sf, True), ["price", "floor_size"], 0.9), ["maha"], 6).select("key", "maha", "maha_flag")


_COLS = ["floor_size", "bath", "land_value"]
_RULES = outliers.OutlierRules(main_z=1.5, support_z=0.8, min_support=1, luxury_k=0.5, mahal_p=0.9)


def _zcol(e: str, a: str) -> str:
    return f"m_{a} AS (SELECT key AS k_{a}, {e} AS v, median({e}) OVER (PARTITION BY bed) AS med, bed FROM tx), z_{a} AS (SELECT k_{a}, 0.6745 * (v - med) / CASE WHEN d = 0 THEN 1e-9 ELSE d END AS z_{a} FROM (SELECT *, median(abs(v - med)) OVER (PARTITION BY bed) AS d FROM m_{a}))"


_O4 = f"""WITH {TXL}, {_zcol('ln(1 + price)', 'price')}, {_zcol('ln(1 + capital_value)', 'capital')}, {", ".join(_zcol(c, c) for c in _COLS)}, {_maha(_COLS)},
fence AS (SELECT bed, quantile_cont(capital_value, 0.75) + 0.5 * (quantile_cont(capital_value, 0.75) - quantile_cont(capital_value, 0.25)) AS top FROM tx GROUP BY 1),
j AS (SELECT key, bed, price, capital_value, maha, z_price, z_capital, coalesce(capital_value > top, false) AS luxury,
  {" + ".join(f"coalesce((abs(z_{c}) >= 0.8)::INTEGER, 0)" for c in _COLS)} AS votes,
  coalesce(abs(z_price) >= 1.5, false) OR coalesce(abs(z_capital) >= 1.5, false) AS main_out, coalesce(bed >= 4 AND z_price <= -1, false) AS low_out,
  maha > {outliers.chi2_quantile(0.9, 3)!r} AS maha_flag
  FROM mh JOIN fence USING (bed) JOIN z_price ON k_price = key JOIN z_capital ON k_capital = key {" ".join(f"JOIN z_{c} ON k_{c} = key" for c in _COLS)}),
o AS (SELECT *, (main_out OR low_out OR maha_flag) AND votes >= 1 AND NOT luxury AS outlier FROM j)"""


@query("o4_outlier_mask", f"{_O4} SELECT key, votes::INTEGER AS votes, luxury, outlier FROM o")
def o4(spark, sf):
    return outliers.outlier_mask(tx(spark, sf, True).select("key", "bed", "price", "capital_value", *_COLS), "bed", "price", "capital_value", _COLS, _RULES).select("key", "votes", "luxury", "outlier")


@query("o5_outlier_report", f"{_O4} SELECT key, CASE WHEN main_out THEN 'main' WHEN low_out THEN 'low_for_beds' ELSE 'mahalanobis' END AS reason, round(z_price, 6) AS z_price FROM o WHERE outlier")
def o5(spark, sf):
    _, removed = outliers.outlier_report(tx(spark, sf, True).select("key", "bed", "price", "capital_value", *_COLS), "bed", "price", "capital_value", _COLS, _RULES)
    return rounded(removed.select("key", "reason", "z_price"), ["z_price"], 6)


@query("o6_zscore_filter", f"WITH {TX}, s AS (SELECT bed, avg(price) AS m, stddev_pop(price) AS s FROM tx GROUP BY 1) SELECT key, price FROM tx JOIN s USING (bed) WHERE abs(price - m) / s < 1.5")
def o6(spark, sf):
    return outliers.zscore_filter(tx(spark, sf).select("key", "bed", "price"), ["bed"], "price", 1.5).select("key", "price")


_O7 = f"""WITH {TXL}, {_zcol('price', 'price')}, {_zcol('capital_value', 'capital')}, {", ".join(_zcol(c, c) for c in _COLS)},
e AS (SELECT bed, {", ".join(f"quantile_cont(abs(z_{c}), 0.8) AS e_{c}" for c in _COLS)} FROM tx {" ".join(f"JOIN z_{c} ON k_{c} = key" for c in _COLS)} GROUP BY 1),
n AS (SELECT year_built, bed, count(*) AS n FROM tx GROUP BY 1, 2),
rare AS (SELECT year_built, bed FROM (SELECT *, n / sum(n) OVER (PARTITION BY year_built)::DOUBLE AS share FROM n) WHERE share < 0.15),
j AS (SELECT key, z_price, z_capital, ({" + ".join(f"coalesce((abs(z_{c}) > greatest(1, e_{c}))::INTEGER, 0)" for c in _COLS)} + CASE WHEN rare.bed IS NULL THEN 0 ELSE 1 END) AS votes
  FROM tx JOIN e USING (bed) JOIN z_price ON k_price = key JOIN z_capital ON k_capital = key {" ".join(f"JOIN z_{c} ON k_{c} = key" for c in _COLS)} LEFT JOIN rare ON rare.bed = tx.bed AND rare.year_built = tx.year_built)
SELECT key, votes::INTEGER AS votes, coalesce(abs(z_price) > 1, false) AND votes >= 2 AND NOT coalesce(abs(z_capital) > 3.5, false) AS outlier FROM j"""


@query("o7_support_vote_outliers", _O7)
def o7(spark, sf):
    got = outliers.support_vote_outliers(tx(spark, sf, True).select("key", "bed", "price", "capital_value", "year_built", *_COLS), "bed", "price", "capital_value", _COLS, "year_built", z=1.0, rare_below=0.15)
    return got.select("key", "votes", "outlier")


@query("o8_outlier_scores", f"""WITH {TX}, t AS (SELECT *, ln(1 + price) AS x FROM tx), r AS (SELECT * FROM t WHERE key % 5 <> 0),
g AS (SELECT suburb, median(x) AS m, count(*) AS n FROM r GROUP BY 1), gs AS (SELECT r.suburb, any_value(m) AS m, 1.4826 * median(abs(x - m)) AS s FROM r JOIN g USING (suburb) WHERE n >= 10 GROUP BY 1),
a AS (SELECT median(x) AS m FROM r), al AS (SELECT any_value(m) AS m0, 1.4826 * median(abs(x - m)) AS s0 FROM r, a),
z AS (SELECT key, (x - coalesce(m, m0)) / greatest(coalesce(s, s0), 1e-9) AS z FROM t LEFT JOIN gs USING (suburb), al)
SELECT key, round(z, 6) AS z, abs(z) > 1.5 AS z_flag FROM z""")
def o8(spark, sf):
    t, x = tx(spark, sf), F.log1p("price")
    params = outliers.fit_outlier_scores(t.where("key % 5 != 0"), "suburb", x)
    return rounded(outliers.apply_outlier_scores(t, params, "suburb", x, 1.5, "z").select("key", "z", "z_flag"), ["z"], 6)


@query("o9_winsor", f"WITH {TXL}, p AS (SELECT quantile_cont(price, 0.02) AS a, quantile_cont(price, 0.98) AS b, quantile_cont(floor_size, 0.02) AS c, quantile_cont(floor_size, 0.98) AS d FROM tx WHERE key % 5 <> 0) SELECT key, round(greatest(a, least(b, price)), 4) AS price, CASE WHEN floor_size IS NOT NULL THEN round(greatest(c, least(d, floor_size)), 4) END AS floor_size FROM tx, p")
def o9(spark, sf):
    t = tx(spark, sf, True).select("key", "price", "floor_size")
    p = encode.fit_winsor(t.where("key % 5 != 0"), ["price", "floor_size"], 0.02, 0.98)
    return rounded(encode.apply_winsor(t, p, ["price", "floor_size"]), ["price", "floor_size"])


@query("o10_group_median_impute", f"WITH {TXL}, g AS (SELECT bed, median(floor_size) AS m FROM tx WHERE key % 5 <> 0 GROUP BY 1) SELECT key, round(coalesce(floor_size, m, (SELECT median(floor_size) FROM tx WHERE key % 5 <> 0), 0), 4) AS floor_size FROM tx LEFT JOIN g USING (bed)")
def o10(spark, sf):
    t = tx(spark, sf, True).select("key", "bed", "floor_size")
    p = encode.fit_group_median_impute(t.where("key % 5 != 0"), "bed", ["floor_size"])
    return rounded(encode.apply_group_median_impute(t, p, "bed", ["floor_size"]), ["floor_size"]).select("key", "floor_size")


@query("o11_rare_levels", "WITH n AS (SELECT p_brand AS b, count(*) AS n FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1), c AS (SELECT median(n) AS m FROM n) SELECT p_partkey AS key, CASE WHEN p_brand IS NULL THEN 'OTHER' WHEN n >= 66 THEN p_brand ELSE 'OTHER' END AS brand FROM part LEFT JOIN n ON b = p_brand")
def o11(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"))
    return encode.apply_rare_levels(t, encode.fit_rare_levels(t.where("key % 5 != 0"), ["brand"], 66), ["brand"])


@query("o12_ordinal", "WITH l AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS c FROM (SELECT DISTINCT p_type AS t FROM part WHERE p_size < 20 AND p_type > 'D')) SELECT p_partkey AS key, coalesce(c, -1)::INTEGER AS type_code FROM part LEFT JOIN l ON t = p_type")
def o12(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("type"), "p_size")
    p = encode.fit_ordinal(t.where("p_size < 20 and type > 'D'"), ["type"])
    return encode.apply_ordinal(t, p, ["type"]).select("key", "type_code")


@query("o13_topn_onehot", "WITH n AS (SELECT p_type AS t, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1), x AS (SELECT p_partkey AS key, r FROM part LEFT JOIN n ON t = p_type AND r <= 3) SELECT key, CASE WHEN r = 1 THEN 1 ELSE 0 END AS first, CASE WHEN r = 2 THEN 1 ELSE 0 END AS second, CASE WHEN r = 3 THEN 1 ELSE 0 END AS third, CASE WHEN r IS NULL THEN 1 ELSE 0 END AS other FROM x")
def o13(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("type"))
    levels = encode.fit_topn_onehot(t, ["type"], 3)
    from ledgerloom.functions.scalars import safe_name

    got = encode.apply_topn_onehot(t, levels)
    return got.select("key", *[F.col(f"type_{safe_name(v)}").alias(n) for v, n in zip(levels["type"], ("first", "second", "third"), strict=False)], F.col("type___OTHER").alias("other"))


@query("o14_scalers", f"WITH {TX}, s AS (SELECT avg(price) AS m, stddev_pop(price) AS s, min(land_value) AS a, max(land_value) AS b FROM tx WHERE key % 5 <> 0) SELECT key, round((price - m) / s, 6) AS price, round((land_value - a) / (b - a), 6) AS land_value FROM tx, s")
def o14(spark, sf):
    t = tx(spark, sf).select("key", "price", "land_value")
    train = t.where("key % 5 != 0")
    got = encode.apply_scaler(t, encode.fit_scaler(train, ["price"]), ["price"])
    got = encode.apply_scaler(got, encode.fit_scaler(train, ["land_value"], "minmax"), ["land_value"])
    return rounded(got, ["price", "land_value"], 6)


@query("w14_loo_encode", f"WITH {TX}, g AS (SELECT avg(price) AS g FROM tx WHERE key % 5 <> 0), s AS (SELECT suburb, sum(price) FILTER (key % 5 <> 0) AS s, count(price) FILTER (key % 5 <> 0) AS n FROM tx GROUP BY 1) SELECT key, round(CASE WHEN key % 5 <> 0 THEN CASE WHEN n > 1 THEN (s - price + 10 * g) / (n - 1 + 10) ELSE g END ELSE CASE WHEN n > 0 THEN (s + 10 * g) / (n + 10) ELSE g END END, 4) AS loo FROM tx JOIN s USING (suburb), g")
def w14(spark, sf):
    t = tx(spark, sf).select("key", "suburb", "price")
    return rounded(encode.loo_encode(t, ["suburb"], "price", F.col("key") % 5 != 0).select("key", "loo"), ["loo"])


@query("w15_mean_encode", f"WITH {TX}, p AS (SELECT suburb, avg(price) AS m FROM tx WHERE key % 5 <> 0 AND suburb < 'R' GROUP BY 1) SELECT key, round(coalesce(m, (SELECT avg(price) FROM tx WHERE key % 5 <> 0 AND suburb < 'R')), 4) AS encoded FROM tx LEFT JOIN p USING (suburb)")
def w15(spark, sf):
    t = tx(spark, sf).select("key", "suburb", "price")
    p = encode.fit_mean_encode(t.where("key % 5 != 0 and suburb < 'R'"), "suburb", "price")
    return rounded(encode.apply_mean_encode(t, p, "suburb", "encoded").select("key", "encoded"), ["encoded"])


_H = "h AS (SELECT * FROM tx), q AS (SELECT * FROM tx WHERE key % 20 = 0)"


@query("w16_asof_mean_encode", f"""WITH {TX}, {_H},
ds AS (SELECT suburb, date, sum(price) AS s, count(*) AS n FROM h GROUP BY 1, 2), rs AS (SELECT suburb, date, sum(s) OVER (PARTITION BY suburb ORDER BY date) / sum(n) OVER (PARTITION BY suburb ORDER BY date) AS v FROM ds),
dm AS (SELECT suburb, month(date) AS mo, date, sum(price) AS s, count(*) AS n FROM h GROUP BY 1, 2, 3), rm AS (SELECT suburb, mo, date, sum(s) OVER (PARTITION BY suburb, mo ORDER BY date) / sum(n) OVER (PARTITION BY suburb, mo ORDER BY date) AS v FROM dm),
dg AS (SELECT date, sum(price) AS s, count(*) AS n FROM h GROUP BY 1), rg AS (SELECT date, sum(s) OVER (ORDER BY date) / sum(n) OVER (ORDER BY date) AS v FROM dg),
dn AS (SELECT month(date) AS mo, date, sum(price) AS s, count(*) AS n FROM h GROUP BY 1, 2), rn AS (SELECT mo, date, sum(s) OVER (PARTITION BY mo ORDER BY date) / sum(n) OVER (PARTITION BY mo ORDER BY date) AS v FROM dn),
z AS (SELECT key, suburb, date, month(date) AS mo FROM q)
SELECT z.key, round(coalesce(rs.v, rg.v), 4) AS mean_suburb, round(coalesce(rm.v, rs.v, rn.v, rg.v), 4) AS mean_suburb_month
FROM z ASOF LEFT JOIN rs ON z.suburb = rs.suburb AND z.date > rs.date ASOF LEFT JOIN rm ON z.suburb = rm.suburb AND z.mo = rm.mo AND z.date > rm.date ASOF LEFT JOIN rg ON z.date > rg.date ASOF LEFT JOIN rn ON z.mo = rn.mo AND z.date > rn.date""")
def w16(spark, sf):
    t = tx(spark, sf).select("key", "suburb", "date", "price")
    got = encode.asof_mean_encode(t.where("key % 20 = 0"), t, "date", "price", "suburb")
    return rounded(got.select("key", "mean_suburb", "mean_suburb_month"), ["mean_suburb", "mean_suburb_month"])


@query("w17_floor_to_group_median", f"WITH {TXL}, g AS (SELECT bed, median(floor_size) AS m FROM tx WHERE key % 5 <> 0 GROUP BY 1) SELECT key, round(coalesce(floor_size / nullif(m, 0), 1), 6) AS floor_ratio FROM tx LEFT JOIN g USING (bed)")
def w17(spark, sf):
    got = encode.floor_to_group_median(tx(spark, sf, True), "floor_size", "bed", F.col("key") % 5 != 0)
    return rounded(got.select("key", "floor_ratio"), ["floor_ratio"], 6)


@query("w17_asof_floor_ratio", f"""WITH {TXL}, h AS (SELECT * FROM tx), q AS (SELECT * FROM tx WHERE key % 20 = 0),
a AS (SELECT q.key, q.floor_size, median(h.floor_size) FILTER (h.date < q.date) AS m, median(h.floor_size) AS every FROM q LEFT JOIN h ON h.bed = q.bed GROUP BY 1, 2) SELECT key, round(coalesce(floor_size / nullif(coalesce(m, every), 0), 1), 6) AS floor_ratio FROM a""")
def w17_asof(spark, sf):
    t = tx(spark, sf, True).select("key", "bed", "date", "floor_size")
    got = encode.asof_floor_ratio(t.where("key % 20 = 0"), t, "floor_size", "bed", "date", "key")
    return rounded(got.select("key", "floor_ratio"), ["floor_ratio"], 6)


@query("t1_dedup_latest", f"WITH {TX} SELECT owner, bed, key FROM (SELECT *, row_number() OVER (PARTITION BY owner, bed ORDER BY date DESC, key DESC) AS n FROM tx) WHERE n = 1")
def t1(spark, sf):
    return filters.dedup_latest(tx(spark, sf), ["owner", "bed"], ["date", "key"]).select("owner", "bed", "key")


@query("t2_worst_errors", f"WITH {TX} SELECT key, abs_err FROM (SELECT key, round(abs(price - price * (0.9 + (key % 21) / 100.0)), 4) AS abs_err, abs(price - price * (0.9 + (key % 21) / 100.0)) AS e FROM tx) ORDER BY e DESC, key LIMIT 100")
def t2(spark, sf):
    t = tx(spark, sf).withColumn("pred", F.col("price") * (F.lit(0.9) + (F.col("key") % 21) / 100.0))
    return rounded(metrics.worst_errors(t, "price", "pred", "key", 100).select("key", "abs_err"), ["abs_err"])


@query("t3_top_groups", f"WITH {TX} SELECT owner, count(*) AS n FROM tx GROUP BY 1 ORDER BY n DESC, owner LIMIT 30")
def t3(spark, sf):
    return metrics.top_groups(tx(spark, sf), "owner", 30)


@query("t5_unions", f"WITH {TX} SELECT DISTINCT suburb, bed FROM tx WHERE bed < 3 UNION SELECT DISTINCT suburb, NULL FROM tx WHERE bed >= 3")
def t5(spark, sf):
    t = tx(spark, sf)
    return t.where("bed < 3").select("suburb", "bed").unionByName(t.where("bed >= 3").select("suburb"), allowMissingColumns=True).dropDuplicates()
