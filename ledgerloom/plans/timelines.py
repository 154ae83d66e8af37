"""Queries over as-of windows, geo joins, splits, metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import geo, metrics, model, splits, windows

from .base import CATEGORIES, POIS, QUERIES, SQL, TX, TXL, pois, query, rnd, rounded, table, tx


def _vwap_sql(by: str, days: int, least: int, weight: str) -> str:
    num, den = ("price * price", "price") if weight == "dollar" else ("price", "1.0")
    part = f"PARTITION BY {by}" if by else ""
    day = f"PARTITION BY {by + ', ' if by else ''}date"
    early = f"OVER ({part} ORDER BY date RANGE BETWEEN INTERVAL {days - 1} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)"
    same = f"OVER ({day} ORDER BY key ROWS UNBOUNDED PRECEDING)"
    both = lambda e: f"coalesce(sum({e}) {early}, 0) + sum({e}) {same}"
    return f"WITH {TX}, w AS (SELECT key, {by + ', ' if by else ''}date, {both(num)} AS a, {both(den)} AS b, coalesce(count(price) {early}, 0) + count(price) {same} AS n FROM tx) SELECT key, round(lag(CASE WHEN n >= {least} THEN a / b END) OVER ({part} ORDER BY date, key), 4) AS vwap FROM w"


def _vwap(by, days, least, weight):
    def run(spark, sf):
        got = windows.vwap(tx(spark, sf).select("key", "bed", "date", "price"), by, "date", "key", "price", days, least, weight)
        return rounded(got.select("key", "vwap"), ["vwap"])

    return run


for _name, _by, _days, _least, _weight in (("w1_vwap_bed_90d_dollar", ["bed"], 90, 3, "dollar"), ("w1_vwap_bed_730d_equal", ["bed"], 730, 1, "equal"), ("w1_vwap_global_90d_dollar", [], 90, 3, "dollar"), ("w1_vwap_global_730d_equal", [], 730, 1, "equal")):
    query(_name, _vwap_sql(", ".join(_by), _days, _least, _weight))(_vwap(_by, _days, _least, _weight))


def _median_sql(value: str, by: str, days: int, least: int) -> str:
    part = f"PARTITION BY {by}" if by else ""
    w = f"OVER ({part} ORDER BY date RANGE BETWEEN INTERVAL {days - 1} DAYS PRECEDING AND CURRENT ROW)"
    return f"SELECT key, {by + ', ' if by else ''}date, CASE WHEN count({value}) {w} >= {least} THEN median({value}) {w} END AS m"


@query("w2_rolling_median_bed_90d", f"WITH {TX}, m AS ({_median_sql('price', 'bed', 90, 3)} FROM tx) SELECT key, round(lag(m) OVER (PARTITION BY bed ORDER BY date, key), 4) AS median FROM m")
def w2a(spark, sf):
    got = windows.rolling_median(tx(spark, sf).select("key", "bed", "date", "price"), ["bed"], "date", "key", "price", 90, 3)
    return rounded(got.select("key", "median"), ["median"])


_W3 = _vwap_sql("bed", 90, 3, "equal").replace(") SELECT key, round(lag(", "), v AS (SELECT key, bed, date, lag(").replace(", 4) AS vwap FROM w", " AS vwap FROM w)")


@query("w3_rolling_median_of_vwap", f"{_W3}, m AS ({_median_sql('vwap', 'bed', 30, 1)} FROM v) SELECT key, round(m, 4) AS median FROM m")
def w3(spark, sf):
    v = windows.vwap(tx(spark, sf).select("key", "bed", "date", "price"), ["bed"], "date", "key", "price", 90, 3, "equal")
    return rounded(windows.rolling_medians(v, ["bed"], "date", "key", "vwap", {"median": (30, "right", 1)}).select("key", "median"), ["median"])


@query("w2_rolling_median_bed_730d", f"WITH {TX}, m AS ({_median_sql('price', 'bed', 730, 1)} FROM tx) SELECT key, round(lag(m) OVER (PARTITION BY bed ORDER BY date, key), 4) AS median FROM m")
def w2c(spark, sf):
    got = windows.rolling_median(tx(spark, sf).select("key", "bed", "date", "price"), ["bed"], "date", "key", "price", 730, 1)
    return rounded(got.select("key", "median"), ["median"])


def _global_median(days):
    def run(spark, sf):
        return rounded(windows.rolling_median(tx(spark, sf).select("key", "date", "price"), [], "date", "key", "price", days, 1).select("key", "median"), ["median"])

    return run


for _name, _days in (("w2_rolling_median_global_30d", 30), ("w2_rolling_median_global_730d", 730)):
    query(_name, f"WITH {TX}, m AS ({_median_sql('price', '', _days, 1)} FROM tx) SELECT key, round(lag(m) OVER (ORDER BY date, key), 4) AS median FROM m")(_global_median(_days))


def _global_vwap_median(days, least, over):
    def run(spark, sf):
        v = windows.vwap(tx(spark, sf).select("key", "date", "price"), [], "date", "key", "price", days, least, "equal")
        return rounded(windows.rolling_medians(v, [], "date", "key", "vwap", {"median": (over, "right", 1)}).select("key", "median"), ["median"])

    return run


for _days, _least, _over in ((90, 3, 30), (730, 1, 730)):  # shifted by the average alone, as in the reference
    _v = _vwap_sql("", _days, _least, "equal").replace(") SELECT key, round(lag(", "), v AS (SELECT key, date, lag(").replace(", 4) AS vwap FROM w", " AS vwap FROM w)")
    query(f"w3_global_{_over}d_median_of_{_days}d_vwap", f"{_v}, m AS ({_median_sql('vwap', '', _over, 1)} FROM v) SELECT key, round(m, 4) AS median FROM m")(_global_vwap_median(_days, _least, _over))


@query("w4_pct_spread", f"WITH {TXL} SELECT key, round(coalesce((price - capital_value) / nullif(capital_value, 0) * 100, 0), 6) AS spread FROM tx")
def w4(spark, sf):
    return tx(spark, sf, True).select("key", rnd(windows.pct_spread(F.col("price"), F.col("capital_value")), 6).alias("spread"))


def _asof_sql(by: str, frames: dict, train: str = "true") -> str:
    cols = []
    for n, (d, least) in frames.items():
        w = f"OVER (PARTITION BY {by} ORDER BY date RANGE BETWEEN INTERVAL {d} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)"
        cols.append(f"CASE WHEN count(p) {w} >= {least} THEN median(p) {w} END AS {n}")
    return f"WITH {TX}, l AS (SELECT key, suburb, bed, date, lag(CASE WHEN {train} THEN price END) OVER (PARTITION BY {by} ORDER BY date, key) AS p FROM tx), m AS (SELECT key, {', '.join(cols)} FROM l)"


_W5 = {"med90": (90, 8), "med365": (365, 16)}


@query("w5_asof_suburb_median", f"{_asof_sql('suburb', _W5, 'key % 5 <> 0')} SELECT key, round(med90, 4) AS med90, round(med365, 4) AS med365 FROM m")
def w5(spark, sf):
    got = windows.asof_group_medians(tx(spark, sf).select("key", "suburb", "date", "price"), ["suburb"], "date", "key", "price", _W5, F.col("key") % 5 != 0)
    return rounded(got.select("key", "med90", "med365"), ["med90", "med365"])


_W5B = {"med90": (90, 6), "med365": (365, 16)}


@query("w5_asof_suburb_bed_median", f"{_asof_sql('suburb, bed', _W5B)} SELECT key, round(med90, 4) AS med90, round(med365, 4) AS med365 FROM m")
def w5b(spark, sf):
    got = windows.asof_group_medians(tx(spark, sf).select("key", "suburb", "bed", "date", "price"), ["suburb", "bed"], "date", "key", "price", _W5B)
    return rounded(got.select("key", "med90", "med365"), ["med90", "med365"])


@query("w5_asof_suburb_median_log", f"{_asof_sql('suburb', _W5, 'key % 5 <> 0').replace('THEN price END', 'THEN ln(1 + price) END')} SELECT key, round(exp(med90) - 1, 3) AS med90, round(exp(med365) - 1, 3) AS med365 FROM m")
def w5_log(spark, sf):
    got = windows.asof_group_medians(tx(spark, sf).select("key", "suburb", "date", "price"), ["suburb"], "date", "key", "price", _W5, F.col("key") % 5 != 0, log_domain=True)
    return rounded(got.select("key", "med90", "med365"), ["med90", "med365"], 3)


_W6 = {f"rec2_{d}": (d, 1) for d in (30, 90, 180, 365)}
_W6_OUT = ", ".join(f"round({n}, 4) AS {n}" for n in _W6) + ", round(rec2_30 / nullif(rec2_365, 0), 6) AS rec2_ratio_30_365, round(rec2_90 / nullif(rec2_365, 0), 6) AS rec2_ratio_90_365"


@query("w6_recency_medians", f"{_asof_sql('suburb', _W6)} SELECT key, {_W6_OUT} FROM m")
def w6(spark, sf):
    got = windows.recency_medians(tx(spark, sf).select("key", "suburb", "date", "price"), ["suburb"], "date", "key", "price")
    got = rounded(rounded(got, list(_W6)), ["rec2_ratio_30_365", "rec2_ratio_90_365"], 6)
    return got.drop("suburb", "date", "price")


@query("w6_batch_recency", f"WITH {TX}, u AS (SELECT key, suburb, date, price AS p FROM tx), m AS (SELECT key, {', '.join(f'median(p) OVER (PARTITION BY suburb ORDER BY date RANGE BETWEEN INTERVAL {d} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING) AS rec2_{d}' for d in (30, 90, 180, 365))} FROM u) SELECT key, {', '.join(f'round({n}, 4) AS {n}' for n in _W6)} FROM m WHERE key % 20 = 0")
def w6b(spark, sf):
    t = tx(spark, sf).select("key", "suburb", "date", "price")
    got = windows.batch_recency(t.where("key % 20 = 0"), t, ["suburb"], "date", "key", "price")
    return rounded(got.drop("suburb", "date"), list(_W6))


@query("w7_momentum", f"{_asof_sql('suburb', _W6)} SELECT key, round(rec2_90 / nullif(rec2_365, 0), 6) AS momentum FROM m")
def w7(spark, sf):
    got = windows.asof_group_medians(tx(spark, sf).select("key", "suburb", "date", "price"), ["suburb"], "date", "key", "price", {"a": (90, 1), "b": (365, 1)})
    return got.select("key", rnd(windows.momentum(F.col("a"), F.col("b")), 6).alias("momentum"))


_DAILY = f"WITH {TX}, d AS (SELECT date AS day, avg(price) AS mean, count(price) AS n FROM tx GROUP BY 1)"


def _daily(spark, sf):
    from ledgerloom.operators.marts import daily_mean_count

    return daily_mean_count(tx(spark, sf), "date", "price")


@query("w8_rolling_daily_mean", f"{_DAILY}, r AS (SELECT day, avg(mean) OVER w AS m, sum(n) OVER w AS c FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)), l AS (SELECT day, lag(m) OVER (ORDER BY day) AS m, lag(c) OVER (ORDER BY day) AS c FROM r) SELECT day, round(CASE WHEN c >= 10 THEN m END, 4) AS rolling_mean, c::BIGINT AS rolling_n FROM l")
def w8(spark, sf):
    return rounded(windows.rolling_daily_mean(_daily(spark, sf)).select("day", "rolling_mean", "rolling_n"), ["rolling_mean"])


@query("w9_anchored_vwap", f"{_DAILY} SELECT day, round(CASE WHEN sum(n) OVER (ORDER BY day) >= 10 THEN sum(mean * n) OVER (ORDER BY day) / sum(n) OVER (ORDER BY day) END, 4) AS anchored_vwap FROM d")
def w9(spark, sf):
    return rounded(windows.anchored_vwap(_daily(spark, sf)).select("day", "anchored_vwap"), ["anchored_vwap"])


@query("w10_combined_daily_vwap", f"WITH {TX}, d AS (SELECT date AS day, sum(price) AS s, count(price) AS n FROM tx WHERE bed IN (2, 3) GROUP BY 1), r AS (SELECT day, s / n AS mean, CASE WHEN count(*) OVER a >= 3 THEN sum(s) OVER a / sum(n) OVER a END AS x, sum(s) OVER b / sum(n) OVER b AS y FROM d WINDOW a AS (ORDER BY day RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW), b AS (ORDER BY day RANGE BETWEEN INTERVAL 729 DAYS PRECEDING AND CURRENT ROW)) SELECT day, round(mean + 0.000123, 3) AS mean, round(lag(x) OVER (ORDER BY day) + 0.000123, 3) AS vwap_short, round(lag(y) OVER (ORDER BY day) + 0.000123, 3) AS vwap_long FROM r")
def w10(spark, sf):
    # sums of cents over small counts often end on a 5; the shift keeps such ties off the rounding edge
    got = windows.combined_daily_vwap(tx(spark, sf), "date", "price", F.col("bed").isin(2, 3))
    return got.select("day", *[rnd(F.col(c) + 0.000123, 3).alias(c) for c in ("mean", "vwap_short", "vwap_long")])


@query("w11_ema_daily", f"""WITH RECURSIVE {TX}, d AS (SELECT date AS day, avg(price) AS mean FROM tx GROUP BY 1),
c AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d),
s AS (SELECT day, row_number() OVER (ORDER BY day) AS i, mean FROM c LEFT JOIN d USING (day)),
k AS (SELECT day, i, mean, count(mean) OVER (ORDER BY i) AS seen FROM s),
g AS (SELECT i, mean, i - lag(i) OVER (ORDER BY i) AS gap, seen FROM k WHERE mean IS NOT NULL),
e(seen, i, ema) AS (SELECT seen, i, mean FROM g WHERE seen = 1 UNION ALL SELECT g.seen, g.i, (e.ema * power(1 - 2.0 / 366, gap) + mean * (2.0 / 366)) / (power(1 - 2.0 / 366, gap) + 2.0 / 366) FROM e JOIN g ON g.seen = e.seen + 1)
SELECT k.day, CASE WHEN k.seen >= 30 THEN round(ema, 4) END AS ema FROM k JOIN e USING (seen)""")
def w11(spark, sf):
    return rounded(windows.ema_daily(tx(spark, sf), "date", "price"), ["ema"])


@query("w12_lookback_means", f"""WITH {TX}, h AS (SELECT bed, date, price FROM tx), q AS (SELECT key, bed, date FROM tx WHERE key % 20 = 0),
a AS (SELECT q.key, avg(h.price) FILTER (h.bed = q.bed) AS own, avg(h.price) AS every,
  avg(h.price) FILTER (h.bed = q.bed AND h.date >= q.date - INTERVAL 3 MONTH) AS m3, count(h.price) FILTER (h.bed = q.bed AND h.date >= q.date - INTERVAL 3 MONTH) AS n3,
  avg(h.price) FILTER (h.bed = q.bed AND h.date >= q.date - INTERVAL 12 MONTH) AS m12, count(h.price) FILTER (h.bed = q.bed AND h.date >= q.date - INTERVAL 12 MONTH) AS n12,
  avg(h.price) FILTER (h.date >= q.date - INTERVAL 3 MONTH) AS e3, count(h.price) FILTER (h.date >= q.date - INTERVAL 3 MONTH) AS k3,
  avg(h.price) FILTER (h.date >= q.date - INTERVAL 12 MONTH) AS e12, count(h.price) FILTER (h.date >= q.date - INTERVAL 12 MONTH) AS k12
  FROM q LEFT JOIN h ON h.date < q.date GROUP BY q.key)
SELECT key, round(CASE WHEN own IS NOT NULL THEN CASE WHEN n3 >= 5 THEN m3 ELSE own END ELSE CASE WHEN k3 >= 5 THEN e3 ELSE every END END, 4) AS vwap_3m,
  round(CASE WHEN own IS NOT NULL THEN CASE WHEN n12 >= 20 THEN m12 ELSE own END ELSE CASE WHEN k12 >= 20 THEN e12 ELSE every END END, 4) AS vwap_12m FROM a""")
def w12(spark, sf):
    t = tx(spark, sf).select("key", "bed", "date", "price")
    got = windows.lookback_means(t.where("key % 20 = 0").drop("price"), t, "bed", "date", "price", "key")
    return rounded(got.select("key", "vwap_3m", "vwap_12m"), ["vwap_3m", "vwap_12m"])


@query("w13_momentum_30d_12m", f"""WITH {TX}, d AS (SELECT date AS day, avg(price) AS mean FROM tx GROUP BY 1),
c AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d),
s AS (SELECT day, avg(mean) OVER (ORDER BY day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING) AS rm FROM c LEFT JOIN d USING (day)), k AS (SELECT * FROM s WHERE rm IS NOT NULL)
SELECT q.key, CASE WHEN a.rm / nullif(b.rm, 0) IS NOT NULL THEN round(greatest(-1, least(1, a.rm / nullif(b.rm, 0) - 1)), 6) END AS momentum FROM (SELECT key, date, (date - 365)::DATE AS back FROM tx WHERE key % 20 = 0) q ASOF LEFT JOIN k a ON q.date > a.day ASOF LEFT JOIN k b ON q.back >= b.day""")
def w13(spark, sf):
    t = tx(spark, sf).select("key", "date", "price")
    got = windows.momentum_30d_12m(t.where("key % 20 = 0").drop("price"), t, "date", "price")
    return rounded(got.select("key", "momentum"), ["momentum"], 6)


@query("w13_group_momentum", f"""WITH {TX}, a AS (SELECT q.key, median(h.price) FILTER (h.date >= q.date - 30) AS m30, median(h.price) AS m12 FROM (SELECT * FROM tx WHERE key % 20 = 0) q LEFT JOIN tx h ON h.suburb = q.suburb AND h.date < q.date AND h.date >= q.date - INTERVAL 12 MONTH GROUP BY 1)
SELECT key, round(m30 / nullif(m12, 0), 6) AS momentum FROM a""")
def w13_group(spark, sf):
    t = tx(spark, sf).select("key", "suburb", "date", "price")
    got = windows.group_momentum(t.where("key % 20 = 0"), t, ["suburb"], "date", "key", "price")
    return rounded(got.select("key", "momentum"), ["momentum"], 6)


@query("w18_recency_weights", f"WITH {TX}, w AS (SELECT key, exp(-ln(2) * (DATE '2001-08-01' - date) / 180) AS w FROM tx) SELECT key, round(w / (SELECT max(w) FROM w), 9) AS recency_weight FROM w")
def w18(spark, sf):
    got = windows.recency_weights(tx(spark, sf).select("key", "date"), "date", 180, F.to_date(F.lit("2001-08-01")))
    return rounded(got.select("key", "recency_weight"), ["recency_weight"], 9)


@query("w19_sample_weights", f"WITH {TX}, c AS (SELECT quantile_cont(price, 0.995) AS cap FROM tx), w AS (SELECT key, price, 1 / sqrt(greatest(1, least(cap, price))) AS w FROM tx, c) SELECT key, round(w / (SELECT avg(w) FROM w) * CASE WHEN price > 150000 THEN 2 ELSE 1 END * CASE WHEN key % 50 = 0 THEN 0.35 ELSE 1 END, 6) AS sample_weight FROM w")
def w19(spark, sf):
    t = tx(spark, sf).select("key", "price", (F.col("key") % 50 == 0).alias("odd"))
    return rounded(windows.sample_weights(t, "price", tail=(150000.0, 2.0), outlier="odd").select("key", "sample_weight"), ["sample_weight"], 6)


_KM = "2 * 6371.0088 * asin(least(1, sqrt(power(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * power(sin(radians(longitude - lon) / 2), 2))))"
_HOMES = "homes AS (SELECT DISTINCT owner AS key, lat, lon FROM tx)"


def _homes(spark, sf):
    return tx(spark, sf).select(F.col("owner").alias("key"), "lat", "lon").distinct()


@query("j7_nearest_poi", f"WITH {TX}, {POIS}, {_HOMES} SELECT key, {', '.join(f'''round(min({_KM}) FILTER (category = '{c}'), 6) AS dist_{c.lower()}_km''' for c in CATEGORIES)} FROM homes, pois GROUP BY key")
def j7(spark, sf):
    names = [f"dist_{c.lower()}_km" for c in CATEGORIES]
    return rounded(geo.nearest_poi(_homes(spark, sf), pois(spark, sf), "key", CATEGORIES).drop("lat", "lon"), names, 6)


@query("j8_poi_counts", f"WITH {TX}, {POIS}, {_HOMES} SELECT key, {', '.join(f'''count(*) FILTER (category = '{c}' AND {_KM} <= {r}) AS cnt_{c.lower()}_{r}000m''' for c in ('CBD', 'PARK') for r in (1, 5))} FROM homes, pois GROUP BY key")
def j8(spark, sf):
    return geo.poi_counts(_homes(spark, sf), pois(spark, sf), "key", [1.0, 5.0], ["CBD", "PARK"]).drop("lat", "lon")


@query("j9_school_distances", f"WITH {TX}, {POIS}, {_HOMES}, m AS (SELECT key, {', '.join(f'''min({_KM}) FILTER (category = 'SCHOOL_{c}') AS {c}''' for c in ('HIGH', 'PRIMARY', 'INTERMEDIATE'))} FROM homes, pois GROUP BY key) SELECT key, round(HIGH, 6) AS school_high_km, round(least(PRIMARY_, INTERMEDIATE), 6) AS school_primary_km, round(least(HIGH, PRIMARY_, INTERMEDIATE), 6) AS school_any_km FROM m".replace("AS PRIMARY,", "AS PRIMARY_,"))
def j9(spark, sf):
    names = ["SCHOOL_HIGH", "SCHOOL_PRIMARY", "SCHOOL_INTERMEDIATE"]
    got = geo.nearest_poi(_homes(spark, sf), pois(spark, sf), "key", names)
    got = geo.school_distances(got, *[f"dist_{n.lower()}_km" for n in names]).drop("lat", "lon")
    return rounded(got, ["school_high_km", "school_primary_km", "school_any_km"], 6)


_COMPS = f"""q AS (SELECT key AS query_key, bed AS qbed, lat, lon FROM tx WHERE key % 20 = 0), h AS (SELECT key AS comp_key, bed, lat AS latitude, lon AS longitude, price AS comp_price FROM tx),
p AS (SELECT query_key, comp_key, qbed = bed AS same, {_KM} AS km FROM q, h WHERE comp_key <> query_key), r AS (SELECT *, row_number() OVER (PARTITION BY query_key, same ORDER BY km, comp_key) AS n, row_number() OVER (PARTITION BY query_key ORDER BY km, comp_key) AS n_all, count(*) FILTER (same) OVER (PARTITION BY query_key) AS n_same FROM p),
b AS (SELECT query_key, comp_key, same, km, row_number() OVER (PARTITION BY query_key ORDER BY km, comp_key) AS rank FROM r WHERE same AND n <= 5 OR n_same < 5 AND n_all <= 5), best AS (SELECT * FROM b WHERE rank <= 5)"""


def _comps(spark, sf):
    t = tx(spark, sf).select("key", "bed", "lat", "lon", "price")
    asked = t.where("key % 20 = 0")
    return asked, geo.knn_comparables(asked, t, 5, "key", but_itself=True)


@query("j10_knn_comparables", f"WITH {TX}, {_COMPS} SELECT query_key, rank::INTEGER AS rank, comp_key, round(km, 6) AS distance_km FROM best")
def j10(spark, sf):
    return _comps(spark, sf)[1].select("query_key", "rank", "comp_key", rnd("distance_km", 6).alias("distance_km"))


_M11 = f"""WITH {TX}, {_COMPS}, e AS (SELECT query_key, comp_key, km, same, (comp_key % 21 - 10) * 1.0 AS err, 1 / (1 + km) * CASE WHEN same THEN 1.25 ELSE 1 END AS w FROM best),
u AS (SELECT *, sum(w) OVER (PARTITION BY query_key ORDER BY abs(err), comp_key ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY query_key) AS t FROM e)
SELECT query_key AS key, round(avg(err), 6) AS mean_err_pct, round(sum(w * abs(err)) / sum(w), 6) AS half_mean_pct, min(abs(err)) FILTER (run > 0.8 * t)::DOUBLE AS half_q80_pct FROM u GROUP BY 1"""


@query("m11_comparable_interval", _M11)
def m11(spark, sf):
    asked, comps = _comps(spark, sf)
    err = comps.select(F.col("query_key").alias("key"), "comp_key", "distance_km", (F.col("same_first") == 1).alias("same"), (F.col("comp_key") % 21 - 10).cast("double").alias("err_pct"))
    got = metrics.comparable_interval(asked.select("key", F.col("price").alias("pred")), err, "key", "pred")
    return rounded(got.select("key", "mean_err_pct", "half_mean_pct", "half_q80_pct"), ["mean_err_pct", "half_mean_pct"], 6)


# splits and folds

_MONTHS = "m AS (SELECT DISTINCT year(date) * 12 + month(date) AS m FROM tx), mr AS (SELECT m, row_number() OVER (ORDER BY m DESC) AS r FROM m)"
_SPLIT = f"WITH {TX}, {_MONTHS}, sp AS (SELECT tx.*, CASE WHEN r <= 3 THEN 'test' WHEN r <= 5 THEN 'early' WHEN r <= 6 THEN 'embargo' ELSE 'train' END AS split FROM tx JOIN mr ON m = year(date) * 12 + month(date))"


@query("v2_split_by_months", f"{_SPLIT} SELECT key, split FROM sp")
def v2(spark, sf):
    return splits.split_by_months(tx(spark, sf), "date").select("key", "split")


@query("v1_month_label", f"WITH {TX} SELECT key, (year(date) * 12 + month(date))::INTEGER AS label FROM tx")
def v1(spark, sf):
    return tx(spark, sf).select("key", splits.month_label(F.col("date")).alias("label"))


@query("v3_split_by_fraction", f"WITH {TX}, r AS (SELECT key, row_number() OVER (ORDER BY date, key) - 1 AS i, count(*) OVER () AS n FROM tx) SELECT key, CASE WHEN i < floor(0.7 * n) THEN 'train' WHEN i < floor(0.8 * n) THEN 'early' ELSE 'test' END AS split FROM r")
def v3(spark, sf):
    return splits.split_by_fraction(tx(spark, sf).select("key", "date"), "date", "key", 0.7, 0.1).select("key", "split")


@query("v4_block_split_groups", f"{_SPLIT} SELECT key, split FROM sp WHERE NOT (split = 'train' AND owner IN (SELECT owner FROM sp WHERE split IN ('early', 'test'))) AND NOT (split = 'early' AND owner IN (SELECT owner FROM sp WHERE split = 'test'))")
def v4(spark, sf):
    return splits.block_split_groups(splits.split_by_months(tx(spark, sf), "date"), "owner").select("key", "split")


_FOLD = f"""WITH {TX}, m AS (SELECT DISTINCT year(date) * 12 + month(date) AS m FROM tx), mi AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM m),
spec AS (SELECT f AS fold, (f + 1) * w AS v0, (f + 2) * w - 1 AS v1, (f + 1) * w - 2 AS t1 FROM (SELECT (max(n) // 5)::BIGINT AS w, max(n) AS n FROM mi), range(0, 4) AS x(f) WHERE (f + 2) * w <= n),
o AS (SELECT key, owner, date, i FROM tx JOIN mi ON m = year(date) * 12 + month(date)),
folds AS (SELECT fold::INTEGER AS fold, key, owner, date, CASE WHEN i BETWEEN v0 AND v1 THEN 'val' ELSE 'train' END AS role FROM o JOIN spec ON i BETWEEN v0 AND v1 OR i <= t1)"""


def _folds(spark, sf):
    t = tx(spark, sf).select("key", "owner", "date")
    return t, splits.walk_forward_folds(t, "date", "key")


@query("v5_walk_forward_folds", f"{_FOLD} SELECT fold, key, role FROM folds")
def v5(spark, sf):
    return _folds(spark, sf)[1]


@query("v6_monte_carlo_folds")
def v6(spark, sf):
    return splits.monte_carlo_folds(tx(spark, sf), "date", "key")


@query("v7_shuffled_kfold", "WITH a AS (SELECT o_orderkey AS key, (o_orderkey % 2147483647 * 48271 + 7) % 2147483647 AS x FROM orders), b AS (SELECT key, (x * 69621 + x // 127773) % 2147483647 AS y FROM a) SELECT key, (y // 1009 % 5)::INTEGER AS fold FROM b")
def v7(spark, sf):
    return splits.shuffled_kfold(tx(spark, sf), "key").select("key", "fold")


@query("v8_embargo_days", f"{_FOLD}, f AS (SELECT fold, min(date) AS d FROM folds WHERE role = 'val' GROUP BY 1) SELECT fold, key, role FROM folds JOIN f USING (fold) WHERE role = 'val' OR date < d - 60")
def v8(spark, sf):
    t, folds = _folds(spark, sf)
    return splits.embargo_days(folds, t, "date", "key", 60)


@query("v8_default_gap", f"{_FOLD}, f AS (SELECT fold, min(date) AS d FROM folds WHERE role = 'val' GROUP BY 1) SELECT fold, key, role FROM folds JOIN f USING (fold) WHERE role = 'val' OR date < d - 372")
def v8_default(spark, sf):
    t, folds = _folds(spark, sf)
    return splits.embargo_days(folds, t, "date", "key", windows=[90, 365])


@query("v11_check_holdout", f"{_SPLIT} SELECT count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'early') AS n_early, count(*) FILTER (split = 'test') >= 120 AND (count(*) FILTER (split = 'early') = 0 OR count(*) FILTER (split = 'early') >= 80) AS ok FROM sp")
def v11_holdout(spark, sf):
    return splits.check_holdout(splits.split_by_months(tx(spark, sf), "date"))


@query("v9_purge_groups", f"{_FOLD} SELECT fold, key, role FROM folds a WHERE role = 'val' OR NOT EXISTS (SELECT 1 FROM folds b WHERE b.fold = a.fold AND b.role = 'val' AND b.owner = a.owner)")
def v9(spark, sf):
    t, folds = _folds(spark, sf)
    return splits.purge_groups(folds, t, "owner", "key")


def _purged_masks(spark, sf):
    t = tx(spark, sf).select("key", "owner", "date")
    specs = splits.walk_forward_specs(t, "date")
    return splits.purge_masks(splits.fold_masks(t, "date", specs), "owner"), [s[0] for s in specs]


_PURGED = f"{_FOLD}, purged AS (SELECT fold, key, owner, date, role FROM folds a WHERE role = 'val' OR NOT EXISTS (SELECT 1 FROM folds b WHERE b.fold = a.fold AND b.role = 'val' AND b.owner = a.owner))"


@query("v9_purge_masks", f"{_PURGED} SELECT fold, key, role FROM purged")
def v9_masks(spark, sf):
    masked, folds = _purged_masks(spark, sf)
    return splits.mask_roles(masked, "key", folds)


@query("v11_check_masks", f"{_PURGED}, n AS (SELECT fold, count(*) FILTER (role = 'train')::BIGINT AS n_train, count(*) FILTER (role = 'val')::BIGINT AS n_val FROM purged GROUP BY 1), g AS (SELECT fold, count(*) FILTER (k > 1) AS shared_groups FROM (SELECT fold, owner, count(DISTINCT role) AS k FROM purged GROUP BY 1, 2) GROUP BY 1), sm AS (SELECT fold, count(*) FILTER (k > 1) AS shared_months FROM (SELECT fold, year(date) * 12 + month(date) AS ym, count(DISTINCT role) AS k FROM purged GROUP BY 1, 2) GROUP BY 1) SELECT fold, n_train, n_val, shared_months, shared_groups, shared_months = 0 AND shared_groups = 0 AND n_val >= 1 AS ok FROM n JOIN g USING (fold) JOIN sm USING (fold)")
def v11_masks(spark, sf):
    masked, folds = _purged_masks(spark, sf)
    return splits.check_masks(masked, "date", "owner", folds)


@query("v10_inferred_gap", f"{_SPLIT} SELECT (min(year(date) * 12 + month(date)) FILTER (split IN ('early', 'test')) - max(year(date) * 12 + month(date)) FILTER (split = 'train') - 1)::INTEGER AS gap_months FROM sp")
def v10(spark, sf):
    return splits.inferred_gap(splits.split_by_months(tx(spark, sf), "date"), "date")


@query("v11_check_folds", f"{_FOLD}, n AS (SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'val') AS n_val FROM folds GROUP BY 1), g AS (SELECT fold, count(*) FILTER (k > 1) AS shared_groups FROM (SELECT fold, owner, count(DISTINCT role) AS k FROM folds GROUP BY 1, 2) GROUP BY 1) SELECT fold, n_train, n_val, 0::BIGINT AS shared_months, shared_groups, shared_groups = 0 AND n_val >= 1 AS ok FROM n JOIN g USING (fold)")
def v11(spark, sf):
    t, folds = _folds(spark, sf)
    return splits.check_folds(folds, t, "date", "owner", "key")


@query("v12_check_required_features", f"WITH {TXL} SELECT 'floor_size' AS feature, true AS present, round(1 - count(floor_size) / count(*)::DOUBLE, 6) AS null_share, 1 - count(floor_size) / count(*)::DOUBLE <= 0.01 AS ok FROM tx UNION ALL SELECT 'price', true, 0, true UNION ALL SELECT 'sauna', false, 1, false")
def v12(spark, sf):
    return rounded(splits.check_required_features(tx(spark, sf, True), ["floor_size", "price", "sauna"], 0.01), ["null_share"], 6)


# evaluation

_P = f"WITH {TX}, e AS (SELECT *, price AS y, price * (0.9 + (key % 21) / 100.0) AS p, 1 + key % 3 AS w FROM tx)"


def _pred(spark, sf, lines=False):
    t = tx(spark, sf, lines)
    return t.withColumns({"pred": F.col("price") * (F.lit(0.9) + (F.col("key") % 21) / 100.0), "w": (1 + F.col("key") % 3).cast("double")})


_METRICS = """count(*) AS n, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2,
round(1 - sum(power(ln(1 + p) - ln(1 + y), 2)) / (sum(power(ln(1 + y), 2)) - power(sum(ln(1 + y)), 2) / count(*)), 6) AS r2_log, round(median(abs(p - y)), 4) AS medae,
round(avg(CASE WHEN y > 0 THEN abs(p - y) / y END) * 100, 6) AS mape, round(avg(2 * abs(p - y) / greatest(abs(y) + abs(p), 1e-6)) * 100, 6) AS smape, round(sum(w * abs(p - y) / greatest(abs(y), 1e-6)) / sum(w), 6) AS safe_mape, round(sum(w * abs(p - y)) / sum(w), 4) AS wmae, round(sqrt(sum(w * (p - y) * (p - y)) / sum(w)), 4) AS wrmse"""


@query("m1_regression_metrics", f"{_P} SELECT bed, {_METRICS} FROM e GROUP BY bed")
def m1(spark, sf):
    got = metrics.regression_metrics(_pred(spark, sf), "price", "pred", "w", ["bed"])
    return rounded(rounded(got, ["mae", "rmse", "medae", "wmae", "wrmse"]), ["r2", "r2_log", "mape", "smape", "safe_mape"], 6)


@query("m2_fold_metrics", f"{_P}, f AS (SELECT bed AS fold, sum(w * abs(p - y)) / sum(w) AS wmae, count(*) AS n FROM e GROUP BY 1) SELECT fold, round(wmae, 4) AS wmae, n, round((SELECT avg(wmae) FROM f), 4) AS mean_wmae, round((SELECT stddev_samp(wmae) FROM f), 4) AS std_wmae FROM f")
def m2(spark, sf):
    got = metrics.fold_metrics(_pred(spark, sf).withColumnRenamed("bed", "fold"), "price", "pred", "w")
    return rounded(got, ["wmae", "mean_wmae", "std_wmae"])


_QB = "quantile_cont(floor_size, {})"


@query("m3_error_segments", f"""WITH {TXL}, e AS (SELECT *, abs(price - price * (0.9 + (key % 21) / 100.0)) AS ae, CASE WHEN price > 0 THEN abs(price - price * (0.9 + (key % 21) / 100.0)) / price END AS ape FROM tx),
q AS (SELECT {", ".join(f"{_QB.format(i / 5)} AS q{i}" for i in range(1, 5))} FROM tx), b AS (SELECT e.*, CASE WHEN floor_size <= q1 THEN 1 WHEN floor_size <= q2 THEN 2 WHEN floor_size <= q3 THEN 3 WHEN floor_size <= q4 THEN 4 WHEN floor_size IS NOT NULL THEN 5 END AS bin FROM e, q),
s AS (SELECT 'bed' AS grp, cast(bed AS VARCHAR) AS segment, ae, ape FROM b UNION ALL SELECT 'agency', agency, ae, ape FROM b UNION ALL SELECT 'floor_bin', cast(bin AS VARCHAR), ae, ape FROM b WHERE bin IS NOT NULL UNION ALL SELECT 'suburb', suburb, ae, ape FROM b),
a AS (SELECT grp, segment, count(*) AS n, avg(ae) AS mae, median(ae) AS medae, avg(ape) * 100 AS mape, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, segment) AS r FROM s GROUP BY 1, 2)
SELECT grp AS "group", segment, n, round(mae, 4) AS mae, round(medae, 4) AS medae, round(mape, 6) AS mape FROM a WHERE grp <> 'suburb' OR r <= 10""")
def m3(spark, sf):
    got = metrics.error_segments(_pred(spark, sf, True), "price", "pred", ["bed", "agency"], "suburb", "floor_size", 10)
    return rounded(rounded(got, ["mae", "medae"]), ["mape"], 6)


@query("m4_drift_check", f"{_P}, x AS (SELECT avg(abs(p - y)) FILTER (key % 5 <> 0) AS cv, avg(abs(p - y)) FILTER (key % 5 = 0) AS test FROM e) SELECT round(cv, 4) AS cv, round(test, 4) AS test, round((test - cv) / cv, 6) AS gap, abs((test - cv) / cv) <= 0.3 AS ok FROM x")
def m4(spark, sf):
    p = _pred(spark, sf)
    part = lambda t: metrics.regression_metrics(p.where(t), "price", "pred")
    return rounded(rounded(metrics.drift_check(part("key % 5 != 0"), part("key % 5 = 0"), "mae"), ["cv", "test"]), ["gap"], 6)


@query("m5_conformal_interval", f"{_P}, i AS (SELECT key, y, p * 0.97 AS lo, p * 1.03 AS hi FROM e), h AS (SELECT quantile_cont(greatest(lo - y, y - hi, 0), 0.9) AS q FROM i WHERE key % 5 <> 0) SELECT key, round(least(lo - q, hi + q), 4) AS lo, round(greatest(lo - q, hi + q), 4) AS hi FROM i, h WHERE key % 5 = 0")
def m5(spark, sf):
    i = _pred(spark, sf).select("key", "price", (F.col("pred") * 0.97).alias("lo"), (F.col("pred") * 1.03).alias("hi"))
    q = metrics.conformal_qhat(i.where("key % 5 != 0"), "price", "lo", "hi", 0.1)
    return rounded(metrics.apply_interval(i.where("key % 5 = 0"), q, "lo", "hi").select("key", "lo", "hi"), ["lo", "hi"])


_LAM = ", ".join(f"({0.05 * i!r})" for i in range(8))


@query("m6_median_blend", f"{_P}, g AS (SELECT suburb, median(price) AS med FROM tx WHERE key % 5 <> 0 GROUP BY 1), l AS (SELECT lam, sum(w * abs(p + lam * (coalesce(med, p) - p) - y)) / sum(w) AS wmae FROM e LEFT JOIN g USING (suburb), (VALUES {_LAM}) v(lam) WHERE key % 5 = 0 GROUP BY 1) SELECT round(lam, 6) AS lam, round(wmae, 4) AS wmae FROM l")
def m6(spark, sf):
    p = _pred(spark, sf)
    med = p.where("key % 5 != 0").groupBy("suburb").agg(F.percentile("price", 0.5).alias("med"))
    return rounded(rounded(metrics.fit_median_blend(p.where("key % 5 = 0").join(med, "suburb", "left"), "price", "pred", "med", "w"), ["wmae"]), ["lam"], 6)


@query("m7_nnls_blend", f"{_P}, b AS (SELECT *, price * (1.1 - (key % 13) / 50.0) AS p2 FROM e), s AS (SELECT sum(w * p * p) AS aa, sum(w * p * p2) AS ab, sum(w * p2 * p2) AS bb, sum(w * p * y) AS ay, sum(w * p2 * y) AS by_ FROM b) SELECT round((bb * ay - ab * by_) / (aa * bb - ab * ab), 6) AS w_a, round((aa * by_ - ab * ay) / (aa * bb - ab * ab), 6) AS w_b FROM s")
def m7(spark, sf):
    p = _pred(spark, sf).withColumn("p2", F.col("price") * (F.lit(1.1) - (F.col("key") % 13) / 50.0))
    return rounded(metrics.nnls_frame(spark, metrics.fit_nnls_2(p, "price", "pred", "p2", "w")), ["w_a", "w_b"], 6)


@query("m7_gated_blend", f"{_P}, b AS (SELECT *, CASE WHEN bed >= 3 THEN price * (1.1 - (key % 13) / 50.0) ELSE p END AS p2 FROM e), s AS (SELECT sum(w * p * p) AS aa, sum(w * p * p2) AS ab, sum(w * p2 * p2) AS bb, sum(w * p * y) AS ay, sum(w * p2 * y) AS by_ FROM b), x AS (SELECT (bb * ay - ab * by_) / (aa * bb - ab * ab) AS u, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS v FROM s) SELECT round(u / (u + v), 6) AS w_a, round(v / (u + v), 6) AS w_b FROM x")
def m7_gated(spark, sf):
    p = _pred(spark, sf).withColumn("p2", F.col("price") * (F.lit(1.1) - (F.col("key") % 13) / 50.0))
    gate = F.col("bed") >= 3
    weights = metrics.fit_nnls_2(p, "price", "pred", "p2", "w", gate, normalise=True)
    return rounded(metrics.nnls_frame(spark, metrics.blend_if_better(p, "price", "pred", "p2", "w", weights, gate)), ["w_a", "w_b"], 6)


@query("m10_weighted_quantile", f"{_P}, u AS (SELECT bed, y, sum(w) OVER (PARTITION BY bed ORDER BY y, key ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY bed) AS t FROM e) SELECT bed, min(y) FILTER (run > 0.8 * t) AS value FROM u GROUP BY 1")
def m10(spark, sf):
    return metrics.weighted_quantile(_pred(spark, sf), ["bed"], "price", "w", 0.8, "key")


@query("m12_residual_table", f"{_P} SELECT key, round(y - p, 4) + 0.0 AS residual, round(abs(y - p), 4) AS abs_err, round(abs(y - p) / y, 6) AS ape FROM e")
def m12(spark, sf):
    got = metrics.residual_table(_pred(spark, sf), "price", "pred").select("key", "residual", "abs_err", "ape")
    return rounded(rounded(got, ["residual", "abs_err"]), ["ape"], 6).withColumn("residual", F.col("residual") + 0.0)


# models: no SQL form, tested by properties

_FEATURES = ["bed", "floor_size", "bath", "land_value", "year_built"]


@query("l1_l2_fit_and_score")
def l2(spark, sf):
    t = tx(spark, sf, True)
    m = model.fit_price_model(t.where("key % 5 != 0"), _FEATURES, "price")
    return model.score_batch(m, t.where("key % 5 = 0"), _FEATURES, low=1.0, high=1e7).select("key", "price", rnd("prediction").alias("prediction"))


@query("l3_cross_validate")
def l3(spark, sf):
    t = tx(spark, sf, True)
    return model.cross_validate(t, splits.walk_forward_folds(t, "date", "key"), "key", _FEATURES, "price")


@query("l3_ridge_folds")
def l3_folds(spark, sf):
    """All walk-forward folds by Gram matrices, in one pass over the rows."""
    t = tx(spark, sf, True)
    return model.cross_validate_ridge(t, splits.walk_forward_folds(t, "date", "key"), "key", _FEATURES, "price")


@query("m8_adversarial_auc")
def m8(spark, sf):
    t = tx(spark, sf, True)
    return model.adversarial_auc(t.where("date < '2000-01-01'"), t.where("date >= '2000-01-01'"), _FEATURES)


@query("m9_domain_importance_weights")
def m9(spark, sf):
    t = tx(spark, sf, True)
    return model.domain_importance_weights(t.where("date < '2000-01-01'"), t.where("date >= '2000-01-01'"), _FEATURES).select("key", "domain_weight")


FLAGSHIP = "flagship_asof_medians"


@query(FLAGSHIP, f"{_asof_sql('suburb', {'med90': (90, 8)})}, r AS (SELECT suburb, price / med90 AS ratio FROM tx JOIN m USING (key) WHERE price BETWEEN 1000 AND 400000 AND med90 IS NOT NULL) SELECT suburb, round(median(ratio), 6) AS median, round(avg(ratio), 6) AS mean, count(ratio) AS n FROM r GROUP BY 1")
def flagship(spark, sf):
    """Price against the leak-safe 90-day median of its suburb, summarised by suburb."""
    from ledgerloom.operators.filters import domain_filter
    from ledgerloom.operators.marts import group_stats

    t = tx(spark, sf).select("key", "suburb", "date", "price")
    got = windows.asof_group_medians(t, ["suburb"], "date", "key", "price", {"med90": (90, 8)})
    got = domain_filter(got, {"price": (1000, 400000)}).where("med90 is not null").withColumn("ratio", F.col("price") / F.col("med90"))
    return rounded(group_stats(got, ["suburb"], "ratio"), ["median", "mean"], 6)


# names under which the whole-table forms were registered first
for _old, _now in (("w2_rolling_median_all_rows_30d", "w2_rolling_median_global_30d"), ("w2_rolling_median_all_rows_730d", "w2_rolling_median_global_730d"), ("j10_knn_comparables_all_requests", "j10_knn_comparables"), ("m11_comparable_interval_all_requests", "m11_comparable_interval")):
    query(_old, SQL[_now])(QUERIES[_now])
