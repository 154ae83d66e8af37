"""Queries over row-wise operators: parsing, categories, features, filters, sources."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as sc
from ledgerloom.operators import filters, joins, normalize, storage
from ledgerloom.sources import readers

from .base import POIS, TX, TXL, pois, query, rnd, rounded, table, tx


def _written(spark, df, **how):
    """The path of df, written by write_table into the shared folder."""
    at = f"{storage.shared(df)}/written-{uuid.uuid4().hex}"
    readers.write_table(df, at, **how)
    return at


@query("s1_read_raw", "SELECT cast(s_suppkey AS VARCHAR) AS s_suppkey, s_name, cast(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def s1(spark, sf):
    raw = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return readers.read_raw(spark, _written(spark, raw, fmt="csv")).select("s_suppkey", "s_name", "s_nationkey")


@query("s4_write_table", f"WITH {TX} SELECT bed, count(*) AS n, round(sum(price), 2) AS total FROM tx GROUP BY 1")
def s4(spark, sf):
    at = _written(spark, tx(spark, sf).select("key", "bed", "price"), partition_by=["bed"])
    return spark.read.parquet(at).groupBy("bed").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("t4_sorted_output", f"WITH {TX} SELECT count(*) AS n, 0::BIGINT AS out_of_order FROM tx")
def t4(spark, sf):
    at = _written(spark, tx(spark, sf).select("key", "date"), sort_by=["date"])
    rows = spark.read.parquet(at).select("date", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"))
    later = F.lag("date").over(Window.partitionBy("file").orderBy("i")) > F.col("date")
    return rows.select(later.alias("late")).agg(F.count("*").alias("n"), F.count(F.when(F.col("late"), 1)).alias("out_of_order"))


@query("s2_points_of_interest", f"WITH {POIS} SELECT name, category, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM pois WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def s2(spark, sf):
    raw = pois(spark, sf).select(F.col("name").alias("Title"), F.lower("category").alias("type"), F.col("latitude").cast("string").alias("lat"), F.col("longitude").cast("string").alias("lng"))
    return rounded(readers.points_of_interest(raw), ["latitude", "longitude"], 6)


@query("s3_geocode_results", "WITH x AS (SELECT s_suppkey % 40 AS q, s_suppkey AS k, s_acctbal AS v FROM supplier), r AS (SELECT concat('Query ', cast(q AS VARCHAR)) AS query, v AS latitude, row_number() OVER (PARTITION BY q ORDER BY k DESC) AS n FROM x) SELECT query, latitude FROM r WHERE n = 1")
def s3(spark, sf):
    raw = table(spark, sf, "supplier").select(F.concat(F.lit("Query "), (F.col("s_suppkey") % 40).cast("string"), F.lit(" , ")).alias("query"), F.col("s_acctbal").cast("string").alias("lat"), F.lit("0").alias("lon"), F.col("s_suppkey").alias("seq"))
    return readers.geocode_results(raw, seq="seq").select("query", "latitude")


@query("p1_normalize_aliases", "SELECT o_orderkey AS key, o_totalprice AS price FROM orders")
def p1(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ID"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("Rent"), F.col("o_totalprice").alias("last rental price"))
    return normalize.normalize_aliases(raw, {"id": "key", "rent": "price", "Last Rental Price": "price"})


@query("p2_parse_money", f"WITH {TX} SELECT key, try_cast(regexp_replace(price_text, '[^0-9.-]', '', 'g') AS DOUBLE) AS price FROM tx".replace("as string", "as varchar"))
def p2(spark, sf):
    return tx(spark, sf).select("key", sc.parse_money(F.col("price_text")).alias("price"))


@query("p3_parse_first_int", "SELECT c_custkey AS key, try_cast(nullif(regexp_extract(c_name, '(\\d+)', 1), '') AS INTEGER) AS number FROM customer")
def p3(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), sc.parse_first_int(F.col("c_name")).alias("number"))


@query("p4_parse_date", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS date FROM orders")
def p4(spark, sf):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "d/M/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "d-MMM-yyyy")).otherwise("soon")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), sc.parse_date(text, ("yyyy-MM-dd", "d/M/yyyy", "d-MMM-yyyy")).alias("date"))


@query("p5_zero_pad_code", "SELECT s_suppkey AS key, CASE WHEN s_suppkey < 10000 THEN lpad(cast(s_suppkey AS VARCHAR), 4, '0') ELSE cast(s_suppkey AS VARCHAR) END AS code FROM supplier")
def p5(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), sc.zero_pad_code(F.col("s_suppkey").cast("double")).alias("code"))


@query("p6_clamp", f"WITH {TXL} SELECT key, greatest(1000.0, least(200000.0, price)) AS price, CASE WHEN floor_size IS NULL THEN NULL ELSE greatest(20, least(120, floor_size)) END AS floor_size FROM tx")
def p6(spark, sf):
    return tx(spark, sf, True).select("key", sc.clamp(F.col("price"), 1000.0, 200000.0).alias("price"), sc.clamp(F.col("floor_size"), 20, 120).alias("floor_size"))


_CANON = """WITH {tx}, x AS (SELECT key, {c} AS raw, lower(trim({c})) AS low FROM tx) SELECT key, CASE {rules} END AS value FROM x"""
_TITLE = "list_aggregate(list_transform(regexp_extract_all(low, '[a-z]+|[^a-z]+'), lambda w: concat(upper(w[1]), w[2:])), 'string_agg', '')"


@query("p7_canonicalize_furnishings", _CANON.format(tx=TX, c="furnishings", rules=f"WHEN raw IS NULL OR low IN ('', 'nill', 'nil', 'none', 'null') THEN 'Unfurnished' WHEN low LIKE '%fully%' AND low LIKE '%furnish%' THEN 'Furnished' WHEN low LIKE '%partial%' THEN 'Partially Furnished' WHEN low = 'full' THEN 'Furnished' ELSE {_TITLE}"))
def p7(spark, sf):
    return tx(spark, sf).select("key", sc.canonicalize_furnishings(F.col("furnishings")).alias("value"))


@query("p8_canonicalize_pets", _CANON.format(tx=TX, c="pets", rules=f"WHEN raw IS NULL OR low IN ('', 'nill', 'nil', 'none', 'null') THEN 'No Pets' WHEN low LIKE '%pets ok%' THEN 'Pets Allowed' WHEN low IN ('no', 'not allowed') THEN 'No Pets' WHEN low LIKE '%negotiable%' THEN 'Pets Negotiable' ELSE {_TITLE}"))
def p8(spark, sf):
    return tx(spark, sf).select("key", sc.canonicalize_pets(F.col("pets")).alias("value"))


@query("p9_canonicalize_garage", _CANON.format(tx=TX, c="garage", rules=f"WHEN raw IS NULL OR low IN ('', 'no', 'none', 'nil', 'n', '0') THEN 'No Garage' WHEN low IN ('y', 'yes') THEN 'Has Garage' WHEN low LIKE '%no garage%' THEN 'No Garage' ELSE {_TITLE}"))
def p9(spark, sf):
    return tx(spark, sf).select("key", sc.canonicalize_garage(F.col("garage")).alias("value"))


@query("p10_bucket_property_type", f"WITH {TX} SELECT key, CASE WHEN lower(property_type) LIKE '%apartment%' THEN 'apartment' WHEN lower(property_type) LIKE '%unit%' THEN 'unit' WHEN lower(property_type) LIKE '%town%house%' THEN 'townhouse' WHEN lower(property_type) LIKE '%house%' THEN 'house' ELSE lower(trim(property_type)) END AS value FROM tx")
def p10(spark, sf):
    return tx(spark, sf).select("key", sc.bucket_property_type(F.col("property_type")).alias("value"))


@query("p11_clean_strings", f"WITH {TX} SELECT key, coalesce(regexp_replace(upper(trim(street)), '[\\\\/]', '_', 'g'), 'UNKNOWN') AS street, coalesce(upper(trim(agency)), 'UNKNOWN') AS agency FROM tx")
def p11(spark, sf):
    return normalize.clean_strings(tx(spark, sf).select("key", "street", "agency"), ["street", "agency"])


@query("p12_derive_car", f"WITH {TXL}, c AS (SELECT key, CASE WHEN key % 3 = 0 THEN NULL ELSE bed END AS total, CASE WHEN key % 2 = 0 THEN NULL ELSE bath END AS garage, CASE WHEN key % 5 = 0 THEN NULL ELSE 1 END AS off FROM tx) SELECT key, greatest(total, CASE WHEN garage IS NULL AND off IS NULL THEN NULL ELSE coalesce(garage, 0) + coalesce(off, 0) END)::BIGINT AS car, coalesce(total, coalesce(garage, 0) + coalesce(off, 0))::BIGINT AS car_sum FROM c")
def p12(spark, sf):
    df = tx(spark, sf, True).select("key", F.when(F.col("key") % 3 != 0, F.col("bed").cast("long")).alias("total"), F.when(F.col("key") % 2 != 0, F.col("bath")).alias("garage"), F.when(F.col("key") % 5 != 0, F.lit(1)).alias("off"))
    df = normalize.derive_car(df, "total", "garage", "off")
    return normalize.derive_car(df, "total", "garage", "off", how="sum", out="car_sum").select("key", "car", "car_sum")


@query("p13_first_price_fallback", f"WITH {TX} SELECT key, CASE WHEN key % 4 = 0 AND key % 3 <> 0 THEN concat('$', cast(key AS VARCHAR)) WHEN key % 4 = 0 THEN ' Not Disclosed' ELSE price_text END AS price, CASE WHEN key % 4 = 0 AND key % 3 <> 0 THEN '2001-01-01' ELSE cast(date AS VARCHAR) END AS date FROM tx".replace("as string", "as varchar"))
def p13(spark, sf):
    t = tx(spark, sf)
    price = F.when(F.col("key") % 4 == 0, " Not Disclosed").otherwise(F.col("price_text"))
    first = F.when(F.col("key") % 3 == 0, "-").otherwise(F.concat(F.lit("$"), F.col("key").cast("string")))
    p, d = sc.price_with_first(price, first, F.lit("2001-01-01"), F.col("date").cast("string"))
    return t.select("key", p.alias("price"), d.alias("date"))


@query("p14_fill_defaults", f"WITH {TXL} SELECT key, coalesce(bath, 0)::BIGINT AS bath, coalesce(floor_size, 0) AS floor_size FROM tx")
def p14(spark, sf):
    return normalize.fill_defaults(tx(spark, sf, True).select("key", "bath", "floor_size"), ["bath", "floor_size"])


@query("p15_map_ordinals", "SELECT o_orderkey AS key, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE NULL END AS grade FROM orders")
def p15(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("poor", "EXCELLENT", " Av ", "GD", "who knows", None)]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return normalize.map_ordinals(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), raw.alias("grade")), ["grade"])


@query("p16_date_parts", f"WITH {TX} SELECT key, year(date)::INTEGER AS year, month(date)::INTEGER AS month, weekofyear(date)::INTEGER AS week_of_year, (isodow(date) - 1)::INTEGER AS day_of_week, round(sin(month(date) * 2 * pi() / 12), 6) + 0.0 AS month_sin, round(cos(month(date) * 2 * pi() / 12), 6) + 0.0 AS month_cos FROM tx")
def p16(spark, sf):
    df = normalize.add_date_parts(tx(spark, sf).select("key", "date"), "date").drop("date")
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in ("month_sin", "month_cos")})


@query("p17_time_index", f"WITH {TX} SELECT key, coalesce(floor(date_diff('day', (SELECT min(date) FROM tx WHERE key % 10 <> 0), date) / 30), 0)::INTEGER AS time_index FROM tx")
def p17(spark, sf):
    return normalize.add_time_index(tx(spark, sf).select("key", "date"), "date", F.col("key") % 10 != 0).select("key", "time_index")


@query("p18_log_features", f"WITH {TX} SELECT key, round(ln(1 + greatest(land_value, 0)), 6) AS log_land_value, CASE WHEN land_value = 0 THEN 1 ELSE 0 END AS land_value_is_zero FROM tx")
def p18(spark, sf):
    return rounded(normalize.add_log_features(tx(spark, sf).select("key", "land_value"), ["land_value"], True), ["log_land_value"], 6).drop("land_value")


@query("p19_skew_logs", f"WITH {TX}, s AS (SELECT key, price, land_value, power(price / 100000, 12) AS steep FROM tx) SELECT key, round(ln(1 + steep), 5) AS log_steep FROM s")
def p19(spark, sf):
    df = tx(spark, sf).select("key", "price", "land_value", F.pow(F.col("price") / 100000, 12).alias("steep"))
    return rounded(normalize.add_skew_logs(df, ["price", "land_value", "steep"], 2.0), ["log_steep"], 5).drop("price", "land_value", "steep")


@query("p20_ratio_features", f"WITH {TXL} SELECT key, greatest(0, 2005 - year_built)::BIGINT AS age_years, CASE WHEN year_built >= 2010 THEN 1 ELSE 0 END AS is_newer_2010, round(coalesce(CASE WHEN land_value > 0 THEN floor_size / land_value END, 0), 6) AS floor_land_ratio, round(coalesce(CASE WHEN bath > 0 THEN bed / bath END, 0), 6) AS bed_bath_ratio, CASE WHEN bath >= 1 THEN 1 ELSE 0 END AS has_car, CASE WHEN bath >= 2 THEN 1 ELSE 0 END AS has_car_2, CASE WHEN bath >= 3 THEN 1 ELSE 0 END AS has_car_3 FROM tx")
def p20(spark, sf):
    df = normalize.add_ratio_features(tx(spark, sf, True), 2005, "floor_size", "land_value", "bed", "bath", "bath", "year_built")
    return rounded(df, ["floor_land_ratio", "bed_bath_ratio"], 6).select("key", "age_years", "is_newer_2010", "floor_land_ratio", "bed_bath_ratio", "has_car", "has_car_2", "has_car_3")


@query("p21_unit_price_and_yield", f"WITH {TXL} SELECT key, round(price / floor_size, 6) AS unit_price, round(price * 52 / capital_value, 6) AS gross_yield FROM tx WHERE floor_size > 0 AND capital_value > 0")
def p21(spark, sf):
    df = normalize.add_gross_yield(normalize.add_unit_price(tx(spark, sf, True), "price", "floor_size"), "price", "capital_value")
    return rounded(df, ["unit_price", "gross_yield"], 6).select("key", "unit_price", "gross_yield")


@query("p22_feature_policy", f"WITH {TX} SELECT key, round(ln(1 + price), 6) AS log_price, least(land_value, 50.0) AS dist_cbd_km FROM tx")
def p22(spark, sf):
    df = tx(spark, sf).select("key", "price", F.round(F.log1p("price"), 6).alias("log_price"), F.log1p("bed").alias("log_bed"), F.col("land_value").alias("dist_cbd_km"), "lat")
    return normalize.apply_feature_policy(df, ["log_price"], ["lat"])


@query("p23_drop_leaky_columns", f"WITH {TX} SELECT key, price, bed FROM tx")
def p23(spark, sf):
    df = tx(spark, sf).select("key", "price", "bed", F.col("price").alias("price_lag"), F.col("price").alias("log_Price"), F.col("price").alias("helper"))
    return normalize.drop_leaky_columns(df, "price", ["helper"])


@query("p24_interactions", f"WITH {TX} SELECT key, round(price * bed, 4) AS price_x_bed, CASE WHEN agency = 'BUILDING' THEN price ELSE 0 END AS price_x_agency_BUILDING, CASE WHEN agency = 'MACHINERY' THEN price ELSE 0 END AS price_x_agency_MACHINERY FROM tx")
def p24(spark, sf):
    df = normalize.interactions(tx(spark, sf).select("key", "price", "bed", "agency"), [("price", "bed"), ("price", "agency")], {"agency": ["BUILDING", "MACHINERY"]})
    return rounded(df, ["price_x_bed"]).drop("price", "bed", "agency")


@query("p25_group_key", f"WITH {TX} SELECT key, concat(upper(suburb), '|', regexp_replace(upper(coalesce(street, '')), '[^A-Z0-9]', '', 'g')) AS by_address, concat(upper(suburb), '|', printf('%.4f', lat), ':', printf('%.4f', lon)) AS by_place FROM tx".replace("as string", "as varchar"))
def p25(spark, sf):
    c = F.col
    return tx(spark, sf).select("key", sc.group_key(c("suburb"), c("street")).alias("by_address"), sc.group_key(c("suburb"), None, c("lat"), c("lon")).alias("by_place"))


_SQL_QUERY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(street, ' ,'), '^(unit|flat|suite|apt|apartment|level)\\s+\\S+\\s+', '', 'i'), '\\(.*?\\)', '', 'g'), 'P\\.?O\\.?\\s*Box.*$', '', 'i'), ',\\s*$', ''))"


@query("p26_geo_query", f"WITH {TX} SELECT key, concat_ws(', ', nullif({_SQL_QUERY}, ''), suburb, 'Christchurch', cast(owner % 9000 AS VARCHAR), 'Christchurch', 'New Zealand') AS geo_query FROM tx".replace("as string", "as varchar"))
def p26(spark, sf):
    c = F.col
    return tx(spark, sf).select("key", sc.geo_query(c("street"), c("suburb"), F.lit(None).cast("string"), (c("owner") % 9000).cast("double"), "Christchurch", "New Zealand").alias("geo_query"))


@query("p27_parse_street", f"""WITH {TX} SELECT key,
  CASE WHEN key % 5 = 0 THEN cast(key % 9 + 1 AS VARCHAR) END AS unit,
  CASE WHEN key % 5 IN (0, 2) THEN cast(owner AS VARCHAR) WHEN key % 5 = 1 THEN concat(cast(owner AS VARCHAR), 'A') END AS housenumber,
  CASE key % 5 WHEN 0 THEN 'Foo Street' WHEN 1 THEN 'Bar Road' WHEN 2 THEN 'Long View Avenue' WHEN 3 THEN 'Po Box 17' END AS road FROM tx""".replace("as string", "as varchar"))
def p27(spark, sf):
    return tx(spark, sf).select("key", sc.parse_street(F.col("street")).alias("s")).select("key", "s.unit", "s.housenumber", "s.road")


@query("p28_geo_query_candidates", f"""WITH {TX}, r AS (SELECT key, suburb, CASE WHEN key % 5 IN (0, 2) THEN cast(owner AS VARCHAR) WHEN key % 5 = 1 THEN concat(cast(owner AS VARCHAR), 'A') END AS house,
  CASE key % 5 WHEN 0 THEN 'Foo Street' WHEN 1 THEN 'Bar Road' WHEN 2 THEN 'Long View Avenue' WHEN 3 THEN 'Po Box 17' END AS road,
  list_aggregate(list_transform(string_split(lower(suburb), ' '), lambda w: concat(upper(w[1]), w[2:])), 'string_agg', ' ') AS s FROM tx)
  SELECT key, CASE WHEN road IS NULL THEN '' WHEN house IS NULL THEN concat(road, ', ', s, ', Christchurch, New Zealand') ELSE concat(house, ' ', road, ', ', s, ', Christchurch, New Zealand;', road, ', ', s, ', Christchurch, New Zealand') END AS candidates FROM r""".replace("as string", "as varchar"))
def p28(spark, sf):
    return tx(spark, sf).select("key", F.array_join(sc.geo_query_candidates(F.col("street"), F.col("suburb")), ";").alias("candidates"))


@query("p29_distance_and_bearing", f"""WITH {TX}, d AS (SELECT key, lat, lon, -43.53 AS a, 172.63 AS b FROM tx) SELECT key,
  round(2 * 6371.0088 * asin(least(1, sqrt(power(sin(radians(a - lat) / 2), 2) + cos(radians(lat)) * cos(radians(a)) * power(sin(radians(b - lon) / 2), 2)))), 6) AS km,
  round(((degrees(atan2(sin(radians(b - lon)) * cos(radians(a)), cos(radians(lat)) * sin(radians(a)) - sin(radians(lat)) * cos(radians(a)) * cos(radians(b - lon)))) + 360)::DOUBLE % 360), 6) AS bearing FROM d""")
def p29(spark, sf):
    c = F.col
    a, b = F.lit(-43.53), F.lit(172.63)
    return tx(spark, sf).select("key", rnd(sc.haversine_km(c("lat"), c("lon"), a, b), 6).alias("km"), rnd(sc.bearing_deg(c("lat"), c("lon"), a, b), 6).alias("bearing"))


_DOMAIN = "coalesce(price BETWEEN 1000 AND 200000, true) AND coalesce(CASE WHEN land_value > 0 THEN land_value END <= 5000, true) AND coalesce(floor_size > 0, true)"


@query("f1_domain_filter", f"WITH {TXL} SELECT key, price, land_value, floor_size FROM tx WHERE {_DOMAIN}")
def f1(spark, sf):
    df = filters.domain_filter(tx(spark, sf, True), {"price": (1000, 200000), "land_value": (None, 5000)}, ("land_value",), ("floor_size",))
    return df.select("key", "price", "land_value", "floor_size")


@query("f2_drop_invalid", f"WITH {TXL} SELECT key FROM tx WHERE floor_size IS NOT NULL AND date IS NOT NULL AND bed <= 3")
def f2(spark, sf):
    return filters.drop_invalid(tx(spark, sf, True), ["floor_size", "date"], {"bed": 3}).select("key")


@query("f3_date_window", f"WITH {TX} SELECT key, date, price FROM tx WHERE date >= DATE '1999-01-01' AND price BETWEEN 5000 AND 150000")
def f3(spark, sf):
    df = filters.date_window(tx(spark, sf), "date", recent_years=2, as_of=dt.date(2001, 1, 1))
    return filters.target_range(df, "price", 5000, 150000).select("key", "date", "price")


@query("f4_audit_removed", f"WITH {TXL} SELECT key, price, 'domain' AS removed_step FROM tx WHERE NOT ({_DOMAIN}) UNION ALL SELECT key, price, 'beds' FROM tx WHERE ({_DOMAIN}) AND bed > 4")
def f4(spark, sf):
    t = tx(spark, sf, True)
    kept = filters.domain_filter(t, {"price": (1000, 200000), "land_value": (None, 5000)}, ("land_value",), ("floor_size",))
    first = filters.audit_removed(t, kept, "key", "domain")
    second = filters.audit_removed(kept, kept.where("bed <= 4"), "key", "beds")
    return first.unionByName(second, allowMissingColumns=True).select("key", "price", "removed_step")


@query("f4_audit_filters", f"""WITH {TXL}, a AS (SELECT key, suburb, price, {_DOMAIN} AS t0, bed <= 4 AS t1 FROM tx),
b AS (SELECT *, coalesce(t0 AND t1, false) AS k1, price <= 1.8 * (SELECT avg(price) FROM a WHERE t0 AND t1) AS t2 FROM a),
c AS (SELECT *, coalesce(k1 AND t2, false) AS k2, price <= 1.5 * median(price) FILTER (k1 AND t2) OVER (PARTITION BY suburb) AS t3 FROM b),
d AS (SELECT *, coalesce(k2 AND t3, false) AS k3 FROM c),
e AS (SELECT *, coalesce(count(*) FILTER (k3) OVER (PARTITION BY suburb) > 3 AND median(price) FILTER (k3) OVER (PARTITION BY suburb) >= 0.99 * (SELECT median(price) FROM d WHERE k3), false) AS t4 FROM d),
f AS (SELECT key, price, coalesce(t0, false) AS t0, coalesce(t1, false) AS t1, coalesce(t2, false) AS t2, coalesce(t3, false) AS t3, t4 FROM e)
SELECT key, price, ((NOT t0)::BIGINT + 2 * (NOT t1)::BIGINT + 4 * (NOT t2)::BIGINT + 8 * (NOT t3)::BIGINT + 16 * (NOT t4)::BIGINT)::BIGINT AS failed_steps,
  CASE WHEN NOT t0 THEN 'domain' WHEN NOT t1 THEN 'beds' WHEN NOT t2 THEN 'mean' WHEN NOT t3 THEN 'median' WHEN NOT t4 THEN 'group' END AS removed_step FROM f""")
def f4_filters(spark, sf):
    domain = filters.domain_test({"price": (1000, 200000), "land_value": (None, 5000)}, ("land_value",), ("floor_size",))
    steps = [("domain", filters.by_test(domain)), ("beds", filters.by_test(F.col("bed") <= 4)), ("mean", filters.by_mean("price", 1.8)),
             ("median", filters.by_group_median("price", ["suburb"], 1.5)), ("group", filters.by_qualified_group("suburb", "price", 3, 0.99))]
    t = tx(spark, sf, True).select("key", "suburb", "price", "bed", "land_value", "floor_size")
    return filters.audit_filters(t, steps).select("key", "price", "failed_steps", "removed_step")


@query("f5_mean_multiple_filter", f"WITH {TX} SELECT key, price FROM tx WHERE price <= 1.5 * (SELECT avg(price) FROM tx)")
def f5(spark, sf):
    return filters.mean_multiple_filter(tx(spark, sf).select("key", "price"), "price", 1.5)


@query("f6_group_median_filter", f"WITH {TX} SELECT key, suburb, price FROM tx JOIN (SELECT suburb, median(price) AS m FROM tx GROUP BY 1) USING (suburb) WHERE price <= 1.4 * m")
def f6(spark, sf):
    return filters.group_median_filter(tx(spark, sf).select("key", "suburb", "price"), "price", ["suburb"], 1.4)


@query("f7_qualify_groups", f"WITH {TX} SELECT key, suburb, price FROM tx WHERE suburb IN (SELECT suburb FROM tx GROUP BY 1 HAVING count(*) > 3 AND median(price) >= 0.99 * (SELECT median(price) FROM tx))")
def f7(spark, sf):
    return filters.qualify_groups(tx(spark, sf).select("key", "suburb", "price"), "suburb", "price", 3, 0.99)


@query("j1_attach_params", f"WITH {TX}, p AS (SELECT suburb, avg(price) AS m FROM tx WHERE bed <= 3 AND suburb < 'M' GROUP BY 1) SELECT key, round(coalesce(m, (SELECT avg(price) FROM tx)), 4) AS suburb_mean FROM tx LEFT JOIN p USING (suburb)")
def j1(spark, sf):
    t = tx(spark, sf).select("key", "suburb", "bed", "price")
    params = t.where("bed <= 3 and suburb < 'M'").groupBy("suburb").agg(F.avg("price").alias("suburb_mean"))
    got = joins.attach_params(t, params, ["suburb"], "suburb_mean", t.agg(F.avg("price").alias("suburb_mean")))
    return rounded(got.select("key", "suburb_mean"), ["suburb_mean"])


@query("j2_merge_on_group_date", f"WITH {TX}, r AS (SELECT suburb, date, max(price) AS top FROM tx WHERE bed = 1 GROUP BY 1, 2) SELECT key, top FROM tx LEFT JOIN r USING (suburb, date)")
def j2(spark, sf):
    t = tx(spark, sf).select("key", "suburb", "date", "bed", "price")
    return joins.merge_on_group_date(t, t.where("bed = 1").select("suburb", "date", F.col("price").alias("top")), ["suburb"], "date", "top").select("key", "top")


_RIGHT = "r AS (SELECT suburb, date, CASE WHEN max(key) % 3 = 0 THEN NULL ELSE max(price) END AS v FROM tx GROUP BY 1, 2)"


def _asof(spark, sf):
    t = tx(spark, sf).select("key", "suburb", "date", "price")
    return t.where("key % 20 = 0").select("key", "suburb", "date"), t.groupBy("suburb", "date").agg(F.when(F.max("key") % 3 != 0, F.max("price")).alias("v"))


# every row asks the rows of the other part of the keys, so none finds itself
_ASKED = "l AS (SELECT *, key % 20 <> 0 AS part FROM tx), h AS (SELECT *, key % 20 = 0 AS part FROM tx)"


def _parts(spark, sf):
    t = tx(spark, sf).select("key", "suburb", "bed", "date", "price")
    return t.select("key", "suburb", "bed", "date", (F.col("key") % 20 != 0).alias("part")), t.withColumn("part", F.col("key") % 20 == 0)


@query("j3_asof_join", f"WITH {TX}, {_ASKED}, r AS (SELECT suburb, part, date, CASE WHEN max(key) % 3 = 0 THEN NULL ELSE max(price) END AS v FROM h GROUP BY 1, 2, 3) SELECT l.key, r.v FROM l ASOF LEFT JOIN r ON l.suburb = r.suburb AND l.part = r.part AND l.date >= r.date")
def j3(spark, sf):
    left, h = _parts(spark, sf)
    right = h.groupBy("suburb", "part", "date").agg(F.when(F.max("key") % 3 != 0, F.max("price")).alias("v"))
    return joins.asof_join(left, right, ["suburb", "part"], "date", "date", "v").select("key", "v")


@query("j3_asof_join_strict", f"WITH {TX}, {_RIGHT} SELECT l.key, r.v FROM (SELECT * FROM tx WHERE key % 20 = 0) l ASOF LEFT JOIN r ON l.suburb = r.suburb AND l.date > r.date")
def j3s(spark, sf):
    left, right = _asof(spark, sf)
    return joins.asof_join(left, right, ["suburb"], "date", "date", "v", strict=True).select("key", "v")


@query("j4_asof_join_with_fallback", f"WITH {TX}, {_ASKED}, a AS (SELECT suburb, bed, part, date, max(price) AS v FROM h WHERE bed = 2 GROUP BY 1, 2, 3, 4), b AS (SELECT suburb, part, date, max(price) AS v FROM h WHERE suburb < 'J' GROUP BY 1, 2, 3), c AS (SELECT part, date, max(price) AS v FROM h GROUP BY 1, 2) SELECT l.key, coalesce(a.v, b.v, c.v) AS v FROM l ASOF LEFT JOIN a ON l.suburb = a.suburb AND l.bed = a.bed AND l.part = a.part AND l.date >= a.date ASOF LEFT JOIN b ON l.suburb = b.suburb AND l.part = b.part AND l.date >= b.date ASOF LEFT JOIN c ON l.part = c.part AND l.date >= c.date")
def j4(spark, sf):
    left, h = _parts(spark, sf)
    level = lambda df, *keys: (df.groupBy(*keys, "part", "date").agg(F.max("price").alias("v")), [*keys, "part"])
    levels = [level(h.where("bed = 2"), "suburb", "bed"), level(h.where("suburb < 'J'"), "suburb"), level(h)]
    return joins.asof_join_with_fallback(left, levels, "date", "date", "v", "v").select("key", "v")


_GEO = "t AS (SELECT key, suburb, cast(owner % 100 AS VARCHAR) AS postcode, cast(owner AS VARCHAR) AS q, CASE WHEN key % 3 = 0 THEN lat END AS lat, CASE WHEN key % 3 = 0 THEN lon END AS lon FROM tx), r AS (SELECT cast(c_custkey AS VARCHAR) AS q, -40.0 AS la, 170.0 + c_custkey / 1000.0 AS lo FROM customer WHERE c_custkey % 5 = 0)"


def _geo(spark, sf):
    c = F.col
    t = tx(spark, sf).select("key", "suburb", (c("owner") % 100).cast("string").alias("postcode"), c("owner").cast("string").alias("q"), F.when(c("key") % 3 == 0, c("lat")).alias("lat"), F.when(c("key") % 3 == 0, c("lon")).alias("lon"))
    r = table(spark, sf, "customer").where("c_custkey % 5 = 0").select(c("c_custkey").cast("string").alias("query"), F.lit(-40.0).alias("latitude"), (170.0 + c("c_custkey") / 1000.0).alias("longitude"))
    return t, r


@query("j5_geocode_join", f"WITH {TX}, {_GEO}, a AS (SELECT t.*, coalesce(t.lat, la) AS x, coalesce(t.lon, lo) AS y FROM t LEFT JOIN r USING (q)), s AS (SELECT suburb, avg(x) AS sx, avg(y) AS sy FROM a WHERE x IS NOT NULL GROUP BY 1) SELECT key, round(coalesce(x, sx), 6) AS lat, round(coalesce(y, sy), 6) AS lon FROM a LEFT JOIN s USING (suburb)")
def j5(spark, sf):
    t, r = _geo(spark, sf)
    return rounded(joins.geocode_join(t, r, "q", "suburb", "postcode").select("key", "lat", "lon"), ["lat", "lon"], 6)


@query("j6_unresolved_queries", f"WITH {TX}, {_GEO} SELECT DISTINCT q FROM t WHERE q NOT IN (SELECT q FROM r)")
def j6(spark, sf):
    t, r = _geo(spark, sf)
    return joins.unresolved_queries(t, r, "q")


@query("j11_snap_to_known_levels", f"WITH {TX} SELECT key, CASE WHEN key % 4 = 0 THEN concat('x', lower(agency)) ELSE agency END AS agency FROM tx")
def j11(spark, sf):
    t = tx(spark, sf)
    raw = t.select("key", F.when(F.col("key") % 4 == 0, F.concat(F.lit("x"), F.lower("agency"))).otherwise(F.lower("agency")).alias("agency"))
    return joins.snap_to_known_levels(raw, "agency", t.select(F.col("agency").alias("level")).distinct(), "level")


@query("j12_attach_sample_size", f"WITH {TX} SELECT key, count(*) OVER (PARTITION BY suburb, bed) AS n FROM tx")
def j12(spark, sf):
    return joins.attach_sample_size(tx(spark, sf).select("key", "suburb", "bed"), ["suburb", "bed"]).select("key", "n")
