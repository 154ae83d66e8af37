"""Parameter joins, as-of joins, geocode joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def attach_params(df: DataFrame, params: DataFrame, keys: list[str], value: str, default: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Left join of fitted statistics (null keys match null); default is a one-row table with the column value."""
    p = params.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_value"))
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    got = df.join(p, test, "left").drop(*[f"_{k}" for k in keys])
    if default is not None:
        got = got.join(F.broadcast(default.select(F.col(value).alias("_default"))), how="left").withColumn("_value", F.coalesce("_value", "_default")).drop("_default")
    return got.withColumn(out or value, F.col("_value")).drop("_value")


def merge_on_group_date(df: DataFrame, roll: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Left join by keys and date after one row for each is kept (the largest value), so no row fans out."""
    one = roll.where(F.col(date).isNotNull()).groupBy(*keys, date).agg(F.max(value).alias(value))
    return df.join(one, [*keys, date], "left")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, value: str, strict: bool = False, out: str | None = None) -> DataFrame:
    """The latest right row at or before (strict: before) each left row of the same group.

    The latest row counts even if its value is null; of right rows at one time the largest value does. Null
    groups and times find nothing. No inequality join: each group and time that is asked for is looked up
    once, by a running `last` over the times of one day and another over the days, so that no window has
    the rows of a group; an equal join brings the value back to the rows.
    """
    by, ts = list(by), lambda c: F.col(c).cast("timestamp")
    hit = right.where(F.col(right_ts).isNotNull()).groupBy(*by, ts(right_ts).alias("_ts")).agg(F.max(F.struct(F.col(value).alias("v"))).alias("_hit"))
    asked = left.where(F.col(left_ts).isNotNull()).select(*by, ts(left_ts).alias("_ts")).distinct()
    both = asked.withColumn("_side", F.lit(0 if strict else 1)).unionByName(hit.withColumn("_side", F.lit(1 if strict else 0)), allowMissingColumns=True)
    both = both.withColumn("_day", F.to_date("_ts"))
    inside = Window.partitionBy(*by, "_day").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_in", F.last("_hit", ignorenulls=True).over(inside))
    days = both.groupBy(*by, "_day").agg(F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("_ts"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"_k{i}" for i in range(len(by))]
    days = days.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col("_day").alias("_kd"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys, strict=True)], F.col("_day") == F.col("_kd"))
    asks = F.col("_side") == (0 if strict else 1)
    found = both.where(asks & F.col("_hit").isNull()).join(days, same, "left").select(*keys, F.col("_ts").alias("_kt"), F.coalesce("_in", "_carried").alias("_found"))
    same = reduce(lambda a, b: a & b, [F.col(b) == F.col(k) for b, k in zip(by, keys, strict=True)], ts(left_ts) == F.col("_kt"))
    return left.join(found, same, "left").withColumn(out or value, F.col("_found.v")).drop(*keys, "_kt", "_found")


def asof_join_with_fallback(left: DataFrame, levels: list[tuple[DataFrame, list[str]]], left_ts: str, right_ts: str, value: str, out: str) -> DataFrame:
    """asof_join for each level of (table, keys), the first level with a value counts. Each combination of
    keys and time is looked up once, and joined back to the rows."""
    used = list(dict.fromkeys(k for _, keys in levels for k in keys))
    got, names = cut(left.select(*used, left_ts).distinct()), []
    for i, (table, keys) in enumerate(levels):
        names.append(f"_level{i}")
        if keys:
            got = asof_join(got, table, keys, left_ts, right_ts, value, out=names[-1])
        else:
            got = asof_join(got.withColumn("_one", F.lit(1)), table.withColumn("_one", F.lit(1)), ["_one"], left_ts, right_ts, value, out=names[-1]).drop("_one")
        got = cut(got)
    got = got.select(*[F.col(c).alias(f"_of_{c}") for c in [*used, left_ts]], F.coalesce(*names).alias("_found"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*used, left_ts]])
    return left.join(got, same, "left").withColumn(out, F.col("_found")).drop("_found", *[f"_of_{c}" for c in [*used, left_ts]])


def geocode_join(df: DataFrame, results: DataFrame, query: str, suburb: str, postcode: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Missing places are filled from results by query, then by the centroid of suburb, then of postcode."""
    r = results.select(F.col("query").alias("_q"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")).where("_q is not null and _q != ''")
    out = df.join(r, F.col(query) == F.col("_q"), "left")
    out = out.withColumns({lat: F.coalesce(lat, "_lat"), lon: F.coalesce(lon, "_lon")}).drop("_q", "_lat", "_lon")
    for key in (suburb, postcode):
        centre = out.where(F.col(lat).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.avg(lat).alias("_lat"), F.avg(lon).alias("_lon"))
        out = out.join(centre, F.col(key) == F.col("_k"), "left").withColumns({lat: F.coalesce(lat, "_lat"), lon: F.coalesce(lon, "_lon")}).drop("_k", "_lat", "_lon")
    return out


def unresolved_queries(df: DataFrame, results: DataFrame, query: str) -> DataFrame:
    """Distinct queries without coordinates in results."""
    known = results.where("latitude is not null and longitude is not null").select(F.col("query").alias(query))
    return df.select(query).where(F.col(query).isNotNull() & (F.col(query) != "")).distinct().join(known, query, "left_anti")


def snap_to_known_levels(df: DataFrame, col: str, levels: DataFrame, level: str) -> DataFrame:
    """Values take the known spelling of the same letters in any case; unknown ones stay."""
    known = levels.where(F.col(level).isNotNull()).groupBy(F.lower(level).alias("_low")).agg(F.min(level).alias("_known"))
    return df.join(known, F.lower(col) == F.col("_low"), "left").withColumn(col, F.coalesce("_known", col)).drop("_low", "_known")


def attach_sample_size(df: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    """Group sizes joined back, so a large group is counted in parts and never gathered."""
    return df.join(df.groupBy(*by).agg(F.count("*").alias(out)), by)
