"""Nearest neighbours and radius counts on a latitude-longitude grid; equi joins on cells only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import EARTH_RADIUS_KM, haversine_km

from .storage import cut

KM_PER_DEGREE = 111.19


def _cells(df: DataFrame, lat: str, lon: str, lat_step: float, lon_step: float, around: bool) -> DataFrame:
    i, j = F.floor(F.col(lat) / lat_step), F.floor(F.col(lon) / lon_step)
    if not around:
        return df.withColumns({"_i": i, "_j": j})
    near = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    return df.withColumn("_di", F.explode(near)).withColumn("_dj", F.explode(near)).withColumns({"_i": i + F.col("_di"), "_j": j + F.col("_dj")}).drop("_di", "_dj")


def _box(*tables: tuple[DataFrame, str, str]) -> tuple[float, float]:
    """(km across, cosine of the latitude furthest from the equator) of all points."""
    rows = [df.agg(F.min(lat), F.max(lat), F.min(lon), F.max(lon)).first() for df, lat, lon in tables]
    rows = [r for r in rows if r[0] is not None]
    if not rows:
        return 0.0, 1.0
    top = min(89.0, max(max(abs(r[0]), abs(r[1])) for r in rows))
    across = max(max(r[1] for r in rows) - min(r[0] for r in rows), max(r[3] for r in rows) - min(r[2] for r in rows))
    return across * KM_PER_DEGREE, math.cos(math.radians(top))


def within_radius(left: DataFrame, right: DataFrame, radius_km: float, by: list[str] = (), left_at: tuple[str, str] = ("lat", "lon"), right_at: tuple[str, str] = ("latitude", "longitude")) -> DataFrame:
    """Pairs of left and right rows (equal in `by`) within radius_km, with distance_km."""
    _, cos = _box((left, *left_at), (right, *right_at))
    lat_step, lon_step = radius_km / KM_PER_DEGREE * 1.001, radius_km / (KM_PER_DEGREE * cos) * 1.001
    a = _cells(left.where(F.col(left_at[0]).isNotNull() & F.col(left_at[1]).isNotNull()), *left_at, lat_step, lon_step, around=True)
    b = _cells(right.where(F.col(right_at[0]).isNotNull() & F.col(right_at[1]).isNotNull()), *right_at, lat_step, lon_step, around=False)
    d = haversine_km(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1]))
    return a.join(b, [*by, "_i", "_j"]).withColumn("distance_km", d).where(F.col("distance_km") <= radius_km).drop("_i", "_j")


def _start(points: DataFrame, by: list[str], start_km: float, most: int) -> float:
    """start_km, or the largest half of a half of it whose cells all hold `most` points or fewer."""
    for level in range(24):  # a cell of the last level is smaller than a metre
        step = start_km / 2**level / KM_PER_DEGREE
        cells = points.groupBy(*by, F.floor(F.col("latitude") / step), F.floor(F.col("longitude") / step)).count()
        if (cells.agg(F.max("count")).first()[0] or 0) <= most:
            break
    return start_km / 2**level


def nearest(queries: DataFrame, points: DataFrame, k: int, point_key: str, by: list[str] = (), start_km: float = 1.0) -> DataFrame:
    """queries with `nearest`, an array of (distance_km, point_key): the k nearest points of each one and its group, exactly.

    Queries have lat, lon; points latitude, longitude. Places are searched, not rows: queries at one place share
    their answer, and of a group's points at one place the k with the smallest keys are enough. A place that
    holds k points itself is done at once. Of the others, a search looks within r; a place with k points there
    is done, the rest go on with a radius twice as large, until r spans all points. Each round is written to the
    checkpoint folder.

    Where the cells of start_km are dense the search starts with smaller ones, so a query meets no more places than
    it needs; a query at the edge of a cluster may still meet that cluster's places in a later round.
    """
    at, real = [*by, "lat", "lon"], "{0} is not null and {1} is not null and not isnan({0}) and not isnan({1})".format
    spots = cut(queries.select(*at).where(real("lat", "lon")).distinct())
    place = Window.partitionBy(*by, "latitude", "longitude").orderBy(point_key)
    places = points.select(point_key, "latitude", "longitude", *by).where(real("latitude", "longitude")).withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k)
    places = cut(places.groupBy(*by, "latitude", "longitude").agg(F.sort_array(F.collect_list(F.struct(point_key))).alias("_keys")))
    put = lambda km: F.transform("_keys", lambda x: F.struct(km.alias("distance_km"), x[point_key].alias(point_key)))
    here = places.where(F.size("_keys") >= k).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    done = cut(spots.join(here, at).select(*at, put(F.lit(0.0)).alias("nearest")))
    left = cut(spots.join(done, at, "left_anti"))
    across, _ = _box((spots, "lat", "lon"), (places, "latitude", "longitude"))
    # k places at most hold the k nearest points: those whose first point is among the first k by distance and key
    order = Window.partitionBy(*at).orderBy("distance_km", F.get("_keys", F.lit(0)))
    r = None
    while not left.isEmpty():
        r = _start(places, by, start_km, max(32, 8 * k)) if r is None else r * 2
        last = r > 2.5 * across + 1
        got = within_radius(left, places, r, by).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
        found = cut(got.groupBy(*at).agg(F.slice(F.sort_array(F.flatten(F.collect_list(put(F.col("distance_km"))))), 1, k).alias("nearest")))
        full = found if last else found.where(F.size("nearest") >= k)
        done = done.unionByName(full)
        if last:
            break
        left = cut(left.join(full, at, "left_anti"))
    none = F.array().cast(done.schema["nearest"].dataType)
    return queries.join(done, at, "left").withColumn("nearest", F.coalesce("nearest", none))


FINEST = 16


def _half(degrees: Column) -> Column:
    return F.pow(F.sin(F.radians(degrees) / 2), 2)


def _apart(q: str, p: str) -> tuple[Column, Column]:
    """Bounds of the squared sine of half the angle between any point of box q and any of box p.

    They hold across the antimeridian, too: between two differences of longitude the squared sine is least at an end.
    """
    c = lambda side, name: F.col(f"{side}_{name}")

    def span(a: str, b: str) -> tuple[Column, Column]:
        near = F.greatest(F.lit(0.0), c(q, a) - c(p, b), c(p, a) - c(q, b))
        return near, F.greatest(c(q, b) - c(p, a), c(p, b) - c(q, a))

    lat_near, lat_far = span("south", "north")
    lon_near, lon_far = span("west", "east")
    low = lambda side: F.least(F.cos(F.radians(c(side, "south"))), F.cos(F.radians(c(side, "north"))))
    high = lambda side: F.when((c(side, "south") <= 0) & (c(side, "north") >= 0), 1.0).otherwise(F.greatest(F.cos(F.radians(c(side, "south"))), F.cos(F.radians(c(side, "north")))))
    widest = F.when((lon_near <= 180) & (lon_far >= 180), 1.0).otherwise(F.greatest(_half(lon_near), _half(lon_far)))
    return _half(lat_near) + low(q) * low(p) * F.least(_half(lon_near), _half(lon_far)), _half(lat_far) + high(q) * high(p) * widest


def _located(df: DataFrame, lat: str, lon: str, *cols: str) -> DataFrame:
    """cols and the place as lat, lon, of rows that have one."""
    return df.select(*cols, F.col(lat).alias("lat"), F.col(lon).alias("lon")).where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")


def _boxes(cells: DataFrame, side: str, level: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells of a level, each with the bounds and the weight of what it holds; cells are those of FINEST."""
    at = [F.shiftright(F.col(c), FINEST - level).alias(f"{side}{c}") for c in ("_i", "_j")]
    edges = [f(f"{side}_{e}").alias(f"{side}_{e}") for f, e in ((F.min, "south"), (F.max, "north"), (F.min, "west"), (F.max, "east"))]
    return cells.groupBy(*by, *at).agg(*edges, F.sum("_n").alias(f"{side}_n"))


def _on_grid(homes: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Both with the cells _i, _j of the finest grid over all of them; None if either is empty."""
    edges = [F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")]
    a, b = homes.agg(*edges).first(), points.agg(*edges).first()
    if a[0] is None or b[0] is None:
        return None
    south, north, west, east = min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])
    cos = math.cos(math.radians(min(89.0, max(abs(south), abs(north)))))
    height = max(north - south, (east - west) * cos, 1e-9) * 1.000001
    cell = lambda c, least, width: F.greatest(F.lit(0), F.least(F.lit((1 << FINEST) - 1), F.floor((F.col(c) - least) / width * (1 << FINEST)).cast("int")))
    put = lambda df: df.withColumns({"_i": cell("lat", south, height), "_j": cell("lon", west, height / cos)})
    return put(homes), put(points)


def _as_boxes(df: DataFrame, side: str) -> DataFrame:
    return df.withColumns({f"{side}_south": F.col("lat"), f"{side}_north": F.col("lat"), f"{side}_west": F.col("lon"), f"{side}_east": F.col("lon")})


def _depth(homes: DataFrame, points: DataFrame, by: tuple[str, ...], most: int) -> int:
    """The level from which on cells hold `most` places each: homes on the average, points of one kind at most."""
    for level in range(3, FINEST):
        at = [F.shiftright("_i", FINEST - level), F.shiftright("_j", FINEST - level)]
        mean = homes.groupBy(*at).count().agg(F.avg("count")).first()[0]
        if mean <= most and points.groupBy(*by, *at).count().agg(F.max("count")).first()[0] <= most:
            return level
    return FINEST


def _descend(pairs: DataFrame, homes: DataFrame, points: DataFrame, by: tuple[str, ...], above: int, level: int) -> DataFrame:
    """Pairs of cells of the level above, as pairs of the cells in them that hold anything, with _near and _far."""
    up = [F.shiftright(f"{s}{c}", level - above).alias(f"_{s}{c}") for s in "qp" for c in ("_i", "_j")]
    q, p = _boxes(homes, "q", level), _boxes(points, "p", level, by)
    got = pairs.withColumnsRenamed({f"{s}{c}": f"_{s}{c}" for s in "qp" for c in ("_i", "_j")})
    got = got.join(p.select("*", *up[2:]), [*by, "_p_i", "_p_j"]).join(q.select("*", *up[:2]), ["_q_i", "_q_j"])
    near, far = _apart("q", "p")
    return got.withColumns({"_near": near, "_far": far})


def _levels(depth: int) -> list[tuple[int, int]]:
    return [(0, 3), *[(i, i + 1) for i in range(3, depth)]]


def _top(points: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return points.select(*by).distinct().withColumns({c: F.lit(0) for c in ("q_i", "q_j", "p_i", "p_j")})


def nearest_km(homes: DataFrame, points: DataFrame, key: str, kinds: list[str], name) -> DataFrame:
    """(key, name(kind) for each kind): the distance to the nearest point of the kind (column `category`), exactly.

    Cells of homes are held against cells of points, from large ones to small: of the cells in a pair those go
    on whose least distance does not exceed the least of all largest distances. So a home meets the few points
    that may be the nearest to its cell, however far they are and however many stand near them.
    """
    rows = cut(_located(homes, "lat", "lon", key).distinct())
    grid = _on_grid(rows, cut(_located(points.where(F.col("category").isin(*kinds)), "latitude", "longitude", "category").distinct()))
    if grid is None:
        return rows.select(key, *[F.lit(None).cast("double").alias(name(k)) for k in kinds])
    rows, spots = grid
    q, p = _as_boxes(rows, "q").withColumn("_n", F.lit(1)), _as_boxes(spots, "p").withColumn("_n", F.lit(1))
    depth, by = _depth(rows, spots, ("category",), 8), ("category",)

    def best(pairs: DataFrame, *keep: str) -> DataFrame:
        w = Window.partitionBy("category", "q_i", "q_j")
        kept = pairs.withColumn("_best", F.min("_far").over(w)).where(F.col("_near") <= F.col("_best") * (1 + 1e-9) + 1e-18)
        return cut(kept.select("category", "q_i", "q_j", *keep))

    pairs = _top(spots, by)
    for above, level in _levels(depth):
        pairs = best(_descend(pairs, q, p, by, above, level), "p_i", "p_j")
    at = lambda side: [F.shiftright(c, FINEST - depth).alias(f"{side}{c}") for c in ("_i", "_j")]
    near, far = _apart("q", "p")
    met = pairs.join(p.select("*", *at("p")).drop("_i", "_j"), ["category", "p_i", "p_j"]).join(_boxes(q, "q", depth), ["q_i", "q_j"])
    met = best(met.withColumns({"_near": near, "_far": far}), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    met = rows.select(key, "lat", "lon", *at("q")).join(met, ["q_i", "q_j"])
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    met = met.select(key, "category", km.alias("_km"))
    return met.groupBy(key).agg(*[F.min(F.when(F.col("category") == k, F.col("_km"))).alias(name(k)) for k in kinds])


def nearest_poi(df: DataFrame, pois: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """df with dist_<category>_km for each category."""
    return df.join(nearest_km(df, pois, key, categories, lambda c: f"dist_{c.lower()}_km"), key, "left")


def poi_counts(df: DataFrame, pois: DataFrame, key: str, radii_km: list[float], categories: list[str]) -> DataFrame:
    """df with cnt_<category>_<metres>m for each category and radius.

    Cells of homes are held against cells of points, from large ones to small: cells wholly inside a radius
    are counted at once, those outside are left, and only the points of cells that the circle cuts are met.
    """
    name = lambda c, r: f"cnt_{c.lower()}_{round(r * 1000)}m"
    wanted = [(c, r) for c in categories for r in radii_km]
    rows = cut(_located(df, "lat", "lon", key))
    spots = _located(pois.where(F.col("category").isin(*categories)), "latitude", "longitude", "category").groupBy("category", "lat", "lon").agg(F.count("*").alias("_n"))
    grid = _on_grid(rows, cut(spots))
    if grid is None:
        return df.withColumns({name(c, r): F.lit(0).cast("long") for c, r in wanted})
    rows, spots = grid
    places = cut(rows.select("lat", "lon", "_i", "_j").distinct())
    q, p = _as_boxes(places, "q").withColumn("_n", F.lit(1)), _as_boxes(spots, "p")
    depth, by = _depth(places, spots, ("category",), 8), ("category",)
    reach = [F.lit(math.sin(r / (2 * EARTH_RADIUS_KM)) ** 2 if r < math.pi * EARTH_RADIUS_KM else 2.0) for r in radii_km]
    limit = lambda: F.get(F.array(*reach), F.col("_r"))
    cell = ["q_i", "q_j"]
    pairs = _top(spots, by).withColumn("_r", F.explode(F.array(*[F.lit(i) for i in range(len(radii_km))])))
    counted = pairs.select("category", "_r", *cell, F.lit(0).cast("long").alias("_sum")).distinct()
    for above, level in _levels(depth):
        got = cut(_descend(pairs, q, p, by, above, level).where(F.col("_near") <= limit() * (1 + 1e-9)).select("category", "_r", *cell, "p_i", "p_j", "p_n", (F.col("_far") < limit() * (1 - 1e-9)).alias("_in")))
        pairs = got.where("not _in").drop("_in", "p_n")
        down = _boxes(q, "q", level).select(*cell, *[F.shiftright(c, level - above).alias(f"_{c}") for c in cell])
        carried = counted.withColumnsRenamed({c: f"_{c}" for c in cell}).join(down, [f"_{c}" for c in cell]).select("category", "_r", *cell, "_sum")
        whole = got.where("_in").select("category", "_r", *cell, F.col("p_n").alias("_sum"))
        counted = cut(carried.unionByName(whole).groupBy("category", "_r", *cell).agg(F.sum("_sum").alias("_sum")))
    at = lambda side: [F.shiftright(c, FINEST - depth).alias(f"{side}{c}") for c in ("_i", "_j")]
    each = lambda value, more=F.lit(True): [F.sum(F.when((F.col("category") == c) & (F.col("_r") == i) & more, F.col(value))).alias(name(c, r)) for c in categories for i, r in enumerate(radii_km)]
    inside = counted.groupBy(*cell).agg(*each("_sum"))
    near, far = _apart("q", "p")
    met = pairs.join(spots.select("category", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "_n", *at("p")), ["category", "p_i", "p_j"]).drop("p_i", "p_j")
    met = places.select("lat", "lon", *at("q")).join(met, cell)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    cuts = met.select("lat", "lon", "category", "_r", "_n", (km <= F.get(F.array(*[F.lit(float(r)) for r in radii_km]), F.col("_r"))).alias("_in")).groupBy("lat", "lon").agg(*each("_n", F.col("_in")))
    total = lambda n: F.coalesce(inside[n], F.lit(0)) + F.coalesce(cuts[n], F.lit(0))
    of = rows.select(key, "lat", "lon", *at("q")).alias("h").join(inside, cell, "left").join(cuts, ["lat", "lon"], "left")
    got = of.groupBy(key).agg(*[F.sum(total(name(c, r))).alias(name(c, r)) for c, r in wanted])
    return df.join(got, key, "left").withColumns({name(c, r): F.coalesce(F.col(name(c, r)), F.lit(0)) for c, r in wanted})


def school_distances(df: DataFrame, high: str, primary: str, intermediate: str, others: list[str] = ()) -> DataFrame:
    """Distances to a high school, to a primary or intermediate one, to any; the raw columns go."""
    raw = [high, primary, intermediate, *others]
    return df.withColumns({"school_high_km": F.col(high), "school_primary_km": F.least(F.col(primary), F.col(intermediate)), "school_any_km": F.least(*raw)}).drop(*raw)


def knn_comparables(queries: DataFrame, history: DataFrame, k: int, key: str, same: str = "bed", radius_km: float | None = None, but_itself: bool = False) -> DataFrame:
    """(query_key, comp_key, distance_km, same_first, rank): k nearest with the same `same`, topped up from all.

    but_itself: history holds the queries too, and a row of a query's own key is none of its comparables.
    """
    points = history.select(F.col(key).alias("comp_key"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), same)
    asked = cut(queries.select(F.col(key).alias("query_key"), "lat", "lon", same).distinct())

    def told(first: int) -> Column:
        others = F.filter("nearest", lambda x: x["comp_key"] != F.col("query_key")) if but_itself else F.col("nearest")
        return F.transform(others, lambda x: F.struct(x["distance_km"], x["comp_key"], F.lit(first).alias("same_first")))

    out = nearest(asked, points, k + but_itself, "comp_key", [same]).select("query_key", "lat", "lon", told(1).alias("own"))
    few = cut(out.where(F.size("own") < k))
    out = out.where(F.size("own") >= k).select("query_key", F.slice("own", 1, k).alias("best"))
    if not few.isEmpty():
        # the top-up fills by distance what the same kind leaves open
        few = nearest(few, points, k + but_itself, "comp_key").withColumn("rest", told(0))
        rest = F.filter("rest", lambda x: ~F.exists("own", lambda y: y["comp_key"] == x["comp_key"]))
        out = out.unionByName(few.select("query_key", F.slice(F.sort_array(F.concat("own", rest)), 1, k).alias("best")))
    out = out.select("query_key", F.posexplode("best").alias("pos", "b")).select("query_key", "b.comp_key", "b.distance_km", "b.same_first", (F.col("pos") + 1).alias("rank"))
    return out.where(F.col("distance_km") <= radius_km) if radius_km is not None else out
