import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import geo


def km(a, b):
    x, y = math.radians(a[0]), math.radians(b[0])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return math.asin(math.sqrt(h))


def test_comparables_top_up_and_dense_places(spark):
    """Bed 2 has three points, so its requests are topped up; bed 1 has a dense place and one of many points."""
    r = random.Random(1)
    at = lambda w: (-43.5 + r.uniform(-w, w), 172.6 + r.uniform(-w, w))
    hist = [(i, 1, *at(0.0004)) for i in range(400)] + [(400 + i, 1, -43.5, 172.6) for i in range(100)] + [(600 + i, 3, *at(0.2)) for i in range(80)] + [(700 + i, 2, *at(0.3)) for i in range(3)]
    asked = [(1000 + i, 1 + i % 3, *at(0.01 if i % 2 else 0.3)) for i in range(18)]
    frame = lambda rows: spark.createDataFrame(rows, "key long, bed int, lat double, lon double")
    got = {}
    for x in geo.knn_comparables(frame(asked), frame(hist), 5, "key").orderBy("rank").collect():
        got.setdefault(x["query_key"], []).append(x["comp_key"])
    for key, bed, *q in asked:
        near = sorted(hist, key=lambda h: (round(km(q, h[2:]), 15), h[0]))
        best = [h for h in near if h[1] == bed][:5]
        if len(best) < 5:
            best = sorted({*best, *near[:5]}, key=near.index)[:5]
        assert got[key] == [h[0] for h in best]
    assert geo._start(frame(hist).withColumnsRenamed({"lat": "latitude", "lon": "longitude"}), [], 1.0, 150) < 1.0


def test_comparables_of_one_place_are_searched_once(spark, monkeypatch):
    """Requests at one place share a search over places: full places meet no other, the rest few; as brute force."""
    r = random.Random(4)
    spots = [(-43.5 + r.uniform(-0.1, 0.1), 172.6 + r.uniform(-0.1, 0.1)) for _ in range(60)]
    rows = [(100 * i + j, 1, *at) for i, at in enumerate(spots) for j in range(40 if i < 50 else 2)]
    met, km_of = spark.sparkContext.accumulator(0), geo.haversine_km
    counted = F.udf(lambda: met.add(1) or 0, "long").asNondeterministic()
    monkeypatch.setattr(geo, "haversine_km", lambda *a: km_of(*a) + counted())
    t = spark.createDataFrame(rows, "key long, bed int, lat double, lon double")
    got = {}
    for x in geo.knn_comparables(t.where("key % 2 = 0"), t, 5, "key", but_itself=True).orderBy("rank").collect():
        got.setdefault(x["query_key"], []).append((x["rank"], x["comp_key"]))
    for key, _, *q in rows:
        if key % 2 == 0:
            near = sorted((h for h in rows if h[0] != key), key=lambda h: (round(km(q, h[2:]), 15), h[0]))[:5]
            assert got.pop(key) == [(i + 1, h[0]) for i, h in enumerate(near)]
    assert not got and met.value < 1000


def test_far_homes_meet_few_points(spark, monkeypatch):
    """Nearest points and counts equal brute force over clusters, far homes, the antimeridian and homes without
    a place; homes far from a cluster meet no more than a few of its points."""
    r = random.Random(2)
    at = lambda lat, lon, w: (lat + r.uniform(-w, w), lon + r.uniform(-w, w))
    points = [("PARK", *at(-43.5, 172.6, 0.01)) for _ in range(1500)] + [("PARK", -43.5, 172.6)] * 40 + [("CBD", -43.4, 172.9), ("CBD", 10.0, -179.99), ("CBD", None, 1.0)]
    homes = [(i, *at(-43.3, 172.9, 0.05)) for i in range(300)] + [(300 + i, *at(-43.5, 172.6, 0.02)) for i in range(60)] + [(400, 10.0, 179.99), (401, None, 172.0)]
    h, p = spark.createDataFrame(homes, "key long, lat double, lon double"), spark.createDataFrame(points, "category string, latitude double, longitude double")
    met, km_of = spark.sparkContext.accumulator(0), geo.haversine_km
    counted = F.udf(lambda: met.add(1) or 0, "long").asNondeterministic()

    def measured(*places):
        return km_of(*places) + counted()

    monkeypatch.setattr(geo, "haversine_km", measured)
    near = {x["key"]: x for x in geo.nearest_poi(h, p, "key", ["PARK", "CBD", "NONE"]).collect()}
    assert 0 < met.value < 40 * len(homes)  # pairs by brute force: 1,500 a home
    monkeypatch.undo()
    count = {x["key"]: x for x in geo.poi_counts(h, p, "key", [0.5, 5.0], ["PARK", "CBD"]).collect()}
    assert len(near) == len(count) == len(homes)
    for key, *place in homes:
        for c in ("PARK", "CBD"):
            d = [2 * 6371.0088 * km(place, q[1:]) for q in points if q[0] == c and q[1] is not None] if place[0] is not None else []
            assert near[key][f"dist_{c.lower()}_km"] == (pytest.approx(min(d), abs=1e-9) if d else None)
            assert [count[key][f"cnt_{c.lower()}_{m}m"] for m in (500, 5000)] == [sum(x <= m / 1000 for x in d) for m in (500, 5000)]
        assert near[key]["dist_none_km"] is None
    empty = p.where("false")
    assert geo.nearest_poi(h, empty, "key", ["PARK"]).where("dist_park_km is null").count() == len(homes)
    assert geo.poi_counts(h, empty, "key", [1.0], ["PARK"]).where("cnt_park_1000m = 0").count() == len(homes)
