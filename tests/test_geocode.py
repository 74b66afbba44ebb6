"""Nearest cities against all pairs: crowds, empty regions, poles, the date line."""

import math
import random

import pytest

from shoebox.operators import geocode


def brute(points, cities):
    def nearest(p):
        shrink = math.cos(math.radians(p[0]))
        return min((round((p[0] - c[0]) ** 2 + ((p[1] - c[1]) * shrink) ** 2, 12), c[2], c[3]) for c in cities)[1:]

    return {p: nearest(p) for p in points}


@pytest.mark.parametrize("where", ["world", "crowd", "two"])
def test_nearest(spark, where):
    pick = random.Random(4)
    cities = {
        "world": [(pick.uniform(-90, 90), pick.uniform(-180, 180), f"c{i:04d}", "XX") for i in range(800)],
        "crowd": [(25 + pick.gauss(0, 0.3), 121.5 + pick.gauss(0, 0.3), f"c{i:04d}", "TW") for i in range(600)] + [(-80.0, 10.0, "south", "AQ")],
        "two": [(0.0, 179.9, "east", "E"), (0.0, -179.9, "west", "W"), (0.0, 179.9, "dual", "E")],
    }[where]
    points = [(round(pick.uniform(-90, 90), 4), round(pick.uniform(-180, 180), 4)) for _ in range(300)] + [(round(25 + pick.gauss(0, 0.5), 4), round(121.5 + pick.gauss(0, 0.5), 4)) for _ in range(200)]
    points += [(90.0, 0.0), (-90.0, 77.0), (89.9999, -180.0), (0.0, 180.0), (0.0, -180.0), (0.0, 0.0), (45.0, 179.99)]
    df = spark.createDataFrame([*points, (None, 1.0), (1.0, None), points[0]], "lat double, lng double")
    towns = spark.createDataFrame(cities, "lat double, lng double, city string, cc string")
    got = geocode.nearest_city(df, towns).collect()
    assert len(got) == len(set(points))
    assert {(r["lat"], r["lng"]): (r["city"], r["cc"]) for r in got} == brute(set(points), cities)


def test_one_row_a_point_and_few_candidates(spark):
    pick = random.Random(6)
    towns = spark.createDataFrame([(pick.uniform(-90, 90), pick.uniform(-180, 180), f"c{i}", "X") for i in range(3000)], "c_lat double, c_lng double, city string, cc string")
    spots = spark.createDataFrame([(pick.uniform(-70, 70), pick.uniform(-180, 180)) for _ in range(500)], "lat double, lng double")
    rows = geocode.candidates(spots, towns).collect()
    assert len({(r["gy"], r["gx"]) for r in rows}) == len(rows)
    assert sum(len(r["towns"]) for r in rows) / len(rows) < 30
    plan = geocode.nearest_city(spots, towns.select(towns.c_lat.alias("lat"), towns.c_lng.alias("lng"), "city", "cc"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nothing(spark):
    points = spark.createDataFrame([(1.0, 2.0)], "lat double, lng double")
    cities = spark.createDataFrame([], "lat double, lng double, city string, cc string")
    assert geocode.nearest_city(points, cities).count() == 0 and geocode.nearest_city(points.limit(0), points.selectExpr("lat", "lng", "'a' city", "'b' cc")).count() == 0
