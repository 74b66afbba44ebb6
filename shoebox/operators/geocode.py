"""Places for coordinates: nearest city, curated names, translation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo


#: Grid cells in degrees; the world has 180 x 360 of them, whatever the number of points or cities.
CELL = 1.0


def _cell(lat: str, lng: str) -> list[Column]:
    place = lambda c, most: F.greatest(F.lit(-most), F.least(F.lit(most - 1), F.floor(F.col(c) / CELL))).cast("int")
    return [place(lat, 90).alias("gy"), place(lng, 180).alias("gx")]


def _boxes(rows: DataFrame, lat: str, lng: str) -> DataFrame:
    """One row a cell that is not empty, with the box around what it holds."""
    return rows.groupBy(*_cell(lat, lng)).agg(F.min(lat).alias("lat0"), F.max(lat).alias("lat1"), F.min(lng).alias("lng0"), F.max(lng).alias("lng1"))


def _spread(lat0: np.ndarray, lat1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest shrinking of longitudes between two latitudes."""
    ends = np.abs(np.cos(np.radians(np.stack([lat0, lat1]))))
    odd = np.maximum(np.abs(lat0), np.abs(lat1)) >= 90
    return np.where(odd, 0.0, ends.min(0)), np.where(odd | ((lat0 <= 0) & (lat1 >= 0)), 1.0, ends.max(0))


def _apart(points: dict, towns: dict) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance between any point of each box and any town of each box."""
    gap = lambda c: np.maximum(0, np.maximum(towns[c + "0"][None] - points[c + "1"][:, None], points[c + "0"][:, None] - towns[c + "1"][None]))
    far = lambda c: np.maximum(towns[c + "1"][None] - points[c + "0"][:, None], points[c + "1"][:, None] - towns[c + "0"][None])
    low, high = _spread(points["lat0"], points["lat1"])
    return gap("lat") ** 2 + (gap("lng") * low[:, None]) ** 2, far("lat") ** 2 + (far("lng") * high[:, None]) ** 2


def candidates(spots: DataFrame, towns: DataFrame) -> DataFrame:
    """``(gy, gx, towns)``: for each cell with points, every town that may be nearest to one of them.

    ``spots(lat, lng)``, ``towns(c_lat, c_lng, city, cc)``.  First cells with towns are found by their
    boxes, of which there are at most as many as cells in the world; then their towns are narrowed
    down in the same way.  A cell far from all towns gets the same exact answer as any other.
    """
    names = ["lat0", "lat1", "lng0", "lng1"]
    held = _boxes(towns, "c_lat", "c_lng").toArrow()
    boxes = {c: held[c].to_numpy() for c in held.column_names}
    shared = towns.sparkSession.sparkContext.broadcast(boxes)

    def near(batches):
        town = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                least, most = _apart({c: np.asarray(batch.column(c)) for c in names}, town)
                i, j = np.nonzero(least <= most.min(1)[:, None] + 1e-12) if least.size else (np.zeros(0, int), np.zeros(0, int))
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("gy", "gx", *names)], pa.array(town["gy"][j]), pa.array(town["gx"][j])], names=["gy", "gx", *names, "ty", "tx"])

    met = _boxes(spots, "lat", "lng").mapInArrow(near, "gy int, gx int, lat0 double, lat1 double, lng0 double, lng1 double, ty int, tx int")
    ty, tx = _cell("c_lat", "c_lng")
    pairs = met.join(towns.withColumn("ty", ty).withColumn("tx", tx), ["ty", "tx"])
    gap = lambda c, t: F.greatest(F.lit(0.0), F.col(t) - F.col(c + "1"), F.col(c + "0") - F.col(t))
    far = lambda c, t: F.greatest(F.col(t) - F.col(c + "0"), F.col(c + "1") - F.col(t))
    ends = [F.abs(F.cos(F.radians(c))) for c in ("lat0", "lat1")]
    odd = F.greatest(F.abs("lat0"), F.abs("lat1")) >= 90
    low = F.when(odd, 0.0).otherwise(F.least(*ends))
    high = F.when(odd | ((F.col("lat0") <= 0) & (F.col("lat1") >= 0)), 1.0).otherwise(F.greatest(*ends))
    ranged = pairs.withColumn("least", F.pow(gap("lat", "c_lat"), 2) + F.pow(gap("lng", "c_lng") * low, 2)).withColumn("most", F.pow(far("lat", "c_lat"), 2) + F.pow(far("lng", "c_lng") * high, 2))
    bound = ranged.groupBy("gy", "gx").agg((F.min("most") + 1e-12).alias("bound"))
    kept = ranged.join(bound, ["gy", "gx"]).where(F.col("least") <= F.col("bound"))
    return kept.groupBy("gy", "gx").agg(F.collect_list(F.struct("c_lat", "c_lng", "city", "cc")).alias("towns"))


def nearest_city(points: DataFrame, cities: DataFrame) -> DataFrame:
    """``(lat, lng, city, cc)``: the nearest city of distinct points.

    A point joins one row, the candidates of its cell.  Distance is squared degrees with longitudes
    shrunk by the point's latitude; it does not reach over the date line.  Ties go to the smaller
    city name.  Points without coordinates are left out; without cities there is no row.
    """
    spots = points.select(F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).where("lat is not null and lng is not null").distinct()
    towns = cities.select(F.col("lat").cast("double").alias("c_lat"), F.col("lng").cast("double").alias("c_lng"), "city", "cc").where("c_lat is not null and c_lng is not null")
    placed = spots.withColumns(dict(zip(("gy", "gx"), _cell("lat", "lng")))).join(candidates(spots, towns), ["gy", "gx"])
    shrink = F.cos(F.radians("lat"))
    away = lambda t: F.pow(F.col("lat") - t["c_lat"], 2) + F.pow((F.col("lng") - t["c_lng"]) * shrink, 2)
    best = F.array_min(F.transform("towns", lambda t: F.struct(away(t).alias("d"), t["city"].alias("city"), t["cc"].alias("cc"))))
    return placed.select("lat", "lng", best.alias("b")).select("lat", "lng", "b.city", "b.cc")


def place_names(points: DataFrame, cities: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """``(location, location_name)`` of the distinct four-decimal coordinates of ``points(lat, lng)``.

    ``overrides(location, name)`` win over the nearest city's label.
    """
    keys = points.select(geo.rounded(F.col("lat")).alias("lat"), geo.rounded(F.col("lng")).alias("lng")).distinct()
    auto = nearest_city(keys, cities).select(geo.coordinate_key(F.col("lat"), F.col("lng")).alias("location"), geo.city_label(F.col("city"), F.col("cc")).alias("auto"))
    if overrides is None:
        return auto.select("location", F.col("auto").alias("location_name"))
    return auto.join(overrides, "location", "left").select("location", F.coalesce("name", "auto").alias("location_name"))


def translate(places: DataFrame, words: DataFrame, column: str = "name") -> DataFrame:
    """Add ``shown``: translation of the whole name, else of the part before the first comma, else itself.

    ``words(word, translation)``; a null or empty name stays.
    """
    whole = words.select(F.col("word").alias(column), F.col("translation").alias("_whole"))
    head = words.select(F.col("word").alias("_head"), F.col("translation").alias("_part"))
    out = places.withColumn("_head", F.trim(F.substring_index(column, ",", 1)))
    return out.join(whole, column, "left").join(head, "_head", "left").withColumn("shown", F.coalesce("_whole", "_part", column)).drop("_head", "_whole", "_part")


def translated(rows: DataFrame, words: DataFrame | None, column: str = "location_name") -> DataFrame:
    """``rows`` with the names of ``column`` as :func:`translate` shows them; without words as they are."""
    if words is None:
        return rows
    return translate(rows, words, column).select(*[F.col("shown").alias(column) if c == column else F.col(c) for c in rows.columns])
