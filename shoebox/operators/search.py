"""Hybrid vector-and-keyword search and filter search over the photo index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import times, vectors


def top_k(scored: DataFrame, k: int, score: str = "score", tie: str = "path") -> DataFrame:
    """The k best rows; ties by ``tie``.  ``k <= 0`` gives none."""
    return scored.orderBy(F.desc(score), tie).limit(max(k, 0))


def vector_top_k(items: DataFrame, query: list[float], k: int, vector: str = "vector") -> DataFrame:
    return top_k(items.withColumn("score", vectors.dot(F.col(vector), vectors.literal(query))), k)


def between_dates(taken: Column, since: str | None, until: str | None) -> Column:
    """Inclusive at midnight on both sides: later times on the last day are outside.

    A missing or unreadable time never passes a bound.
    """
    instant = times.exif_time(taken)
    keep = F.lit(True)
    if since:
        keep = keep & (instant >= F.to_timestamp_ntz(F.lit(since)))
    if until:
        keep = keep & (instant <= F.to_timestamp_ntz(F.lit(until)))
    return F.coalesce(keep, F.lit(False))


def camera_contains(make: Column, model: Column, text: str | None) -> Column:
    if not text:
        return F.lit(True)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return low(make).contains(text.lower()) | low(model).contains(text.lower())


def keyword_score(label: Column, text: str) -> Column:
    return F.when(F.lower(F.coalesce(label, F.lit(""))).contains(text.lower()), 1.0).otherwise(0.0)


def hybrid_search(items: DataFrame, query: list[float], text: str, labels: DataFrame | None = None, k: int = 10, weight: float = 0.5, since: str | None = None, until: str | None = None, camera: str | None = None) -> DataFrame:
    """Best ``k`` of ``items(path, vector, exif_time, make, model)`` by blended score.

    ``weight`` goes to the vector part, the rest to the caption's exact substring score; without
    ``labels(path, text)`` the vector part stands alone.  Filters apply before any score.
    """
    kept = items.where(between_dates(F.col("exif_time"), since, until) & camera_contains(F.col("make"), F.col("model"), camera))
    scored = kept.select("path", vectors.dot(F.col("vector"), vectors.literal(query)).alias("vector_score"))
    if labels is None:
        scored = scored.select("path", F.lit(None).cast("string").alias("label"), "vector_score", F.lit(0.0).alias("keyword_score"), F.col("vector_score").alias("score"))
    else:
        captions = labels.where((F.col("path") != "") & (F.col("text") != "")).groupBy("path").agg(F.max_by("text", "seq").alias("label"))
        scored = scored.join(captions, "path", "left").withColumn("keyword_score", keyword_score(F.col("label"), text))
        scored = scored.withColumn("score", F.lit(weight) * F.col("vector_score") + F.lit(1 - weight) * F.col("keyword_score"))
    return top_k(scored, k)


@dataclass
class Filters:
    """Index search terms.  Empty strings, zero and None are off; ``query`` scores, never excludes."""

    path: str = ""
    face: str = ""
    faces: list[str] = field(default_factory=list)
    year: int = 0
    month: int = 0
    location: str = ""
    location_name: str = ""
    query: str = ""


def has_face(faces: Column, value: str) -> Column:
    return F.exists(faces, lambda f: (f["id"] == value) | (f["name"] == value))


def search_index(index: DataFrame, wanted: Filters, k: int = 20) -> DataFrame:
    """Rows of ``index`` that pass all filters, scored by the filters they pass, best first."""
    keep, score = F.lit(True), F.lit(0.0)
    terms: list[tuple[Column, float]] = []
    if wanted.path:
        terms.append((F.col("path").contains(wanted.path), 0.5))
    if wanted.face:
        terms.append((has_face(F.col("faces"), wanted.face), 1.0))
    for value in wanted.faces:
        terms.append((has_face(F.col("faces"), value), 1.0))
    if wanted.year:
        terms.append((F.col("year") == wanted.year, 0.5))
    if wanted.month:
        terms.append((F.col("month") == wanted.month, 0.3))
    if wanted.location:
        terms.append((F.lower("location").contains(wanted.location.lower()), 0.5))
    if wanted.location_name:
        terms.append((F.lower("location_name").contains(wanted.location_name.lower()), 0.5))
    for condition, points in terms:
        keep, score = keep & F.coalesce(condition, F.lit(False)), score + F.lit(points)
    if wanted.query:
        score = score + keyword_score(F.col("label"), wanted.query)
    return top_k(index.where(keep).withColumn("score", score), k)


def query_vector(text: str, encode, translate=None) -> list[float]:
    """Vector of a search text: one call of ``encode`` on the driver.

    A text with CJK characters is translated first if ``translate`` is given; if that fails or
    returns nothing, the text is encoded as it is.
    """
    if translate is not None and any("\u4e00" <= c <= "\u9fff" or "\u3400" <= c <= "\u4dbf" for c in text):
        try:
            text = translate(text) or text
        except Exception:  # searching untranslated is better than not at all
            pass
    return [float(x) for x in encode(text)]
