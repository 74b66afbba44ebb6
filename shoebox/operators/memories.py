"""Themed collections of photos ("memories"): candidates of eight kinds, and a seeded pick.

Candidates are whole and reproducible; only :func:`pick` chooses, by a hash of a seed.  Photos come
as ``photos(path, taken_at, year, month, label, location_name, face_ids, pet_ids)`` already reduced to
what the viewer may see.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text, times
from . import geocode, graph

#: Photos that each kind of card needs, and the most a card shows.
LEAST = {"on_this_day": 3, "trip": 5, "topic": 6, "place": 10, "person": 8, "season": 30, "weekend": 12, "pet": 6}
MOST_SHOWN, TRIP_DAYS, TOPIC_HITS = 30, 2, 2


def _grouped(photos: DataFrame, kind: str, keys: list[str], *more: Column) -> DataFrame:
    return photos.groupBy(*keys).agg(F.count("*").alias("n"), *more).where(F.col("n") >= LEAST[kind])


def on_this_day(photos: DataFrame, today: datetime.date) -> DataFrame:
    """Photos of this month and day in other years: ``(year, n)``."""
    same = photos.where((F.month("taken_at") == today.month) & (F.dayofmonth("taken_at") == today.day) & (F.col("year") != today.year))
    return _grouped(same, "on_this_day", ["year"])


def trips(found: DataFrame, visible: DataFrame) -> DataFrame:
    """Events with a place and at least two days: ``(id, n)`` of visible photos.

    ``found(id, duration_days, photos, top_places)``, ``visible(path)``.
    """
    lasting = found.where((F.size("top_places") > 0) & (F.col("duration_days") >= TRIP_DAYS)).select("id", F.explode("photos").alias("path"))
    return _grouped(lasting.join(visible.select("path"), "path", "left_semi"), "trip", ["id"])


def topic_photos(photos: DataFrame, topics: dict = text.TOPICS) -> DataFrame:
    """``(path, year, month, topic, hits)`` of captions with at least two distinct words of a topic."""
    counts = F.array(*[F.struct(F.lit(name).alias("topic"), text.distinct_hits(F.col("label"), inc, exc).alias("hits")) for name, (_, inc, exc) in topics.items()])
    rows = photos.where("year is not null and month is not null").select("path", "year", "month", F.inline(counts))
    return rows.where(F.col("hits") >= TOPIC_HITS)


def topics(photos: DataFrame, words: dict = text.TOPICS) -> DataFrame:
    return _grouped(topic_photos(photos, words), "topic", ["topic", "year", "month"], F.sum("hits").alias("hits"))


def places(photos: DataFrame) -> DataFrame:
    return _grouped(photos.where("location_name is not null and location_name <> ''"), "place", ["location_name"])


def people(photos: DataFrame, names: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    """Named faces by month: ``(face, year, month, n)``.

    With ``preferred`` (faces the viewer has names for, and the viewer's own) only those, unless none
    of them has enough photos.
    """
    faces = photos.where("year is not null and month is not null").select("year", "month", F.explode("face_ids").alias("face"))
    found = _grouped(faces.join(names.select(F.col("id").alias("face")), "face", "left_semi"), "person", ["face", "year", "month"])
    if preferred:
        known = found.where(F.col("face").isin(preferred))
        others = known.limit(1).agg(F.count("*").alias("some"))  # one row
        return found.crossJoin(F.broadcast(others)).where((F.col("some") == 0) | F.col("face").isin(preferred)).drop("some")
    return found


def seasons(photos: DataFrame, today: datetime.date) -> DataFrame:
    year, month = F.col("year"), F.col("month")
    rows = photos.where(year.isNotNull() & month.isNotNull()).select(times.season(month).alias("season"), times.season_year(year, month).alias("season_year"))
    return _grouped(rows, "season", ["season", "season_year"]).where(F.col("season_year") < today.year)


def weekends(photos: DataFrame) -> DataFrame:
    return _grouped(photos.where(times.on_weekend(F.col("taken_at"))), "weekend", ["year", "month"])


def pets(photos: DataFrame, names: DataFrame) -> DataFrame:
    rows = photos.where("year is not null and month is not null").select("year", "month", F.explode("pet_ids").alias("pet"))
    return _grouped(rows.join(names.select(F.col("id").alias("pet")), "pet", "left_semi"), "pet", ["pet", "year", "month"])


#: Fixed value: how card ids name a kind, where it isn't by the kind itself.
ID_OF_KIND = {"on_this_day": "otd"}


def _card_id(kind: str, key: Column) -> Column:
    """The id of a card; a place's name goes in as eight digits of its hash."""
    return F.concat(F.lit(f"mem_{ID_OF_KIND.get(kind, kind)}_"), text.short_id("", key) if kind == "place" else key)


def cards(kind: str, candidates: DataFrame, key: Column, title: Column) -> DataFrame:
    """Candidates of one kind as ``(kind, card_id, title, n)``."""
    return candidates.select(F.lit(kind).alias("kind"), _card_id(kind, key).alias("card_id"), title.alias("title"), "n")


#: Cards of one kind in a selection; other kinds show one, this-day cards all.
SHOWN = {"trip": 3, "topic": 3}


def pick(candidates: DataFrame, seed: str) -> DataFrame:
    """A reproducible selection: cards of each kind by hash of seed and id, then all in hash order.

    ``candidates(kind, card_id, title, n)``, and ``grp`` if only one card of a group may be taken (one
    month of each topic).  Returns ``place, kind, card_id, title, n``.
    """
    draw = candidates.withColumn("draw", F.md5(F.concat(F.lit(seed), "card_id")))
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("draw", "card_id"))
    if "grp" in draw.columns:
        draw = draw.withColumn("_one", nth("kind", "grp")).where("_one = 1")
    quota = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in SHOWN.items()], F.when(F.col("kind") == "on_this_day", 1 << 30), F.lit(1))
    chosen = draw.withColumn("_k", nth("kind")).where(F.col("_k") <= quota)
    # what is left are a few cards a kind and a card a year
    return chosen.withColumn("place", F.row_number().over(Window.orderBy("draw", "card_id")) - 1).select("place", "kind", "card_id", "title", "n")


def _cards_of(kind: str, rows: DataFrame, keys: list[str], card: Column, title: Column, subtitle: Column | None = None, grp: Column | None = None, rank: Column | None = None, cover: Column | None = None) -> DataFrame:
    """The photos of all cards of one kind that have enough of them, a row each."""
    enough = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST[kind])
    card_id = _card_id(kind, card)
    return rows.join(enough, keys).select(
        F.lit(kind).alias("kind"), card_id.alias("card_id"), title.alias("title"), (F.lit("") if subtitle is None else subtitle).alias("subtitle"), (card_id if grp is None else grp).alias("grp"),
        "path", "taken_at", (F.lit(0) if rank is None else rank).alias("rank"), (F.lit(None).cast("string") if cover is None else cover).alias("event_cover"), "n",
    )


def view(photos: DataFrame, found: DataFrame, face_names: DataFrame, pet_names: DataFrame, today: datetime.date, seed: str, identity: str = "", preferred: list[str] | None = None, topics_: dict = text.TOPICS, words: DataFrame | None = None) -> DataFrame:
    """All eight kinds as cards for one viewer, with titles, photos and covers.

    ``photos(path, taken_at, year, month, label, location_name, face_ids, pet_ids)`` are those the
    viewer sees, ``found(id, start, duration_days, photos, top_places, cover)`` the events.  Returns
    ``place, kind, card_id, title, subtitle, cover, photos, photo_count``: at most MOST_SHOWN photos a
    card, topics' by hits and others' by seeded hash, in time order; the cover is the event's own if
    it is among them, else the middle one.  ``words(word, translation)`` translates places in titles,
    not in ids.
    """
    shown = lambda rows, column: rows.withColumn("shown", F.col(column)) if words is None else geocode.translate(rows, words, column)
    #: the titles below are fixed values
    year, month = F.col("year").cast("string"), F.col("month").cast("string")
    when = F.concat(year, F.lit(" 年 "), month, F.lit(" 月 · "))
    stamp = F.concat(year, F.lit("_"), F.lpad(month, 2, "0"))
    dated = photos.where("year is not null and month is not null")
    slim = photos.select("path", "taken_at")
    same = photos.where((F.month("taken_at") == today.month) & (F.dayofmonth("taken_at") == today.day) & (F.col("year") != today.year))
    parts = [_cards_of("on_this_day", same, ["year"], year, F.concat((F.lit(today.year) - F.col("year")).cast("string"), F.lit(" 年前的今天")), F.concat(year, F.lit(f" 年 {today.month} 月 {today.day} 日")))]
    lasting = found.where((F.size("top_places") > 0) & (F.col("duration_days") >= TRIP_DAYS))
    went = lasting.select(F.col("id"), F.year("start").alias("year"), F.month("start").alias("month"), F.get("top_places", 0).alias("spot"), "duration_days", "cover", F.explode("photos").alias("path")).join(slim, "path")
    parts.append(_cards_of("trip", shown(went, "spot"), ["id"], F.col("id"), F.concat(when, "shown"), F.concat(F.col("duration_days").cast("string"), F.lit(" 天")), cover=F.col("cover")))
    told = topic_photos(photos, topics_).join(slim, "path")
    parts.append(_cards_of("topic", told, ["topic", "year", "month"], F.concat("topic", F.lit("_"), stamp), F.concat(when, "topic"), grp=F.col("topic"), rank=F.col("hits")))
    parts.append(_cards_of("place", shown(photos.where("location_name <> ''"), "location_name"), ["location_name"], F.col("location_name"), F.concat(F.lit("在 "), "shown"), F.lit("跨年度回顧")))
    faces = dated.select("path", "taken_at", "year", "month", F.explode("face_ids").alias("id")).join(face_names.where("name <> ''").select("id", "name"), "id")
    people_ = people(photos, face_names.where("name <> ''"), preferred).select(F.col("face").alias("id"), "year", "month")
    title = F.when(F.col("id") == identity, F.concat(when, F.lit("那時候的我"))).otherwise(F.concat(when, F.lit("與 "), "name"))
    parts.append(_cards_of("person", faces.join(people_, ["id", "year", "month"]), ["id", "year", "month"], F.concat("id", F.lit("_"), stamp), title))
    turned = dated.select("path", "taken_at", times.season(F.col("month")).alias("season"), times.season_year(F.col("year"), F.col("month")).alias("season_year")).where(F.col("season_year") < today.year)
    parts.append(_cards_of("season", turned, ["season", "season_year"], F.concat("season", F.lit("_"), F.col("season_year").cast("string")), F.concat(F.col("season_year").cast("string"), F.lit(" 年的"), "season", F.lit("天"))))
    parts.append(_cards_of("weekend", photos.where(times.on_weekend(F.col("taken_at"))), ["year", "month"], stamp, F.concat(when, F.lit("週末"))))
    animals = dated.select("path", "taken_at", "year", "month", F.explode("pet_ids").alias("id")).join(pet_names.where("name <> ''").select("id", "name"), "id")
    parts.append(_cards_of("pet", animals, ["id", "year", "month"], F.concat("id", F.lit("_"), stamp), F.concat(when, "name")))
    members = parts[0]
    for part in parts[1:]:
        members = members.unionByName(part)
    members = graph.materialize(members)
    cards_ = members.groupBy("kind", "card_id").agg(F.first("title").alias("title"), F.first("grp").alias("grp"), F.first("n").alias("n"))  # one value a card
    chosen = graph.materialize(pick(cards_, seed).select("place", "card_id"))
    best = Window.partitionBy("card_id").orderBy(F.desc("rank"), F.md5(F.concat(F.lit(seed), "path")), "path")
    drawn = members.join(chosen, "card_id").withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= MOST_SHOWN)
    listed = drawn.groupBy("place", "kind", "card_id", "title", "subtitle", "event_cover").agg(F.transform(F.array_sort(F.collect_list(F.struct("taken_at", "path"))), lambda r: r["path"]).alias("photos"))
    cover = F.when(F.array_contains("photos", F.col("event_cover")), F.col("event_cover")).otherwise(F.get("photos", F.floor(F.size("photos") / 2).cast("int")))
    return listed.select("place", "kind", "card_id", "title", "subtitle", cover.alias("cover"), "photos", F.size("photos").alias("photo_count"))


def card_photos(photos: DataFrame, seed: str, rank: Column | None = None) -> DataFrame:
    """At most MOST_SHOWN photos of one card: the best by ``rank``, else by seeded hash; in time order.

    Returns ``pos, path, is_cover``; the cover is the middle one.
    """
    by = F.struct((-rank if rank is not None else F.lit(0)).alias("a"), F.md5(F.concat(F.lit(seed), "path")).alias("b"))
    few = photos.select("path", "taken_at", by.alias("by")).orderBy("by").limit(MOST_SHOWN)
    listed = few.agg(F.array_sort(F.collect_list(F.struct("taken_at", "path"))).alias("l"))
    return listed.select(F.size("l").alias("n"), F.posexplode("l").alias("pos", "r")).select("pos", "r.path", (F.col("pos") == F.floor(F.col("n") / 2)).alias("is_cover"))
