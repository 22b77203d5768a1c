"""Music service: plays by city, weekday and genre."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.cleaning import canonicalize, dedupe, normalize_columns
from ledgerline.operators.profile import null_profile
from ledgerline.operators.relational import top_k

DAYS = ["Monday", "Wednesday", "Friday"]
CITIES = ["Moscow", "Saint-Petersburg"]
SLOTS = [("Monday", "07:00", "11:00"), ("Friday", "17:00", "23:00")]


def clean(plays: DataFrame) -> DataFrame:
    named = normalize_columns(plays, {"userid": "user_id"})
    filled = named.na.fill("unknown", ["track", "artist", "genre"])
    return canonicalize(dedupe(filled), "genre", {"hiphop": ["hip", "hop", "hip-hop"]})


def plays_by(plays: DataFrame, column: str) -> DataFrame:
    return plays.groupBy(column).agg(F.count("track").alias("plays"))


def city_by_day(plays: DataFrame, days=DAYS) -> DataFrame:
    """Cities × weekdays in one aggregate; the listed days make the pivot a single job."""
    wide = plays.groupBy("city").pivot("day", list(days)).agg(F.count("user_id")).na.fill(0)
    return wide.toDF("city", *[d.lower() for d in days])


def genre_weekday(plays: DataFrame, day: str, after: str, before: str, k: int = 10) -> DataFrame:
    """Top genres of one weekday between two times of day, both ends excluded."""
    slot = plays.filter((F.col("day") == day) & (F.col("time") > after) & (F.col("time") < before))
    counts = slot.groupBy("genre").agg(F.count("genre").alias("plays"))
    return top_k(counts, k, F.desc("plays"), F.asc("genre"))


def genre_slots(plays: DataFrame, k: int = 10) -> DataFrame:
    """The same for every city and time slot at once."""
    slot = None
    for day, after, before in SLOTS:
        hit = (F.col("day") == day) & (F.col("time") > after) & (F.col("time") < before)
        name = f"{day} {after}-{before}"
        slot = F.when(hit, name) if slot is None else slot.when(hit, name)
    counts = (
        plays.withColumn("slot", slot)
        .filter(F.col("slot").isNotNull())
        .groupBy("city", "slot", "genre")
        .agg(F.count("*").alias("plays"))
    )
    place = F.row_number().over(Window.partitionBy("city", "slot").orderBy(F.desc("plays"), F.asc("genre")))
    return counts.withColumn("place", place.cast("bigint")).filter(F.col("place") <= k)


def city_genres(plays: DataFrame, city: str, k: int = 10) -> DataFrame:
    counts = plays.filter(F.col("city") == city).groupBy("genre").agg(F.count("genre").alias("plays"))
    return top_k(counts, k, F.desc("plays"), F.asc("genre"))


QUERIES = {
    "mus_clean": lambda t: clean(t.plays),
    "mus_nulls": lambda t: null_profile(normalize_columns(t.plays)),
    "mus_genres": lambda t: clean(t.plays).select("genre").distinct(),
    "mus_plays_by_city": lambda t: plays_by(clean(t.plays), "city"),
    "mus_plays_by_day": lambda t: plays_by(clean(t.plays), "day"),
    "mus_city_day": lambda t: city_by_day(clean(t.plays)),
    "mus_genre_weekday_top10": lambda t: genre_weekday(clean(t.plays), *SLOTS[0]),
    "mus_genre_slots": lambda t: genre_slots(clean(t.plays)),
    "mus_genre_by_city": lambda t: city_genres(clean(t.plays), "Moscow"),
}
