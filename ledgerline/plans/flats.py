"""Flat advertisements: cleaning, features and price factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import half_even, half_up, ratio
from ledgerline.functions.text import replace_in_order
from ledgerline.operators.profile import (
    correlation,
    describe,
    group_stats,
    histogram,
    iqr_report,
    null_profile,
)
from ledgerline.operators.relational import keep_matching, top_k

# Spelling rules for place names, in order.
PLACE_RULES = [
    ("ё", "е"),
    (" при железнодорожной", ""),
    ("поселок Рябово", "поселок городского типа Рябово"),
    ("городской поселок", "поселок городского типа"),
]
BIG_CITY = "Санкт-Петербург"


def clean(flats: DataFrame) -> DataFrame:
    """Fills, casts, place names and ceilings; rows without a ceiling height stay."""
    height = F.col("ceiling_height")
    return (
        flats.withColumn("non_residential_area", F.col("total_area") - F.col("living_area"))
        .na.fill(0.0, ["balcony"])
        .na.fill(False, ["is_apartment"])
        .na.drop(subset=["locality_name"])
        .withColumns(
            {
                "last_price": F.col("last_price").cast("bigint"),
                "first_day_exposition": F.to_timestamp_ntz("first_day_exposition", F.lit("yyyy-MM-dd'T'HH:mm:ss")),
                "floors_total": F.col("floors_total").cast("bigint"),
                "balcony": F.col("balcony").cast("bigint"),
                "days_exposition": half_even("days_exposition").cast("bigint"),
                "locality_name": replace_in_order("locality_name", PLACE_RULES),
                "ceiling_height": F.when(height >= 20, height / 10).otherwise(height),
            }
        )
        .filter(~F.coalesce((F.col("ceiling_height") < 2) | (F.col("ceiling_height") >= 10), F.lit(False)))
    )


def features(cleaned: DataFrame) -> DataFrame:
    floor_type = (
        F.when(F.col("floor") == 1, "первый")
        .when(F.col("floor") == F.col("floors_total"), "последний")
        .otherwise("другой")
    )
    day = F.col("first_day_exposition")
    return cleaned.na.drop(subset=["floors_total"]).withColumns(
        {
            "one_meter_price": ratio("last_price", "total_area"),
            "weekday": F.weekday(day).cast("bigint"),
            "month": F.month(day).cast("bigint"),
            "year": F.year(day).cast("bigint"),
            "floor_type": floor_type,
            "city_center_km": half_even(F.col("city_center_m") / 1000),
        }
    )


def price_factors(flats: DataFrame, columns: Sequence[str] = ("total_area", "kitchen_area", "rooms")) -> DataFrame:
    """Pearson r of each factor with the price, all in one aggregate."""
    row = flats.agg(*[correlation(c, "last_price").alias(c) for c in columns])
    return row.unpivot([], list(columns), "factor", "r")


def top_localities(flats: DataFrame, k: int = 10) -> DataFrame:
    """Places with most advertisements and their mean price per square metre."""
    counts = flats.groupBy("locality_name").agg(F.count("*").alias("ads"))
    best = top_k(counts, k, F.desc("ads"), F.asc("locality_name"))
    means = (
        keep_matching(flats, best, "locality_name")
        .groupBy("locality_name")
        .agg(F.count("*").alias("ads"), half_up(F.avg("one_meter_price"), 2).alias("mean_meter_price"))
    )
    return means


def locality_extremes(top: DataFrame) -> DataFrame:
    """The dearest and the cheapest of the top places (ties stay)."""
    price = F.col("mean_meter_price")
    highest, lowest = top.agg(F.max(price)).scalar(), top.agg(F.min(price)).scalar()
    return top.withColumn(
        "extreme", F.when(price == highest, "highest").when(price == lowest, "lowest")
    ).filter(F.col("extreme").isNotNull())


def price_by_km(flats: DataFrame, city: str = BIG_CITY) -> DataFrame:
    """Mean price and price per kilometre by distance to the centre, one city."""
    priced = flats.filter((F.col("locality_name") == city) & F.col("city_center_km").isNotNull())
    return priced.groupBy("city_center_km").agg(
        F.count("*").alias("cnt"),
        half_up(ratio(F.sum("last_price"), F.count("*")), 2).alias("mean_price"),
        half_up(ratio(F.sum("last_price"), F.count("*")) / F.nullif("city_center_km", F.lit(0.0)), 2).alias(
            "mean_price_per_km"
        ),
    )


def city_distance_r(flats: DataFrame, city: str = BIG_CITY) -> DataFrame:
    return flats.filter(F.col("locality_name") == city).agg(
        correlation("city_center_km", "last_price").alias("r")
    )


NUMERIC = [
    "total_area", "living_area", "kitchen_area", "last_price", "rooms", "ceiling_height", "floor",
    "floors_total", "city_center_m", "days_exposition",
]
AREAS = ["total_area", "kitchen_area", "living_area", "non_residential_area"]


def _ready(t) -> DataFrame:
    return features(clean(t.flats))


def _stats(*by: str):
    return lambda t: group_stats(_ready(t), "last_price", by)


QUERIES = {
    "flt_clean": lambda t: clean(t.flats),
    "flt_area_nulls": lambda t: null_profile(clean(t.flats), AREAS),
    "flt_features": lambda t: _ready(t).select(
        "one_meter_price", "weekday", "month", "year", "floor_type", "city_center_km", "locality_name"
    ),
    "flt_describe": lambda t: describe(_ready(t), NUMERIC, 3),
    "flt_histogram": lambda t: histogram(_ready(t), "total_area", 0, 350, 35),
    "flt_iqr_report": lambda t: iqr_report(_ready(t), NUMERIC, 3),
    "flt_price_by_area": _stats("total_area"),
    "flt_price_by_kitchen": _stats("kitchen_area"),
    "flt_price_by_rooms": _stats("rooms"),
    "flt_price_by_floor": _stats("floor_type"),
    "flt_price_by_date": _stats("weekday", "month", "year"),
    "flt_price_factors": lambda t: price_factors(
        _ready(t), ["total_area", "kitchen_area", "rooms", "weekday", "month", "year"]
    ),
    "flt_top10_localities": lambda t: top_localities(_ready(t)),
    "flt_locality_extremes": lambda t: locality_extremes(top_localities(_ready(t))),
    "flt_price_by_km": lambda t: price_by_km(_ready(t)),
    "flt_city_distance_r": lambda t: city_distance_r(_ready(t)),
}
