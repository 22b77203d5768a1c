"""Video games: sales by platform, genre and region; score tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import half_up
from ledgerline.operators.cleaning import canonicalize, normalize_columns
from ledgerline.operators.profile import box_stats, correlation, group_stats
from ledgerline.operators.relational import keep_matching, top_k
from ledgerline.operators.statistics import welch, welch_test

REGIONS = ["na_sales", "eu_sales", "jp_sales"]


def clean(games: DataFrame) -> DataFrame:
    named = canonicalize(normalize_columns(games), "user_score", {}, ["tbd"])
    total = F.col("na_sales") + F.col("eu_sales") + F.col("jp_sales") + F.col("other_sales")
    return named.withColumns(
        {
            "critic_score": F.col("critic_score").cast("bigint"),
            "user_score": F.col("user_score").cast("double"),
            "total_sales": total,
        }
    )


def _sales(column: str = "total_sales") -> Column:
    return half_up(F.sum(column), 2)


def releases_by_year(games: DataFrame) -> DataFrame:
    return (
        games.na.drop(subset=["year_of_release"])
        .groupBy("year_of_release")
        .agg(F.count("name").alias("games_cnt"))
    )


def sales_by(games: DataFrame, *by: str) -> DataFrame:
    return games.na.drop(subset=list(by)).groupBy(*by).agg(_sales().alias("total_sales"))


def top_platform_years(games: DataFrame, k: int = 6) -> DataFrame:
    """Yearly sales of the best-selling platforms, from one (year, platform) aggregate."""
    best = top_k(sales_by(games, "platform"), k, F.desc("total_sales"), F.asc("platform"))
    return keep_matching(sales_by(games, "year_of_release", "platform"), best, "platform")


def in_years(games: DataFrame, years: Sequence[int]) -> DataFrame:
    return games.filter(F.col("year_of_release").isin(list(years)))


def score_correlations(games: DataFrame) -> DataFrame:
    """Scores against sales for every platform in one pass."""
    return (
        games.na.drop(subset=["platform"])
        .groupBy("platform")
        .agg(
            correlation("user_score", "total_sales").alias("user_score_r"),
            correlation("critic_score", "total_sales").alias("critic_score_r"),
        )
    )


def region_leaders(games: DataFrame, dimension: str, k: int = 5) -> DataFrame:
    """Best values of a dimension per sales region; all regions from one aggregate."""
    sums = (
        games.na.drop(subset=[dimension]).groupBy(dimension).agg(*[_sales(r).alias(r) for r in REGIONS])
    )
    long = sums.unpivot([dimension], REGIONS, "region", "sales")
    place = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("sales"), F.asc(dimension)))
    return long.withColumn("place", place.cast("bigint")).filter(F.col("place") <= k)


def rating_sales(games: DataFrame) -> DataFrame:
    known = games.na.fill("No rating", ["rating"])
    return known.groupBy("rating").agg(*[_sales(r).alias(r) for r in REGIONS])


YEARS = (1998, 1999, 2000)


def _now(t) -> DataFrame:
    return in_years(clean(t.games), YEARS)


QUERIES = {
    "gam_clean": lambda t: clean(t.games),
    "gam_by_year": lambda t: releases_by_year(clean(t.games)),
    "gam_by_platform": lambda t: sales_by(clean(t.games), "platform"),
    "gam_by_platform_year": lambda t: sales_by(clean(t.games), "year_of_release", "platform"),
    "gam_top6_platforms": lambda t: top_platform_years(clean(t.games)),
    "gam_actual_period": lambda t: sales_by(_now(t), "platform"),
    "gam_actual_period_years": lambda t: sales_by(_now(t), "year_of_release", "platform"),
    "gam_boxplot": lambda t: box_stats(_now(t), "total_sales", ["platform"]),
    "gam_score_corr": lambda t: score_correlations(_now(t)),
    "gam_genre_stats": lambda t: group_stats(_now(t), "total_sales", ["genre"], total=True),
    "gam_region_platforms": lambda t: region_leaders(_now(t), "platform"),
    "gam_region_genres": lambda t: region_leaders(_now(t), "genre"),
    "gam_region_ratings": lambda t: rating_sales(_now(t)),
    "gam_welch_platforms": lambda t: welch(_now(t), "user_score", "platform", "P1", "P2"),
    "gam_welch_genres": lambda t: welch(_now(t), "user_score", "genre", "URGENT", "HIGH"),
    "gam_welch_p_values": lambda t: welch_test(_now(t), "user_score", "platform", "P1", "P2").select(
        "group_1", "group_2", *[half_up(c, 6).alias(c) for c in ("t", "dof", "p_value")], "rejected"
    ),
}
