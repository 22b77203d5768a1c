"""A/B tests: funnel, z-test per step, group balance and overlap with promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import half_up, percent
from ledgerline.operators.relational import overlap_join, whole
from ledgerline.operators.statistics import funnel, funnel_z, with_normal_p

STEPS = ["signup", "view", "click", "purchase"]


def group_balance(experiment: DataFrame) -> DataFrame:
    """Users per group, their share, and how many of them are also in another group."""
    members = experiment.select("user_id", "grp").distinct()
    per_user = members.groupBy("user_id").agg(F.count("*").alias("n"), F.collect_set("grp").alias("groups"))
    counts = per_user.select(F.explode("groups").alias("grp"), "n").groupBy("grp").agg(
        F.count("*").alias("users"), F.count_if(F.col("n") > 1).alias("in_several")
    )
    return counts.withColumn("share", percent("users", whole(counts, F.sum("users"))))


def promo_overlap(experiment: DataFrame, promos: DataFrame) -> DataFrame:
    """Users whose test days overlap a promotion in their region.

    Users are counted per (region, first day, last day) first, so the join sees calendar days instead of
    users; strips of time are part of its key, so a region with most of the rows is spread.
    """
    stays = (
        experiment.groupBy("user_id", "region")
        .agg(F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))
        .groupBy("region", "first_day", "last_day")
        .agg(F.count("*").alias("users"))
    )
    offers = promos.select(
        "name", "start_dt", "finish_dt", F.explode(F.array_distinct(F.split("regions", r",\s*"))).alias("region")
    )
    return (
        overlap_join(stays, offers, ["region"], ("first_day", "last_day"), ("start_dt", "finish_dt"), 7)
        .groupBy("name", "start_dt", "finish_dt")
        .agg(F.sum("users").alias("users"), F.countDistinct("region").alias("regions"))
    )


def _funnel(t) -> DataFrame:
    return funnel(t.experiment, "user_id", "event_type", STEPS, "grp")


QUERIES = {
    "ab_funnel": _funnel,
    "ab_ztest": lambda t: funnel_z(_funnel(t), "grp", "A", "B"),
    "ab_ztest_p_values": lambda t: with_normal_p(funnel_z(_funnel(t), "grp", "A", "B", 12)).select(
        "step_number", "step", half_up("z", 6).alias("z"), half_up("p_value", 6).alias("p_value")
    ),
    "ab_group_balance": lambda t: group_balance(t.experiment),
    "ab_promo_overlap": lambda t: promo_overlap(t.experiment, t.promos),
}
