"""Delivery service: campaign cost, return, cheque and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import from_cents, half_up, percent, ratio
from ledgerline.plans.delivery import committed
from ledgerline.plans.economics import priced_e

BUDGET = 250_000  # fixed value: cost of each campaign


def campaign_payers(user_actions: DataFrame, campaigns: DataFrame) -> DataFrame:
    payers = committed(user_actions).select("user_id").distinct()
    return payers.join(campaigns, "user_id").groupBy("ads_campaign").agg(F.count("*").alias("users"))


def cac(user_actions: DataFrame, campaigns: DataFrame, budget: float = BUDGET) -> DataFrame:
    return campaign_payers(user_actions, campaigns).select(
        "ads_campaign", half_up(ratio(F.lit(budget), "users"), 2).alias("cac")
    )


def _spent_by_user(user_actions: DataFrame, priced: DataFrame) -> DataFrame:
    """One row per paying user: cents, priced orders. The campaign join then sees users only."""
    orders = committed(user_actions).groupBy("order_id", "user_id").agg(F.count("*").alias("n"))
    return (
        orders.join(priced.select("order_id", "order_cents"), "order_id", "left")
        .groupBy("user_id")
        .agg(
            F.sum(F.col("n") * F.col("order_cents")).alias("cents"),
            F.sum(F.when(F.col("order_cents").isNotNull(), F.col("n"))).alias("orders"),
        )
    )


def roi(user_actions: DataFrame, campaigns: DataFrame, priced: DataFrame, budget: float = BUDGET) -> DataFrame:
    """ROI as (revenue - cost) / cost, in percent."""
    revenue = (
        _spent_by_user(user_actions, priced)
        .join(campaigns, "user_id")
        .groupBy("ads_campaign")
        .agg(from_cents(F.sum("cents")).alias("revenue"))
    )
    return revenue.select("ads_campaign", percent(F.col("revenue") - budget, F.lit(budget)).alias("roi"))


def average_check(
    user_actions: DataFrame, campaigns: DataFrame, priced: DataFrame, start: str, end: str
) -> DataFrame:
    """Mean over users of their mean order value, orders created on the given days."""
    days = F.to_date("creation_time").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    users = _spent_by_user(user_actions, priced.filter(days)).filter(F.col("orders") > 0)
    return (
        users.withColumn("check", ratio("cents", "orders") / 100)
        .join(campaigns, "user_id")
        .groupBy("ads_campaign")
        .agg(half_up(F.avg("check"), 2).alias("avg_check"))
    )


def retention(user_actions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of each first-day cohort seen again on every later day."""
    by = list(by)
    seen = user_actions.select(*by, "user_id", F.to_date("time").alias("session_date")).distinct()
    profiles = seen.groupBy(*by, "user_id").agg(F.min("session_date").alias("cohort_date"))
    sizes = profiles.groupBy(*by, "cohort_date").agg(F.count("*").alias("cohort_size"))
    active = (
        seen.join(profiles, [*by, "user_id"])
        .groupBy(*by, "cohort_date", "session_date")
        .agg(F.count("*").alias("users"))
    )
    return active.join(sizes, [*by, "cohort_date"]).select(
        *by,
        F.col("cohort_date").alias("start_date"),
        F.datediff("session_date", "cohort_date").cast("bigint").alias("day_number"),
        half_up(ratio("users", "cohort_size"), 2).alias("retention"),
    )


def daily_retention(user_actions: DataFrame) -> DataFrame:
    return retention(user_actions).withColumn("start_month", F.trunc("start_date", "month"))


def campaign_retention(user_actions: DataFrame, campaigns: DataFrame, days=(0, 1, 7)) -> DataFrame:
    """Retention of campaign users on chosen days; the campaign joins distinct user-days."""
    user_days = user_actions.select("user_id", F.to_date("time").alias("time")).distinct()
    return retention(user_days.join(campaigns, "user_id"), ("ads_campaign",)).filter(
        F.col("day_number").isin(list(days))
    )


def cumulative_arppu(
    user_actions: DataFrame, campaigns: DataFrame, priced: DataFrame, start: str, budget: float = BUDGET
) -> DataFrame:
    """Running revenue per payer and campaign day against the cost per payer."""
    orders = user_actions.groupBy("order_id", "user_id", F.to_date("time").alias("date")).agg(
        F.count("*").alias("n")
    )
    user_days = (
        orders.join(priced.select("order_id", "order_cents"), "order_id")
        .groupBy("user_id", "date")
        .agg(F.sum(F.col("n") * F.col("order_cents")).alias("cents"))
    )
    revenue = (
        user_days.join(campaigns, "user_id").groupBy("ads_campaign", "date").agg(F.sum("cents").alias("cents"))
    )
    run = Window.partitionBy("ads_campaign").orderBy("date")  # one row per campaign and day
    return (
        revenue.withColumn("cents", F.sum("cents").over(run))
        .join(campaign_payers(user_actions, campaigns), "ads_campaign")
        .select(
            "ads_campaign",
            F.datediff("date", F.lit(start).cast("date")).cast("bigint").alias("day_number"),
            half_up(ratio("cents", "users") / 100, 2).alias("cumulative_arppu"),
            half_up(ratio(F.lit(budget), "users"), 2).alias("cac"),
        )
        .withColumn("day", F.concat(F.lit("Day "), F.col("day_number").cast("string")))
    )


def payback_day(curve: DataFrame) -> DataFrame:
    """First campaign day on which running revenue per payer covers the cost per payer."""
    return curve.groupBy("ads_campaign").agg(
        F.min(F.when(F.col("cumulative_arppu") >= F.col("cac"), F.col("day_number"))).alias("payback_day")
    )


START, WEEK1 = "2024-01-01", ("2024-01-01", "2024-01-07")

QUERIES = {
    "mkt_cac": lambda t: cac(t.user_actions_e, t.campaign_users),
    "mkt_roi": lambda t: roi(t.user_actions_e, t.campaign_users, priced_e(t)),
    "mkt_avg_check_week1": lambda t: average_check(t.user_actions_e, t.campaign_users, priced_e(t), *WEEK1),
    "mkt_retention_daily": lambda t: daily_retention(t.user_actions_e),
    "mkt_retention_yearly_cohorts": lambda t: daily_retention(t.user_actions_o),
    "mkt_retention_campaign": lambda t: campaign_retention(t.user_actions_e, t.campaign_users),
    "mkt_cum_arppu_vs_cac": lambda t: cumulative_arppu(t.user_actions_e, t.campaign_users, priced_e(t), START),
    "mkt_payback_day": lambda t: payback_day(
        cumulative_arppu(t.user_actions_e, t.campaign_users, priced_e(t), START)
    ),
}
