"""Cohort and unit economics: retention, lifetime value, cost per customer, return, payback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import cents, from_cents, half_up, percent, ratio
from ledgerline.operators.relational import join_back
from ledgerline.plans.engagement import first_visits, user_days
from ledgerline.sources.bucketed import bucketed


def mature(profiles: DataFrame, today: str, horizon: int) -> DataFrame:
    """Profiles old enough to have lived all ``horizon`` days by the observation day."""
    last = F.date_sub(F.lit(today).cast("date"), horizon - 1)
    return profiles.filter(F.col("first_day") <= last)


def _paid_days(payments: DataFrame) -> DataFrame:
    return payments.groupBy("user_id", F.to_date("paid_at").alias("day")).agg(
        F.count("*").alias("orders"), F.sum(cents("amount")).alias("cents")
    )


def _lifetime(days: DataFrame, profiles: DataFrame, horizon: int) -> DataFrame:
    """User-days of the profiles with their day of life, up to the horizon."""
    age = F.datediff("day", "first_day").cast("bigint")
    return (
        days.join(profiles, "user_id").withColumn("lifetime", age).filter(F.col("lifetime").between(0, horizon - 1))
    )


def bucketed_log(visits: DataFrame, payments: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Visits and payments in buckets of their user, reduced to what cohorts need of a user's day.

    A user's visits of a day become the first one, and the payments a count and a sum, so a user has a bounded
    number of rows for each day of the log.
    """
    day = F.to_date("visited_at")
    first = F.min(F.struct("visited_at", "visit_id", "source", "device", "country")).alias("f")
    visits = visits.groupBy("user_id", day.alias("day")).agg(first).select("user_id", "f.*")
    return bucketed(visits, "user_id", "visits", buckets), bucketed(_paid_days(payments), "user_id", "payments", buckets)


def cohort_curve_of_days(
    visits: DataFrame, paid: DataFrame, today: str, horizon: int, by: Sequence[str]
) -> DataFrame:
    """``cohort_curve`` over tables that lie in buckets of their user: no step shuffles by user."""
    return _curve_of(first_visits(visits), user_days(visits), paid, today, horizon, by)


def cohort_curve(
    profiles: DataFrame, visits: DataFrame, payments: DataFrame, today: str, horizon: int, by: Sequence[str]
) -> DataFrame:
    """Retention, running revenue, LTV and mean order value per group and day of life.

    Visits and payments are reduced to user-days before they meet the profiles. Every group has all days
    of life, also those without a visit or a payment; an unknown group is a group.
    """
    return _curve_of(profiles, user_days(visits), _paid_days(payments), today, horizon, by)


def _curve_of(
    profiles: DataFrame, active_days: DataFrame, paid_days: DataFrame, today: str, horizon: int, by: Sequence[str]
) -> DataFrame:
    by = list(by)
    people = mature(profiles, today, horizon).select("user_id", "first_day", *by)
    sizes = people.groupBy(*by).agg(F.count("*").alias("cohort_size"))
    active = _lifetime(active_days, people, horizon).groupBy(*by, "lifetime").agg(F.count("*").alias("active"))
    paid = _lifetime(paid_days, people, horizon).groupBy(*by, "lifetime").agg(
        F.sum("orders").alias("orders"), F.sum("cents").alias("cents")
    )
    run = Window.partitionBy(*by).orderBy("lifetime")  # at most ``horizon`` rows per group
    every = sizes.withColumn("lifetime", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(horizon - 1).cast("bigint"))))
    known = join_back(join_back(every, active, [*by, "lifetime"]), paid, [*by, "lifetime"])
    days = known.na.fill(0, ["active", "orders", "cents"]).withColumns(
        {"run_cents": F.sum("cents").over(run), "run_orders": F.sum("orders").over(run)}
    )
    return days.select(
        *by,
        "lifetime",
        "cohort_size",
        percent("active", "cohort_size").alias("retention"),
        from_cents("run_cents").alias("cumulative_revenue"),
        half_up(ratio("run_cents", "cohort_size") / 100, 2).alias("ltv"),
        half_up(ratio("run_cents", "run_orders") / 100, 2).alias("aov"),
    )


def _roi_ltv_cac(ltv: Column, cac: Column) -> Column:
    """Return as LTV over CAC; 100 is break-even."""
    return percent(ltv, cac)


def channel_sums(
    profiles: DataFrame,
    visits: DataFrame,
    payments: DataFrame,
    costs: DataFrame,
    today: str,
    horizon: int,
    by: Sequence[str],
) -> DataFrame:
    """Users, last-day actives, payers, revenue and cost per (source, …); the base of all ratios.

    Costs are known per source and day; each acquired user of the day carries an equal part.
    """
    keys = list(dict.fromkeys(["source", *by]))
    people = mature(profiles, today, horizon).select("user_id", "first_day", *keys)
    per_day = people.groupBy("source", "first_day").agg(F.count("*").alias("acquired"))
    day_costs = costs.select("source", F.col("day").alias("first_day"), "cost_cents")
    unit = join_back(per_day, day_costs, ["source", "first_day"]).select(
        "source", "first_day", ratio("cost_cents", "acquired").alias("unit_cents")
    )
    spent = (
        join_back(people.groupBy(*keys, "first_day").agg(F.count("*").alias("users")), unit, ["source", "first_day"])
        .groupBy(*keys)
        .agg(F.sum("users").alias("users"), F.sum(F.col("users") * F.col("unit_cents")).alias("cost_cents"))
    )
    last_day = (
        _lifetime(user_days(visits), people, horizon)
        .filter(F.col("lifetime") == horizon - 1)
        .groupBy(*keys)
        .agg(F.count("*").alias("retained"))
    )
    payers = (
        _lifetime(_paid_days(payments), people, horizon)
        .groupBy(*keys, "user_id")
        .agg(F.sum("cents").alias("cents"))
        .groupBy(*keys)
        .agg(F.count("*").alias("payers"), F.sum("cents").alias("cents"))
    )
    return join_back(join_back(spent, last_day, keys), payers, keys).na.fill(0, ["retained", "payers", "cents"])


def unit_economics(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Retention, conversion, LTV, CAC and ROI per group at the horizon."""
    names = ("users", "retained", "payers", "cents", "cost_cents")
    groups = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    ltv, cac = ratio("cents", "users") / 100, ratio("cost_cents", "users") / 100
    return groups.select(
        *by,
        "users",
        percent("retained", "users").alias("retention"),
        percent("payers", "users").alias("conversion"),
        half_up(ltv, 2).alias("ltv"),
        half_up(cac, 2).alias("cac"),
        _roi_ltv_cac(F.col("cents"), F.col("cost_cents")).alias("roi_ltv_cac_pct"),
    )


def loss_channels(sums: DataFrame) -> DataFrame:
    """Share of users from channels that do not break even, and the return without them.

    One pass: the channels' sums are marked, then summed with and without the marked ones. A channel
    without costs, or an unknown one, is no loss by itself.
    """
    names = ("users", "cents", "cost_cents")
    channels = sums.groupBy("source").agg(*[F.sum(c).alias(c) for c in names])
    kept = F.coalesce(_roi_ltv_cac(F.col("cents"), F.col("cost_cents")) >= 100, F.lit(True))
    totals = channels.withColumn("kept", kept).agg(
        *[F.sum(c).alias(c) for c in names], *[F.sum(F.when(F.col("kept"), F.col(c))).alias(f"kept_{c}") for c in names]
    )
    return totals.select(
        "users",
        percent(F.col("users") - F.coalesce("kept_users", F.lit(0)), "users").alias("loss_users_share"),
        _roi_ltv_cac(F.col("cents"), F.col("cost_cents")).alias("roi_all"),
        _roi_ltv_cac(F.col("kept_cents"), F.col("kept_cost_cents")).alias("roi_without"),
    )


def payback(curve: DataFrame, economics: DataFrame, by: Sequence[str]) -> DataFrame:
    """First day of life on which LTV covers CAC; null while it never does."""
    by = list(by)
    covered = F.when(F.col("ltv") >= F.col("cac"), F.col("lifetime"))
    return (
        join_back(curve.select(*by, "lifetime", "ltv"), economics.select(*by, "cac"), by)
        .groupBy(*by)
        .agg(F.min(covered).alias("payback_day"))
    )


TODAY, HORIZON = "2024-01-30", 14


def _curve(t, by: Sequence[str], horizon: int = HORIZON) -> DataFrame:
    return cohort_curve(first_visits(t.visits), t.visits, t.payments, TODAY, horizon, by)


def _sums(t, by: Sequence[str] = ()) -> DataFrame:
    return channel_sums(first_visits(t.visits), t.visits, t.payments, t.ad_costs, TODAY, HORIZON, by)


QUERIES = {
    "cohort_rr_ltv_aov": lambda t: cohort_curve_of_days(*bucketed_log(t.visits, t.payments), TODAY, 28, ["country"]),
    "cohort_rr_ltv_aov_by_device": lambda t: _curve(t, ["device"]),
    "unit_economics_channel": lambda t: unit_economics(_sums(t), ["source"]),
    "unit_economics_device": lambda t: unit_economics(_sums(t, ["device"]), ["device"]),
    "unit_economics_country": lambda t: unit_economics(_sums(t, ["country"]), ["country"]),
    "loss_channels": lambda t: loss_channels(_sums(t)),
    "payback_day": lambda t: payback(_curve(t, ["source"]), unit_economics(_sums(t), ["source"]), ["source"]),
}
