"""Delivery service: audience, load and timing per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import growth_percent, half_up, percent, ratio
from ledgerline.operators.relational import (
    drop_matching,
    first_day,
    join_back,
    join_days,
    keep_matching,
    previous,
    running_total,
)


def cancelled(user_actions: DataFrame) -> DataFrame:
    return user_actions.filter(F.col("action") == "cancel_order").select("order_id")


def delivered(courier_actions: DataFrame) -> DataFrame:
    return courier_actions.filter(F.col("action") == "deliver_order").select("order_id")


def committed(user_actions: DataFrame) -> DataFrame:
    """Actions of orders that were never cancelled."""
    return drop_matching(user_actions, cancelled(user_actions), "order_id")


def newcomers(actions: DataFrame, who: str, new: str, total: str) -> DataFrame:
    """First-time actors per day and the running total of them."""
    per_day = first_day(actions, who, out="date").groupBy("date").agg(F.count(who).alias(new))
    return per_day.withColumn(total, running_total(new))


def audience(user_actions: DataFrame, courier_actions: DataFrame) -> DataFrame:
    return join_days(
        newcomers(user_actions, "user_id", "new_users", "total_users"),
        newcomers(courier_actions, "courier_id", "new_couriers", "total_couriers"),
    )


def audience_growth(user_actions: DataFrame, courier_actions: DataFrame) -> DataFrame:
    base = audience(user_actions, courier_actions)
    grown = {
        "new_users_change": "new_users",
        "new_couriers_change": "new_couriers",
        "total_users_growth": "total_users",
        "total_couriers_growth": "total_couriers",
    }
    return base.select("*", *[growth_percent(c, previous(c)).alias(out) for out, c in grown.items()])


def payers_per_day(user_actions: DataFrame) -> DataFrame:
    return (
        committed(user_actions)
        .groupBy(F.to_date("time").alias("date"))
        .agg(F.countDistinct("user_id").alias("paying_users"))
    )


def active_couriers_per_day(courier_actions: DataFrame) -> DataFrame:
    return (
        keep_matching(courier_actions, delivered(courier_actions), "order_id")
        .groupBy(F.to_date("time").alias("date"))
        .agg(F.countDistinct("courier_id").alias("active_couriers"))
    )


def paying_and_active_share(user_actions: DataFrame, courier_actions: DataFrame) -> DataFrame:
    days = join_days(
        payers_per_day(user_actions),
        active_couriers_per_day(courier_actions),
        newcomers(user_actions, "user_id", "new_users", "total_users"),
        newcomers(courier_actions, "courier_id", "new_couriers", "total_couriers"),
    )
    return days.select(
        "date",
        "paying_users",
        "active_couriers",
        percent("paying_users", "total_users").alias("paying_users_share"),
        percent("active_couriers", "total_couriers").alias("active_couriers_share"),
    )


def single_or_several(user_actions: DataFrame) -> DataFrame:
    """Share of the day's payers with one and with more orders, from one user-day table."""
    user_days = (
        committed(user_actions)
        .filter(F.col("user_id").isNotNull())
        .groupBy(F.to_date("time").alias("date"), "user_id")
        .agg(F.count("order_id").alias("orders"))
    )
    days = user_days.groupBy("date").agg(
        F.count("*").alias("payers"),
        F.count_if(F.col("orders") == 1).alias("single"),
        F.count_if(F.col("orders") > 1).alias("several"),
    )
    both = days.filter((F.col("single") > 0) & (F.col("several") > 0))
    return both.select(
        "date",
        percent("single", "payers").alias("single_order_users_share"),
        percent("several", "payers").alias("several_orders_users_share"),
    )


def first_orders(user_actions: DataFrame) -> DataFrame:
    """Orders, first orders and orders of users on their very first day, per day.

    Everything after the first aggregate works on user-days, so a user with very many
    orders weighs no more than one with few.
    """
    user_days = (
        committed(user_actions)
        .groupBy("user_id", F.to_date("time").alias("date"))
        .agg(F.count("order_id").alias("orders"))
    )
    total = user_days.groupBy("date").agg(F.sum("orders").alias("orders"))
    firsts = (
        user_days.groupBy("user_id")
        .agg(F.min("date").alias("date"))
        .groupBy("date")
        .agg(F.count("user_id").alias("first_orders"))
    )
    arrivals = first_day(user_actions, "user_id", out="date")
    fresh = (
        join_back(user_days, arrivals, ["user_id", "date"], "inner")
        .groupBy("date")
        .agg(F.sum("orders").alias("new_users_orders"))
    )
    return join_days(total, firsts, fresh).select(
        "*",
        percent("first_orders", "orders").alias("first_orders_share"),
        percent("new_users_orders", "orders").alias("new_users_orders_share"),
    )


def courier_load(user_actions: DataFrame, courier_actions: DataFrame, orders: DataFrame) -> DataFrame:
    kept = (
        drop_matching(orders, cancelled(user_actions), "order_id")
        .groupBy(F.to_date("creation_time").alias("date"))
        .agg(F.count("order_id").alias("kept_orders"))
    )
    days = join_days(payers_per_day(user_actions), active_couriers_per_day(courier_actions), kept)
    return days.select(
        "date",
        half_up(ratio("paying_users", "active_couriers"), 2).alias("users_per_courier"),
        half_up(ratio("kept_orders", "active_couriers"), 2).alias("orders_per_courier"),
    )


def minutes_to_deliver(user_actions: DataFrame, courier_actions: DataFrame) -> DataFrame:
    """Mean minutes between the delivery and the action before it, by delivery day.

    A window per courier and order holds the few actions of one order.
    """
    log = drop_matching(courier_actions, cancelled(user_actions), "order_id")
    earlier = F.lag("time").over(Window.partitionBy("courier_id", "order_id").orderBy("time"))
    steps = log.withColumn("accepted", earlier)
    spent = F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.col("accepted").cast("timestamp"))
    return (
        steps.filter(F.col("action") == "deliver_order")
        .groupBy(F.to_date("time").alias("date"))
        .agg(F.sum(spent).alias("micros"), F.count(spent).alias("n"))
        .select("date", half_up(ratio("micros", "n") / 60e6).cast("bigint").alias("minutes_to_deliver"))
    )


def cancel_rate_by_hour(user_actions: DataFrame, courier_actions: DataFrame, orders: DataFrame) -> DataFrame:
    hour = F.hour("creation_time").cast("bigint").alias("hour")
    done = (
        keep_matching(orders, delivered(courier_actions), "order_id")
        .groupBy(hour)
        .agg(F.count("order_id").alias("successful_orders"))
    )
    lost = (
        keep_matching(orders, cancelled(user_actions), "order_id")
        .groupBy(hour)
        .agg(F.count("order_id").alias("canceled_orders"))
    )
    both = F.col("successful_orders") + F.col("canceled_orders")
    return done.join(lost, "hour").withColumn(
        "cancel_rate", half_up(ratio("canceled_orders", both), 3)
    )


QUERIES = {
    "del_new_and_total": lambda t: audience(t.user_actions_o, t.courier_actions_o),
    "del_growth_pct": lambda t: audience_growth(t.user_actions_o, t.courier_actions_o),
    "del_paying_active_share": lambda t: paying_and_active_share(t.user_actions_o, t.courier_actions_o),
    "del_single_vs_several": lambda t: single_or_several(t.user_actions_e),
    "del_first_orders": lambda t: first_orders(t.user_actions_o),
    "del_load_per_courier": lambda t: courier_load(t.user_actions_e, t.courier_actions_e, t.delivery_orders_e),
    "del_minutes_to_deliver": lambda t: minutes_to_deliver(t.user_actions_e, t.courier_actions_e),
    "del_cancel_rate_by_hour": lambda t: cancel_rate_by_hour(
        t.user_actions_e, t.courier_actions_e, t.delivery_orders_e
    ),
}
