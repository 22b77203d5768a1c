"""Delivery service: revenue, unit revenue and gross profit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ledgerline.functions.numbers import (
    cents,
    from_cents,
    growth_percent,
    half_up,
    percent,
    ratio,
)
from ledgerline.operators.relational import (
    drop_matching,
    first_day,
    join_back,
    join_days,
    keep_matching,
    previous,
    running_total,
    whole,
)
from ledgerline.plans.delivery import cancelled, delivered, newcomers, payers_per_day

# Goods taxed at the reduced rate.
REDUCED_RATE_GOODS = [
    "сахар", "сухарики", "сушки", "семечки", "масло льняное", "виноград", "масло оливковое",
    "арбуз", "батон", "йогурт", "сливки", "гречка", "овсянка", "макароны", "баранина", "апельсины",
    "бублики", "хлеб", "горох", "сметана", "рыба копченая", "мука", "шпроты", "сосиски", "свинина",
    "рис", "масло кунжутное", "сгущенка", "ананас", "говядина", "соль", "рыба вяленая",
    "масло подсолнечное", "яблоки", "груши", "лепешка", "молоко", "курица", "лаваш", "вафли", "мандарины",
]
OTHER_GOODS = "ДРУГОЕ"


@dataclass(frozen=True)
class MonthCosts:
    """Costs of one calendar month, in whole currency units."""

    warehouse_per_day: int
    assembly_per_order: int
    courier_bonus: int


# Cost model by calendar month; other months have no known costs.
COSTS_BY_MONTH = {8: MonthCosts(120_000, 140, 400), 9: MonthCosts(150_000, 115, 500)}
COURIER_FEE = 150
COURIER_BONUS_FROM = 5


def basket_lines(orders: DataFrame) -> DataFrame:
    """One row per product of an order with a ``product_ids`` array.

    Empty and null arrays give no row; a product listed twice gives two rows.
    """
    return orders.select("order_id", F.explode("product_ids").alias("product_id"))


def priced_orders(
    user_actions: DataFrame,
    orders: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    reduced_goods: Sequence[str] = (),
) -> DataFrame:
    """Order value and value-added tax in cents for every order that was not cancelled.

    Lines are summed to one row per order before they meet the orders, so an order with very
    many lines is combined on the map side and all later joins share the order_id partitioning.
    """
    tax = F.when(F.col("name").isin(list(reduced_goods)), F.col("price") / 110 * 10).otherwise(
        F.col("price") / 120 * 20
    )
    tariff = products.select(
        "product_id", cents("price").alias("price_cents"), cents(half_up(tax, 2)).alias("tax_cents")
    )
    values = (
        lines.join(tariff, "product_id")
        .groupBy("order_id")
        .agg(F.sum("price_cents").alias("order_cents"), F.sum("tax_cents").alias("tax_cents"))
    )
    kept = drop_matching(orders, cancelled(user_actions), "order_id")
    return kept.select("order_id", "creation_time").join(values, "order_id")


def revenue_days(priced: DataFrame) -> DataFrame:
    return priced.groupBy(F.to_date("creation_time").alias("date")).agg(
        F.sum("order_cents").alias("cents"),
        F.sum("tax_cents").alias("tax_cents"),
        F.count("*").alias("paid_orders"),
    )


def daily_revenue(priced: DataFrame) -> DataFrame:
    return revenue_days(priced).select(
        "date",
        from_cents("cents").alias("revenue"),
        from_cents(running_total("cents")).alias("total_revenue"),
        growth_percent("cents", previous("cents")).alias("revenue_change"),
    )


def _per(numerator: str, denominator: str) -> Column:
    return half_up(ratio(numerator, denominator) / 100, 2)


def arpu_arppu_aov(user_actions: DataFrame, priced: DataFrame) -> DataFrame:
    users = user_actions.groupBy(F.to_date("time").alias("date")).agg(
        F.countDistinct("user_id").alias("total_users")
    )
    days = join_days(revenue_days(priced), users, payers_per_day(user_actions))
    return days.select(
        "date",
        _per("cents", "total_users").alias("arpu"),
        _per("cents", "paying_users").alias("arppu"),
        _per("cents", "paid_orders").alias("aov"),
    )


def running_arpu(user_actions: DataFrame, priced: DataFrame) -> DataFrame:
    paid = drop_matching(user_actions, cancelled(user_actions), "order_id")
    days = join_days(
        revenue_days(priced),
        newcomers(user_actions, "user_id", "new_users", "_u"),
        newcomers(paid, "user_id", "new_payers", "_p"),
    )
    for c in ("cents", "new_users", "new_payers", "paid_orders"):
        days = days.withColumn(f"run_{c}", running_total(c))
    return days.select(
        "date",
        _per("run_cents", "run_new_users").alias("running_arpu"),
        _per("run_cents", "run_new_payers").alias("running_arppu"),
        _per("run_cents", "run_paid_orders").alias("running_aov"),
    )


def weekday_revenue(user_actions: DataFrame, priced: DataFrame, start: str, end: str) -> DataFrame:
    """ARPU, ARPPU and AOV by weekday over full weeks, both ends included."""

    def keys(time: str) -> list[Column]:
        return [
            F.date_format(time, "EEEE").alias("weekday"),
            F.extract(F.lit("DAYOFWEEK_ISO"), F.col(time)).cast("bigint").alias("weekday_number"),
        ]

    def inside(df: DataFrame, time: str) -> DataFrame:
        return df.filter(F.to_date(time).between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    money = inside(priced, "creation_time").groupBy(*keys("creation_time")).agg(
        F.sum("order_cents").alias("cents"), F.count("*").alias("paid_orders")
    )
    actions = inside(user_actions, "time")
    users = actions.groupBy(*keys("time")).agg(F.countDistinct("user_id").alias("total_users"))
    payers = (
        drop_matching(actions, cancelled(user_actions), "order_id")
        .groupBy(*keys("time"))
        .agg(F.countDistinct("user_id").alias("paying_users"))
    )
    on = ["weekday", "weekday_number"]
    return money.join(users, on).join(payers, on).select(
        *on,
        _per("cents", "total_users").alias("arpu"),
        _per("cents", "paying_users").alias("arppu"),
        _per("cents", "paid_orders").alias("aov"),
    )


def new_user_revenue(user_actions: DataFrame, priced: DataFrame) -> DataFrame:
    """Revenue of users' first days against the rest; summed to user-days before the join."""
    actions = user_actions.groupBy("order_id", "user_id", F.to_date("time").alias("date")).agg(
        F.count("*").alias("n")
    )
    user_days = (
        actions.join(priced.select("order_id", "order_cents"), "order_id", "left")
        .groupBy("user_id", "date")
        .agg(F.sum(F.col("n") * F.col("order_cents")).alias("cents"))
    )
    fresh = (
        join_back(user_days, first_day(user_actions, "user_id", out="date"), ["user_id", "date"], "inner")
        .groupBy("date")
        .agg(F.sum("cents").alias("new_cents"))
    )
    return revenue_days(priced).join(fresh, "date").select(
        "date",
        from_cents("cents").alias("revenue"),
        from_cents("new_cents").alias("new_users_revenue"),
        percent("new_cents", "cents").alias("new_users_revenue_share"),
        percent(F.col("cents") - F.col("new_cents"), "cents").alias("old_users_revenue_share"),
    )


def product_share(
    user_actions: DataFrame,
    orders: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    rare_below: float = 0.5,
    other: str = OTHER_GOODS,
) -> DataFrame:
    """Revenue by product name with rare products lumped into one row.

    Lines are counted per product before the product join, not per order: an order seldom holds a product
    twice, so a count of such pairs would keep all lines in memory.
    """
    kept = drop_matching(orders, cancelled(user_actions), "order_id")
    sold = keep_matching(lines, kept, "order_id").groupBy("product_id").agg(F.count("*").alias("n"))
    names = (
        sold.join(products, "product_id")
        .groupBy(F.col("name").alias("product_name"))
        .agg(F.sum(F.col("n") * cents("price")).alias("cents"))
    )
    share = percent("cents", whole(names, F.sum("cents")))
    lumped = names.withColumn("share", share).withColumn(
        "product_name", F.when(F.col("share") < rare_below, other).otherwise(F.col("product_name"))
    )
    return lumped.groupBy("product_name").agg(
        from_cents(F.sum("cents")).alias("revenue"),
        F.sum(F.col("share").cast(DecimalType(12, 2))).cast("double").alias("share_in_revenue"),
    )


def gross_profit(
    priced: DataFrame, courier_actions: DataFrame, costs: Mapping[int, MonthCosts] = COSTS_BY_MONTH
) -> DataFrame:
    """Revenue, costs, tax and gross profit per day with running totals and ratios.

    ``priced`` must carry tax by the reduced-rate list. Months without costs give null costs.
    """

    def by_month(pick, default=None) -> Column:
        month = F.month("date")
        result = F.lit(default).cast("bigint")
        for number, model in sorted(costs.items()):
            result = F.when(month == number, F.lit(pick(model)).cast("bigint")).otherwise(result)
        return result

    deliveries = (
        courier_actions.filter(F.col("action") == "deliver_order")
        .groupBy("courier_id", F.to_date("time").alias("date"))
        .agg(F.count("order_id").alias("n"))
    )
    bonus = F.when(F.col("n") >= COURIER_BONUS_FROM, by_month(lambda m: m.courier_bonus, 0)).otherwise(0)
    couriers = deliveries.groupBy("date").agg((F.sum(F.col("n") * COURIER_FEE + bonus)).alias("courier_pay"))
    fixed = by_month(lambda m: m.warehouse_per_day)
    assembly = F.col("paid_orders") * by_month(lambda m: m.assembly_per_order)
    days = (
        revenue_days(priced)
        .join(couriers, "date")
        .withColumn("cost_cents", (fixed + assembly + F.col("courier_pay")) * 100)
        .withColumn("gross_cents", F.col("cents") - (F.col("cost_cents") + F.col("tax_cents")))
    )
    names = {"cents": "revenue", "cost_cents": "costs", "tax_cents": "tax", "gross_cents": "gross_profit"}
    for c in names:
        days = days.withColumn(f"run_{c}", running_total(c))
    return days.select(
        "date",
        *[from_cents(c).alias(n) for c, n in names.items()],
        *[from_cents(f"run_{c}").alias(f"total_{n}") for c, n in names.items()],
        percent("gross_cents", "cents").alias("gross_profit_ratio"),
        percent("run_gross_cents", "run_cents").alias("total_gross_profit_ratio"),
    )


# Test-table settings: two full weeks of the event log, its only month, reduced-rate names.
WEEKS = ("2024-01-08", "2024-01-21")
JANUARY = {1: MonthCosts(120_000, 140, 400)}
REDUCED_TEST_GOODS = ["small ring", "red widget", "blue bolt", "red bolt", "small widget"]


def priced_e(t, reduced_goods: Sequence[str] = ()) -> DataFrame:
    return priced_orders(t.user_actions_e, t.delivery_orders_e, basket_lines(t.baskets), t.products, reduced_goods)


def priced_o(t, reduced_goods: Sequence[str] = ()) -> DataFrame:
    return priced_orders(t.user_actions_o, t.delivery_orders_o, basket_lines(t.baskets), t.products, reduced_goods)


QUERIES = {
    "eco_revenue": lambda t: daily_revenue(priced_e(t)),
    "eco_arpu_arppu_aov": lambda t: arpu_arppu_aov(t.user_actions_e, priced_e(t)),
    "eco_running_arpu": lambda t: running_arpu(t.user_actions_o, priced_o(t)),
    "eco_weekday": lambda t: weekday_revenue(t.user_actions_e, priced_e(t), *WEEKS),
    "eco_new_user_revenue": lambda t: new_user_revenue(t.user_actions_o, priced_o(t)),
    "eco_product_share": lambda t: product_share(
        t.user_actions_e, t.delivery_orders_e, basket_lines(t.baskets), t.products, rare_below=1.6
    ),
    "eco_gross_profit": lambda t: gross_profit(
        priced_e(t, REDUCED_TEST_GOODS), t.courier_actions_e, JANUARY
    ),
    "eco_gross_profit_by_month": lambda t: gross_profit(priced_o(t, REDUCED_TEST_GOODS), t.courier_actions_o),
}
