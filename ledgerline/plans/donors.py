"""Donations: segments, statuses, bursts, outliers and RFM; churn portrait of customers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import cents, from_cents, half_up, percent, ratio
from ledgerline.functions.text import band
from ledgerline.operators.ordered import rank_quantiles, row_numbers, value_ranks
from ledgerline.operators.profile import QUARTILES, fences
from ledgerline.operators.relational import keep_matching, share_of_total, top_k, whole
from ledgerline.operators.selection import column_quantiles
from ledgerline.session import durable

SUCCESS, FAILED = "success", "failed"


def segments(donations: DataFrame, since: str) -> DataFrame:
    """Donors by first activity (historical or new) and by whether they ever donated."""
    donors = donations.groupBy("donor_id").agg(
        F.to_date(F.min("donated_at")).alias("first_day"),
        F.some(F.col("status") == SUCCESS).alias("donated"),
    )
    kind = F.when(F.col("first_day") < F.lit(since).cast("date"), "historical").otherwise("new")
    reached = F.when(F.col("donated"), "donated").otherwise("never")
    return donors.groupBy(kind.alias("segment"), reached.alias("reached")).agg(F.count("*").alias("donors"))


def status_crosstab(donations: DataFrame, by: str, at_least: int = 100) -> DataFrame:
    """Statuses × group with the share of failures; groups below the minimum sample are left out."""
    wide = donations.groupBy(by).pivot("status", [SUCCESS, FAILED, "cancelled"]).count().na.fill(0)
    total = F.col(SUCCESS) + F.col(FAILED) + F.col("cancelled")
    return (
        wide.withColumn("total", total)
        .filter(F.col("total") >= at_least)
        .withColumn("failed_percent", percent(FAILED, "total"))
    )


def first_date_by_status(donations: DataFrame) -> DataFrame:
    return donations.groupBy("status").agg(F.min("donated_at").alias("first_at"), F.count("*").alias("cnt"))


def worst_burst(attempts: DataFrame, minutes: int = 7 * 60) -> DataFrame:
    """Donor and time with most failed attempts in the ``minutes`` from that minute on.

    Attempts are first counted per donor and minute, so a donor's rows are bounded by the calendar.
    """
    minute = F.date_trunc("minute", F.col("tried_at").cast("timestamp"))
    counts = attempts.filter(F.col("status") == FAILED).groupBy("donor_id", minute.alias("minute")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("donor_id").orderBy(F.unix_seconds("minute")).rangeBetween(0, 60 * minutes - 1)
    windows = counts.select(
        "donor_id", F.col("minute").cast("timestamp_ntz").alias("window_start"), F.sum("n").over(ahead).alias("failures")
    )
    return top_k(windows, 1, F.desc("failures"), F.asc("donor_id"), F.asc("window_start"))


def by_quarter(donations: DataFrame, since: str) -> DataFrame:
    """Count and money per quarter and donor segment, summed to donor-quarters before the join."""
    paid = donations.filter(F.col("status") == SUCCESS)
    sums = paid.groupBy("donor_id", F.trunc("donated_at", "quarter").alias("quarter")).agg(
        F.count("*").alias("n"), F.sum(cents("amount")).alias("c")
    )
    firsts = donations.groupBy("donor_id").agg(F.to_date(F.min("donated_at")).alias("first_day"))
    kind = F.when(F.col("first_day") < F.lit(since).cast("date"), "historical").otherwise("new")
    return (
        sums.join(firsts, "donor_id")
        .groupBy("quarter", kind.alias("segment"))
        .agg(F.sum("n").alias("donations"), from_cents(F.sum("c")).alias("money"))
    )


def outlier_money(donations: DataFrame) -> DataFrame:
    """Typical and outstanding donations: range, count and share of the money."""
    paid = donations.filter(F.col("status") == SUCCESS).select(cents("amount").alias("c"))
    ranks = value_ranks(paid, "c")
    limit = fences(rank_quantiles(ranks, "c", QUARTILES)).select("upper_bound").scalar()
    kind = F.when(F.col("c") <= limit, "typical").otherwise("outstanding")
    groups = ranks.groupBy(kind.alias("kind")).agg(
        F.sum("cnt").alias("donations"),
        F.sum(F.col("c") * F.col("cnt")).alias("c"),
        F.min("c").alias("lo"),
        F.max("c").alias("hi"),
    )
    return groups.select(
        "kind",
        "donations",
        from_cents("lo").alias("smallest"),
        from_cents("hi").alias("largest"),
        percent("donations", whole(groups, F.sum("donations"))).alias("count_share"),
        percent("c", whole(groups, F.sum("c"))).alias("money_share"),
    )


def rfm_scores(donations: DataFrame, today: str) -> DataFrame:
    """Recency, frequency and money scored 1..3 by the exact thirds of each measure.

    The donors are written once; the cut points of all three measures come from two passes over them. Equal
    values always get equal scores. 3 is best.
    """
    donors = (
        donations.filter(F.col("status") == SUCCESS)
        .groupBy("donor_id")
        .agg(
            F.datediff(F.lit(today).cast("date"), F.to_date(F.max("donated_at"))).cast("bigint").alias("recency"),
            F.count("*").alias("frequency"),
            F.sum(cents("amount")).alias("money_cents"),
        )
    )
    donors = durable(donors)
    thirds = column_quantiles(donors, ["recency", "frequency", "money_cents"], {"low": 1 / 3, "high": 2 / 3})

    def score(measure: str) -> Column:
        cut = thirds[measure].quantiles
        return F.when(F.col(measure) <= F.lit(cut["low"]), 1).when(F.col(measure) <= F.lit(cut["high"]), 2).otherwise(3)

    r, f, m = F.lit(4) - score("recency"), score("frequency"), score("money_cents")
    return donors.select(
        "donor_id", "recency", "frequency", "money_cents", F.concat(*[x.cast("string") for x in (r, f, m)]).alias("segment")
    )


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Donors, money, share of money and mean donation per segment."""
    groups = scores.groupBy("segment").agg(
        F.count("*").alias("donors"), F.sum("money_cents").alias("c"), F.sum("frequency").alias("n")
    )
    return groups.select(
        "segment",
        "donors",
        from_cents("c").alias("money"),
        percent("c", whole(groups, F.sum("c"))).alias("money_share"),
        half_up(ratio("c", "n") / 100, 2).alias("avg_check"),
    )


def export_rfm(scores: DataFrame, folder: str) -> None:
    """Three tables: scores, segment statistics and donor ids per segment."""
    write_tables(
        {"rfm": scores, "segments": rfm_segments(scores)}, folder
    )
    scores.select("segment", "donor_id").write.mode("overwrite").partitionBy("segment").parquet(f"{folder}/ids")


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    from ledgerline.sources.tables import export

    export(tables, folder)


def value_thirds(donations: DataFrame) -> DataFrame:
    """Donors in three equal buckets by money (NTILE), from distributed row numbers."""
    donors = donations.groupBy("donor_id").agg(F.sum(cents("amount")).alias("money_cents"))
    ranked = row_numbers(donors, [F.col("money_cents"), F.col("donor_id")], "place", unique=True)
    n = ranked.agg(F.count("*")).scalar()
    size, larger = F.floor(F.col("n") / 3), F.col("n") % 3
    border = larger * (size + 1)
    place = F.col("place") - 1
    bucket = F.when(place < border, F.floor(place / (size + 1))).otherwise(
        larger + F.floor((place - border) / F.greatest(size, F.lit(1)))
    )
    return ranked.withColumn("n", n).select("donor_id", (bucket + 1).cast("bigint").alias("third"))


# Bands of the number of orders, for the churn portrait.
ORDER_BANDS = [(5.0, "1-5"), (10.0, "6-10"), (15.0, "11-15")]


def churn_portrait(customers: DataFrame, orders: DataFrame, active_since: str) -> DataFrame:
    """Churned against retained customers by tariff and order band, shares inside each side."""
    used = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders"), F.max("o_orderdate").alias("last_at")
    )
    churned = F.when(F.to_date("last_at") < F.lit(active_since).cast("date"), "churned").otherwise("retained")
    rows = customers.join(used, "c_custkey").select(
        churned.alias("side"),
        F.col("c_mktsegment").alias("tariff"),
        band("orders", ORDER_BANDS, "16+").alias("orders_band"),
    )
    counts = rows.groupBy("side", "tariff", "orders_band").agg(F.count("*").alias("customers"))
    totals = counts.groupBy("side").agg(F.sum("customers").alias("_total"))
    return counts.join(totals, "side").withColumn("share", percent("customers", "_total")).drop("_total")


STAFF_BANDS = [(4.0, "1-4"), (15.0, "5-15")]
PARTNER_BANDS = [(10.0, "1-10"), (40.0, "11-40")]


def churn_features(companies: DataFrame, orders: DataFrame, counterparties: DataFrame, active_since: str) -> DataFrame:
    """Churned against retained companies by tariff, staff, orders and counterparties, one feature per row.

    Orders and pairs of partners become one row per company before they meet; shares are of each side.
    """
    used = orders.groupBy("company_id").agg(F.count("*").alias("orders"), F.max("ordered_at").alias("last_at"))
    partners = counterparties.distinct().groupBy("company_id").agg(F.count("counterparty_id").alias("partners"))
    churned = F.when(F.to_date("last_at") < F.lit(active_since).cast("date"), "churned").otherwise("retained")
    known = companies.join(used, "company_id").join(partners, "company_id", "left").na.fill(0, ["partners"])
    features = {
        "tariff": F.col("tariff"),
        "staff": band("staff", STAFF_BANDS, "16+"),
        "orders": band("orders", ORDER_BANDS, "16+"),
        "counterparties": band("partners", PARTNER_BANDS, "41+"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in features.items()])
    counts = (
        known.select(churned.alias("side"), F.explode(pairs).alias("p"))
        .groupBy("side", "p.feature", "p.value")
        .agg(F.count("*").alias("companies"))
    )
    of_side = Window.partitionBy("side", "feature")  # a few bands each
    return counts.withColumn("share", percent("companies", F.sum("companies").over(of_side)))


def churn_coverage(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """How many customers the portrait covers."""
    known = keep_matching(customers, orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return known.agg(F.count("*").alias("covered")).select(
        "covered",
        customers.agg(F.count("*")).scalar().alias("customers"),
        percent("covered", customers.agg(F.count("*")).scalar()).alias("coverage"),
    )


SINCE, TODAY, ACTIVE_SINCE = "1996-01-01", "2001-08-02", "2001-01-01"

QUERIES = {
    "don_segments": lambda t: segments(t.donations, SINCE),
    "don_status_by_region": lambda t: status_crosstab(t.donations, "region"),
    "don_status_by_campaign": lambda t: status_crosstab(t.donations, "campaign"),
    "don_first_date_by_status": lambda t: first_date_by_status(t.donations),
    "don_burst": lambda t: worst_burst(t.attempts),
    "don_by_period": lambda t: by_quarter(t.donations, SINCE),
    "don_outlier_money": lambda t: outlier_money(t.gifts),
    "don_region_share": lambda t: share_of_total(
        t.donations.groupBy("region").agg(F.count("*").alias("donations")), "donations", "share"
    ),
    "rfm_scores": lambda t: rfm_scores(t.donations, TODAY),
    "rfm_segments": lambda t: rfm_segments(rfm_scores(t.donations, TODAY)),
    "rfm_value_thirds": lambda t: value_thirds(t.donations),
    "churn_portrait": lambda t: churn_portrait(t.customer, t.orders, ACTIVE_SINCE),
    "churn_features": lambda t: churn_features(t.companies, t.company_orders, t.counterparties, ACTIVE_SINCE),
    "churn_coverage": lambda t: churn_coverage(t.customer, t.orders),
}
