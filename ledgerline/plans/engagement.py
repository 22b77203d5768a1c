"""Visits: active users, channels, mail funnels, activity curves and topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import cents, from_cents, half_up, percent, ratio
from ledgerline.operators.ordered import row_numbers, sliding
from ledgerline.operators.relational import join_back, over_days, share_of_total, top_k
from ledgerline.session import durable


def user_days(visits: DataFrame, *by: str) -> DataFrame:
    """Distinct active days per user; weeks and months are derived from it, not from the visits."""
    return visits.select(*by, "user_id", F.to_date("visited_at").alias("day")).distinct()


def user_bitmaps(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, day, bucket, users``: each day's users as bitmaps over dense user numbers.

    A bitmap covers 32,768 numbers, so a day has one row for each that many users, and longer periods are
    unions of its rows.
    """
    numbers = row_numbers(days.select("user_id").filter("user_id is not null").distinct(), ["user_id"], "_number", unique=True)
    numbered = days.join(numbers, "user_id")
    return numbered.groupBy(*by, "day", F.bitmap_bucket_number("_number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("users")
    )


def active_users(visits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean daily, weekly and monthly active users and sticky factors, calendar periods.

    The visits are read once, as user-days; all periods are counted from one set of daily bitmaps.
    """
    daily = durable(user_bitmaps(durable(user_days(visits, *by)), by))

    def mean_users(period: Column, out: str) -> DataFrame:
        unions = daily.groupBy(*by, period.alias("p"), "bucket").agg(F.bitmap_or_agg("users").alias("users"))
        counts = unions.groupBy(*by, "p").agg(F.sum(F.bitmap_count("users")).alias("n"))
        return counts.groupBy(*by).agg(ratio(F.sum("n"), F.count("*")).alias(out))

    parts = [
        mean_users(F.col("day"), "dau"),
        mean_users(F.trunc("day", "week"), "wau"),
        mean_users(F.trunc("day", "month"), "mau"),
    ]
    if by:
        joined = join_back(join_back(parts[0], parts[1], by), parts[2], by)
    else:
        joined = parts[0].select("dau", parts[1].scalar().alias("wau"), parts[2].scalar().alias("mau"))
    return joined.select(
        *by,
        *[half_up(c, 2).alias(c) for c in ("dau", "wau", "mau")],
        percent("dau", "wau").alias("sticky_week"),
        percent("dau", "mau").alias("sticky_month"),
    )


def user_moving_sums(events: DataFrame, rows: int = 7) -> DataFrame:
    """Spending and number of events over each user's last ``rows`` events, on the raw log."""
    log = events.select("user_id", "ts", "event_id", cents("value").alias("cents"))
    sums = {"last_cents": F.sum("cents"), "last_events": F.count("cents")}
    return sliding(log, ["user_id"], ["ts", "event_id"], rows - 1, 0, sums).select("event_id", "user_id", *sums)


def first_visits(visits: DataFrame) -> DataFrame:
    """First visit per user; a bounded state per user, combined on the map side."""
    first = F.min_by(F.struct("source", "device", "country"), F.struct("visited_at", "visit_id"))
    return visits.groupBy("user_id").agg(F.to_date(F.min("visited_at")).alias("first_day"), first.alias("f")).select(
        "user_id", "first_day", "f.source", "f.device", "f.country"
    )


def first_touch_channels(visits: DataFrame, k: int = 10) -> DataFrame:
    counts = first_visits(visits).groupBy("source").agg(F.count("*").alias("first_visits"))
    shares = share_of_total(counts, "first_visits", "share")
    return top_k(shares, k, F.desc("first_visits"), F.asc("source"))


def channel_visits(visits: DataFrame) -> DataFrame:
    return share_of_total(visits.groupBy("source").agg(F.count("*").alias("visits")), "visits", "share")


def visits_per_day(visits: DataFrame) -> DataFrame:
    return visits.groupBy(F.to_date("visited_at").alias("date")).agg(F.count("*").alias("visits"))


def spikes(visits: DataFrame, more_than: int) -> DataFrame:
    return visits_per_day(visits).filter(F.col("visits") > more_than)


def moving_average(visits: DataFrame, days: int = 7) -> DataFrame:
    """Mean over the day and the days before it (rows of a day-grain table)."""
    window = over_days().rowsBetween(-(days - 1), 0)
    mean = ratio(F.sum("visits").over(window), F.count("*").over(window))
    return visits_per_day(visits).withColumn("moving_avg", half_up(mean, 2))


def channel_effectiveness(visits: DataFrame, at_least: int = 200) -> DataFrame:
    """First visits over all visits, channels with a minimum of visits."""
    every = visits.groupBy("source").agg(F.count("*").alias("visits")).filter(F.col("visits") >= at_least)
    first = first_visits(visits).groupBy("source").agg(F.count("*").alias("first_visits"))
    return every.join(first, "source", "left").select(
        "source",
        "visits",
        F.coalesce("first_visits", F.lit(0)).alias("first_visits"),
        percent(F.coalesce("first_visits", F.lit(0)), "visits").alias("effectiveness"),
    )


def engaged_users(visits: DataFrame, k: int = 10) -> DataFrame:
    per_source = visits.groupBy("user_id", "source").agg(F.count("*").alias("n"))
    users = per_source.groupBy("user_id").agg(F.count("*").alias("sources"), F.sum("n").alias("visits"))
    return top_k(users, k, F.desc("sources"), F.desc("visits"), F.asc("user_id"))


STAGES = ["sent", "opened", "clicked"]


def mail_funnel(emails: DataFrame) -> DataFrame:
    """Distinct (user, message) pairs per stage with conversion from the stage before."""
    pairs = emails.select("user_id", "message_id", "stage").distinct()
    row = pairs.agg(*[F.count_if(F.col("stage") == s).alias(s) for s in STAGES])
    return row.select(
        *STAGES,
        percent("opened", "sent").alias("open_rate"),
        percent("clicked", "opened").alias("click_rate"),
        percent("clicked", "sent").alias("click_through"),
    )


def campaign_romi(emails: DataFrame, cost_per_mail: float = 2.5) -> DataFrame:
    """Conversion and revenue over cost in percent, per campaign."""
    sums = emails.groupBy("campaign").agg(
        F.count_if(F.col("stage") == "sent").alias("sent"),
        F.count_if(F.col("stage") == "clicked").alias("paid"),
        F.sum(F.when(F.col("stage") == "clicked", cents("amount"))).alias("cents"),
    )
    cost = F.col("sent") * F.lit(cost_per_mail)
    return sums.select(
        "campaign",
        from_cents("cents").alias("revenue"),
        cost.alias("cost"),
        percent("paid", "sent").alias("conversion"),
        percent(from_cents("cents"), cost).alias("romi_pct"),
    )


def activity_per_minute(visits: DataFrame) -> DataFrame:
    return visits.groupBy(F.date_trunc("minute", "visited_at").cast("timestamp_ntz").alias("minute")).agg(
        F.count("*").alias("visits")
    )


def extreme_topics(visits: DataFrame, k: int = 3) -> DataFrame:
    """The least and the most shown sources."""
    counts = visits.groupBy("source").agg(F.count("*").alias("shows"))
    most = top_k(counts, k, F.desc("shows"), F.asc("source")).withColumn("kind", F.lit("most"))
    least = top_k(counts, k, F.asc("shows"), F.asc("source")).withColumn("kind", F.lit("least"))
    return most.unionByName(least)


def topics(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """Views per topic; a talk with several topics counts for each of them.

    Lines are counted per talk before topics multiply the rows.
    """
    seen = lines.groupBy("product_id").agg(F.count("*").alias("views"))
    tagged = parts.select("product_id", F.explode(F.split("name", " ")).alias("topic"))
    return (
        tagged.join(seen, "product_id")
        .groupBy("topic")
        .agg(F.count("*").alias("talks"), F.sum("views").alias("views"))
    )


def documents_by_language(documents: DataFrame) -> DataFrame:
    return documents.groupBy("lang").agg(
        F.count("*").alias("talks"), F.countDistinct("source").alias("speakers"), F.sum("n_chars").alias("chars")
    )


def talks_by_occupation(talks: DataFrame) -> DataFrame:
    """Talks, speakers and seconds per occupation; a speaker may name several, an unnamed one is unknown."""
    named = F.coalesce(F.split("occupation", r",\s*"), F.array(F.lit("unknown")))
    return (
        talks.select("speaker", "seconds", F.explode(F.array_distinct(named)).alias("occupation"))
        .groupBy("occupation")
        .agg(F.count("*").alias("talks"), F.countDistinct("speaker").alias("speakers"), F.sum("seconds").alias("seconds"))
    )


def top_speaker_per_language(documents: DataFrame) -> DataFrame:
    sums = documents.groupBy("lang", "source").agg(F.count("*").alias("talks"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("talks"), F.asc("source")))
    return sums.withColumn("place", place).filter(F.col("place") == 1).drop("place")


QUERIES = {
    "dau_wau_mau_sticky": lambda t: active_users(t.visits),
    "dau_wau_mau_by_device": lambda t: active_users(t.visits, ("device",)),
    "chan_first_touch": lambda t: first_touch_channels(t.visits),
    "chan_all": lambda t: channel_visits(t.visits),
    "chan_spikes": lambda t: spikes(t.visits, 335),
    "chan_effectiveness": lambda t: channel_effectiveness(t.visits),
    "visits_moving_avg": lambda t: moving_average(t.visits),
    "visits_user_moving_sum": lambda t: user_moving_sums(t.events),
    "top_engaged_users": lambda t: engaged_users(t.visits),
    "email_funnel": lambda t: mail_funnel(t.emails),
    "campaign_romi": lambda t: campaign_romi(t.emails),
    "zen_activity": lambda t: activity_per_minute(t.visits),
    "zen_topics": lambda t: extreme_topics(t.visits),
    "ted_topics": lambda t: topics(t.products, t.order_lines),
    "ted_by_language": lambda t: documents_by_language(t.documents),
    "ted_by_occupation": lambda t: talks_by_occupation(t.talks),
    "ted_top_speaker": lambda t: top_speaker_per_language(t.documents),
}
