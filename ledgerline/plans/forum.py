"""Questions-and-answers site: posts, users, badges and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import growth_percent, half_up, ratio
from ledgerline.operators.ordered import row_numbers, running_sum
from ledgerline.operators.relational import (
    overlap_join,
    in_days,
    in_years,
    drop_matching,
    join_back,
    keep_matching,
    previous,
    running_total,
    top_k,
)


def _day(column: str) -> Column:
    return F.to_date(column)


def _between(column: Column, start: str, end: str) -> Column:
    return column.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def _of_type(posts: DataFrame, post_types: DataFrame, name: str) -> DataFrame:
    ids = post_types.filter(F.col("type") == name).select(F.col("id").alias("post_type_id"))
    return keep_matching(posts, ids, "post_type_id")


def popular_questions(posts: DataFrame, post_types: DataFrame) -> DataFrame:
    liked = (F.col("score") > 300) | (F.col("favorites_count") >= 100)
    return _of_type(posts.filter(liked), post_types, "Question").agg(F.count("id").alias("questions"))


def questions_per_day(posts: DataFrame, post_types: DataFrame, start: str, end: str) -> DataFrame:
    """Mean daily count of titled questions; days without any question are not counted."""
    days = (
        _of_type(posts.filter(_between(_day("creation_date"), start, end)), post_types, "Question")
        .groupBy(_day("creation_date"))
        .agg(F.count("title").alias("n"))
    )
    return days.agg(half_up(ratio(F.sum("n"), F.count("*"))).alias("questions_per_day"))


def badge_on_signup_day(users: DataFrame, badges: DataFrame) -> DataFrame:
    badge_days = badges.select(F.col("user_id").alias("id"), _day("creation_date").alias("day")).distinct()
    return keep_matching(
        users.select("id", _day("creation_date").alias("day")), badge_days, "id", "day"
    ).agg(F.countDistinct("id").alias("unique_users"))


def voted_posts_of(posts: DataFrame, votes: DataFrame, users: DataFrame, name: str) -> DataFrame:
    authors = users.filter(F.col("display_name") == name).select(F.col("id").alias("user_id"))
    voted = votes.select(F.col("post_id").alias("id"))
    return keep_matching(keep_matching(posts, authors, "user_id"), voted, "id").agg(
        F.countDistinct("id").alias("posts")
    )


def reverse_rank(table: DataFrame) -> DataFrame:
    return row_numbers(table, [F.col("id").desc()], "rank", unique=True)


def top_voters(votes: DataFrame, vote_types: DataFrame, name: str, k: int = 10) -> DataFrame:
    kind = vote_types.filter(F.col("name") == name).select(F.col("id").alias("vote_type_id"))
    counts = keep_matching(votes, kind, "vote_type_id").groupBy("user_id").agg(F.count("*").alias("close_votes"))
    return top_k(counts, k, F.desc("close_votes"), F.desc("user_id"))


def badge_rank(badges: DataFrame, start: str, end: str, k: int = 10) -> DataFrame:
    counts = (
        badges.filter(_between(_day("creation_date"), start, end))
        .groupBy("user_id")
        .agg(F.count("id").alias("badges"))
    )
    best = top_k(counts, k, F.desc("badges"), F.asc("user_id"))
    rank = F.dense_rank().over(Window.orderBy(F.desc("badges")))  # k rows
    return best.withColumn("rank", rank.cast("bigint"))


def average_score(posts: DataFrame) -> DataFrame:
    """Each scored, titled post beside its author's rounded mean score."""
    scored = posts.filter(F.col("title").isNotNull() & (F.col("score") != 0))
    means = scored.groupBy("user_id").agg(half_up(ratio(F.sum("score"), F.count("*"))).alias("avg_score"))
    return join_back(scored, means, ["user_id"]).select("title", "user_id", "score", "avg_score")


def titles_of_badge_leaders(posts: DataFrame, badges: DataFrame, more_than: int = 1000) -> DataFrame:
    leaders = (
        badges.groupBy("user_id").agg(F.count("name").alias("n")).filter(F.col("n") > more_than)
    )
    return keep_matching(posts.filter(F.col("title").isNotNull()), leaders, "user_id").select("title")


def view_groups(users: DataFrame, location: str) -> DataFrame:
    band = F.when(F.col("views") >= 350, 1).when(F.col("views") >= 100, 2).when(F.col("views") < 100, 3)
    return users.filter((F.col("views") != 0) & F.col("location").contains(location)).select(
        "id", "views", band.alias("group")
    )


def view_group_leaders(users: DataFrame, location: str) -> DataFrame:
    """Every user who reaches the largest view count of the band (ties stay)."""
    groups = view_groups(users, location)
    best = groups.groupBy("group").agg(F.max("views").alias("views"))
    return groups.join(F.broadcast(best), ["group", "views"]).select("id", "group", "views")  # three bands


def daily_signups(users: DataFrame, year: int, month: int) -> DataFrame:
    days = (
        users.filter(in_days("creation_date", f"{year}-{month:02d}-01", f"{year + month // 12}-{month % 12 + 1:02d}-01"))
        .groupBy(F.dayofmonth("creation_date").cast("bigint").alias("day"))
        .agg(F.count("id").alias("users"))
    )
    return days.withColumn("cum_sum", running_total("users", "day"))


def time_to_first_post(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Seconds from sign-up to the first post, one row per post at that first moment."""
    firsts = posts.groupBy("user_id").agg(F.min("creation_date").alias("creation_date"))
    signup = users.select(F.col("id").alias("user_id"), F.col("creation_date").alias("signup"))
    gap = F.unix_micros(F.col("creation_date").cast("timestamp")) - F.unix_micros(
        F.col("signup").cast("timestamp")
    )
    started = firsts.join(signup, "user_id").withColumn("seconds", gap.cast("double") / 1e6)
    return posts.select("user_id", "creation_date").join(started, ["user_id", "creation_date"]).select(
        "user_id", "seconds"
    )


def views_by_month(posts: DataFrame, year: int) -> DataFrame:
    return (
        posts.filter(in_years("creation_date", year, year))
        .groupBy(F.trunc("creation_date", "month").alias("month"))
        .agg(F.sum("views_count").alias("views"))
    )


def early_helpers(posts: DataFrame, users: DataFrame, post_types: DataFrame, more_than: int = 100) -> DataFrame:
    """Names with many answers within a month of sign-up, with the number of user ids behind each.

    The month is a calendar month, cut to the month's last day. The threshold applies to the
    name, not to the id, as several users may share one name.
    """
    people = users.select(
        F.col("id").alias("user_id"),
        "display_name",
        (F.col("creation_date") + F.make_ym_interval(F.lit(0), F.lit(1))).alias("until"),
    )
    answers = _of_type(posts, post_types, "Answer").select("user_id", "creation_date")
    # answers from before the sign-up count as well: a user's span starts with the log
    start = answers.agg(F.min("creation_date")).scalar()
    people = people.withColumn("since", F.least(start, "until"))
    per_user = (
        overlap_join(answers, people, ["user_id"], ("creation_date", "creation_date"), ("since", "until"), 30)
        .groupBy("display_name", "user_id")
        .agg(F.count("*").alias("answers"))
    )
    return (
        per_user.groupBy("display_name")
        .agg(F.sum("answers").alias("answers"), F.count("*").alias("user_ids"))
        .filter(F.col("answers") > more_than)
        .select("display_name", "user_ids")
    )


def cohort_posts_by_month(
    posts: DataFrame, users: DataFrame, signup: tuple[str, str], active: tuple[str, str]
) -> DataFrame:
    joined = users.filter(_between(_day("creation_date"), *signup)).select(F.col("id").alias("user_id"))
    busy = keep_matching(posts.filter(_between(_day("creation_date"), *active)), joined, "user_id")
    return (
        keep_matching(posts, busy, "user_id")
        .groupBy(F.trunc("creation_date", "month").alias("month"))
        .agg(F.count("id").alias("posts"))
    )


def cumulative_views(posts: DataFrame) -> DataFrame:
    columns = posts.select("user_id", "creation_date", "views_count")
    return running_sum(columns, ["user_id"], "creation_date", "views_count", "cum_sum")


def average_active_days(posts: DataFrame, start: str, end: str) -> DataFrame:
    days = (
        posts.filter(_between(_day("creation_date"), start, end))
        .select("user_id", _day("creation_date").alias("day"))
        .distinct()
    )
    per_user = days.groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.agg(half_up(ratio(F.sum("n"), F.count("*"))).alias("av_days"))


def monthly_change(posts: DataFrame, start: str, end: str) -> DataFrame:
    """Posts per month and change in percent.

    The end is a timestamp bound, so posts after midnight of the last day are outside.
    """
    bounds = F.col("creation_date").between(
        F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    )
    months = (
        posts.filter(bounds)
        .groupBy(F.month("creation_date").cast("bigint").alias("month_number"))
        .agg(F.count("id").alias("posts"))
    )
    return months.withColumn(
        "percent_changes", growth_percent("posts", previous("posts", "month_number"))
    )


def last_post_per_week(posts: DataFrame, start: str, end: str) -> DataFrame:
    """Last post of every ISO week by the most prolific author (smallest id on ties)."""
    author = top_k(
        posts.groupBy("user_id").agg(F.count("id").alias("n")), 1, F.desc("n"), F.asc("user_id")
    )
    return (
        keep_matching(posts.filter(_between(_day("creation_date"), start, end)), author, "user_id")
        .groupBy(F.weekofyear("creation_date").cast("bigint").alias("week"))
        .agg(F.max("creation_date").alias("last_post_week"))
    )


def never_badged(users: DataFrame, badges: DataFrame) -> DataFrame:
    return drop_matching(users, badges.select(F.col("user_id").alias("id")), "id").select("id")


QUERIES = {
    "so_popular_questions": lambda t: popular_questions(t.posts, t.post_types),
    "so_avg_questions_per_day": lambda t: questions_per_day(t.posts, t.post_types, "2024-01-01", "2024-01-18"),
    "so_badge_on_signup_day": lambda t: badge_on_signup_day(t.users, t.badges),
    "so_voted_posts_of_user": lambda t: voted_posts_of(t.posts, t.votes, t.users, "BUILDING 7"),
    "so_reverse_rank": lambda t: reverse_rank(t.vote_types),
    "so_reverse_rank_users": lambda t: reverse_rank(t.users.select("id", "location")),
    "so_top_close_voters": lambda t: top_voters(t.votes, t.vote_types, "Close"),
    "so_badge_rank": lambda t: badge_rank(t.badges, "2024-01-15", "2024-01-25"),
    "so_avg_score_per_user": lambda t: average_score(t.posts),
    "so_titles_of_badge_leaders": lambda t: titles_of_badge_leaders(t.posts, t.badges, 28),
    "so_view_groups": lambda t: view_groups(t.users, "NATION_2"),
    "so_view_group_leaders": lambda t: view_group_leaders(t.users, "NATION_2"),
    "so_daily_signups_cum": lambda t: daily_signups(t.users, 2024, 1),
    "so_time_to_first_post": lambda t: time_to_first_post(t.posts, t.users),
    "so_views_by_month": lambda t: views_by_month(t.posts_o, 1996),
    "so_early_helpers": lambda t: early_helpers(t.posts, t.users, t.post_types, 8),
    "so_cohort_posts_by_month": lambda t: cohort_posts_by_month(
        t.posts_o, t.users_o, ("1996-09-01", "1996-09-30"), ("1996-12-01", "1996-12-31")
    ),
    "so_cum_views_per_user": lambda t: cumulative_views(t.posts),
    "so_avg_active_days": lambda t: average_active_days(t.posts, "2024-01-01", "2024-01-07"),
    "so_monthly_change_pct": lambda t: monthly_change(t.posts_o, "1996-09-01", "1996-12-31"),
    "so_last_post_per_week": lambda t: last_post_per_week(t.posts, "2024-01-01", "2024-01-31"),
    "so_users_without_badge": lambda t: never_badged(t.users, t.badges),
}
