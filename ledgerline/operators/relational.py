"""Set membership, first occurrence and day-grain helpers used by most queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_matching(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key occurs in ``keys`` (``IN (SELECT …)``).

    The key set is de-duplicated first, with a map-side combine, so a key repeated many
    times on the right never travels; the join reuses that partitioning.
    """
    return df.join(keys.select(*on).na.drop().distinct(), list(on), "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key does not occur in ``keys``.

    Null keys on the right are ignored. SQL ``NOT IN`` would return nothing as soon as one
    of them is null; and it drops left rows with a null key, as is done here.
    """
    left = df.na.drop(subset=list(on))
    return left.join(keys.select(*on).na.drop().distinct(), list(on), "left_anti")


def join_back(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group results to their rows; null keys form a group of their own, as in windows."""
    right = stats.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if i == 0 else on & same
    return df.join(right, on, how).drop(*[f"_k_{k}" for k in keys])


def missing_members(members: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Listed members that never occur in the table: the typo check for member lists."""
    return drop_matching(members.select(column).distinct(), table, column)


def in_days(column: str, start: str, end: str) -> Column:
    """From ``start`` up to, without, ``end``; unlike calendar functions, this reaches the scan."""
    return (F.col(column) >= F.lit(start).cast("date")) & (F.col(column) < F.lit(end).cast("date"))


def in_years(column: str, first: int, last: int) -> Column:
    return in_days(column, f"{first}-01-01", f"{last + 1}-01-01")


def first_day(df: DataFrame, who: str, time: str = "time", out: str = "first_day") -> DataFrame:
    """Day of the first action per actor. One aggregate instead of ROW_NUMBER() = 1."""
    return df.groupBy(who).agg(F.to_date(F.min(time)).alias(out))


def over_days(column: str = "date"):
    """Running frame over a table with one row per day; its size is bounded by the calendar."""
    return Window.orderBy(column)


def running_total(value: Column | str, column: str = "date") -> Column:
    return F.sum(value).over(over_days(column))


def previous(value: Column | str, column: str = "date") -> Column:
    return F.lag(value).over(over_days(column))


def join_days(first: DataFrame, *others: DataFrame, on: str = "date") -> DataFrame:
    """Inner join of per-day aggregates: days missing on any side drop out."""
    for other in others:
        first = first.join(other, on)
    return first


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    days: int,
) -> DataFrame:
    """Pairs with equal keys whose spans of time share a moment; both ends belong to a span.

    Time is cut into strips of ``days`` days, and a strip is part of the join key: a key with a large part of
    all rows is spread over its strips, and rows only meet where their spans pass. A pair that meets in several
    strips counts in the one where the later of its two spans starts. A moment is a span whose ends are the same
    column. Rows with a null key or end have no pairs; a span that ends before it starts has none either.
    """

    def strip(time: str) -> Column:
        return F.floor(F.unix_date(F.to_date(time)) / days)

    def spread(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        known = df.filter(F.col(span[0]) <= F.col(span[1]))
        if span[0] == span[1]:
            return known.withColumns({name: strip(span[0]), f"{name}_first": strip(span[0])})
        every = F.explode(F.sequence(strip(span[0]), strip(span[1])))
        return known.withColumn(f"{name}_first", strip(span[0])).withColumn(name, every)

    a = spread(left, left_span, "_strip_l")
    b = spread(right, right_span, "_strip_r").withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.col("_strip_l") == F.col("_strip_r")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    share = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    once = F.col("_strip_l") == F.greatest("_strip_l_first", "_strip_r_first")
    return a.join(b, on).filter(share & once).drop(
        "_strip_l", "_strip_r", "_strip_l_first", "_strip_r_first", *[f"_r_{k}" for k in keys]
    )


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Sort and limit; every call passes a unique last key so that ties are decided."""
    return df.orderBy(*order).limit(k)


def whole(df: DataFrame, value: Column) -> Column:
    """One-row aggregate of ``df`` as a scalar, without a cross join or a global window."""
    return df.agg(value).scalar()


def share_of_total(df: DataFrame, value: str, out: str, digits: int = 2) -> DataFrame:
    from ledgerline.functions.numbers import percent

    return df.withColumn(out, percent(value, whole(df, F.sum(value)), digits))


def rule_case(column: str, rules: list[tuple[Column, Column]]) -> Column:
    """Ordered overrides: every rule sees the value the earlier ones left behind.

    Rules are (predicate, new value) pairs over the same row; a predicate that must see an
    overwritten column is given a new ``withColumn`` step by the caller.
    """
    result = F.col(column)
    for predicate, value in rules:
        result = F.when(predicate, value).otherwise(result)
    return result
