"""Table profiling in as few passes as possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import half_up, percent, ratio
from ledgerline.operators.ordered import rank_quantiles, value_ranks
from ledgerline.operators.selection import column_quantiles


def long_form(df: DataFrame, columns: Sequence[str], kind: str, by: Sequence[str] = ()) -> DataFrame:
    """(column, value) rows of the chosen columns, all cast to one type."""
    cast = df.select(*by, *[F.col(f"`{c}`").cast(kind).alias(c) for c in columns])
    return cast.unpivot(list(by), list(columns), "column", "value")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Null count and percent per column from a single aggregate."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns],
    )
    return counts.unpivot(["_rows"], columns, "column", "null_cnt").select(
        "column", "null_cnt", percent("null_cnt", "_rows", digits).alias("null_percent")
    )


def null_shares(df: DataFrame) -> dict[str, float]:
    """Null share per column on the driver: one number per column, whatever the row count."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in df.columns]).first()
    return {c: row[i] or 0.0 for i, c in enumerate(df.columns)}


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null is a value of its own."""
    return df.groupBy(column).agg(F.count("*").alias("cnt"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values of every column, nulls included, ties by value.

    ``row_number <= k`` is limited inside every map task before the shuffle, so a column with
    very many different values does not gather in one task.
    """
    counts = long_form(df, columns, "string").groupBy("column", "value").agg(F.count("*").alias("cnt"))
    best = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc_nulls_first("value"))
    return (
        counts.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k)
        .select("column", "value", "cnt", F.col("place").cast("bigint").alias("place"))
    )


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled rows, different values, smallest and largest value per column (as text)."""
    counts = long_form(df, columns, "string").groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("row_cnt"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("filled_cnt"),
        F.count("value").alias("distinct_cnt"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows, different rows, exact duplicates and their share (nulls equal each other)."""
    distinct = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    return distinct.agg(F.sum("_n").alias("row_cnt"), F.count("*").alias("distinct_rows")).select(
        "row_cnt",
        "distinct_rows",
        (F.col("row_cnt") - F.col("distinct_rows")).alias("duplicate_rows"),
        percent(F.col("row_cnt") - F.col("distinct_rows"), "row_cnt").alias("duplicate_percent"),
    )


def before_after(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and different values per column before and after cleaning."""

    def one(df: DataFrame, tag: str) -> DataFrame:
        counts = long_form(df, columns, "string").groupBy("column", "value").agg(F.count("*").alias("n"))
        return counts.groupBy("column").agg(
            F.sum("n").alias(f"rows_{tag}"), F.count("value").alias(f"distinct_{tag}")
        )

    return one(before, "before").join(one(after, "after"), "column")


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _weighted(value: str = "value") -> dict[str, Column]:
    """Aggregates of all rows from (value, cnt) rows."""
    v, w = F.col(value).cast("double"), F.col("cnt")
    return {"cnt": F.sum(w), "sum": F.sum(v * w), "mean": F.sum(v * w) / F.sum(w)}


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def describe(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of numeric columns, in three passes over the rows.

    Nothing is sorted or written: see ``column_quantiles``. A column without values has no row.
    """
    known = {c: s for c, s in column_quantiles(df, columns, QUARTILES).items() if s.n}
    rows = [(c, s.n, s.least, s.most, s.total / s.n, *(s.quantiles[q] for q in QUARTILES)) for c, s in known.items()]
    basic = _rows(df, rows, f"column string, cnt long, min double, max double, mean double, {', '.join(f'{q} double' for q in QUARTILES)}")
    if not known:
        return basic.withColumn("std", F.lit(None).cast("double"))
    spread = [
        F.sqrt(F.sum(F.pow(F.col(c).cast("double") - F.lit(s.total / s.n), 2)) / F.nullif(F.lit(s.n - 1), F.lit(0))).alias(c)
        for c, s in known.items()
    ]
    std = df.agg(*spread).unpivot([], list(known), "column", "std")
    return basic.join(std, "column").select(
        "column", "cnt", "min", "max", *[half_up(c, digits).alias(c) for c in ("mean", "std", *QUARTILES)]
    )


def fences(quarts: DataFrame) -> DataFrame:
    spread = F.col("q3") - F.col("q1")
    return quarts.withColumns(
        {"lower_bound": F.col("q1") - 1.5 * spread, "upper_bound": F.col("q3") + 1.5 * spread}
    )


def iqr_report(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Mean, median, fences and share of values up to the upper fence, all columns in three passes.

    The share is taken of all values; outliers are the values above the fence. A column without values has
    no row.
    """
    known = {c: s for c, s in column_quantiles(df, columns, QUARTILES).items() if s.n}
    rows = [(c, s.n, s.total / s.n, *(s.quantiles[q] for q in QUARTILES)) for c, s in known.items()]
    limits = fences(_rows(df, rows, f"column string, cnt long, mean double, {', '.join(f'{q} double' for q in QUARTILES)}"))
    if not known:
        normal = _rows(df, [], "column string, normal_cnt long")
    else:
        top = {c: s.quantiles["q3"] + 1.5 * (s.quantiles["q3"] - s.quantiles["q1"]) for c, s in known.items()}
        counts = df.agg(*[F.count_if(F.col(c).cast("double") <= F.lit(top[c])).alias(c) for c in known])
        normal = counts.unpivot([], list(known), "column", "normal_cnt")
    return limits.join(normal, "column").select(
        "column",
        *[half_up(c, digits).alias(c) for c in ("mean", "median", "lower_bound", "upper_bound")],
        "normal_cnt",
        percent("normal_cnt", "cnt", 1).alias("normal_percent"),
    )


def box_stats(df: DataFrame, value: str, by: Sequence[str], digits: int = 4) -> DataFrame:
    """Quartiles, whisker ends and outlier count per group; null groups are dropped."""
    by = list(by)
    rows = df.na.drop(subset=[*by, value]).select(*by, F.col(value).cast("double").alias("value"))
    ranks = value_ranks(rows, "value", by)
    limits = fences(rank_quantiles(ranks, "value", QUARTILES, by)).drop("n")
    inside = F.col("value").between(F.col("lower_bound"), F.col("upper_bound"))
    return (
        ranks.join(limits, by)
        .groupBy(*by)
        .agg(
            F.sum("cnt").alias("cnt"),
            *[half_up(F.max(q), digits).alias(q) for q in QUARTILES],
            half_up(F.min(F.when(inside, F.col("value"))), digits).alias("whisker_low"),
            half_up(F.max(F.when(inside, F.col("value"))), digits).alias("whisker_high"),
            F.sum(F.when(~inside, F.col("cnt")).otherwise(0)).alias("outlier_cnt"),
        )
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width bins over [low, high]; the last bin includes its upper end."""
    v = F.col(value).cast("double")
    width = (high - low) / bins
    number = F.least(F.floor((v - low) / width) + 1, F.lit(bins)).cast("bigint")
    return (
        df.filter(v.between(low, high))
        .groupBy(number.alias("bin"))
        .agg(F.count("*").alias("cnt"))
        .withColumn("bin_start", F.lit(float(low)) + (F.col("bin") - 1) * width)
    )


def group_stats(df: DataFrame, value: str, by: Sequence[str], total: bool = False, digits: int = 4) -> DataFrame:
    """Count, mean, exact median (and sum) per group in one pass; null groups are dropped, as pivots do."""
    by = list(by)
    ranks = value_ranks(df.na.drop(subset=by), value, by)
    sums = _weighted(value)
    extra = [half_up(sums["sum"], digits).alias("sum")] if total else []
    basic = ranks.groupBy(*by).agg(
        sums["cnt"].alias("cnt"), half_up(sums["mean"], digits).alias("mean"), *extra
    )
    middle = rank_quantiles(ranks, value, {"median": 0.5}, by)
    return basic.join(middle.select(*by, half_up("median", digits).alias("median")), by)


def correlation(x: str, y: str, digits: int = 6) -> Column:
    """Pearson r over the rows where both values are known."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return half_up(
        F.corr(F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))), digits
    )


def share(condition: Column, digits: int = 2) -> Column:
    return half_up(ratio(F.count_if(condition), F.count("*")) * 100, digits)


