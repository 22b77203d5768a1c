"""Cleaning steps for dirty tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import percent
from ledgerline.functions.text import replace_whole
from ledgerline.operators.ordered import mode, modes, quantiles, row_numbers
from ledgerline.operators.profile import null_shares
from ledgerline.operators.relational import join_back, missing_members
from ledgerline.session import durable


def normalize_columns(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Strip byte-order marks and blanks, lower-case, then rename by ``mapping``."""
    plain = [c.lstrip("﻿").strip().lower() for c in df.columns]
    return df.toDF(*plain).withColumnsRenamed(dict(mapping or {}))


def prune_sparse(df: DataFrame, null_share: float = 0.9) -> DataFrame:
    """Drop columns whose share of nulls reaches the threshold (1.0 drops all-null columns)."""
    return df.drop(*[c for c, s in null_shares(df).items() if s >= null_share])


def dedupe(df: DataFrame) -> DataFrame:
    """Keep one of each set of fully equal rows; nulls equal each other."""
    return df.dropDuplicates()


def with_row_id(df: DataFrame, order: Sequence[str], out: str = "id") -> DataFrame:
    """Dense key from 0 in sort order, nulls last, duplicates kept."""
    return row_numbers(df, [F.col(c).asc_nulls_last() for c in order], out, start=0)


def canonicalize(
    df: DataFrame, column: str, variants: Mapping[str, Sequence[str]], null_values: Sequence[str] = ()
) -> DataFrame:
    """Whole-value synonyms to one spelling; placeholder texts become null."""
    mapping: dict[str, str | None] = {v: canon for canon, vs in variants.items() for v in vs}
    mapping.update({v: None for v in null_values})
    return df.withColumn(column, replace_whole(column, mapping))


def canonicalize_by_table(df: DataFrame, column: str, synonyms: DataFrame) -> DataFrame:
    """The same with (variant, canonical) rows kept in a table of any size."""
    mapping = synonyms.select(F.col("variant").alias(column), F.col("canonical").alias("_canonical"))
    return (
        df.join(mapping, column, "left")
        .withColumn(column, F.coalesce("_canonical", column))
        .select(df.columns)
    )


def impute_median(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Fill nulls with the exact median of the row's group."""
    medians = quantiles(df, column, {"_median": 0.5}, by).select(*by, "_median")
    return (
        join_back(df, medians, by)
        .withColumn(column, F.coalesce(F.col(column).cast("double"), "_median"))
        .select(df.columns)
    )


def null_analysis(df: DataFrame, column: str, by: Sequence[str], rows: str | None = None) -> DataFrame:
    """Per group with nulls: null and all rows, percent of nulls, mode and its percent of filled rows.

    ``rows`` names a column that says how many rows each row stands for.
    """
    groups = mode(df, column, by, "mode_value", rows)
    nulls = F.col("obs_cnt") - F.col("value_cnt")
    return groups.filter(nulls > 0).select(
        *by,
        nulls.alias("null_cnt"),
        "obs_cnt",
        percent(nulls, "obs_cnt", 1).alias("null_perc"),
        F.coalesce(percent("mode_cnt", "value_cnt", 1), F.lit(0.0)).alias("mode_perc"),
        "mode_value",
    )


def reconcile(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Totals of the diagnostic table beside those of the base table's groups with nulls; both pairs must agree.

    The base is read once: rows by group and value are counted and written down, and the diagnostic table and
    the base's totals are taken from these counts each in their own way.
    """
    counts = durable(df.groupBy(*by, column).agg(F.count("*").alias("_rows")))
    groups = counts.groupBy(*by).agg(
        F.sum("_rows").alias("n"), F.sum(F.when(F.col(column).isNull(), F.col("_rows")).otherwise(0)).alias("nulls")
    )
    analysis = null_analysis(counts, column, by, rows="_rows")
    return analysis.agg(F.sum("obs_cnt").alias("table_obs"), F.sum("null_cnt").alias("table_nulls")).select(
        "table_obs",
        "table_nulls",
        groups.filter("nulls > 0").agg(F.sum("n")).scalar().alias("base_obs"),
        groups.agg(F.sum("nulls")).scalar().alias("base_nulls"),
    )


@dataclass(frozen=True)
class ModeGate:
    """When a group's mode may fill nulls: its percent of filled rows, and the percent of nulls."""

    min_mode_percent: float = 60.0
    max_null_percent: float | None = None


def impute_modes(df: DataFrame, gates: Mapping[str, ModeGate], by: Sequence[str]) -> DataFrame:
    """Fill nulls of several columns with their group's mode where the gate allows it.

    The gate and the mode use the same key. All columns share one statistics pass and one join.
    """
    columns = list(gates)
    stats = modes(df, columns, by)
    nulls = F.col("obs_cnt") - F.col("value_cnt")
    fills = []
    for c, gate in gates.items():
        allowed = (F.col("column") == c) & (percent("mode_cnt", "value_cnt", 1) >= gate.min_mode_percent)
        if gate.max_null_percent is not None:
            allowed = allowed & (percent(nulls, "obs_cnt", 1) <= gate.max_null_percent)
        fills.append(F.max(F.when(allowed, F.col(f"best._v_{c}"))).alias(f"_fill_{c}"))
    wide = stats.filter(nulls > 0).groupBy(*by).agg(*fills)
    filled = {c: F.coalesce(F.col(c), F.col(f"_fill_{c}")) for c in columns}
    return join_back(df, wide, by).withColumns(filled).select(df.columns)


def impute_mode(
    df: DataFrame,
    column: str,
    by: Sequence[str],
    min_mode_percent: float = 60.0,
    max_null_percent: float | None = None,
) -> DataFrame:
    return impute_modes(df, {column: ModeGate(min_mode_percent, max_null_percent)}, by)


def reclassify(df: DataFrame, rules: DataFrame, member: str, column: str, measure: str) -> DataFrame:
    """New class by a rule table of any size; rows that fit no rule keep their class.

    ``rules`` has ``class, member, low, high, priority``. A rule fits its member's rows whose measure is at
    least ``low`` and below ``high``; a null limit is open, and a rule without limits fits any measure, also an
    unknown one. The rule with the least priority wins, then the first class by name. The rules of a member are
    one row before they meet the table, so no row is multiplied; Spark broadcasts them only if they are small.
    """
    rule = F.struct("priority", "class", "low", "high")
    listed = rules.filter(F.col("member").isNotNull()).groupBy(F.col("member").alias("_member"))
    listed = listed.agg(F.array_sort(F.collect_set(rule)).alias("_rules"))
    x = F.col(measure)

    def fits(r: Column) -> Column:
        above = r["low"].isNull() | F.coalesce(x >= r["low"], F.lit(False))
        return above & (r["high"].isNull() | F.coalesce(x < r["high"], F.lit(False)))

    best = F.try_element_at(F.filter("_rules", fits), F.lit(1))["class"]
    joined = df.join(listed, F.col(member) == F.col("_member"), "left")
    return joined.withColumn(column, F.coalesce(best, column)).select(df.columns)


def unknown_members(df: DataFrame, member: str, rules: DataFrame) -> DataFrame:
    """Listed members that the data never mentions: likely typing errors in the list."""
    return missing_members(rules.select(F.col("member").alias(member)), df, member)


def class_audit(before: DataFrame, after: DataFrame, member: str, column: str) -> DataFrame:
    """Rows per member and class before and after, from two aggregates and one join."""
    old = before.groupBy(member, F.col(column).alias("class_before")).agg(F.count("*").alias("cnt_before"))
    new = after.groupBy(member, F.col(column).alias("class_after")).agg(F.count("*").alias("cnt_after"))
    return old.join(new, member)


def fill_own_mode(df: DataFrame, column: str, member: str, members: Sequence[str]) -> DataFrame:
    """Nulls of the listed members become the member's most frequent value, the smallest one on ties."""
    listed = F.col(member).isin(*members)
    own = mode(df.filter(listed), column, [member], "_own").select(member, "_own")
    filled = F.coalesce(column, F.when(listed, F.col("_own")))
    return join_back(df, own, [member]).withColumn(column, filled).select(df.columns)


def set_own_mode(df: DataFrame, column: str, member: str, members: Sequence[str]) -> DataFrame:
    """All values of the listed members, right or wrong, become the member's most frequent one."""
    listed = F.col(member).isin(*members)
    own = mode(df.filter(listed), column, [member], "_own").select(member, "_own")
    real = F.when(listed, F.coalesce("_own", column)).otherwise(F.col(column))
    return join_back(df, own, [member]).withColumn(column, real).select(df.columns)


def assign_where(df: DataFrame, rules: Sequence[tuple[Column, Mapping[str, Column]]]) -> DataFrame:
    """Masked assignments to several columns; a rule's values and mask see the row as earlier rules left it."""
    for predicate, values in rules:
        df = df.withColumns({c: F.when(predicate, v).otherwise(F.col(c)) for c, v in values.items()})
    return df


def reset_where(df: DataFrame, column: str, rules: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Masked assignments one after the other; each rule sees the earlier results."""
    for predicate, value in rules:
        df = df.withColumn(column, F.when(predicate, value).otherwise(F.col(column)))
    return df
