"""Borrowers: cleaning, categories and share of debtors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import half_up, percent
from ledgerline.functions.text import band, categorize
from ledgerline.operators.cleaning import dedupe, impute_median
from ledgerline.operators.ordered import quantiles
from ledgerline.operators.profile import duplicate_report

# Income bands and loan purposes.
INCOME_BANDS = [(30_000, "E"), (50_000, "D"), (200_000, "C"), (1_000_000, "B")]
PURPOSES = [
    (["автомоб"], "операции с автомобилем"),
    (["недвиж", "жил"], "операции с недвижимостью"),
    (["свадьб"], "проведение свадьбы"),
    (["образов"], "получение образования"),
]


def clean(borrowers: DataFrame) -> DataFrame:
    """Incomes by group median, days as positive numbers, impossible child counts out, no duplicates.

    Rows with an unknown number of children stay.
    """
    income = impute_median(borrowers, "total_income", ["income_type"])
    days = income.withColumn("days_employed", F.abs("days_employed"))
    possible = days.filter(~F.coalesce(F.col("children").isin(-1, 20), F.lit(False)))
    filled = impute_median(possible, "days_employed", ["income_type"])
    whole = filled.withColumns(
        {
            "total_income": F.col("total_income").cast("bigint"),
            "days_employed": F.col("days_employed").cast("bigint"),
            "education": F.lower("education"),
        }
    )
    return dedupe(whole)


def categorized(borrowers: DataFrame) -> DataFrame:
    return borrowers.withColumns(
        {
            "income_band": band("total_income", INCOME_BANDS, "A"),
            "purpose_category": categorize("purpose", PURPOSES, "другое"),
        }
    )


def debt_by(borrowers: DataFrame, column: str) -> DataFrame:
    return (
        borrowers.na.drop(subset=[column])
        .groupBy(column)
        .agg(F.count("debt").alias("total"), F.sum("debt").alias("debtors"))
        .withColumn("debt_percent", percent("debtors", "total"))
    )


def income_by_debt(borrowers: DataFrame) -> DataFrame:
    middle = quantiles(borrowers, "total_income", {"median": 0.5}, ["debt"])
    return middle.select("debt", F.col("n").alias("cnt"), half_up("median", 2).alias("median_income"))


def _ready(t) -> DataFrame:
    return categorized(clean(t.borrowers))


QUERIES = {
    "crd_duplicates": lambda t: duplicate_report(t.borrowers),
    "crd_clean": lambda t: clean(t.borrowers),
    "crd_categories": lambda t: _ready(t).select(
        "total_income", "income_band", "purpose", "purpose_category"
    ),
    "crd_debt_by_children": lambda t: debt_by(_ready(t), "children"),
    "crd_debt_by_family": lambda t: debt_by(_ready(t), "family_status"),
    "crd_debt_by_income": lambda t: debt_by(_ready(t), "income_band"),
    "crd_debt_by_purpose": lambda t: debt_by(_ready(t), "purpose_category"),
    "crd_income_by_debt": lambda t: income_by_debt(_ready(t)),
}
