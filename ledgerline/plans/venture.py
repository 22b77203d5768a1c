"""Venture funding: companies, funds, rounds, deals and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import half_up, ratio
from ledgerline.operators.relational import in_years, keep_matching, top_k


def closed_count(company: DataFrame) -> DataFrame:
    return company.filter(F.col("status") == "closed").agg(F.count("id").alias("closed_companies"))


def funding_of(company: DataFrame, category: str, country: str) -> DataFrame:
    """Funding of one category and country, unknown amounts first, then largest first."""
    return (
        company.filter((F.col("category_code") == category) & (F.col("country_code") == country))
        .select("funding_total")
        .orderBy(F.col("funding_total").desc_nulls_first())
    )


def cash_deals(acquisition: DataFrame, first: int, last: int) -> DataFrame:
    return acquisition.filter((F.col("term_code") == "cash") & in_years("acquired_at", first, last)).agg(
        F.sum("price_amount").alias("total_sum")
    )


def handle_starts(people: DataFrame, prefix: str) -> DataFrame:
    return people.filter(F.col("twitter_username").startswith(prefix)).select(
        "first_name", "last_name", "twitter_username"
    )


def handle_contains(people: DataFrame, part: str, last_name_prefix: str) -> DataFrame:
    return people.filter(
        F.col("twitter_username").contains(part) & F.col("last_name").startswith(last_name_prefix)
    )


def funding_by_country(company: DataFrame) -> DataFrame:
    return company.groupBy("country_code").agg(F.sum("funding_total").alias("funding_total"))


def round_min_max(rounds: DataFrame) -> DataFrame:
    return (
        rounds.groupBy("funded_at")
        .agg(F.min("raised_amount").alias("min_amount"), F.max("raised_amount").alias("max_amount"))
        .filter((F.col("min_amount") != 0) & (F.col("min_amount") != F.col("max_amount")))
    )


def activity(invested: str = "invested_companies") -> Column:
    return (
        F.when(F.col(invested) >= 100, "high_activity")
        .when(F.col(invested) >= 20, "middle_activity")
        .otherwise("low_activity")
    )


def fund_activity(fund: DataFrame) -> DataFrame:
    return fund.withColumn("activity_category", activity())


def activity_rounds(fund: DataFrame) -> DataFrame:
    return fund.groupBy(activity().alias("activity_category")).agg(
        half_up(ratio(F.sum("investment_rounds"), F.count("investment_rounds"))).alias("avg_investment_rounds")
    )


def top_fund_countries(fund: DataFrame, first: int, last: int, k: int = 10) -> DataFrame:
    invested = "invested_companies"
    countries = (
        fund.filter(in_years("founded_at", first, last))
        .groupBy("country_code")
        .agg(
            F.min(invested).alias("min_invested_companies"),
            F.max(invested).alias("max_invested_companies"),
            ratio(F.sum(invested), F.count(invested)).alias("avg_invested_companies"),
        )
        .filter(F.col("min_invested_companies") != 0)
    )
    return top_k(countries, k, F.desc("avg_invested_companies"), F.asc("country_code"))


def people_education(people: DataFrame, education: DataFrame) -> DataFrame:
    schools = education.withColumnRenamed("person_id", "id")
    return people.join(schools, "id", "left").select("first_name", "last_name", "instituition")


def top_company_schools(company: DataFrame, people: DataFrame, education: DataFrame, k: int = 5) -> DataFrame:
    """Companies whose people attended most different schools; ties by name.

    Schools are made distinct per person, then per company name, before they are counted.
    """
    schools = education.select(F.col("person_id").alias("person"), "instituition").distinct()
    staff = people.select(F.col("id").alias("person"), "company_id")
    firms = company.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    pairs = firms.join(staff, "company_id", "left").join(schools, "person", "left")
    counts = (
        pairs.select("company_name", "instituition")
        .distinct()
        .groupBy("company_name")
        .agg(F.count("instituition").alias("instituition_count"))
    )
    return top_k(counts, k, F.desc("instituition_count"), F.asc("company_name"))


def single_round_closed(company: DataFrame, rounds: DataFrame) -> DataFrame:
    only = rounds.filter((F.col("is_first_round") == 1) & (F.col("is_last_round") == 1))
    closed = company.filter(F.col("status") == "closed")
    return (
        keep_matching(closed, only.select(F.col("company_id").alias("id")), "id")
        .select(F.col("name").alias("company_name"))
        .distinct()
    )


def staff_of_single_round(company: DataFrame, rounds: DataFrame, people: DataFrame) -> DataFrame:
    names = single_round_closed(company, rounds).withColumnRenamed("company_name", "name")
    firms = keep_matching(company, names, "name").select(F.col("id").alias("company_id"))
    return keep_matching(people, firms, "company_id").select(F.col("id").alias("employee_id")).distinct()


def staff_schools(staff: DataFrame, education: DataFrame) -> DataFrame:
    return staff.join(education.withColumnRenamed("person_id", "employee_id"), "employee_id")


def schools_per_person(staff: DataFrame, education: DataFrame) -> DataFrame:
    """Schools per employee; a school attended twice counts twice."""
    return (
        staff_schools(staff, education)
        .groupBy("employee_id")
        .agg(F.count("instituition").alias("instituitions"))
    )


def average_schools(per_person: DataFrame) -> DataFrame:
    return per_person.agg(ratio(F.sum("instituitions"), F.count("instituitions")).alias("avg_instituitions"))


def staff_of(company: DataFrame, people: DataFrame, name: str) -> DataFrame:
    firms = company.filter(F.col("name") == name).select(F.col("id").alias("company_id"))
    return keep_matching(people, firms, "company_id").select(F.col("id").alias("employee_id"))


def fund_company_round(
    investment: DataFrame, company: DataFrame, fund: DataFrame, rounds: DataFrame, years: tuple[int, int]
) -> DataFrame:
    firms = company.filter(F.col("milestones") > 6).select(
        F.col("id").alias("company_id"), F.col("name").alias("name_of_company")
    )
    funds = fund.select(F.col("id").alias("fund_id"), F.col("name").alias("name_of_fund"))
    dated = rounds.filter(in_years("funded_at", *years)).select(
        F.col("id").alias("funding_round_id"), F.col("raised_amount").alias("amount")
    )
    return (
        investment.join(firms, "company_id")
        .join(dated, "funding_round_id")
        .join(funds, "fund_id")
        .select("name_of_fund", "name_of_company", "amount")
    )


def acquisition_ratio(acquisition: DataFrame, company: DataFrame, k: int = 10) -> DataFrame:
    """Largest deals with buyer, target and price over funding. A buyer may be unknown.

    The top rows are picked before the buyer's name is looked up.
    """
    target = company.select(
        F.col("id").alias("acquired_company_id"), F.col("name").alias("acquired_company_name"), "funding_total"
    ).filter(F.col("funding_total") != 0)
    buyer = company.select(
        F.col("id").alias("acquiring_company_id"), F.col("name").alias("acquiring_company_name")
    )
    deals = acquisition.filter(F.col("price_amount") != 0).join(target, "acquired_company_id")
    best = top_k(
        deals, k, F.desc("price_amount"), F.asc("acquired_company_name"), F.asc("deal_id"), F.asc("deal_line")
    )
    return best.join(buyer, "acquiring_company_id", "left").select(
        "acquiring_company_name",
        "price_amount",
        "acquired_company_name",
        "funding_total",
        half_up(ratio("price_amount", "funding_total")).alias("ratio"),
    )


def category_round_months(company: DataFrame, rounds: DataFrame, category: str, years: tuple[int, int]) -> DataFrame:
    firms = company.filter(F.col("category_code") == category).select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name")
    )
    dated = rounds.filter(in_years("funded_at", *years) & (F.col("raised_amount") != 0))
    return dated.join(firms, "company_id").select(
        "company_name", F.month("funded_at").cast("bigint").alias("round_month")
    )


def month_funds_and_deals(
    acquisition: DataFrame,
    rounds: DataFrame,
    fund: DataFrame,
    investment: DataFrame,
    country: str,
    years: tuple[int, int],
) -> DataFrame:
    deals = (
        acquisition.filter(in_years("acquired_at", *years))
        .groupBy(F.month("acquired_at").cast("bigint").alias("month"))
        .agg(
            F.count("acquired_company_id").alias("acquired_companies"),
            F.sum("price_amount").alias("total_sum"),
        )
    )
    months = rounds.filter(in_years("funded_at", *years)).select(
        F.col("id").alias("funding_round_id"), F.month("funded_at").cast("bigint").alias("month")
    )
    names = fund.filter(F.col("country_code") == country).select(F.col("id").alias("fund_id"), "name")
    funds = (
        investment.join(names, "fund_id")
        .select("funding_round_id", "name")
        .distinct()
        .join(months, "funding_round_id")
        .groupBy("month")
        .agg(F.countDistinct("name").alias("unique_funds"))
    )
    return funds.join(deals, "month").select("month", "unique_funds", "acquired_companies", "total_sum")


def funding_of_years(company: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Mean funding per country, one column per founding year, countries present in all years.

    One conditional pass instead of one aggregate per year and joins between them.
    """
    founded = F.year("founded_at")
    in_range = in_years("founded_at", min(years), max(years))
    rows = company.filter(in_range & founded.isin(list(years))).groupBy(F.col("country_code").alias("country"))
    parts = []
    for y in years:
        amount = F.when(founded == y, F.col("funding_total"))
        parts += [
            ratio(F.sum(amount), F.count(amount)).alias(f"avg_funding_{y}"),
            F.count_if(founded == y).alias(f"_n{y}"),
        ]
    wide = rows.agg(*parts)
    for y in years:
        wide = wide.filter(F.col(f"_n{y}") > 0)
    return wide.select("country", *[f"avg_funding_{y}" for y in years])


DEAL_YEARS, ROUND_YEARS = (1998, 2000), (1996, 1997)


def _staff(t) -> DataFrame:
    return staff_of_single_round(t.company, t.funding_round, t.people)


QUERIES = {
    "inv_closed_count": lambda t: closed_count(t.company),
    "inv_news_usa_funding": lambda t: funding_of(t.company, "building", "NATION_3"),
    "inv_cash_deals_sum": lambda t: cash_deals(t.acquisition, *DEAL_YEARS),
    "inv_prefix_search": lambda t: handle_starts(t.people, "small"),
    "inv_infix_search": lambda t: handle_contains(t.people, "bolt", "b"),
    "inv_funding_by_country": lambda t: funding_by_country(t.company),
    "inv_round_minmax": lambda t: round_min_max(t.funding_round),
    "inv_fund_activity": lambda t: fund_activity(t.fund),
    "inv_activity_avg_rounds": lambda t: activity_rounds(t.fund),
    "inv_top_fund_countries": lambda t: top_fund_countries(t.fund, 2010, 2012),
    "inv_people_education": lambda t: people_education(t.people, t.education),
    "inv_top5_company_schools": lambda t: top_company_schools(t.company, t.people, t.education),
    "inv_single_round_closed": lambda t: single_round_closed(t.company, t.funding_round),
    "inv_their_people": lambda t: _staff(t),
    "inv_their_people_schools": lambda t: staff_schools(_staff(t), t.education).distinct(),
    "inv_schools_per_person": lambda t: schools_per_person(_staff(t), t.education),
    "inv_avg_schools": lambda t: average_schools(schools_per_person(_staff(t), t.education)),
    "inv_avg_schools_one_company": lambda t: average_schools(
        schools_per_person(staff_of(t.company, t.people, "Customer#000000007"), t.education)
    ),
    "inv_star_fund_company_round": lambda t: fund_company_round(
        t.investment, t.company, t.fund, t.funding_round, ROUND_YEARS
    ),
    "inv_acquisition_ratio": lambda t: acquisition_ratio(t.acquisition, t.company),
    "inv_social_round_months": lambda t: category_round_months(
        t.company, t.funding_round, "machinery", ROUND_YEARS
    ),
    "inv_month_funds_vs_deals": lambda t: month_funds_and_deals(
        t.acquisition, t.funding_round, t.fund, t.investment, "NATION_2", DEAL_YEARS
    ),
    "inv_avg_funding_3_years": lambda t: funding_of_years(t.company, (2011, 2012, 2013)),
}
