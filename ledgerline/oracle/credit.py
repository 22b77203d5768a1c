from ledgerline.oracle.kit import big, pct, rnd, using

_CLEAN = """
mi AS (SELECT income_type, quantile_cont(total_income, 0.5) AS m FROM borrowers GROUP BY 1),
a AS (SELECT b.* EXCLUDE (days_employed, total_income), ABS(days_employed) AS days_employed,
             COALESCE(total_income, mi.m) AS total_income
      FROM borrowers b JOIN mi USING (income_type) WHERE children NOT IN (-1, 20)),
md AS (SELECT income_type, quantile_cont(days_employed, 0.5) AS m FROM a GROUP BY 1),
c AS (SELECT DISTINCT children, CAST(TRUNC(COALESCE(days_employed, md.m)) AS BIGINT) AS days_employed,
             LOWER(education) AS education, family_status, income_type, debt,
             CAST(TRUNC(total_income) AS BIGINT) AS total_income, purpose
      FROM a JOIN md USING (income_type)),
k AS (SELECT *, CASE WHEN total_income <= 30000 THEN 'E' WHEN total_income <= 50000 THEN 'D'
                     WHEN total_income <= 200000 THEN 'C' WHEN total_income <= 1000000 THEN 'B' ELSE 'A' END AS income_band,
             CASE WHEN purpose LIKE '%автомоб%' THEN 'операции с автомобилем'
                  WHEN purpose LIKE '%недвиж%' OR purpose LIKE '%жил%' THEN 'операции с недвижимостью'
                  WHEN purpose LIKE '%свадьб%' THEN 'проведение свадьбы'
                  WHEN purpose LIKE '%образов%' THEN 'получение образования' ELSE 'другое' END AS purpose_category
      FROM c)"""
_W = using("borrowers", rest=_CLEAN)


def _debt(column: str) -> str:
    return _W + f"""SELECT {column}, COUNT(debt) AS total, {big('SUM(debt)')} AS debtors,
        {pct('SUM(debt)', 'COUNT(debt)')} AS debt_percent FROM k GROUP BY 1"""


SQL = {
    "crd_duplicates": using("borrowers", rest="d AS (SELECT DISTINCT * FROM borrowers), "
                            "n AS (SELECT (SELECT COUNT(*) FROM borrowers) AS row_cnt, COUNT(*) AS distinct_rows FROM d)") + f"""
        SELECT row_cnt, distinct_rows, row_cnt - distinct_rows AS duplicate_rows,
               {pct('row_cnt - distinct_rows', 'row_cnt')} AS duplicate_percent FROM n""",
    "crd_clean": _W + "SELECT * FROM c",
    "crd_categories": _W + "SELECT total_income, income_band, purpose, purpose_category FROM k",
    "crd_debt_by_children": _debt("children"),
    "crd_debt_by_family": _debt("family_status"),
    "crd_debt_by_income": _debt("income_band"),
    "crd_debt_by_purpose": _debt("purpose_category"),
    "crd_income_by_debt": _W + f"""SELECT debt, COUNT(total_income) AS cnt,
        {rnd('quantile_cont(CAST(total_income AS DOUBLE), 0.5)', 2)} AS median_income FROM k GROUP BY 1""",
}
