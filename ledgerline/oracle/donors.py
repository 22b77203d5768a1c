from ledgerline.oracle.kit import cents, div, money, pct, rnd, using

_D = using("donations")
_KIND = "CASE WHEN first_day < DATE '1996-01-01' THEN 'historical' ELSE 'new' END"


def _cross(by: str) -> str:
    return _D + f"""SELECT {by}, COUNT(CASE WHEN status = 'success' THEN 1 END) AS success,
        COUNT(CASE WHEN status = 'failed' THEN 1 END) AS failed, COUNT(CASE WHEN status = 'cancelled' THEN 1 END) AS cancelled,
        COUNT(*) AS total, {pct("COUNT(CASE WHEN status = 'failed' THEN 1 END)", 'COUNT(*)')} AS failed_percent
        FROM donations GROUP BY 1 HAVING COUNT(*) >= 100"""


_RFM = f"""
d AS (SELECT donor_id, DATE '2001-08-02' - CAST(MAX(donated_at) AS DATE) AS recency, COUNT(*) AS frequency,
             CAST(SUM({cents('amount')}) AS BIGINT) AS money_cents FROM donations WHERE status = 'success' GROUP BY 1),
q AS (SELECT quantile_cont(CAST(recency AS DOUBLE), 1/3.0e0) AS r1, quantile_cont(CAST(recency AS DOUBLE), 2/3.0e0) AS r2,
             quantile_cont(CAST(frequency AS DOUBLE), 1/3.0e0) AS f1, quantile_cont(CAST(frequency AS DOUBLE), 2/3.0e0) AS f2,
             quantile_cont(CAST(money_cents AS DOUBLE), 1/3.0e0) AS m1, quantile_cont(CAST(money_cents AS DOUBLE), 2/3.0e0) AS m2 FROM d),
s AS (SELECT donor_id, recency, frequency, money_cents,
             (CASE WHEN recency <= r1 THEN '3' WHEN recency <= r2 THEN '2' ELSE '1' END)
             || (CASE WHEN frequency <= f1 THEN '1' WHEN frequency <= f2 THEN '2' ELSE '3' END)
             || (CASE WHEN money_cents <= m1 THEN '1' WHEN money_cents <= m2 THEN '2' ELSE '3' END) AS segment FROM d, q)"""

SQL = {
    "don_segments": _D + f"""SELECT {_KIND} AS segment, CASE WHEN ok THEN 'donated' ELSE 'never' END AS reached,
        COUNT(*) AS donors FROM (SELECT donor_id, CAST(MIN(donated_at) AS DATE) AS first_day, bool_or(status = 'success') AS ok
                                 FROM donations GROUP BY 1) GROUP BY 1, 2""",
    "don_status_by_region": _cross("region"),
    "don_status_by_campaign": _cross("campaign"),
    "don_first_date_by_status": _D + "SELECT status, MIN(donated_at) AS first_at, COUNT(*) AS cnt FROM donations GROUP BY 1",
    "don_burst": using("attempts", rest="""
        m AS (SELECT donor_id, date_trunc('minute', tried_at) AS window_start, COUNT(*) AS n FROM attempts
              WHERE status = 'failed' GROUP BY 1, 2)""") + """
        SELECT a.donor_id, a.window_start, CAST(SUM(b.n) AS BIGINT) AS failures FROM m a JOIN m b
          ON b.donor_id = a.donor_id AND b.window_start >= a.window_start AND b.window_start < a.window_start + INTERVAL 7 HOUR
        GROUP BY 1, 2 ORDER BY failures DESC, a.donor_id, a.window_start LIMIT 1""",
    "don_by_period": _D + f"""SELECT CAST(date_trunc('quarter', donated_at) AS DATE) AS quarter, {_KIND} AS segment,
        COUNT(*) AS donations, {money(f"SUM({cents('amount')})")} AS money
        FROM (SELECT *, CAST(MIN(donated_at) OVER (PARTITION BY donor_id) AS DATE) AS first_day FROM donations)
        WHERE status = 'success' GROUP BY 1, 2""",
    "don_outlier_money": using("gifts", rest=f"""
        p AS (SELECT {cents('amount')} AS c FROM gifts WHERE status = 'success'),
        q AS (SELECT quantile_cont(CAST(c AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(c AS DOUBLE), 0.75) AS q3 FROM p),
        g AS (SELECT CASE WHEN c <= q3 + 1.5 * (q3 - q1) THEN 'typical' ELSE 'outstanding' END AS kind, COUNT(*) AS n,
                     SUM(c) AS c, MIN(c) AS lo, MAX(c) AS hi FROM p, q GROUP BY 1)""") + f"""
        SELECT kind, n AS donations, {money('lo')} AS smallest, {money('hi')} AS largest,
               {pct('n', 'SUM(n) OVER ()')} AS count_share, {pct('c', 'SUM(c) OVER ()')} AS money_share FROM g""",
    "don_region_share": _D + f"""SELECT region, COUNT(*) AS donations, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS share
        FROM donations GROUP BY 1""",
    "rfm_scores": using("donations", rest=_RFM) + "SELECT * FROM s",
    "rfm_segments": using("donations", rest=_RFM) + f"""SELECT segment, COUNT(*) AS donors, {money('SUM(money_cents)')} AS money,
        {pct('SUM(money_cents)', 'SUM(SUM(money_cents)) OVER ()')} AS money_share,
        {rnd(div('SUM(money_cents)', 'SUM(frequency)') + ' / 100', 2)} AS avg_check FROM s GROUP BY 1""",
    "rfm_value_thirds": _D + f"""SELECT donor_id, NTILE(3) OVER (ORDER BY c, donor_id) AS third
        FROM (SELECT donor_id, SUM({cents('amount')}) AS c FROM donations GROUP BY 1)""",
    "churn_portrait": f"""SELECT side, tariff, orders_band, COUNT(*) AS customers,
        {pct('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY side)')} AS share
        FROM (SELECT CASE WHEN MAX(o_orderdate) < DATE '2001-01-01' THEN 'churned' ELSE 'retained' END AS side,
                     c_mktsegment AS tariff, CASE WHEN COUNT(*) <= 5 THEN '1-5' WHEN COUNT(*) <= 10 THEN '6-10'
                     WHEN COUNT(*) <= 15 THEN '11-15' ELSE '16+' END AS orders_band
              FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment) GROUP BY 1, 2, 3""",
    "churn_features": using("companies", "company_orders", "counterparties", rest="""
        u AS (SELECT company_id, COUNT(*) AS n, MAX(ordered_at) AS last_at FROM company_orders GROUP BY 1),
        k AS (SELECT company_id, COUNT(DISTINCT counterparty_id) AS m FROM counterparties GROUP BY 1),
        c AS (SELECT CASE WHEN last_at < DATE '2001-01-01' THEN 'churned' ELSE 'retained' END AS side, tariff,
                     CASE WHEN staff < 5 THEN '1-4' WHEN staff < 16 THEN '5-15' ELSE '16+' END AS staff,
                     CASE WHEN n < 6 THEN '1-5' WHEN n < 11 THEN '6-10' WHEN n < 16 THEN '11-15' ELSE '16+' END AS orders,
                     CASE WHEN COALESCE(m, 0) < 11 THEN '1-10' WHEN m < 41 THEN '11-40' ELSE '41+' END AS counterparties
              FROM companies JOIN u USING (company_id) LEFT JOIN k USING (company_id)),
        f AS (UNPIVOT c ON tariff, staff, orders, counterparties INTO NAME feature VALUE value)""") + f"""
        SELECT side, feature, value, COUNT(*) AS companies,
               {pct('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY side, feature)')} AS share FROM f GROUP BY 1, 2, 3""",
    "churn_coverage": f"""SELECT covered, customers, {pct('covered', 'customers')} AS coverage FROM
        (SELECT (SELECT COUNT(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS covered,
                (SELECT COUNT(*) FROM customer) AS customers)""",
}
