from ledgerline.oracle.economics import _priced, _views
from ledgerline.oracle.kit import big, div, money, pct, rnd, using

_V = _views("e", "campaign_users")
_PAID = """
paid AS (SELECT * FROM user_actions_e
         WHERE order_id NOT IN (SELECT order_id FROM user_actions_e WHERE action = 'cancel_order')),
cu AS (SELECT ads_campaign, COUNT(DISTINCT user_id) AS n FROM paid JOIN campaign_users USING (user_id) GROUP BY 1)"""


def _retention(kind: str) -> str:
    return using(f"user_actions_{kind}", rest=f"""
        prof AS (SELECT user_id, MIN(CAST(time AS DATE)) AS c,
                        COUNT(*) OVER (PARTITION BY MIN(CAST(time AS DATE))) AS size
                 FROM user_actions_{kind} GROUP BY user_id),
        ses AS (SELECT DISTINCT user_id, CAST(time AS DATE) AS d FROM user_actions_{kind})""") + f"""
        SELECT CAST(date_trunc('month', c) AS DATE) AS start_month, c AS start_date, {big('d - c')} AS day_number,
               {rnd(div('COUNT(*)', 'size'), 2)} AS retention
        FROM prof JOIN ses USING (user_id) GROUP BY c, d, size"""


_CURVE = _PAID + """,
    r AS (SELECT ads_campaign, CAST(time AS DATE) AS date, SUM(c) AS c
          FROM user_actions_e JOIN campaign_users USING (user_id) JOIN op USING (order_id) GROUP BY 1, 2),
    k AS (SELECT ads_campaign, date, n, SUM(c) OVER (PARTITION BY ads_campaign ORDER BY date) AS c
          FROM r JOIN cu USING (ads_campaign))"""
_CURVE_COLS = f"""ads_campaign, {big("date - DATE '2024-01-01'")} AS day_number,
    {rnd(div('c', 'n') + ' / 100', 2)} AS cumulative_arppu, {rnd(div('250000', 'n'), 2)} AS cac"""

SQL = {
    "mkt_cac": using("user_actions_e", "campaign_users", rest=_PAID) + f"""
        SELECT ads_campaign, {rnd(div('250000', 'n'), 2)} AS cac FROM cu""",
    "mkt_roi": using(*_V, rest=_priced("e") + "," + _PAID) + f"""
        SELECT ads_campaign, {pct(money('SUM(c)') + ' - 250000', '250000')} AS roi
        FROM paid JOIN campaign_users USING (user_id) LEFT JOIN op USING (order_id) GROUP BY 1""",
    "mkt_avg_check_week1": using(*_V, rest=_priced("e") + "," + _PAID + f""",
        a AS (SELECT user_id, ads_campaign, {div('SUM(c)', 'COUNT(c)')} / 100 AS aov
              FROM paid JOIN campaign_users USING (user_id) LEFT JOIN op USING (order_id)
              WHERE CAST(creation_time AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-07' GROUP BY 1, 2)
        """) + f"""
        SELECT ads_campaign, {rnd('AVG(aov)', 2)} AS avg_check FROM a GROUP BY 1""",
    "mkt_retention_daily": _retention("e"),
    "mkt_retention_yearly_cohorts": _retention("o"),
    "mkt_retention_campaign": using("user_actions_e", "campaign_users", rest="""
        a AS (SELECT ads_campaign, user_id, CAST(time AS DATE) AS d FROM user_actions_e
              JOIN campaign_users USING (user_id)),
        p AS (SELECT ads_campaign, user_id, MIN(d) AS c FROM a GROUP BY 1, 2),
        z AS (SELECT ads_campaign, c, COUNT(*) AS size FROM p GROUP BY 1, 2)""") + f"""
        SELECT z.ads_campaign, z.c AS start_date, {big('d - z.c')} AS day_number,
               {rnd(div('COUNT(DISTINCT p.user_id)', 'size'), 2)} AS retention
        FROM p JOIN a ON a.user_id = p.user_id JOIN z ON z.ads_campaign = p.ads_campaign AND z.c = p.c
        WHERE d - z.c IN (0, 1, 7) GROUP BY z.ads_campaign, z.c, d, size""",
    "mkt_cum_arppu_vs_cac": using(*_V, rest=_priced("e") + "," + _CURVE) + f"""
        SELECT *, 'Day ' || CAST(day_number AS VARCHAR) AS day FROM (SELECT {_CURVE_COLS} FROM k)""",
    "mkt_payback_day": using(*_V, rest=_priced("e") + "," + _CURVE) + f"""
        SELECT ads_campaign, MIN(CASE WHEN cumulative_arppu >= cac THEN day_number END) AS payback_day
        FROM (SELECT {_CURVE_COLS} FROM k) GROUP BY 1""",
}
