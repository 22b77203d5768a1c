from ledgerline.oracle.engagement import _FIRST
from ledgerline.oracle.kit import cents, div, money, pct, rnd, using

_V = ("visits", "payments", "ad_costs")


def _people(h: int) -> str:
    return _FIRST + f""",
p AS (SELECT * FROM fv WHERE first_day <= DATE '2024-01-30' - {h - 1}),
vis AS (SELECT DISTINCT p.*, CAST(visited_at AS DATE) - first_day AS lifetime FROM visits JOIN p USING (user_id)
        WHERE CAST(visited_at AS DATE) - first_day BETWEEN 0 AND {h - 1}),
pay AS (SELECT p.*, CAST(paid_at AS DATE) - first_day AS lifetime, {cents('amount')} AS c FROM payments JOIN p USING (user_id)
        WHERE CAST(paid_at AS DATE) - first_day BETWEEN 0 AND {h - 1})"""


_P_COLUMNS = ("source", "device", "country")


def _vis(h: int) -> str:
    return _people(h).replace("SELECT DISTINCT p.*", "SELECT DISTINCT p.user_id, p.source, p.device, p.country")


def _curve(by: str, h: int) -> str:
    return using(*_V, rest=_vis(h) + f""",
        z AS (SELECT {by}, COUNT(*) AS cohort_size FROM p GROUP BY 1),
        a AS (SELECT {by}, lifetime, COUNT(*) AS active FROM vis GROUP BY 1, 2),
        m AS (SELECT {by}, lifetime, COUNT(*) AS o, SUM(c) AS c FROM pay GROUP BY 1, 2),
        dz AS (SELECT *, unnest(range({h})) AS lifetime FROM z),
        cv AS (SELECT dz.{by}, dz.lifetime, COALESCE(active, 0) AS active, cohort_size,
                      SUM(COALESCE(c, 0)) OVER w AS rc, SUM(COALESCE(o, 0)) OVER w AS ro
               FROM dz LEFT JOIN a ON a.{by} IS NOT DISTINCT FROM dz.{by} AND a.lifetime = dz.lifetime
               LEFT JOIN m ON m.{by} IS NOT DISTINCT FROM dz.{by} AND m.lifetime = dz.lifetime
               WINDOW w AS (PARTITION BY dz.{by} ORDER BY dz.lifetime))""")


def _curve_out(by: str) -> str:
    return f"""SELECT {by}, lifetime, cohort_size, {pct('active', 'cohort_size')} AS retention,
        {money('rc')} AS cumulative_revenue, {rnd(div('rc', 'cohort_size') + ' / 100', 2)} AS ltv,
        {rnd(div('rc', 'ro') + ' / 100', 2)} AS aov FROM cv"""


_UNIT = """,
u AS (SELECT user_id, p.source, p.device, p.country, CAST(cost_cents AS DOUBLE) / COUNT(*) OVER (PARTITION BY p.source, first_day) AS cost
      FROM p LEFT JOIN ad_costs k ON k.source = p.source AND k.day = p.first_day),
b AS (SELECT u.*, COALESCE(r.kept, 0) AS kept, COALESCE(m.c, 0) AS c, CASE WHEN m.c IS NULL THEN 0 ELSE 1 END AS payer
      FROM u LEFT JOIN (SELECT DISTINCT user_id, 1 AS kept FROM vis WHERE lifetime = 13) r USING (user_id)
      LEFT JOIN (SELECT user_id, SUM(c) AS c FROM pay GROUP BY 1) m USING (user_id))"""


def _unit(by: str) -> str:
    return f"""SELECT {by}, COUNT(*) AS users, {pct('SUM(kept)', 'COUNT(*)')} AS retention,
        {pct('SUM(payer)', 'COUNT(*)')} AS conversion, {rnd(div('SUM(c)', 'COUNT(*)') + ' / 100', 2)} AS ltv,
        {rnd(div('SUM(cost)', 'COUNT(*)') + ' / 100', 2)} AS cac, {pct('SUM(c)', 'SUM(cost)')} AS roi_ltv_cac_pct
        FROM b GROUP BY 1"""


_BASE = using(*_V, rest=_vis(14) + _UNIT)

SQL = {
    "cohort_rr_ltv_aov": _curve("country", 28) + _curve_out("country"),
    "cohort_rr_ltv_aov_by_device": _curve("device", 14) + _curve_out("device"),
    "unit_economics_channel": _BASE + _unit("source"),
    "unit_economics_device": _BASE + _unit("device"),
    "unit_economics_country": _BASE + _unit("country"),
    "loss_channels": _BASE.rstrip() + f""",
        e AS ({_unit('source')}),
        g AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source IS NOT DISTINCT FROM b.source
                                                AND roi_ltv_cac_pct < 100))
        SELECT COUNT(*) AS users, {pct('COUNT(*) - (SELECT COUNT(*) FROM g)', 'COUNT(*)')} AS loss_users_share,
               {pct('SUM(c)', 'SUM(cost)')} AS roi_all, (SELECT {pct('SUM(c)', 'SUM(cost)')} FROM g) AS roi_without FROM b""",
    "payback_day": _curve("source", 14).rstrip() + _UNIT + f""",
        e AS ({_unit('source')}), k AS ({_curve_out('source')})
        SELECT k.source, MIN(CASE WHEN k.ltv >= e.cac THEN lifetime END) AS payback_day FROM k JOIN e ON e.source IS NOT DISTINCT FROM k.source GROUP BY 1""",
}
