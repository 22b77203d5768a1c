from ledgerline.oracle.kit import big, cents, money, pct, rnd, using

_FIRST = """
fv AS (SELECT user_id, source, device, country, CAST(visited_at AS DATE) AS first_day
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY visited_at, visit_id) AS rn FROM visits)
       WHERE rn = 1)"""
_DAY = "CAST(visited_at AS DATE)"


def _active(by: str = "") -> str:
    g, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON TRUE")
    grp = f"GROUP BY {by}" if by else ""

    def part(period: str, name: str) -> str:
        return (f"(SELECT {g}AVG(n) AS {name} FROM (SELECT {g}{period} AS p, COUNT(DISTINCT user_id) AS n FROM visits "
                f"GROUP BY {g}p) {grp}) AS q_{name}")

    return using("visits") + f"""SELECT {g}{rnd('dau', 2)} AS dau, {rnd('wau', 2)} AS wau, {rnd('mau', 2)} AS mau,
        {pct('dau', 'wau')} AS sticky_week, {pct('dau', 'mau')} AS sticky_month
        FROM {part(_DAY, 'dau')} JOIN {part(f"date_trunc('week', visited_at)", 'wau')} {on}
        JOIN {part(f"date_trunc('month', visited_at)", 'mau')} {on}"""


SQL = {
    "dau_wau_mau_sticky": _active(),
    "dau_wau_mau_by_device": _active("device"),
    "chan_first_touch": using("visits", rest=_FIRST) + f"""
        SELECT source, n AS first_visits, {pct('n', 'SUM(n) OVER ()')} AS share
        FROM (SELECT source, COUNT(*) AS n FROM fv GROUP BY 1) ORDER BY n DESC, source LIMIT 10""",
    "chan_all": using("visits") + f"""SELECT source, n AS visits, {pct('n', 'SUM(n) OVER ()')} AS share
        FROM (SELECT source, COUNT(*) AS n FROM visits GROUP BY 1)""",
    "chan_spikes": using("visits") + f"SELECT {_DAY} AS date, COUNT(*) AS visits FROM visits GROUP BY 1 HAVING COUNT(*) > 335",
    "chan_effectiveness": using("visits", rest=_FIRST) + f"""
        SELECT source, visits, COALESCE(f, 0) AS first_visits, {pct('COALESCE(f, 0)', 'visits')} AS effectiveness
        FROM (SELECT source, COUNT(*) AS visits FROM visits GROUP BY 1 HAVING COUNT(*) >= 200)
        LEFT JOIN (SELECT source, COUNT(*) AS f FROM fv GROUP BY 1) USING (source)""",
    "visits_moving_avg": using("visits") + f"""SELECT date, visits,
        {rnd('AVG(visits) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 2)} AS moving_avg
        FROM (SELECT {_DAY} AS date, COUNT(*) AS visits FROM visits GROUP BY 1)""",
    "visits_user_moving_sum": f"""SELECT event_id, user_id, {big('SUM(c) OVER w')} AS last_cents, COUNT(c) OVER w AS last_events
        FROM (SELECT *, {cents('value')} AS c FROM events)
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "top_engaged_users": using("visits") + """SELECT user_id, COUNT(DISTINCT source) AS sources, COUNT(*) AS visits
        FROM visits GROUP BY 1 ORDER BY sources DESC, visits DESC, user_id LIMIT 10""",
    "email_funnel": using("emails", rest="""p AS (SELECT DISTINCT user_id, message_id, stage FROM emails),
        s AS (SELECT COUNT(CASE WHEN stage = 'sent' THEN 1 END) AS sent, COUNT(CASE WHEN stage = 'opened' THEN 1 END) AS opened,
                     COUNT(CASE WHEN stage = 'clicked' THEN 1 END) AS clicked FROM p)""") + f"""
        SELECT *, {pct('opened', 'sent')} AS open_rate, {pct('clicked', 'opened')} AS click_rate,
               {pct('clicked', 'sent')} AS click_through FROM s""",
    "campaign_romi": using("emails", rest=f"""
        s AS (SELECT campaign, COUNT(CASE WHEN stage = 'sent' THEN 1 END) AS sent,
                     COUNT(CASE WHEN stage = 'clicked' THEN 1 END) AS paid,
                     SUM(CASE WHEN stage = 'clicked' THEN {cents('amount')} END) AS c FROM emails GROUP BY 1)""") + f"""
        SELECT campaign, {money('c')} AS revenue, CAST(sent * 2.5 AS DOUBLE) AS cost, {pct('paid', 'sent')} AS conversion,
               {pct(money('c'), 'sent * 2.5')} AS romi_pct FROM s""",
    "zen_activity": using("visits") + "SELECT date_trunc('minute', visited_at) AS minute, COUNT(*) AS visits FROM visits GROUP BY 1",
    "zen_topics": using("visits", rest="c AS (SELECT source, COUNT(*) AS shows FROM visits GROUP BY 1)") + """
        SELECT * FROM (SELECT source, shows, 'most' AS kind FROM c ORDER BY shows DESC, source LIMIT 3)
        UNION ALL SELECT * FROM (SELECT source, shows, 'least' AS kind FROM c ORDER BY shows, source LIMIT 3)""",
    "ted_topics": using("products", "order_lines") + f"""SELECT topic, COUNT(*) AS talks, {big('SUM(views)')} AS views
        FROM (SELECT product_id, UNNEST(string_split(name, ' ')) AS topic FROM products)
        JOIN (SELECT product_id, COUNT(*) AS views FROM order_lines GROUP BY 1) USING (product_id) GROUP BY 1""",
    "ted_by_language": f"""SELECT lang, COUNT(*) AS talks, COUNT(DISTINCT source) AS speakers, {big('SUM(n_chars)')} AS chars
        FROM documents GROUP BY 1""",
    "ted_by_occupation": using("talks") + f"""
        SELECT TRIM(o) AS occupation, COUNT(*) AS talks, COUNT(DISTINCT speaker) AS speakers, {big('SUM(seconds)')} AS seconds
        FROM (SELECT *, UNNEST(string_split(COALESCE(occupation, 'unknown'), ',')) AS o FROM talks) GROUP BY 1""",
    "ted_top_speaker": """SELECT lang, source, talks FROM (SELECT lang, source, COUNT(*) AS talks,
        ROW_NUMBER() OVER (PARTITION BY lang ORDER BY COUNT(*) DESC, source) AS p FROM documents GROUP BY 1, 2) WHERE p = 1""",
}
