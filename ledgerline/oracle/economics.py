from ledgerline.oracle.kit import big, cents, div, growth, money, pct, rnd, using


_LINES = "lines AS (SELECT order_id, UNNEST(product_ids) AS product_id FROM baskets)"


def _priced(kind: str) -> str:
    return f"""
{_LINES},
op AS (SELECT o.order_id, o.creation_time, SUM({cents('p.price')}) AS c
       FROM delivery_orders_{kind} o JOIN lines l ON l.order_id = o.order_id
       JOIN products p ON p.product_id = l.product_id
       WHERE o.order_id NOT IN (SELECT order_id FROM user_actions_{kind} WHERE action = 'cancel_order')
       GROUP BY 1, 2),
rev AS (SELECT CAST(creation_time AS DATE) AS date, SUM(c) AS c, COUNT(*) AS paid_orders FROM op GROUP BY 1)"""


def _views(kind: str, *more: str) -> tuple[str, ...]:
    return (f"user_actions_{kind}", f"delivery_orders_{kind}", "baskets", "products", *more)


def _gross(kind: str, months: dict[int, tuple[int, int, int]]) -> str:
    def pick(i, default):
        return "CASE EXTRACT(MONTH FROM date) " + " ".join(
            f"WHEN {m} THEN {v[i]}" for m, v in months.items()) + f" ELSE {default} END"

    reduced = "'small ring', 'red widget', 'blue bolt', 'red bolt', 'small widget'"
    vat = (f"CASE WHEN p.name IN ({reduced}) THEN {cents(rnd('p.price / 110 * 10', 2))} "
           f"ELSE {cents(rnd('p.price / 120 * 20', 2))} END")
    return using(*_views(kind, f"courier_actions_{kind}"), rest=_priced(kind) + f""",
        tax AS (SELECT CAST(o.creation_time AS DATE) AS date, SUM({vat}) AS tax
                FROM delivery_orders_{kind} o JOIN lines l ON l.order_id = o.order_id
                JOIN products p ON p.product_id = l.product_id
                WHERE o.order_id NOT IN (SELECT order_id FROM user_actions_{kind} WHERE action = 'cancel_order')
                GROUP BY 1),
        cd AS (SELECT courier_id, CAST(time AS DATE) AS date, COUNT(*) AS n FROM courier_actions_{kind}
               WHERE action = 'deliver_order' GROUP BY 1, 2),
        cp AS (SELECT date, SUM(n * 150 + CASE WHEN n >= 5 THEN {pick(2, 0)} ELSE 0 END) AS pay FROM cd GROUP BY date),
        d AS (SELECT date, c, tax, (({pick(0, 'NULL')}) + paid_orders * ({pick(1, 'NULL')}) + pay) * 100 AS cost
              FROM rev JOIN cp USING (date) JOIN tax USING (date)),
        g AS (SELECT *, c - (cost + tax) AS gp FROM d),
        r AS (SELECT *, SUM(c) OVER w AS rc, SUM(cost) OVER w AS rcost, SUM(tax) OVER w AS rtax, SUM(gp) OVER w AS rgp
              FROM g WINDOW w AS (ORDER BY date))""") + f"""
        SELECT date, {money('c')} AS revenue, {money('cost')} AS costs, {money('tax')} AS tax,
               {money('gp')} AS gross_profit, {money('rc')} AS total_revenue, {money('rcost')} AS total_costs,
               {money('rtax')} AS total_tax, {money('rgp')} AS total_gross_profit,
               {pct('gp', 'c')} AS gross_profit_ratio, {pct('rgp', 'rc')} AS total_gross_profit_ratio
        FROM r"""


def _per(a: str, b: str) -> str:
    return rnd(div(a, b) + " / 100", 2)


_WEEK = "BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'"

SQL = {
    "eco_revenue": using(*_views("e"), rest=_priced("e")) + f"""
        SELECT date, {money('c')} AS revenue, {money('SUM(c) OVER (ORDER BY date)')} AS total_revenue,
               {growth('c', 'LAG(c) OVER (ORDER BY date)')} AS revenue_change FROM rev""",
    "eco_arpu_arppu_aov": using(*_views("e"), rest=_priced("e") + """,
        tu AS (SELECT CAST(time AS DATE) AS date, COUNT(DISTINCT user_id) AS u FROM user_actions_e GROUP BY 1),
        pu AS (SELECT CAST(time AS DATE) AS date, COUNT(DISTINCT user_id) AS p FROM user_actions_e
               WHERE order_id NOT IN (SELECT order_id FROM user_actions_e WHERE action = 'cancel_order') GROUP BY 1)
        """) + f"""
        SELECT date, {_per('c', 'u')} AS arpu, {_per('c', 'p')} AS arppu, {_per('c', 'paid_orders')} AS aov
        FROM rev JOIN tu USING (date) JOIN pu USING (date)""",
    "eco_running_arpu": using(*_views("o"), rest=_priced("o") + """,
        nu AS (SELECT d AS date, COUNT(*) AS nu FROM (SELECT CAST(MIN(time) AS DATE) AS d FROM user_actions_o
               GROUP BY user_id) GROUP BY d),
        np AS (SELECT d AS date, COUNT(*) AS np FROM (SELECT CAST(MIN(time) AS DATE) AS d FROM user_actions_o
               WHERE order_id NOT IN (SELECT order_id FROM user_actions_o WHERE action = 'cancel_order')
               GROUP BY user_id) GROUP BY d)""") + f"""
        SELECT date, {_per('SUM(c) OVER w', 'SUM(nu) OVER w')} AS running_arpu,
               {_per('SUM(c) OVER w', 'SUM(np) OVER w')} AS running_arppu,
               {_per('SUM(c) OVER w', 'SUM(paid_orders) OVER w')} AS running_aov
        FROM rev JOIN nu USING (date) JOIN np USING (date) WINDOW w AS (ORDER BY date)""",
    "eco_weekday": using(*_views("e"), rest=_priced("e") + f""",
        r AS (SELECT dayname(creation_time) AS weekday, SUM(c) AS c, COUNT(*) AS n,
                     MIN(isodow(creation_time)) AS weekday_number
              FROM op WHERE CAST(creation_time AS DATE) {_WEEK} GROUP BY 1),
        tu AS (SELECT dayname(time) AS weekday, COUNT(DISTINCT user_id) AS u FROM user_actions_e
               WHERE CAST(time AS DATE) {_WEEK} GROUP BY 1),
        pu AS (SELECT dayname(time) AS weekday, COUNT(DISTINCT user_id) AS p FROM user_actions_e
               WHERE order_id NOT IN (SELECT order_id FROM user_actions_e WHERE action = 'cancel_order')
                 AND CAST(time AS DATE) {_WEEK} GROUP BY 1)""") + f"""
        SELECT weekday, {big('weekday_number')} AS weekday_number, {_per('c', 'u')} AS arpu,
               {_per('c', 'p')} AS arppu, {_per('c', 'n')} AS aov
        FROM r JOIN tu USING (weekday) JOIN pu USING (weekday)""",
    "eco_new_user_revenue": using(*_views("o"), rest=_priced("o") + """,
        t AS (SELECT ua.user_id, CAST(ua.time AS DATE) AS date, op.c,
                     MIN(CAST(ua.time AS DATE)) OVER (PARTITION BY ua.user_id) AS first_day
              FROM user_actions_o ua LEFT JOIN op ON op.order_id = ua.order_id),
        n AS (SELECT date, SUM(c) AS nc FROM t WHERE date = first_day GROUP BY date)""") + f"""
        SELECT date, {money('c')} AS revenue, {money('nc')} AS new_users_revenue,
               {pct('nc', 'c')} AS new_users_revenue_share, {pct('c - nc', 'c')} AS old_users_revenue_share
        FROM n JOIN rev USING (date)""",
    "eco_product_share": using(*_views("e"), rest=f"""{_LINES},
        a AS (SELECT p.name, SUM({cents('p.price')}) AS c
              FROM delivery_orders_e o JOIN lines l ON l.order_id = o.order_id
              JOIN products p ON p.product_id = l.product_id
              WHERE o.order_id NOT IN (SELECT order_id FROM user_actions_e WHERE action = 'cancel_order') GROUP BY 1),
        s AS (SELECT name, c, {pct('c', 'SUM(c) OVER ()')} AS s FROM a)""") + f"""
        SELECT CASE WHEN s < 1.6 THEN 'ДРУГОЕ' ELSE name END AS product_name, {money('SUM(c)')} AS revenue,
               CAST(SUM(CAST(s AS DECIMAL(12, 2))) AS DOUBLE) AS share_in_revenue
        FROM s GROUP BY 1""",
    "eco_gross_profit": _gross("e", {1: (120000, 140, 400)}),
    "eco_gross_profit_by_month": _gross("o", {8: (120000, 140, 400), 9: (150000, 115, 500)}),
}
