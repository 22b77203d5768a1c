from ledgerline.oracle.kit import big, div, growth, pct, rnd, using

_NEW = """
nu AS (SELECT d AS date, COUNT(*) AS new_users, SUM(COUNT(*)) OVER (ORDER BY d) AS total_users
       FROM (SELECT user_id, CAST(MIN(time) AS DATE) AS d FROM user_actions_o GROUP BY user_id) GROUP BY d),
nc AS (SELECT d AS date, COUNT(*) AS new_couriers, SUM(COUNT(*)) OVER (ORDER BY d) AS total_couriers
       FROM (SELECT courier_id, CAST(MIN(time) AS DATE) AS d FROM courier_actions_o GROUP BY courier_id) GROUP BY d)
"""
_PAID_E = """
paid AS (SELECT * FROM user_actions_e
         WHERE order_id NOT IN (SELECT order_id FROM user_actions_e WHERE action = 'cancel_order'))
"""

SQL = {
    "del_new_and_total": using("user_actions_o", "courier_actions_o", rest=_NEW) + f"""
        SELECT date, new_users, {big('total_users')} AS total_users, new_couriers,
               {big('total_couriers')} AS total_couriers
        FROM nc JOIN nu USING (date)""",
    "del_growth_pct": using("user_actions_o", "courier_actions_o", rest=_NEW) + f"""
        SELECT date, new_users, {big('total_users')} AS total_users, new_couriers,
               {big('total_couriers')} AS total_couriers,
               {growth('new_users', 'LAG(new_users) OVER (ORDER BY date)')} AS new_users_change,
               {growth('new_couriers', 'LAG(new_couriers) OVER (ORDER BY date)')} AS new_couriers_change,
               {growth('total_users', 'LAG(total_users) OVER (ORDER BY date)')} AS total_users_growth,
               {growth('total_couriers', 'LAG(total_couriers) OVER (ORDER BY date)')} AS total_couriers_growth
        FROM nc JOIN nu USING (date)""",
    "del_paying_active_share": using("user_actions_o", "courier_actions_o", rest=_NEW + f""",
        pu AS (SELECT CAST(time AS DATE) AS date, COUNT(DISTINCT user_id) AS paying_users FROM user_actions_o
               WHERE order_id NOT IN (SELECT order_id FROM user_actions_o WHERE action = 'cancel_order') GROUP BY 1),
        ac AS (SELECT CAST(time AS DATE) AS date, COUNT(DISTINCT courier_id) AS active_couriers FROM courier_actions_o
               WHERE order_id IN (SELECT order_id FROM courier_actions_o WHERE action = 'deliver_order') GROUP BY 1)
        """) + f"""
        SELECT date, paying_users, active_couriers,
               {pct('paying_users', 'total_users')} AS paying_users_share,
               {pct('active_couriers', 'total_couriers')} AS active_couriers_share
        FROM pu JOIN ac USING (date) JOIN nu USING (date) JOIN nc USING (date)""",
    "del_single_vs_several": using("user_actions_e", rest=_PAID_E + """,
        t AS (SELECT CAST(time AS DATE) AS date, user_id,
                     COUNT(order_id) OVER (PARTITION BY user_id, CAST(time AS DATE)) AS n FROM paid),
        one AS (SELECT date, COUNT(user_id) AS one FROM t WHERE n = 1 GROUP BY date),
        many AS (SELECT date, COUNT(DISTINCT user_id) AS many FROM t WHERE n > 1 GROUP BY date),
        payers AS (SELECT date, COUNT(DISTINCT user_id) AS payers FROM t GROUP BY date)""") + f"""
        SELECT date, {pct('one', 'payers')} AS single_order_users_share,
               {pct('many', 'payers')} AS several_orders_users_share
        FROM one JOIN many USING (date) JOIN payers USING (date)""",
    "del_first_orders": using("user_actions_o", rest="""
        paid AS (SELECT * FROM user_actions_o
                 WHERE order_id NOT IN (SELECT order_id FROM user_actions_o WHERE action = 'cancel_order')),
        a AS (SELECT CAST(time AS DATE) AS date, COUNT(order_id) AS orders FROM paid GROUP BY 1),
        f AS (SELECT d AS date, COUNT(*) AS first_orders
              FROM (SELECT user_id, CAST(MIN(time) AS DATE) AS d FROM paid GROUP BY user_id) GROUP BY d),
        n AS (SELECT date, COUNT(order_id) AS new_users_orders
              FROM (SELECT *, CAST(time AS DATE) AS date,
                           DENSE_RANK() OVER (PARTITION BY user_id ORDER BY CAST(time AS DATE)) AS r
                    FROM user_actions_o)
              WHERE r = 1 AND order_id NOT IN (SELECT order_id FROM user_actions_o WHERE action = 'cancel_order')
              GROUP BY date)""") + f"""
        SELECT date, orders, first_orders, new_users_orders,
               {pct('first_orders', 'orders')} AS first_orders_share,
               {pct('new_users_orders', 'orders')} AS new_users_orders_share
        FROM a JOIN f USING (date) JOIN n USING (date)"""
    .replace("SELECT date, orders,", "SELECT date, CAST(orders AS BIGINT) AS orders,"),
    "del_load_per_courier": using("user_actions_e", "courier_actions_e", "delivery_orders_e", rest=_PAID_E + """,
        pu AS (SELECT CAST(time AS DATE) AS date, COUNT(DISTINCT user_id) AS u FROM paid GROUP BY 1),
        ac AS (SELECT CAST(time AS DATE) AS date, COUNT(DISTINCT courier_id) AS c FROM courier_actions_e
               WHERE order_id IN (SELECT order_id FROM courier_actions_e WHERE action = 'deliver_order') GROUP BY 1),
        o AS (SELECT CAST(creation_time AS DATE) AS date, COUNT(order_id) AS o FROM delivery_orders_e
              WHERE order_id NOT IN (SELECT order_id FROM user_actions_e WHERE action = 'cancel_order') GROUP BY 1)
        """) + f"""
        SELECT date, {rnd(div('u', 'c'), 2)} AS users_per_courier, {rnd(div('o', 'c'), 2)} AS orders_per_courier
        FROM pu JOIN ac USING (date) JOIN o USING (date)""",
    "del_minutes_to_deliver": using("user_actions_e", "courier_actions_e") + f"""
        SELECT CAST(time AS DATE) AS date,
               {big(rnd(div('SUM(epoch_us(time) - epoch_us(accepted))', 'COUNT(*)') + ' / 60e6'))} AS minutes_to_deliver
        FROM (SELECT *, LAG(time) OVER (PARTITION BY courier_id, order_id ORDER BY time) AS accepted
              FROM courier_actions_e
              WHERE order_id NOT IN (SELECT order_id FROM user_actions_e WHERE action = 'cancel_order'))
        WHERE action = 'deliver_order' GROUP BY 1""",
    "del_cancel_rate_by_hour": using("user_actions_e", "courier_actions_e", "delivery_orders_e", rest="""
        s AS (SELECT EXTRACT(HOUR FROM creation_time) AS hour, COUNT(*) AS successful_orders FROM delivery_orders_e
              WHERE order_id IN (SELECT order_id FROM courier_actions_e WHERE action = 'deliver_order') GROUP BY 1),
        c AS (SELECT EXTRACT(HOUR FROM creation_time) AS hour, COUNT(*) AS canceled_orders FROM delivery_orders_e
              WHERE order_id IN (SELECT order_id FROM user_actions_e WHERE action = 'cancel_order') GROUP BY 1)
        """) + f"""
        SELECT hour, successful_orders, canceled_orders,
               {rnd(div('canceled_orders', 'successful_orders + canceled_orders'), 3)} AS cancel_rate
        FROM s JOIN c USING (hour)""",
}
