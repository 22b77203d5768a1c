from ledgerline.oracle.kit import area, big, div, pct, rnd, steps, using

_STEPS = ["signup", "view", "click", "purchase"]
_FUNNEL = "f AS (" + " UNION ALL ".join(
    f"""SELECT grp, {i} AS step_number, '{s}' AS step, COUNT(DISTINCT CASE WHEN event_type = '{s}' THEN user_id END) AS users,
        COUNT(DISTINCT user_id) AS users_all,
        COUNT(DISTINCT CASE WHEN event_type = '{_STEPS[max(i - 2, 0)]}' THEN user_id END) AS before,
        COUNT(DISTINCT CASE WHEN event_type = '{_STEPS[0]}' THEN user_id END) AS first FROM experiment GROUP BY grp"""
    for i, s in enumerate(_STEPS, 1)) + ")"
_Z = "(a.users * 1.0e0 / a.users_all - b.users * 1.0e0 / b.users_all) / sqrt(pool * (1 - pool) * (1.0e0 / a.users_all + 1.0e0 / b.users_all))"

SQL = {
    "ab_funnel": using("experiment", rest=_FUNNEL) + f"""SELECT grp, {big('step_number')} AS step_number, step, users, users_all,
        {pct('users', 'users_all')} AS share_of_all, {pct('users', 'before')} AS share_of_previous,
        {pct('users', 'first')} AS share_of_first FROM f""",
    "ab_ztest": using("experiment", rest=_FUNNEL) + f"""SELECT step_number, step, users_1, users_all_1, users_2, users_all_2, z,
        ABS(z) > 1.959963984540054 AS rejected FROM (
        SELECT {big('a.step_number')} AS step_number, a.step, a.users AS users_1, a.users_all AS users_all_1,
               b.users AS users_2, b.users_all AS users_all_2, {rnd(_Z, 6)} AS z
        FROM (SELECT *, 1 AS one FROM f WHERE grp = 'A') a JOIN (SELECT * FROM f WHERE grp = 'B') b ON a.step = b.step,
             LATERAL (SELECT {div('a.users + b.users', 'a.users_all + b.users_all')} AS pool))""",
    "ab_ztest_p_values": using("experiment", rest=_FUNNEL + f""",
        t AS (SELECT a.step_number, a.step, {_Z} AS z
              FROM (SELECT * FROM f WHERE grp = 'A') a JOIN (SELECT * FROM f WHERE grp = 'B') b ON a.step = b.step,
              LATERAL (SELECT {div('a.users + b.users', 'a.users_all + b.users_all')} AS pool)),
        p AS (SELECT step_number, {area('exp(-x * x / 2) / sqrt(2 * pi())', 'ABS(z)', 't')} AS inside FROM {steps('t')}
              GROUP BY step_number)""") + f"""
        SELECT {big('t.step_number')} AS step_number, t.step, {rnd('z', 6)} AS z, {rnd('1 - 2 * inside', 6)} AS p_value
        FROM t JOIN p USING (step_number)""",
    "ab_group_balance": using("experiment") + f"""SELECT grp, users, CAST(0 AS BIGINT) + in_several AS in_several,
        {pct('users', 'SUM(users) OVER ()')} AS share FROM (
        SELECT grp, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT CASE WHEN n > 1 THEN user_id END) AS in_several
        FROM experiment JOIN (SELECT user_id, COUNT(DISTINCT grp) AS n FROM experiment GROUP BY 1) USING (user_id) GROUP BY 1)""",
    "ab_promo_overlap": using("experiment", "promos", rest="""
        s AS (SELECT user_id, region, CAST(MIN(ts) AS DATE) AS a, CAST(MAX(ts) AS DATE) AS b FROM experiment GROUP BY 1, 2),
        o AS (SELECT DISTINCT name, start_dt, finish_dt, TRIM(UNNEST(string_split(regions, ','))) AS region FROM promos)""") + """
        SELECT name, start_dt, finish_dt, COUNT(*) AS users, COUNT(DISTINCT region) AS regions FROM s JOIN o USING (region)
        WHERE a <= finish_dt AND start_dt <= b GROUP BY 1, 2, 3""",
}
