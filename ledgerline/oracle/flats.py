from ledgerline.oracle.kit import div, pct, rnd, using

_CLEAN = """
h AS (SELECT * REPLACE (CASE WHEN ceiling_height >= 20 THEN ceiling_height / 10 ELSE ceiling_height END AS ceiling_height)
      FROM flats WHERE locality_name IS NOT NULL),
c AS (SELECT CAST(last_price AS DECIMAL(18, 2)) AS p, total_area, living_area, kitchen_area, ceiling_height,
             CAST(TRUNC(last_price) AS BIGINT) AS last_price, CAST(floors_total AS BIGINT) AS floors_total, floor, rooms,
             CAST(COALESCE(balcony, 0) AS BIGINT) AS balcony, COALESCE(is_apartment, FALSE) AS is_apartment,
             replace(replace(replace(replace(locality_name, 'ё', 'е'), ' при железнодорожной', ''), 'поселок Рябово',
                     'поселок городского типа Рябово'), 'городской поселок', 'поселок городского типа') AS locality_name,
             city_center_m, CAST(round_even(days_exposition, 0) AS BIGINT) AS days_exposition,
             CAST(replace(first_day_exposition, 'T', ' ') AS TIMESTAMP) AS first_day_exposition,
             total_area - living_area AS non_residential_area
      FROM h WHERE ceiling_height IS NULL OR (ceiling_height >= 2 AND ceiling_height < 10)),
k AS (SELECT *, CAST(last_price AS DOUBLE) / total_area AS one_meter_price,
             isodow(first_day_exposition) - 1 AS weekday, EXTRACT(MONTH FROM first_day_exposition) AS month,
             EXTRACT(YEAR FROM first_day_exposition) AS year,
             CASE WHEN floor = 1 THEN 'первый' WHEN floor = floors_total THEN 'последний' ELSE 'другой' END AS floor_type,
             round_even(city_center_m / 1000, 0) AS city_center_km
      FROM c WHERE floors_total IS NOT NULL)"""
_W = using("flats", rest=_CLEAN)
_NUMERIC = ["total_area", "living_area", "kitchen_area", "last_price", "rooms", "ceiling_height", "floor",
            "floors_total", "city_center_m", "days_exposition"]


def _q(x: str, p: float) -> str:
    return f"quantile_cont(CAST({x} AS DOUBLE), {p})"


def _each(sql, names) -> str:
    return " UNION ALL ".join(sql(n) for n in names)


def _describe(c: str) -> str:
    return f"""SELECT '{c}' AS "column", COUNT({c}) AS cnt, {rnd(f'AVG({c})', 3)} AS mean,
        {rnd(f'STDDEV_SAMP({c})', 3)} AS std, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
        {rnd(_q(c, 0.25), 3)} AS q1, {rnd(_q(c, 0.5), 3)} AS median, {rnd(_q(c, 0.75), 3)} AS q3 FROM k"""


def _iqr(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {rnd(f'AVG({c})', 3)} AS mean, {rnd('MAX(m)', 3)} AS median,
        {rnd('MAX(q1 - 1.5 * (q3 - q1))', 3)} AS lower_bound, {rnd('MAX(q3 + 1.5 * (q3 - q1))', 3)} AS upper_bound,
        COUNT(CASE WHEN {c} <= q3 + 1.5 * (q3 - q1) THEN 1 END) AS normal_cnt,
        {pct(f'COUNT(CASE WHEN {c} <= q3 + 1.5 * (q3 - q1) THEN 1 END)', f'COUNT({c})', 1)} AS normal_percent
        FROM k, (SELECT {_q(c, 0.25)} AS q1, {_q(c, 0.5)} AS m, {_q(c, 0.75)} AS q3 FROM k)"""


def _stats(*by: str) -> str:
    keys = ", ".join(by)
    return _W + f"""SELECT {keys}, COUNT(last_price) AS cnt, {rnd('AVG(last_price)', 4)} AS mean,
        {rnd(_q('last_price', 0.5), 4)} AS median FROM k WHERE {' AND '.join(f'{b} IS NOT NULL' for b in by)} GROUP BY {keys}"""


_TOP = """, t AS (SELECT locality_name, COUNT(*) AS ads, """ + rnd("AVG(one_meter_price)", 2) + """ AS mean_meter_price
    FROM k GROUP BY 1 ORDER BY ads DESC, locality_name LIMIT 10)"""

SQL = {
    "flt_clean": _W + "SELECT * EXCLUDE (p) FROM c",
    "flt_area_nulls": _W + _each(lambda c: f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS null_cnt,
        {pct(f'COUNT(*) - COUNT({c})', 'COUNT(*)')} AS null_percent FROM c""",
        ["total_area", "kitchen_area", "living_area", "non_residential_area"]),
    "flt_features": _W + """SELECT one_meter_price, weekday, month, year, floor_type, city_center_km, locality_name FROM k""",
    "flt_describe": _W + _each(_describe, _NUMERIC),
    "flt_histogram": _W + """SELECT bin, COUNT(*) AS cnt, CAST(0.0 + (bin - 1) * 10.0 AS DOUBLE) AS bin_start
        FROM (SELECT LEAST(CAST(FLOOR(total_area / 10.0) AS BIGINT) + 1, 35) AS bin FROM k
              WHERE total_area BETWEEN 0 AND 350) GROUP BY bin""",
    "flt_iqr_report": _W + _each(_iqr, _NUMERIC),
    "flt_price_by_area": _stats("total_area"),
    "flt_price_by_kitchen": _stats("kitchen_area"),
    "flt_price_by_rooms": _stats("rooms"),
    "flt_price_by_floor": _stats("floor_type"),
    "flt_price_by_date": _stats("weekday", "month", "year"),
    "flt_price_factors": _W + _each(lambda c: f"SELECT '{c}' AS factor, {rnd(f'corr({c}, last_price)', 6)} AS r FROM k",
                                    ["total_area", "kitchen_area", "rooms", "weekday", "month", "year"]),
    "flt_top10_localities": _W.rstrip() + _TOP + " SELECT * FROM t",
    "flt_locality_extremes": _W.rstrip() + _TOP + """
        SELECT *, CASE WHEN mean_meter_price = (SELECT MAX(mean_meter_price) FROM t) THEN 'highest' ELSE 'lowest' END AS extreme
        FROM t WHERE mean_meter_price IN ((SELECT MAX(mean_meter_price) FROM t), (SELECT MIN(mean_meter_price) FROM t))""",
    "flt_price_by_km": _W + f"""SELECT city_center_km, COUNT(*) AS cnt, {rnd('AVG(last_price)', 2)} AS mean_price,
        {rnd(div('AVG(last_price)', 'city_center_km'), 2)} AS mean_price_per_km
        FROM k WHERE locality_name = 'Санкт-Петербург' AND city_center_km IS NOT NULL GROUP BY 1""",
    "flt_city_distance_r": _W + f"""SELECT {rnd('corr(city_center_km, last_price)', 6)} AS r FROM k
        WHERE locality_name = 'Санкт-Петербург'""",
}
