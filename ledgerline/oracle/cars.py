from ledgerline.oracle.kit import big, div, pct, rnd, using

_MONTHS = ["Январь", "Февраль", "Март", "Апрель", "Май", "Июнь", "Июль", "Август", "Сентябрь"]


def _num(x: str) -> str:
    return f"NULLIF(regexp_replace(replace({x}, ',', '.'), '[^0-9.\\-]', '', 'g'), '')"


def _pick(x: str, pairs: dict[str, str | None]) -> str:
    """The raw values of the test table and what becomes of them."""
    cases = " ".join(f"WHEN '{raw}' THEN {repr(clean) if clean else 'NULL'}" for raw, clean in pairs.items())
    return f"CASE {x} {cases} ELSE {x} END"


_BOXES = {"АКПП": "AT", "A/T": "AT", "А": "AT", "МКПП": "MT", "М/T": "MT", "S-Tronic": "AMT", "CVT(вариатор)": "CVT",
          "#Н/Д": None, "РЕДУКТОР": "Редуктор"}
_DRIVES = {"4x2": "2WD", "2 WD": "2WD", "Передний (FF)": "FWD", "quattro": "4WD", "полный": "4WD", "Задний": "RWD", "#Н/Д": None}
_PAID = {"кредит": "В кредит", "лизинг": "В кредит", "trade-in": "В кредит", "Безналичная ": "Наличный расчёт",
         "б/н": "Наличный расчёт", "нал": "Наличный расчёт", "наличный": "Наличный расчёт", "Без оплаты": None}
_CANON = f"""
ty AS (SELECT * EXCLUDE (year, month) REPLACE (TRIM(model, ' ') AS model,
          TRY_CAST(CASE manufacturing_year WHEN '2 018' THEN '2018' WHEN '2 019' THEN '2019'
                   ELSE manufacturing_year END AS BIGINT) AS manufacturing_year,
          TRY_CAST(NULLIF(TRIM(regexp_replace(replace(engine_displacement_l, ',', '.'), '[^0-9.]', '', 'g'), '.'), '')
                   AS DOUBLE) AS engine_displacement_l,
          CAST(round_even(CAST(replace(price_usd, ',', '.') AS DOUBLE), 0) AS BIGINT) AS price_usd,
          CAST(round_even(CAST(replace(sale_usd, ',', '.') AS DOUBLE), 0) AS BIGINT) AS sale_usd),
          make_date(year, CASE month {' '.join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(_MONTHS, 1))} END, 1)
            AS purchase_date FROM cars),
f1 AS (SELECT * REPLACE (CASE WHEN fuel_type = '2' THEN 2.0 WHEN fuel_type = '1,6' THEN 1.6
                              ELSE engine_displacement_l END AS engine_displacement_l,
                         CASE TRIM(UPPER(SUBSTR(fuel_type, 1, 1)) || LOWER(SUBSTR(fuel_type, 2)))
                              WHEN 'Электро' THEN 'Электричество' WHEN '2' THEN 'Бензин' WHEN '1,6' THEN 'Бензин'
                              WHEN '0' THEN 'Бензин' ELSE TRIM(UPPER(SUBSTR(fuel_type, 1, 1)) || LOWER(SUBSTR(fuel_type, 2)))
                         END AS fuel_type) FROM ty),
c AS (SELECT * REPLACE (CASE WHEN company IN ('#Н/Д', '0') THEN NULL
                             WHEN company IN ('ТОО Astana Motors', 'Astana  Motors', 'astana motors') THEN 'Astana Motors'
                             ELSE company END AS company,
                        CASE manufacturing_country WHEN 'Республика Казахстан' THEN 'Казахстан'
                             WHEN 'Российская Федерация' THEN 'Россия' WHEN 'UK' THEN 'Великобритания'
                             ELSE manufacturing_country END AS manufacturing_country,
                        CASE WHEN sale_usd IN (0, -35588) THEN price_usd ELSE sale_usd END AS sale_usd,
                        CASE WHEN fuel_type = 'Электричество' THEN NULL ELSE engine_displacement_l END
                          AS engine_displacement_l,
                        CASE WHEN fuel_type = 'Электричество' THEN 'Редуктор' ELSE
                             {_pick("regexp_replace(transmission_type, '[ 0-9]', '', 'g')", _BOXES)} END AS transmission_type,
                        {_pick('drive_type', _DRIVES)} AS drive_type,
                        CASE car_type WHEN 'Пикапы' THEN 'Внедорожники' WHEN 'Минивэны' THEN 'Легковые автомобили'
                             ELSE car_type END AS car_type,
                        CASE dealer WHEN 'Auto trader' THEN 'Auto Trader' ELSE replace(TRIM(dealer, ' '), ' ', ' ') END AS dealer,
                        CASE WHEN customer_type IN ('ФизЛицо', 'физ.лицо') THEN 'Физическое лицо'
                             WHEN customer_type IN ('Юр. Лицо', 'Корп. клиент') THEN 'Юридическое лицо'
                             ELSE customer_type END AS customer_type,
                        {_pick('payment_form', _PAID)} AS payment_form,
                        CASE WHEN quantity < 0 THEN 1 ELSE quantity END AS quantity) FROM f1)"""
_W = using("cars", rest=_CANON)


def _analysis(name: str, table: str, column: str) -> str:
    """Group statistics with the mode ranked explicitly, smallest value on ties."""
    return f"""
{name} AS (SELECT brand, model, SUM(n) AS obs, SUM(CASE WHEN v IS NULL THEN n ELSE 0 END) AS nulls,
        MAX(CASE WHEN v IS NOT NULL THEN n END) AS top,
        FIRST(v ORDER BY CASE WHEN v IS NULL THEN 1 ELSE 0 END, n DESC, v) AS m
    FROM (SELECT brand, model, {column} AS v, COUNT(*) AS n FROM {table} GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


_NULLP = pct("nulls", "obs", 1)
_MODEP = f"COALESCE({pct('top', 'obs - nulls', 1)}, 0.0)"


def _impute(step: int, table: str, column: str, gate: str) -> str:
    return _analysis(f"a{step}", table, column) + f""",
i{step} AS (SELECT t.* REPLACE (COALESCE(t.{column}, CASE WHEN {gate} THEN a.m END) AS {column})
            FROM {table} t JOIN a{step} a ON a.brand = t.brand AND a.model = t.model)"""


_COLUMNS = ["company", "brand", "model", "fuel_type"]
_PROFILE = " UNION ALL ".join(f"""SELECT '{c}' AS "column", COUNT(*) AS row_cnt, COUNT({c}) AS filled_cnt,
    COUNT(DISTINCT {c}) AS distinct_cnt, MIN({c}) AS min_value, MAX({c}) AS max_value FROM ty""" for c in _COLUMNS)
_TOPV = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value, cnt, place FROM (
    SELECT {c}, COUNT(*) AS cnt, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c} ASC NULLS FIRST) AS place
    FROM ty GROUP BY {c}) WHERE place <= 5""" for c in _COLUMNS)
_RULED = """, hits AS (SELECT model, car_classification, engine_displacement_l, FIRST(r.class ORDER BY priority, r.class) AS new
        FROM (SELECT DISTINCT model, car_classification, engine_displacement_l FROM c) LEFT JOIN class_rules r
          ON member = model AND (low IS NULL OR engine_displacement_l >= low) AND (high IS NULL OR engine_displacement_l < high)
        GROUP BY 1, 2, 3),
    n AS (SELECT c.model, c.car_classification AS class_before, COALESCE(new, c.car_classification) AS class_after
          FROM c JOIN hits h ON h.model = c.model AND h.car_classification IS NOT DISTINCT FROM c.car_classification
           AND h.engine_displacement_l IS NOT DISTINCT FROM c.engine_displacement_l)
    """
_R = using("cars", "class_rules", rest=_CANON)


def _top(column: str) -> str:
    return _W + f"""SELECT {column}, COUNT(*) AS sales, {big('SUM(sale_usd)')} AS revenue FROM c GROUP BY 1
        ORDER BY revenue DESC, {column} LIMIT 10"""


SQL = {
    "car_types": _W + "SELECT * FROM ty",
    "car_duplicates": _W + f""", d AS (SELECT DISTINCT * FROM ty),
        n AS (SELECT (SELECT COUNT(*) FROM ty) AS row_cnt, COUNT(*) AS distinct_rows FROM d)
        SELECT row_cnt, distinct_rows, row_cnt - distinct_rows AS duplicate_rows,
               {pct('row_cnt - distinct_rows', 'row_cnt')} AS duplicate_percent FROM n""",
    "car_key": _W + """SELECT purchase_date, brand, model, city, dealer, price_usd,
        ROW_NUMBER() OVER (ORDER BY purchase_date, brand, model, city, dealer, price_usd) - 1 AS id FROM ty""",
    "car_profile": _W + _PROFILE,
    "car_top_values": _W + _TOPV,
    "car_canonical": _W + """SELECT company, manufacturing_country, fuel_type, engine_displacement_l, price_usd,
        sale_usd, model, car_type, transmission_type, drive_type, dealer, customer_type, payment_form, quantity FROM c""",
    "car_drives": _W.rstrip() + """,
        d1 AS (SELECT * REPLACE (CASE WHEN drive_type = '2WD' AND model IN ('M9', 'M18') THEN 'FWD'
                   WHEN drive_type = '2WD' AND model IN ('M27', 'M36') THEN 'RWD' WHEN drive_type = '2WD' AND model = 'M45' THEN '4WD'
                   WHEN drive_type IS NULL AND model IN ('M8', 'M17') THEN 'FWD' ELSE drive_type END AS drive_type) FROM c),
        own AS (SELECT model, FIRST(drive_type ORDER BY n DESC, drive_type) AS best
                FROM (SELECT model, drive_type, COUNT(*) AS n FROM d1 WHERE drive_type IS NOT NULL GROUP BY 1, 2)
                WHERE model IN ('M5', 'M14', 'M23', 'M6', 'M7') GROUP BY 1)
        SELECT model, COALESCE(drive_type, best) AS drive_type, COUNT(*) AS cnt FROM d1 LEFT JOIN own USING (model) GROUP BY 1, 2""",
    "car_null_analysis": _W.rstrip() + "," + _analysis("a", "c", "manufacturing_year") + f"""
        SELECT brand, model, {big('nulls')} AS null_cnt, {big('obs')} AS obs_cnt, {_NULLP} AS null_perc,
               {_MODEP} AS mode_perc, m AS mode_value FROM a WHERE nulls > 0""",
    "car_reconcile": _W.rstrip() + "," + _analysis("a", "c", "manufacturing_year") + f"""
        SELECT {big('SUM(obs)')} AS table_obs, {big('SUM(nulls)')} AS table_nulls,
               (SELECT COUNT(*) FROM c WHERE EXISTS (SELECT 1 FROM c x WHERE x.brand = c.brand AND x.model = c.model
                                                     AND x.manufacturing_year IS NULL)) AS base_obs,
               (SELECT COUNT(*) - COUNT(manufacturing_year) FROM c) AS base_nulls FROM a WHERE nulls > 0""",
    "car_impute": _W.rstrip() + "," + _impute(1, "c", "manufacturing_year", f"{_MODEP} >= 60") + ","
        + _impute(2, "i1", "fuel_type", f"{_MODEP} >= 60") + ","
        + _impute(3, "i2", "engine_displacement_l", f"{_MODEP} >= 60 AND {_NULLP} <= 90") + ","
        + _impute(4, "i3", "transmission_type", f"{_MODEP} = 100 AND {_NULLP} <= 90") + """
        SELECT brand, model, manufacturing_year, fuel_type, engine_displacement_l, transmission_type, price_usd, dealer
        FROM i4""",
    "car_overrides": _W + """SELECT brand, model, CASE WHEN transmission_type IS NULL AND brand = 'Brand 3' THEN 'AT'
        WHEN transmission_type IS NULL AND model IN ('M10', 'M20') THEN 'MT' ELSE transmission_type END
        AS transmission_type,
        CASE WHEN model = 'M5' AND engine_displacement_l IN (2.0, 2.5) THEN 'FWD' ELSE drive_type END AS drive_type,
        CASE WHEN model = 'M5' AND engine_displacement_l IN (2.0, 2.5) THEN 1.6 ELSE engine_displacement_l END
        AS engine_displacement_l FROM c""",
    "car_customer_crosstab": _W + f"""SELECT quantity, COUNT(CASE WHEN customer_type = 'Физическое лицо' THEN 1 END) AS persons,
        COUNT(CASE WHEN customer_type = 'Юридическое лицо' THEN 1 END) AS firms,
        COUNT(*) - COUNT(customer_type) AS null_cnt, COUNT(*) AS obs_cnt,
        {pct('COUNT(*) - COUNT(customer_type)', 'COUNT(*)', 1)} AS null_perc
        FROM c WHERE quantity IS NOT NULL GROUP BY 1""",
    "car_customer_rule": _W + """SELECT COALESCE(quantity, 1) AS quantity,
        CASE WHEN quantity IS NULL THEN 'Физическое лицо' WHEN customer_type IS NOT NULL THEN customer_type
             WHEN quantity = 1 THEN 'Физическое лицо' ELSE 'Юридическое лицо' END AS customer_type, COUNT(*) AS cnt
        FROM c GROUP BY 1, 2""",
    "car_reclass": _R.rstrip() + _RULED + """SELECT * FROM
        (SELECT model, class_before, COUNT(*) AS cnt_before FROM n GROUP BY 1, 2)
        JOIN (SELECT model, class_after, COUNT(*) AS cnt_after FROM n GROUP BY 1, 2) USING (model)""",
    "car_reclass_typos": _R + "SELECT DISTINCT member AS model FROM class_rules WHERE member NOT IN (SELECT model FROM c)",
    "car_real_displacement": _W.rstrip() + """,
        own AS (SELECT model, FIRST(v ORDER BY n DESC, v) AS best
                FROM (SELECT model, engine_displacement_l AS v, COUNT(*) AS n FROM c
                      WHERE engine_displacement_l IS NOT NULL AND model IN ('M5', 'M12', 'M33') GROUP BY 1, 2) GROUP BY 1)
        SELECT model, COALESCE(best, engine_displacement_l) AS engine_displacement_l, COUNT(*) AS cnt
        FROM c LEFT JOIN own USING (model) GROUP BY 1, 2""",
    "car_market_monthly": _W + f"""SELECT purchase_date, car_type, {big('SUM(sale_usd)')} AS revenue,
        {big('SUM(quantity)')} AS cars FROM c GROUP BY 1, 2""",
    "car_market_price_bands": _W + f"""SELECT price_band, sales, {pct('sales', 'SUM(sales) OVER ()')} AS share
        FROM (SELECT CASE WHEN price_usd <= 10000 THEN 'до 10' WHEN price_usd <= 30000 THEN '10-30'
                          WHEN price_usd <= 60000 THEN '30-60' ELSE 'свыше 60' END AS price_band, COUNT(*) AS sales
              FROM c GROUP BY 1)""",
    "car_market_top_models": _W + """SELECT * FROM (SELECT car_classification, model, COUNT(*) AS sales,
        ROW_NUMBER() OVER (PARTITION BY car_classification ORDER BY COUNT(*) DESC, model) AS place FROM c GROUP BY 1, 2)
        WHERE place <= 3""",
    "car_market_brands": _top("brand"),
    "car_market_cities": _top("city"),
    "car_market_local_share": _W + f"""SELECT purchase_date,
        {pct("COUNT(CASE WHEN assembly = 'Местное' THEN 1 END)", 'COUNT(*)')} AS local_percent FROM c GROUP BY 1""",
    "car_market_dealers": _W + "SELECT company, COUNT(DISTINCT dealer) AS dealers FROM c GROUP BY 1",
    "car_market_specialisation": _W + """SELECT company, CASE WHEN bool_and(car_type = 'Коммерческие') THEN 'only'
        WHEN bool_or(car_type = 'Коммерческие') THEN 'mixed' ELSE 'none' END AS sells FROM c GROUP BY 1""",
    "car_market_efficiency": _W + f"""SELECT company, {rnd(div('SUM(sale_usd)', 'COUNT(DISTINCT dealer)'), 2)} AS revenue_per_dealer,
        {rnd(div('SUM(sale_usd)', 'SUM(quantity)'), 2)} AS revenue_per_car FROM c GROUP BY 1""",
}
