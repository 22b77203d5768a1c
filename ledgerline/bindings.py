"""Reference-shaped tables over the parquet test tables.

Every view is one SQL text understood by Spark and by the checking database alike, so
both sides of a comparison start from the same relation. The queries themselves are
written separately for each side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}


def _view(name: str, sql: str) -> None:
    VIEWS[name] = sql


# --- delivery service, bound to the event log (suffix _e) and to dated orders (_o) ----
_view("user_actions_e", """
    SELECT user_id, event_id AS order_id, 'create_order' AS action, ts AS time FROM {events}
    UNION ALL
    SELECT user_id, event_id, 'cancel_order', ts FROM {events} WHERE event_type = 'error'""")
_view("delivery_orders_e", "SELECT event_id AS order_id, ts AS creation_time FROM {events}")
_view("order_lines", "SELECT l_orderkey AS order_id, l_partkey AS product_id FROM {lineitem}")
# some orders have no list of products and some an empty one
_view("baskets", """
    SELECT l_orderkey AS order_id,
           CASE WHEN l_orderkey % 97 <> 0 THEN array_agg(l_partkey) FILTER (WHERE l_orderkey % 89 <> 0) END AS product_ids
    FROM {lineitem} GROUP BY l_orderkey""")
_view("products", "SELECT p_partkey AS product_id, p_name AS name, p_retailprice AS price FROM {part}")
_view("courier_actions_e", """
    SELECT event_id % 50 AS courier_id, event_id AS order_id, 'accept_order' AS action, ts AS time
    FROM {events}
    UNION ALL
    SELECT event_id % 50, event_id, 'deliver_order',
           ts + INTERVAL '1' MINUTE * CAST(10 + event_id % 20 AS INTEGER)
    FROM {events} WHERE event_type <> 'error'""")
_view("user_actions_o", """
    SELECT o_custkey AS user_id, o_orderkey AS order_id, 'create_order' AS action, o_orderdate AS time
    FROM {orders}
    UNION ALL
    SELECT o_custkey, o_orderkey, 'cancel_order', o_orderdate FROM {orders} WHERE o_orderstatus = 'F'""")
_view("delivery_orders_o", "SELECT o_orderkey AS order_id, o_orderdate AS creation_time FROM {orders}")
_view("courier_actions_o", """
    SELECT o_orderkey % 50 AS courier_id, o_orderkey AS order_id, 'accept_order' AS action,
           o_orderdate AS time
    FROM {orders}
    UNION ALL
    SELECT o_orderkey % 50, o_orderkey, 'deliver_order', MIN(l_shipdate)
    FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate
    WHERE o_orderstatus <> 'F' GROUP BY o_orderkey""")
_view("campaign_users", """
    SELECT DISTINCT user_id, CASE user_id % 3 WHEN 1 THEN 'Campaign 1' ELSE 'Campaign 2' END AS ads_campaign
    FROM {events} WHERE user_id % 3 <> 0""")

# --- questions-and-answers site --------------------------------------------------------
_view("posts", """
    SELECT event_id AS id, user_id,
           CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3
                           WHEN 'signup' THEN 4 ELSE 5 END AS post_type_id,
           CASE WHEN event_type <> 'error' THEN event_type || ' ' || CAST(event_id AS VARCHAR(20)) END AS title,
           ts AS creation_date, CAST(FLOOR(value) AS INTEGER) - 10 AS score,
           CAST(event_id % 150 AS INTEGER) AS favorites_count,
           CAST(FLOOR(value * 7) AS BIGINT) AS views_count
    FROM {events}""")
_view("post_types", """
    SELECT DISTINCT CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3
                                    WHEN 'signup' THEN 4 ELSE 5 END AS id,
           CASE event_type WHEN 'view' THEN 'Question' WHEN 'click' THEN 'Answer'
                           ELSE event_type END AS type
    FROM {events}""")
_view("users", """
    SELECT c_custkey AS id, c_mktsegment || ' ' || CAST(c_custkey % 40 AS VARCHAR(20)) AS display_name,
           TIMESTAMP_NTZ '2023-12-20 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 40 AS INTEGER) AS creation_date,
           n_name AS location, CAST(FLOOR(c_acctbal / 20) AS INTEGER) AS views
    FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""")
_view("badges", """
    SELECT event_id AS id, user_id, event_type AS name, ts AS creation_date
    FROM {events} WHERE event_type IN ('signup', 'purchase')""")
_view("votes", """
    SELECT l_suppkey AS user_id, l_orderkey AS post_id, l_linenumber AS vote_type_id FROM {lineitem}""")
_view("vote_types", """
    SELECT DISTINCT l_linenumber AS id,
           CASE l_linenumber WHEN 2 THEN 'UpMod' WHEN 3 THEN 'DownMod' WHEN 6 THEN 'Close'
                             ELSE 'Type ' || CAST(l_linenumber AS VARCHAR(20)) END AS name
    FROM {lineitem}""")

_view("posts_o", """
    SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS creation_date,
           CAST(FLOOR(o_totalprice / 100) AS BIGINT) AS views_count FROM {orders}""")
_view("users_o", """
    SELECT c_custkey AS id,
           TIMESTAMP_NTZ '1996-08-15 08:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 60 AS INTEGER) AS creation_date
    FROM {customer}""")

# --- venture funding -------------------------------------------------------------------
_view("company", """
    SELECT c_custkey AS id, c_name AS name, LOWER(c_mktsegment) AS category_code,
           CASE WHEN c_custkey % 5 = 0 THEN 'closed' ELSE 'operating' END AS status,
           DATE '2011-01-01' + CAST(c_custkey % 1096 AS INTEGER) AS founded_at,
           n_name AS country_code,
           CASE WHEN c_acctbal >= 0 THEN CAST(FLOOR(c_acctbal) AS BIGINT) END AS funding_total,
           CAST(c_custkey % 10 AS INTEGER) AS milestones
    FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""")
_view("fund", """
    SELECT s_suppkey AS id, s_name AS name,
           DATE '2009-01-01' + CAST((s_suppkey * 13) % 1800 AS INTEGER) AS founded_at,
           n_name AS country_code, CAST((s_suppkey * 7) % 150 AS INTEGER) AS invested_companies,
           CAST((s_suppkey * 3) % 37 AS INTEGER) AS investment_rounds
    FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""")
_view("funding_round", """
    SELECT o_orderkey AS id, o_custkey AS company_id, CAST(o_orderdate AS DATE) AS funded_at,
           CASE WHEN o_orderkey % 20 = 0 THEN 0 ELSE CAST(FLOOR(o_totalprice) AS BIGINT) END AS raised_amount,
           CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS is_first_round,
           CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS is_last_round
    FROM {orders}""")
_view("investment", """
    SELECT l_orderkey AS funding_round_id, l_partkey AS company_id, l_suppkey AS fund_id FROM {lineitem}""")
_view("acquisition", """
    SELECT l_suppkey AS acquiring_company_id, l_partkey AS acquired_company_id,
           CASE l_returnflag WHEN 'A' THEN 'cash' WHEN 'N' THEN 'stock' ELSE 'mixed' END AS term_code,
           CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(FLOOR(l_extendedprice) AS BIGINT) END AS price_amount,
           CAST(l_shipdate AS DATE) AS acquired_at,
           l_orderkey AS deal_id, l_linenumber AS deal_line
    FROM {lineitem}""")
_view("people", """
    SELECT p_partkey AS id, SUBSTR(p_name, 1, STRPOS_(p_name) - 1) AS first_name,
           SUBSTR(p_name, STRPOS_(p_name) + 1) AS last_name, p_partkey AS company_id,
           p_name || CAST(p_partkey AS VARCHAR(20)) AS twitter_username
    FROM {part}""".replace("STRPOS_(p_name)", "INSTR(p_name, ' ')"))
_view("education", """
    SELECT l_partkey AS person_id, 'School ' || CAST(l_suppkey AS VARCHAR(20)) AS instituition FROM {lineitem}""")

# --- transaction screening -------------------------------------------------------------
_view("transactions", """
    SELECT o_orderkey AS operation_id, o_custkey AS client_id, o_totalprice AS operation_amount,
           CASE SUBSTR(o_orderpriority, 1, 1) WHEN '1' THEN 'rub' WHEN '2' THEN 'RUB.' WHEN '3' THEN 'USD'
                                              ELSE 'EUR' END AS currency,
           CASE SUBSTR(o_orderpriority, 1, 1) WHEN '3' THEN '2.5' WHEN '4' THEN '3.25' WHEN '5' THEN 'n/a'
                                              ELSE '1' END AS exchange_rate,
           CASE o_orderstatus WHEN 'F' THEN 'Завершена.' WHEN 'O' THEN ' завершена !' ELSE 'ОТКЛОНЕНА' END
               AS operation_status,
           CASE o_orderkey % 7 WHEN 0 THEN 'Кредит' WHEN 1 THEN 'получение целевого кредита, договор 5'
               WHEN 2 THEN 'Выдача займа' WHEN 3 THEN 'займ; предоставление кредита'
               WHEN 4 THEN 'аренда, договор № ' || CAST(o_orderkey % 5000 AS VARCHAR(20))
               WHEN 5 THEN NULL ELSE 'Реструктуризация старого займа' END AS payment_purpose,
           CASE o_orderkey % 11 WHEN 0 THEN 'г.Тегеран (Иран)' WHEN 1 THEN NULL ELSE 'Москва' END AS location,
           CASE o_orderkey % 13 WHEN 0 THEN 'PRK' WHEN 1 THEN ' irn.' WHEN 2 THEN 'IRNX' ELSE 'USA' END
               AS counterparty_bank_country_code
    FROM {orders}""")
_view("client_persons", """
    SELECT c_custkey AS client_id, c_name AS full_name,
           CASE c_nationkey WHEN 3 THEN 'IRN' WHEN 4 THEN NULL ELSE 'RUS' END AS tax_registration_country,
           CASE c_nationkey WHEN 5 THEN 'дом 7, КНДР, кв. 1' WHEN 6 THEN 'ИРАН' ELSE 'Казань' END
               AS residential_address,
           CASE c_nationkey WHEN 6 THEN 'Северная Корея, ул. 3' WHEN 7 THEN NULL ELSE 'Омск' END
               AS registration_address,
           CASE c_nationkey WHEN 8 THEN 'Иран; а/я 12' WHEN 5 THEN 'КНДРовская ул.' ELSE 'Томск' END
               AS postal_address
    FROM {customer} WHERE c_custkey % 5 IN (0, 1, 2)""")
_view("client_companies", """
    SELECT c_custkey AS client_id, c_name AS company_name,
           CASE c_nationkey WHEN 9 THEN 'PRK' ELSE 'USA' END AS tax_registration_country,
           CASE c_nationkey WHEN 10 THEN 'порт, Корейская Народная Демократическая Республика' ELSE 'Пермь' END
               AS company_address,
           CASE c_nationkey WHEN 11 THEN 'Иран' WHEN 12 THEN NULL ELSE 'Тверь' END AS postal_address
    FROM {customer} WHERE c_custkey % 5 = 3""")

# --- notebook tables -------------------------------------------------------------------
_PLAY = """
    SELECT CAST(user_id AS VARCHAR(20)) AS "userID",
           CASE WHEN event_id % 17 <> 0 THEN 'track ' || CAST(event_id % 500 AS VARCHAR(20)) END AS "Track",
           CASE WHEN event_id % 11 <> 0 THEN 'artist ' || CAST(event_id % 90 AS VARCHAR(20)) END AS artist,
           CASE event_id % 9 WHEN 0 THEN 'hip' WHEN 1 THEN 'hop' WHEN 2 THEN 'hip-hop' WHEN 3 THEN 'pop'
               WHEN 4 THEN 'rock' WHEN 5 THEN 'dance' WHEN 6 THEN event_type WHEN 7 THEN NULL ELSE 'hiphop' END AS genre,
           CASE user_id % 2 WHEN 0 THEN 'Moscow' ELSE 'Saint-Petersburg' END AS "City",
           SUBSTR(CAST(ts AS VARCHAR(30)), 12, 8) AS time,
           CASE EXTRACT(DAY FROM ts) % 3 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Wednesday' ELSE 'Friday' END AS "Day"
    FROM {events}"""
_view("plays", _PLAY + " UNION ALL " + _PLAY + " WHERE event_id % 25 = 0")
_BORROWER = """
    SELECT CAST(CASE WHEN c_custkey % 70 = 5 THEN 20 ELSE c_custkey % 7 - 1 END AS INTEGER) AS children,
           CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal - 3000 END AS days_employed,
           CASE c_custkey % 3 WHEN 0 THEN 'Высшее' WHEN 1 THEN 'ВЫСШЕЕ' ELSE 'среднее' END AS education,
           CASE c_custkey % 4 WHEN 0 THEN 'женат / замужем' WHEN 1 THEN 'гражданский брак' WHEN 2 THEN 'в разводе'
               ELSE 'вдовец / вдова' END AS family_status,
           c_mktsegment AS income_type,
           CAST(CASE WHEN (c_custkey * 7) % 12 = 0 THEN 1 ELSE 0 END AS INTEGER) AS debt,
           CASE WHEN c_custkey % 10 <> 0 THEN ABS(c_acctbal) * 60 END AS total_income,
           CASE c_custkey % 6 WHEN 0 THEN 'на покупку автомобиля' WHEN 1 THEN 'сделка с жилой недвижимостью'
               WHEN 2 THEN 'сыграть свадьбу' WHEN 3 THEN 'получение образования' WHEN 4 THEN 'покупка жилья'
               ELSE 'ремонт' END AS purpose
    FROM {customer}"""
_view("borrowers", _BORROWER + " UNION ALL " + _BORROWER + " WHERE c_custkey % 40 = 0")
_view("flats", """
    SELECT CAST(l_extendedprice AS DOUBLE) AS last_price, l_quantity + 20 AS total_area,
           CASE WHEN l_partkey % 9 <> 0 THEN l_quantity + 5 END AS living_area,
           CASE WHEN l_partkey % 8 <> 0 THEN CAST(6 + l_partkey % 30 AS DOUBLE) END AS kitchen_area,
           CASE l_suppkey % 10 WHEN 0 THEN 25.0 WHEN 1 THEN 1.8 WHEN 2 THEN 14.0 WHEN 3 THEN NULL ELSE 2.7 END
               + 0.0e0 AS ceiling_height,
           CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_linenumber + l_partkey % 3 AS DOUBLE) END AS floors_total,
           l_linenumber AS floor, CAST(1 + l_partkey % 5 AS INTEGER) AS rooms,
           CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_orderkey % 4 AS DOUBLE) END AS balcony,
           CASE WHEN l_orderkey % 10 = 0 THEN TRUE END AS is_apartment,
           CASE l_suppkey % 20 WHEN 0 THEN 'Санкт-Петербург' WHEN 1 THEN 'Санкт-Петербург'
               WHEN 2 THEN 'посёлок Рябово' WHEN 3 THEN 'поселок при железнодорожной станции' WHEN 4 THEN NULL
               WHEN 5 THEN 'городской поселок Мга'
               ELSE 'деревня ' || CAST(l_suppkey % 20 AS VARCHAR(20)) END AS locality_name,
           CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_partkey * 15 AS DOUBLE) END AS city_center_m,
           CASE WHEN l_partkey % 6 <> 0 THEN l_extendedprice / 100 END AS days_exposition,
           SUBSTR(CAST(l_shipdate AS VARCHAR(30)), 1, 10) || 'T00:00:00' AS first_day_exposition
    FROM {lineitem}""")
_view("games", """
    SELECT 'Game ' || CAST(o_orderkey AS VARCHAR(20)) AS "Name", 'P' || CAST(o_custkey % 25 AS VARCHAR(20)) AS "Platform",
           CASE WHEN o_orderkey % 60 <> 0 THEN CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) END AS "Year_of_Release",
           CASE WHEN o_orderkey % 90 <> 0 THEN SUBSTR(o_orderpriority, 3) END AS "Genre",
           CAST(o_orderkey % 97 AS DOUBLE) / 100 AS "NA_sales", CAST(o_orderkey % 61 AS DOUBLE) / 100 AS "EU_sales",
           CAST(o_custkey % 53 AS DOUBLE) / 100 AS "JP_sales", CAST(o_custkey % 19 AS DOUBLE) / 100 AS "Other_sales",
           CASE WHEN o_orderkey % 3 <> 0 THEN CAST(40 + o_custkey % 60 AS DOUBLE) END AS "Critic_Score",
           CASE o_orderkey % 5 WHEN 0 THEN 'tbd' WHEN 1 THEN NULL
               ELSE CAST((o_orderkey * 7) % 10 AS VARCHAR(20)) || '.' || CAST(o_custkey % 10 AS VARCHAR(20)) END
               AS "User_Score",
           CASE o_custkey % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'T' WHEN 2 THEN 'M' END AS "Rating"
    FROM {orders}""")


def _documents(n: int) -> str:
    """A JSON list of n documents, as an SQL text."""
    user = "' || CAST(user_id AS VARCHAR(20)) || '"
    items = [
        f'{{"name": "акт {i} {user}", "archive": {{"id": "a{i}", "url": "u{i}"}}}}' for i in range(1, n + 1)
    ]
    return f"WHEN {n} THEN '[{', '.join(items)}]'"


_DOCUMENTS = "CASE event_id % 8 " + " ".join(_documents(n) for n in range(7)) + " END"
_view("heritage", """
    SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'Дом жилой' WHEN 1 THEN 'Жилой дом'
               ELSE 'объект ' || CAST(event_id AS VARCHAR(20)) END AS "Объект",
           CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 13 = 1 THEN '{not json'
               ELSE '{"coordinates": [' || CAST(event_id % 180 AS VARCHAR(20)) || ', ' || CAST(user_id % 90 AS VARCHAR(20))
                    || '], "type": "Point"}' END AS map_json,
           CASE WHEN event_id % 7 <> 0 THEN '[{"id": "' || CAST(event_id % 3 AS VARCHAR(20)) || '", "value": "'
               || event_type || '"}, {"id": "9", "value": "ансамбль"}]' END AS kind_json,
           """ + _DOCUMENTS + """ AS docs_json,
           CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN '{"title": "фасад"}'
               ELSE '{"url": "http://h/' || CAST(event_id AS VARCHAR(20)) || '", "preview": "p", "title": "вид"}' END
               AS image_json,
           CASE event_id % 12 WHEN 0 THEN 'XVIII век' WHEN 1 THEN 'Начало XIX в.' WHEN 2 THEN 'вторая половина ХХ века'
               WHEN 3 THEN 'кон. XIX - нач. XX вв.' WHEN 4 THEN '1942 - 1943 годы' WHEN 5 THEN NULL
               WHEN 6 THEN 'эпоха бронзы' WHEN 7 THEN 'nan' WHEN 8 THEN 'I пол. XIX в. ' WHEN 9 THEN '-'
               WHEN 10 THEN 'Последняя четверть XVIII' ELSE 'середина XIX века' END AS construction_date,
           CASE event_id % 6 WHEN 0 THEN '0019-02-30' WHEN 1 THEN 'дата неизвестна' WHEN 2 THEN NULL
               ELSE SUBSTR(CAST(ts AS VARCHAR(30)), 1, 10) END AS doc_date,
           CASE event_id % 5 WHEN 0 THEN 'не утвержден' WHEN 1 THEN 'Не утвержден.' WHEN 2 THEN NULL
               WHEN 3 THEN 'Предмет охраны не утвержден' ELSE 'Предмет охраны ' || event_type END AS object_description,
           CASE event_id % 6 WHEN 0 THEN 'Не утверждены.' WHEN 1 THEN 'не утверждены' WHEN 2 THEN 'Границы территории не утверждены.'
               WHEN 3 THEN 'Не утверждены' WHEN 4 THEN NULL ELSE 'Граница ' || event_type END AS object_border_description,
           CASE WHEN event_id % 20 = 0 THEN event_type END AS sparse_95, CAST(NULL AS VARCHAR(20)) AS all_null,
           CASE WHEN event_id % 9 <> 0 THEN 'Памятник' || CASE user_id % 3 WHEN 0 THEN ' археологии' ELSE '' END END AS kind
    FROM {events}""")
_view("cars", """
    SELECT CASE EXTRACT(YEAR FROM l_shipdate) % 2 WHEN 0 THEN 2018 ELSE 2019 END AS year,
           CASE EXTRACT(MONTH FROM l_shipdate) WHEN 1 THEN 'Январь' WHEN 2 THEN 'Февраль' WHEN 3 THEN 'Март'
               WHEN 4 THEN 'Апрель' WHEN 5 THEN 'Май' WHEN 6 THEN 'Июнь' WHEN 7 THEN 'Июль' WHEN 8 THEN 'Август'
               WHEN 9 THEN 'Сентябрь' END AS month,
           CASE l_suppkey % 6 WHEN 0 THEN 'ТОО Astana Motors' WHEN 1 THEN 'Astana  Motors' WHEN 2 THEN 'astana motors'
               WHEN 3 THEN 'Toyota Motor' WHEN 4 THEN '#Н/Д' ELSE '0' END AS company,
           'Brand ' || CAST(l_partkey % 12 AS VARCHAR(20)) AS brand,
           ' M' || CAST(l_partkey % 60 AS VARCHAR(20)) || CASE l_orderkey % 3 WHEN 0 THEN ' ' ELSE '' END AS model,
           CASE l_partkey % 5 WHEN 0 THEN 'A класс' WHEN 1 THEN 'B класс' WHEN 2 THEN 'C класс' ELSE 'SUV' END
               AS car_classification,
           CASE WHEN l_orderkey % 6 = 0 THEN NULL WHEN l_orderkey % 6 = 1 THEN '2 018' WHEN l_partkey % 60 < 30 THEN '2019'
               WHEN l_orderkey % 6 = 2 THEN 'n2018a'
               ELSE CAST(2010 + l_orderkey % 9 AS VARCHAR(20)) END AS manufacturing_year,
           CASE l_suppkey % 5 WHEN 0 THEN 'Республика Казахстан' WHEN 1 THEN 'Казахстан' WHEN 2 THEN 'UK'
               WHEN 3 THEN 'Российская Федерация' ELSE 'Япония' END AS manufacturing_country,
           CASE l_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '1,6' WHEN 2 THEN 'электро' WHEN 3 THEN 'ДИЗЕЛЬ '
               WHEN 4 THEN '2' ELSE 'бензин' END AS fuel_type,
           CASE l_orderkey % 9 WHEN 0 THEN '1,6' WHEN 1 THEN '2,0 л' WHEN 2 THEN '' WHEN 3 THEN '2.5.' WHEN 4 THEN NULL
               ELSE '1.8' END AS engine_displacement_l,
           CASE WHEN l_orderkey % 4 = 0 THEN NULL
               WHEN l_partkey % 60 < 40 THEN CASE l_suppkey % 4 WHEN 0 THEN 'АКПП' WHEN 1 THEN '6 АКПП' WHEN 2 THEN 'A/T' ELSE 'А' END
               ELSE CASE l_orderkey % 7 WHEN 0 THEN 'МКПП' WHEN 1 THEN '5М/T' WHEN 2 THEN 'S-Tronic' WHEN 3 THEN 'CVT (вариатор)'
                    WHEN 4 THEN '#Н/Д' WHEN 5 THEN 'РЕДУКТОР' ELSE 'АКПП' END END AS transmission_type,
           CASE l_partkey % 60 % 9 WHEN 0 THEN '4x2' WHEN 1 THEN 'Передний (FF)' WHEN 2 THEN 'quattro' WHEN 3 THEN 'AWD' WHEN 4 THEN '#Н/Д'
               WHEN 5 THEN CASE l_orderkey % 2 WHEN 0 THEN 'Задний' END ELSE CASE l_orderkey % 3 WHEN 0 THEN '2 WD' WHEN 1 THEN 'полный' END END
               AS drive_type,
           CASE l_orderkey % 10 WHEN 0 THEN 'кредит' WHEN 1 THEN 'лизинг' WHEN 2 THEN 'Безналичная ' WHEN 3 THEN 'б/н' WHEN 4 THEN 'нал'
               WHEN 5 THEN 'Без оплаты' WHEN 6 THEN NULL WHEN 7 THEN 'trade-in' ELSE 'наличный' END AS payment_form,
           CASE WHEN l_orderkey % 8 <> 0 THEN CASE l_orderkey % 9 WHEN 0 THEN 'Физическое лицо' WHEN 1 THEN 'ФизЛицо'
               WHEN 2 THEN 'физ.лицо' WHEN 3 THEN 'Юр. Лицо' WHEN 4 THEN 'Корп. клиент' ELSE 'Юридическое лицо' END END AS customer_type,
           CASE WHEN l_orderkey % 31 = 1 THEN -1 WHEN l_orderkey % 31 <> 0 THEN CAST(l_linenumber % 3 + 1 AS INTEGER) END AS quantity,
           CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) AS VARCHAR(20)) || ',5' AS price_usd,
           CASE l_linenumber WHEN 7 THEN '0' WHEN 6 THEN '-35588'
               ELSE CAST(CAST(FLOOR(l_extendedprice * 2) AS BIGINT) AS VARCHAR(20)) || ',25' END AS sale_usd,
           'Город ' || CAST(l_suppkey % 15 AS VARCHAR(20)) AS city, CASE l_suppkey % 5 WHEN 0 THEN 'Auto trader' WHEN 1 THEN ' ДЦ ' ELSE 'ДЦ ' END || CASE l_suppkey % 5 WHEN 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR(20)) END AS dealer,
           CASE l_suppkey % 4 WHEN 0 THEN 'Коммерческие' WHEN 1 THEN 'Пикапы' WHEN 2 THEN 'Минивэны' ELSE 'Легковые автомобили' END
               AS car_type,
           CASE l_suppkey % 3 WHEN 0 THEN 'Местное' ELSE 'Импорт' END AS assembly
    FROM {lineitem}""")

# classes of models: A to F, sports cars, five sizes of off-roaders, pick-ups; lorries by displacement
_SIZES = ["A", "B", "C", "D", "E", "F", "S", "B-SUV", "C-SUV", "D-SUV", "E-SUV", "F-SUV", "Пикап"]
_CLASS_OF = "CASE p_partkey % 60 % 13 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_SIZES)) + " END"
_MODEL = "'M' || CAST(p_partkey % 60 AS VARCHAR(20))"
_view("class_rules", f"""
    SELECT DISTINCT {_CLASS_OF} AS class, {_MODEL} AS member, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high,
           9 AS priority
    FROM {{part}} WHERE p_partkey % 60 < 56
    UNION ALL SELECT DISTINCT 'Среднетоннажные грузовики', {_MODEL}, 1.8e0, 2.4e0, 2 FROM {{part}} WHERE p_partkey % 60 % 7 = 3
    UNION ALL SELECT DISTINCT 'Крупнотоннажные грузовики', {_MODEL}, 2.0e0, CAST(NULL AS DOUBLE), 1 FROM {{part}} WHERE p_partkey % 60 % 14 = 3
    UNION ALL SELECT DISTINCT 'A', 'M99x', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 9 FROM {{part}} WHERE p_partkey = 1""")

# --- audience, channels, donations, experiments ------------------------------------------
_view("visits", """
    SELECT event_id AS visit_id, user_id, ts AS visited_at, 'source ' || CAST(event_id % 14 AS VARCHAR(20)) AS source,
           CASE user_id % 3 WHEN 0 THEN 'Mac' WHEN 1 THEN 'PC' ELSE 'Android' END AS device,
           CASE user_id % 4 WHEN 0 THEN 'France' WHEN 1 THEN 'UK' ELSE 'Germany' END AS country
    FROM {events}""")
_view("payments", "SELECT user_id, ts AS paid_at, value AS amount FROM {events} WHERE event_type = 'purchase'")
_view("ad_costs", """
    SELECT 'source ' || CAST(event_id % 14 AS VARCHAR(20)) AS source, CAST(ts AS DATE) AS day,
           SUM(CAST(ROUND(value * 20) AS BIGINT)) AS cost_cents
    FROM {events} WHERE event_type = 'click' GROUP BY 1, 2""")
_view("donations", """
    SELECT o_orderkey AS donation_id, o_custkey AS donor_id, o_orderdate AS donated_at, o_totalprice AS amount,
           CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'cancelled' END AS status,
           SUBSTR(o_orderpriority, 3) AS campaign, n_name AS region
    FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey""")
_view("gifts", """
    SELECT event_id AS donation_id, user_id AS donor_id, ts AS donated_at, value AS amount, 'success' AS status
    FROM {events} WHERE event_type = 'purchase'""")
_view("attempts", """
    SELECT user_id AS donor_id, ts AS tried_at, CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status
    FROM {events}""")
_view("companies", """
    SELECT c_custkey AS company_id, c_mktsegment AS tariff, 1 + c_custkey % 30 AS staff FROM {customer}""")
_view("company_orders", "SELECT o_custkey AS company_id, o_orderdate AS ordered_at FROM {orders}")
_view("counterparties", """
    SELECT o_custkey AS company_id, l_suppkey AS counterparty_id FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey""")
_view("talks", """
    SELECT doc_id AS talk_id, source AS speaker, n_chars AS seconds,
           CASE doc_id % 5 WHEN 0 THEN 'writer, designer' WHEN 1 THEN 'writer' WHEN 2 THEN 'physicist' WHEN 3 THEN NULL
               ELSE 'designer,physicist' END AS occupation
    FROM {documents}""")
_view("emails", """
    SELECT user_id, event_id % 400 AS message_id,
           CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'opened' WHEN 'purchase' THEN 'clicked' END AS stage,
           'campaign ' || CAST(event_id % 5 AS VARCHAR(20)) AS campaign, value AS amount
    FROM {events} WHERE event_type IN ('view', 'click', 'purchase')""")
# a participant is a user on one day of the log's month, so that a step is not taken by all of them
_view("experiment", """
    SELECT user_id * 100 + CAST(EXTRACT(DAY FROM ts) AS INTEGER) AS user_id, ts, event_type, CASE user_id % 2 WHEN 0 THEN 'A' ELSE 'B' END AS grp, r_name AS region
    FROM {events} JOIN {region} ON r_regionkey = user_id % 5""")
_view("promos", """
    SELECT 'promo ' || CAST(r_regionkey AS VARCHAR(20)) AS name, r_name || ', EUROPE' AS regions,
           DATE '2023-12-20' + CAST(r_regionkey * 6 AS INTEGER) AS start_dt,
           DATE '2023-12-25' + CAST(r_regionkey * 6 AS INTEGER) AS finish_dt
    FROM {region}""")

_NAME = re.compile(r"\{([a-z_]+)\}")
_QUOTED = re.compile(r' AS "([^"{}]+)"')  # quoted names become back-ticked ones for Spark

_SCHEMAS: dict = {}  # footers are read once per process and path


def dependencies(sql: str) -> list[str]:
    return sorted(set(_NAME.findall(sql)))


class Bound:
    """Lazily bound tables of one data folder: ``Bound(spark, path).events``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def _scan(self, path: str) -> DataFrame:
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            df = self._scan(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEWS:
            needed = dependencies(VIEWS[name])
            sql = _QUOTED.sub(r" AS `\1`", VIEWS[name]).replace("{", "{{").replace("}", "}}")
            for table in needed:
                sql = sql.replace("{{" + table + "}}", "{" + table + "}")
            df = self.spark.sql(sql, **{d: getattr(self, d) for d in needed})
        else:
            raise AttributeError(name)
        self.__dict__[name] = df  # read footers and parse once per query
        return df


def view_sql(name: str) -> str:
    """The view as a common table expression for the checking database."""
    return f"{name} AS ({_NAME.sub(r'\1', VIEWS[name])})".replace("TIMESTAMP_NTZ", "TIMESTAMP")
