"""Rules that the test tables do not exercise: nulls, ties, text, rounding, empty input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import jsontext, numbers, text
from ledgerline.operators import cleaning, profile, relational
from ledgerline.plans import cars, credit, delivery, economics, flats, forum, heritage

D = dt.datetime


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def values(spark, column, *inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_null_in_the_excluded_set_does_not_empty_the_result(spark):
    orders = spark.createDataFrame([(1,), (2,), (None,)], "order_id int")
    cancelled = spark.createDataFrame([(2,), (2,), (None,)], "order_id int")
    assert rows(relational.drop_matching(orders, cancelled, "order_id"), "order_id") == [(1,)]
    assert rows(relational.keep_matching(orders, cancelled, "order_id"), "order_id") == [(2,)]


def test_basket_lines_keep_repeats_and_drop_empty_arrays(spark):
    orders = spark.createDataFrame(
        [(1, [10, 10, 11]), (2, []), (3, None)], "order_id int, product_ids array<int>"
    )
    assert rows(economics.basket_lines(orders), "order_id", "product_id") == [(1, 10), (1, 10), (1, 11)]


def test_priced_orders_and_revenue(spark):
    actions = spark.createDataFrame(
        [(1, 1, "create_order", D(2022, 8, 24)), (1, 2, "create_order", D(2022, 8, 24)),
         (1, 2, "cancel_order", D(2022, 8, 24)), (2, 3, "create_order", D(2022, 8, 25))],
        "user_id int, order_id int, action string, time timestamp",
    )
    orders = spark.createDataFrame(
        [(1, D(2022, 8, 24, 10), [1, 1]), (2, D(2022, 8, 24, 11), [2]), (3, D(2022, 8, 25, 1), [1, 2])],
        "order_id int, creation_time timestamp, product_ids array<int>",
    )
    products = spark.createDataFrame([(1, "сахар", 110.0), (2, "чай", 120.0)], "product_id int, name string, price double")
    priced = economics.priced_orders(
        actions, orders, economics.basket_lines(orders), products, economics.REDUCED_RATE_GOODS
    )
    assert rows(priced, "order_id", "order_cents", "tax_cents") == [(1, 22000, 2000), (3, 23000, 3000)]
    assert rows(economics.daily_revenue(priced), "revenue", "total_revenue", "revenue_change") == [
        (220.0, 220.0, None), (230.0, 450.0, 4.55),
    ]
    couriers = spark.createDataFrame(
        [(7, 1, "deliver_order", D(2022, 8, 24, 12)), (7, 3, "deliver_order", D(2022, 8, 25, 12))],
        "courier_id int, order_id int, action string, time timestamp",
    )
    day = rows(economics.gross_profit(priced, couriers), "date", "costs", "tax", "gross_profit")[0]
    assert day == (dt.date(2022, 8, 24), 120000.0 + 140 + 150, 20.0, 220.0 - (120290.0 + 20.0))


def test_bonus_needs_five_deliveries_and_known_month(spark):
    priced = spark.createDataFrame(
        [(i, D(2022, m, 1, 9), 100, 10) for m in (9, 10) for i in range(5)],
        "order_id int, creation_time timestamp, order_cents bigint, tax_cents bigint",
    )
    couriers = spark.createDataFrame(
        [(7, i, "deliver_order", D(2022, m, 1, 12)) for m in (9, 10) for i in range(5)],
        "courier_id int, order_id int, action string, time timestamp",
    )
    got = sorted(rows(economics.gross_profit(priced, couriers), "date", "costs"), key=lambda r: r[0])
    assert got == [(dt.date(2022, 9, 1), 150000.0 + 5 * 115 + 5 * 150 + 500), (dt.date(2022, 10, 1), None)]


def test_rows_without_user_keep_their_place(spark):
    posts = spark.createDataFrame(
        [("a", None, 4, D(2024, 1, 1)), ("b", None, 5, D(2024, 1, 2)), ("c", 1, 7, D(2024, 1, 1))],
        "title string, user_id int, score int, creation_date timestamp",
    ).withColumn("views_count", F.col("score"))
    assert rows(forum.average_score(posts), "title", "avg_score") == [("a", 5.0), ("b", 5.0), ("c", 7.0)]
    assert rows(forum.cumulative_views(posts), "user_id", "cum_sum") == [(1, 7), (None, 4), (None, 9)]
    actions = spark.createDataFrame(
        [(None, 1, "create_order", D(2024, 1, 1)), (5, 2, "create_order", D(2024, 1, 1)), (5, 3, "create_order", D(2024, 1, 1)),
         (6, 4, "create_order", D(2024, 1, 1))],
        "user_id int, order_id int, action string, time timestamp",
    )
    assert rows(delivery.newcomers(actions, "user_id", "new", "total"), "new", "total") == [(2, 2)]
    assert rows(delivery.single_or_several(actions), "single_order_users_share") == [(50.0,)]
    assert rows(delivery.first_orders(actions), "orders", "first_orders", "new_users_orders") == [(4, 2, 4)]


def test_rounding_rules(spark):
    x = F.col("x")
    assert values(spark, numbers.half_up(x), 0.5, 1.5, 2.5, -0.5, kind="double") == [1.0, 2.0, 3.0, -1.0]
    assert values(spark, numbers.half_even(x), 0.5, 1.5, 2.5, kind="double") == [0.0, 2.0, 2.0]
    assert values(spark, numbers.half_up(x, 2), 1.005, kind="double") == [1.01]
    assert values(spark, numbers.ratio(x, F.lit(0)), 1.0, kind="double") == [None]


def test_dirty_numbers(spark):
    got = values(spark, numbers.try_number("x"), "1,6", "2\xa0018", "12 л", "", "abc", None, "-35588", "nan")
    assert got == [1.6, 2018.0, 12.0, None, None, None, -35588.0, None]


def test_cyrillic_survives_cleaning(spark):
    assert values(spark, text.spaced_words("x"), "г.Тегеран (Иран)!", None) == [" Г ТЕГЕРАН ИРАН ", " "]
    assert values(spark, text.bare_word("x"), " завершена. !") == ["ЗАВЕРШЕНА"]


def test_masks_match_whole_words_in_order(spark):
    masks = ["% ИРАН %", "% ПОЛУЧЕНИЕ% КРЕДИТА %", "a_c%"]
    inputs = ["Иран", "иранский", "получение целевого кредита", "кредита получение", None, "a.b"]
    assert values(spark, text.matches_any("x", masks), *inputs) == [1, 0, 1, 0, 0, 0]
    assert text.like_pattern("a_c%") == "^a.c"


def test_text_helpers(spark):
    assert values(spark, text.capitalize("x"), "АИ 92 ДИЗЕЛЬ", "") == ["Аи 92 дизель", ""]
    assert values(spark, text.replace_whole("x", {"a": "b", "z": None}), "a", "ab", "z", None) == ["b", "ab", None, None]
    assert values(spark, text.lower_except("x", "IXVХ"), "Начало XIX В.", "ХХ Век") == ["начало XIX в.", "ХХ век"]


def test_construction_dates(spark):
    pairs = {
        "Середина XIX века": "сер. XIX в.",
        "кон. XIX - нач. XX вв.": "кон. XIX-нач. XX вв.",
        "nan": None,
        "-": "дата создания (возникновения) не определена",
        "1942 - 1943 годы": "1942-1943 гг.",
        "Вторая половина XIX в.": "2-я пол. XIX в.",
    }
    df = spark.createDataFrame([(k, k) for k in pairs], "raw string, construction_date string")
    assert dict(rows(heritage.normalized(df), "raw", "construction_date")) == pairs


def test_dates_outside_the_range_are_null(spark):
    got = values(spark, heritage.coerced_date("x"), "2020-02-29", "2021-02-29", "1500-01-01", "?", None)
    assert got == [dt.date(2020, 2, 29), None, None, None, None]


def test_json_columns(spark):
    df = spark.createDataFrame(
        [(1, '{"type": "Point", "n": 3}'), (2, "{oops"), (3, None)], "id int, j string"
    )
    wide = jsontext.json_columns(df, "j", "type string, n int")
    assert rows(wide, "id", "type", "n") == [(1, "Point", 3), (2, None, None), (3, None, None)]
    assert values(spark, jsontext.first_item("x", "id"), '[{"id": "5"}]', "[]", "nan", None) == ["5", None, None, None]
    assert values(spark, jsontext.json_get("x", "url"), '{"url": "u"}', "{}", "nan", None) == ["u", "", "", ""]


def test_sparse_columns(spark):
    df = spark.createDataFrame([(i, None, "x" if i == 0 else None) for i in range(10)], "a int, b string, c string")
    assert cleaning.prune_sparse(df, 0.9).columns == ["a"]
    assert cleaning.prune_sparse(df, 1.0).columns == ["a", "c"]


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], ["﻿  userID", "  City  "])
    assert cleaning.normalize_columns(df, {"userid": "user_id"}).columns == ["user_id", "city"]


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert rows(profile.duplicate_report(df), "row_cnt", "distinct_rows", "duplicate_rows") == [(3, 2, 1)]
    assert cleaning.dedupe(df).count() == 2


def test_mode_gate(spark):
    data = [("a", "m", v) for v in (1, 1, 2, None)] + [("b", "m", v) for v in (1, 2, None)] + [(None, "m", 7), (None, "m", None)]
    df = spark.createDataFrame(data, "brand string, model string, v int")
    filled = cleaning.impute_mode(df, "v", ["brand", "model"], 60.0)
    assert rows(filled.filter("v is null"), "brand") == [("b",)]
    assert filled.filter("brand is null and v = 7").count() == 2
    kept = cleaning.impute_mode(df, "v", ["brand", "model"], 60.0, max_null_percent=20.0)
    assert kept.filter("v is null").count() == 3


def test_median_fill_keeps_null_groups_apart(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), (None, 9.0), (None, None)], "g string, v double")
    assert rows(cleaning.impute_median(df, "v", ["g"]), "g", "v") == [
        ("a", 1.0), ("a", 2.5), ("a", 4.0), (None, 9.0), (None, 9.0),
    ]


def test_unknown_children_stay(spark):
    df = spark.createDataFrame(
        [(None, 5.0, "B", "x", 0, 1.0), (20, 5.0, "B", "x", 0, 1.0), (-1, 5.0, "B", "x", 0, 1.0)],
        "children int, days_employed double, education string, income_type string, debt int, total_income double",
    )
    assert rows(credit.clean(df), "children", "education") == [(None, "b")]


def test_income_bands_and_purposes(spark):
    got = values(spark, text.band("x", credit.INCOME_BANDS, "A"), 30000.0, 30001.0, 1e6, 2e6, kind="double")
    assert got == ["E", "D", "B", "A"]
    got = values(spark, text.categorize("x", credit.PURPOSES, "другое"), "автомобили", "жилье", "дача")
    assert got == ["операции с автомобилем", "операции с недвижимостью", "другое"]


def test_ceiling_repair_keeps_unknown_heights(spark):
    df = spark.createDataFrame(
        [(h, "ё") for h in (25.0, 1.9, 10.0, None, 2.0, 100.0)], "ceiling_height double, locality_name string"
    )
    for c in ("total_area", "living_area", "balcony", "floors_total", "days_exposition"):
        df = df.withColumn(c, F.lit(2.5))
    df = df.withColumns(
        {"is_apartment": F.lit(None).cast("boolean"), "last_price": F.lit(10.9),
         "first_day_exposition": F.lit("2019-03-01T00:00:00")}
    )
    got = rows(flats.clean(df), "ceiling_height", "last_price", "days_exposition", "locality_name")
    assert [r[0] for r in got] == [2.0, 2.5, None] and set(got[0][1:]) == {10, 2, "е"}


def test_month_ends_are_clamped(spark):
    users = spark.createDataFrame([(1, "ann", D(2024, 1, 31))], "id int, display_name string, creation_date timestamp")
    posts = spark.createDataFrame(
        [(i, 1, 2, D(2024, 2, 29)) for i in range(2)] + [(9, 1, 2, D(2024, 3, 1))],
        "id int, user_id int, post_type_id int, creation_date timestamp",
    )
    kinds = spark.createDataFrame([(2, "Answer")], "id int, type string")
    assert rows(forum.early_helpers(posts, users, kinds, 1), "display_name", "user_ids") == [("ann", 1)]
    assert forum.early_helpers(posts, users, kinds, 2).count() == 0


def test_first_posts_at_the_same_moment_all_count(spark):
    users = spark.createDataFrame([(1, D(2024, 1, 1))], "id int, creation_date timestamp")
    posts = spark.createDataFrame([(1, D(2024, 1, 2))] * 2 + [(1, D(2024, 1, 3))], "user_id int, creation_date timestamp")
    assert rows(forum.time_to_first_post(posts, users), "user_id", "seconds") == [(1, 86400.0)] * 2


def test_last_day_is_cut_at_midnight(spark):
    posts = spark.createDataFrame(
        [(1, D(2008, 12, 31)), (2, D(2008, 12, 31, 0, 1)), (3, D(2008, 11, 1))], "id int, creation_date timestamp_ntz"
    )
    got = rows(forum.monthly_change(posts, "2008-09-01", "2008-12-31"), "month_number", "posts", "percent_changes")
    assert got == [(11, 1, None), (12, 1, 0.0)]


def test_car_rules(spark):
    df = spark.createDataFrame(
        [(1, None), (3, None), (None, "x"), (2, "y")], "quantity int, customer_type string"
    )
    assert rows(cars.customer_filled(df), "quantity", "customer_type") == [
        (1, cars.PERSON), (1, cars.PERSON), (2, "y"), (3, cars.FIRM),
    ]
    months = spark.createDataFrame([(2019, "Март"), (2019, "Декабрь")], "year int, month string")
    assert rows(months.select(cars.purchase_date().alias("d")), "d") == [(None,), (dt.date(2019, 3, 1),)]


def test_reclassify_reports_typos_and_changes(spark):
    df = spark.createDataFrame([("Picanto", "A класс", 1.0), ("Rio", "C", 1.4)], "model string, cls string, litres double")
    listed = [("A", "Picanto", None, None, 1), ("A", "Pikanto", None, None, 1)]
    rules = spark.createDataFrame(listed, "class string, member string, low double, high double, priority int")
    after = cleaning.reclassify(df, rules, "model", "cls", "litres")
    assert rows(after, "model", "cls") == [("Picanto", "A"), ("Rio", "C")]
    assert rows(cleaning.unknown_members(df, "model", rules), "model") == [("Pikanto",)]
    assert rows(cleaning.class_audit(df, after, "model", "cls"), "class_before", "class_after") == [("A класс", "A"), ("C", "C")]


def test_masked_assignments_run_in_order(spark):
    df = spark.createDataFrame([(1,)], "v int")
    rules = [(F.col("v") == 1, F.lit(2)), (F.col("v") == 2, F.lit(3))]
    assert cleaning.reset_where(df, "v", rules).first().v == 3


def test_share_of_total_adds_up(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "k string, n int")
    assert sum(r.s for r in relational.share_of_total(df, "n", "s").collect()) == pytest.approx(100)


def test_histogram_includes_both_ends(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (11.0,), (None,)], "v double")
    assert rows(profile.histogram(df, "v", 0, 10, 2), "bin", "cnt", "bin_start") == [(1, 1, 0.0), (2, 2, 5.0)]


def test_groups_without_key_are_dropped_from_pivots(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0)], "g string, v double")
    assert rows(profile.group_stats(df, "v", ["g"], total=True), "g", "cnt", "mean", "median", "sum") == [("a", 2, 1.5, 1.5, 3.0)]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert profile.group_stats(empty, "v", ["g"]).count() == 0
    assert cleaning.impute_median(empty, "v", ["g"]).count() == 0
    assert profile.null_profile(empty).count() == 2
