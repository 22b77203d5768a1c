"""Moving frames, overlap joins, bitmaps, bucketed tables, SQL functions, class rules and narrowed quantiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import selection
from ledgerline.operators.cleaning import reclassify, set_own_mode, unknown_members
from ledgerline.operators.ordered import sliding
from ledgerline.operators.profile import describe, iqr_report
from ledgerline.operators.relational import overlap_join
from ledgerline.plans import cohorts, engagement, screening


@pytest.mark.parametrize("before,after", [(0, 0), (2, 0), (6, 3), (0, 5), (60, 40), (2000, 2000)])
def test_sliding_frames_over_chunk_edges(many_chunks, before, after):
    rnd = random.Random(before * 7 + after)
    # one key holds most of the rows, some keys have one; a null key is a key
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), i, rnd.randrange(100) if i % 9 else None) for i in range(500)]
    rnd.shuffle(rows)
    df = many_chunks.createDataFrame(rows, "k string, t int, v int")
    got = sliding(df, ["k"], ["t"], before, after, {"total": F.sum("v"), "n": F.count("*")}).collect()
    assert len(got) == len(rows)
    by_key = {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(k, []).append((t, v))
    want = {}
    for k, vs in by_key.items():
        for i, (t, _) in enumerate(vs):
            frame = [v for _, v in vs[max(i - before, 0) : i + after + 1]]
            known = [v for v in frame if v is not None]
            want[k, t] = (sum(known) if known else None, len(frame))
    assert {(r.k, r.t): (r.total, r.n) for r in got} == want


def test_sliding_without_keys_or_rows(many_chunks):
    df = many_chunks.range(100).select(F.col("id").alias("t"), F.lit(1).alias("v"))
    got = sliding(df, [], ["t"], 3, 0, {"n": F.sum("v")}).collect()
    assert sorted((r.t, r.n) for r in got) == [(i, min(i, 3) + 1) for i in range(100)]
    assert sliding(df.filter("false"), [], ["t"], 3, 0, {"n": F.sum("v")}).collect() == []


def test_overlaps_count_once_also_on_strip_edges(spark):
    rnd = random.Random(2)
    # spans that start and end on the edges of strips of five days, and elsewhere; one key has most rows
    def span():
        a = rnd.choice([0, 5, 10, 15, 20, 4, 9, 14, rnd.randrange(30)])
        return a, a + rnd.choice([0, 0, 1, 5, 10, 4, 12, -3])

    left = [(i, rnd.choice(["hot"] * 5 + ["x", None]), *span()) for i in range(80)]
    right = [(i, rnd.choice(["hot"] * 5 + ["x", None]), *span()) for i in range(60)] + [(99, "hot", None, 5)]

    def frame(rows, tag):
        df = spark.createDataFrame(rows, f"{tag} int, k string, a int, b int")
        return df.select(tag, "k", *[F.date_add(F.lit("1969-12-25").cast("date"), F.col(c)).alias(f"{tag}_{c}") for c in "ab"])

    got = overlap_join(frame(left, "l"), frame(right, "r"), ["k"], ("l_a", "l_b"), ("r_a", "r_b"), 5)
    want = sorted(
        (i, j) for i, k, a, b in left for j, m, c, d in right
        if k is not None and k == m and c is not None and a <= b and c <= d and a <= d and c <= b
    )
    assert sorted((r.l, r.r) for r in got.collect()) == want and want
    assert got.columns == ["l", "k", "l_a", "l_b", "r", "r_a", "r_b"]
    moments = overlap_join(frame(left, "l"), frame(right, "r"), ["k"], ("l_a", "l_a"), ("r_a", "r_b"), 5)
    want = sorted(
        (i, j) for i, k, a, _ in left for j, m, c, d in right if k is not None and k == m and c is not None and c <= a <= d
    )
    assert sorted((r.l, r.r) for r in moments.collect()) == want


def test_bitmaps_over_several_buckets(spark):
    """More users than a bitmap holds; a user may come on several days, and on a day several times."""
    visits = spark.range(70_000).select(
        (F.col("id") * 3 % 40_009).alias("user_id"),
        F.expr("timestamp_ntz'2024-01-29 10:00:00' + make_interval(0, 0, 0, cast(id % 10 as int))").alias("visited_at"),
    )
    got = engagement.active_users(visits.union(visits.limit(500))).first()
    days = visits.select("user_id", F.to_date("visited_at").alias("d"))
    mean = lambda p: days.groupBy(p.alias("p")).agg(F.countDistinct("user_id").alias("n")).agg(F.avg("n")).first()[0]
    assert got.dau == round(mean(F.col("d")), 2)
    assert got.wau == round(mean(F.trunc("d", "week")), 2) and got.mau == round(mean(F.trunc("d", "month")), 2)
    buckets = engagement.user_bitmaps(engagement.user_days(visits))
    assert buckets.select("bucket").distinct().count() == 2


def test_cohorts_of_bucketed_tables_do_not_shuffle_by_user(spark):
    log = [(i, i % 40, f"2024-01-{1 + (i * 7) % 25:02d} 0{i % 9}:00:00", f"s{i % 3}", "PC", ["UK", "France"][i % 40 % 2]) for i in range(400)]
    visits = spark.createDataFrame(log, "visit_id int, user_id int, at string, source string, device string, country string")
    visits = visits.withColumn("visited_at", F.col("at").cast("timestamp_ntz")).drop("at")
    payments = visits.select("user_id", F.col("visited_at").alias("paid_at"), F.lit(1.25).alias("amount"))
    tables = cohorts.bucketed_log(visits, payments, 3)
    got = cohorts.cohort_curve_of_days(*tables, "2024-01-30", 14, ["country"])
    want = cohorts.cohort_curve(engagement.first_visits(visits), visits, payments, "2024-01-30", 14, ["country"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = cohorts.cohort_curve_of_days(*tables, "2024-01-30", 14, ["country"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "hashpartitioning(user_id" not in plan and "Bucketed: true" in plan and "SortMergeJoin" in plan


def test_list_functions_are_dropped_again(spark):
    rows = spark.createDataFrame([("1", "г. Иран", "irn", "Кредит"), ("2", None, None, None)], "operation_id string, location string, counterparty_bank_country_code string, payment_purpose string")
    found = screening.list_flags_in_sql(rows)
    functions = {f.name for f in spark.catalog.listFunctions()}
    assert not functions & set(screening.LIST_FUNCTIONS)
    assert sorted(map(tuple, found.collect())) == [("1", 1, 1, 1, 0), ("2", 0, 0, 0, 0)]
    spark.sql("CREATE TEMPORARY FUNCTION is_credit(x INT) RETURNS INT RETURN x + 1")
    try:
        with pytest.raises(Exception, match="is_credit|exist"):
            screening.list_flags_in_sql(rows)
        assert spark.sql("SELECT is_credit(1)").first()[0] == 2
        assert "in_country_list" not in {f.name for f in spark.catalog.listFunctions()}
    finally:
        spark.sql("DROP TEMPORARY FUNCTION is_credit")


RULES = "class string, member string, low double, high double, priority int"


def test_class_rules(spark):
    rules = spark.createDataFrame([
        ("whole", "a", None, None, 9), ("low", "a", 1.0, 2.0, 2), ("mid", "a", 2.0, 3.0, 2), ("first", "a", 1.5, 2.5, 1),
        ("up", "b", 2.0, None, 1), ("down", "b", None, 2.0, 1), ("tie 2", "c", None, None, 1), ("tie 1", "c", None, None, 1),
        ("tie 1", "c", None, None, 1), ("never", "zz", None, None, 1), ("nobody", None, None, None, 1),
    ], RULES)
    rows = [("a", x) for x in (0.9, 1.0, 1.49, 1.5, 2.49, 2.5, 3.0, None)] + [("b", x) for x in (1.9, 2.0, None)]
    rows += [("c", 1.0), ("d", 1.0), (None, 1.0)]
    cars = spark.createDataFrame([(m, x, "old") for m, x in rows], "model string, litres double, class string")
    got = [(r.model, r.litres, r["class"]) for r in reclassify(cars, rules, "model", "class", "litres").collect()]
    want = ["whole", "low", "low", "first", "first", "mid", "whole", "whole", "down", "up", "old", "tie 1", "old", "old"]
    assert sorted(got, key=repr) == sorted([(m, x, c) for (m, x), c in zip(rows, want)], key=repr)
    assert [r.model for r in unknown_members(cars, "model", rules).collect()] == ["zz"]


def test_real_modes_replace_wrong_values(spark):
    rows = [("n", 1.7), ("n", 1.7), ("n", 9.9), ("n", None), ("m", 2.0), ("m", 3.0), ("e", None)]
    df = spark.createDataFrame(rows, "model string, litres double")
    got = sorted(map(tuple, set_own_mode(df, "litres", "model", ["n", "e"]).collect()), key=repr)
    assert got == sorted([("n", 1.7)] * 4 + [("m", 2.0), ("m", 3.0), ("e", None)], key=repr)


def samples():
    rng = np.random.default_rng(5)
    return {
        "even": rng.normal(size=5000).tolist(),
        "tail": np.exp(rng.normal(size=5000) * 9).tolist(),
        "few": rng.integers(0, 4, 5000).astype(float).tolist(),
        "one": [3.5] * 5000,
        "gaps": [float(x) if i % 3 else None for i, x in enumerate(rng.integers(-9, 10**9, 5000))],
        "none": [None] * 5000,
        "last": [1.0, 2.0] + [None] * 4998,
    }


def wanted(values, p):
    known = [v for v in values if v is not None]
    return float(np.quantile(known, p)) if known else None


PROBS = {"q0": 0.0, "q1": 0.25, "median": 0.5, "odd": 0.9137, "q4": 1.0}


@pytest.mark.parametrize("way", ["plain", "coarse", "narrowed", "sketch off"])
def test_narrowed_quantiles(spark, monkeypatch, way):
    data = samples()
    if way != "plain":
        monkeypatch.setattr(selection, "ACCURACY", 100)
    if way == "narrowed":
        monkeypatch.setattr(selection, "INSIDE", 20)
    if way == "sketch off":  # spans that miss their ranks
        real = selection._sketched

        def off(*args):
            found, spans = real(*args)
            return found, {c: [(s.least, s.least)] for c, s in found.items() if s.n}

        monkeypatch.setattr(selection, "_sketched", off)
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data)).repartition(5)
    got = selection.column_quantiles(df, list(data), PROBS)
    for c, values in data.items():
        for name, p in PROBS.items():
            want = wanted(values, p)
            assert got[c].quantiles[name] == want or math.isclose(got[c].quantiles[name], want, rel_tol=1e-12), (c, name)
        assert got[c].n == sum(v is not None for v in values)


def test_reports_of_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert [(r.column, r.cnt, r.median, r.std) for r in describe(df, ["a", "b"]).collect()] == [("a", 2, 2.0, round(math.sqrt(2), 4))]
    assert [(r.column, r.normal_cnt, r.normal_percent) for r in iqr_report(df, ["a", "b"]).collect()] == [("a", 2, 100.0)]
    for report in (describe, iqr_report):
        assert report(df.filter("false"), ["a", "b"]).collect() == []


def test_reports_read_their_rows_three_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), F.rand(1).alias("b")).mapInArrow(counted, "a double, b double")
    assert len(iqr_report(df, ["a", "b"]).collect()) == 2
    assert seen.value == 3000


def test_clusters_need_a_shared_folder():
    from ledgerline.session import refuse_own_folder

    for master in ("local", "local[8]", "local[*]"):
        refuse_own_folder(master, True, "/x")
    refuse_own_folder("yarn", False, "hdfs://x")
    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            refuse_own_folder(master, True, "/x")
