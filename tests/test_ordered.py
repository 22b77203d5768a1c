"""Distributed sorted operators against brute force, with a key that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.operators import ordered


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 3000
    user = np.where(rng.random(n) < 0.6, 1, rng.integers(2, 40, n))  # one user holds most rows
    return pd.DataFrame({"user": user, "t": rng.integers(0, 700, n), "v": rng.integers(-5, 90, n)})


def test_running_sum_shares_totals_between_peers(many_chunks, rows):
    got = ordered.running_sum(many_chunks.createDataFrame(rows), ["user"], "t", "v", "s").toPandas()
    want = rows.groupby(["user", "t"]).v.sum().groupby("user").cumsum().rename("w").reset_index()
    merged = got.merge(want, on=["user", "t"])
    assert len(merged) == len(rows) and (merged.s == merged.w).all()


def test_large_key_spans_chunks(many_chunks, rows):
    peers = many_chunks.createDataFrame(rows).groupBy("user", "t").agg(F.sum("v").alias("v"))
    chunks = ordered._chunks(peers, ["user"], ["t"]).filter("user = 1").select(ordered.CHUNK).distinct()
    assert chunks.count() > 2


def test_row_numbers_are_dense_and_ordered(many_chunks, rows):
    got = ordered.row_numbers(many_chunks.createDataFrame(rows), [F.desc("v"), F.col("t")], "n").toPandas()
    assert sorted(got.n) == list(range(1, len(rows) + 1))
    in_order = got.sort_values("n")[["v", "t"]].reset_index(drop=True)
    assert in_order.equals(rows.sort_values(["v", "t"], ascending=[False, True])[["v", "t"]].reset_index(drop=True))


def test_copies_of_one_row_go_to_several_chunks(many_chunks):
    copies = many_chunks.range(2000).select(F.lit(1).alias("x"))
    split = ordered._chunks(ordered._split_ties(copies), [], ["x", ordered.TIE])
    assert split.select(ordered.CHUNK).distinct().count() > 2
    numbers = ordered.row_numbers(copies, ["x"], "n", start=0)
    assert numbers.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (0, 1999, 2000)


def test_previous_value(many_chunks, rows):
    got = ordered.previous_value(many_chunks.createDataFrame(rows), ["user"], "t", "p").toPandas()
    want = rows.sort_values(["user", "t"])
    want["p"] = want.groupby("user").t.shift()
    key = ["user", "t", "p"]
    a = got[key].astype(float).fillna(-1).sort_values(key).reset_index(drop=True)
    b = want[key].astype(float).fillna(-1).sort_values(key).reset_index(drop=True)
    assert a.equals(b)


def test_quantiles_by_group_with_null_group(many_chunks, rows):
    df = many_chunks.createDataFrame(rows).withColumn("user", F.when(F.col("user") > 20, F.col("user")))
    got = ordered.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.99}, ["user"]).toPandas()
    groups = rows.assign(user=rows.user.where(rows.user > 20)).groupby("user", dropna=False).v
    for key, values in groups:
        row = got[got.user.isna()] if pd.isna(key) else got[got.user == key]
        assert row.n.item() == len(values)
        assert np.allclose(row[["a", "b", "c"]].to_numpy()[0], values.quantile([0.1, 0.5, 0.99]).to_numpy())


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60), st.floats(0, 1))
def test_any_quantile(many_chunks, values, p):
    df = many_chunks.createDataFrame([(v,) for v in values], "v int")
    got = ordered.quantiles(df, "v", {"q": p}).collect()
    known = [v for v in values if v is not None]
    if not known:
        assert got[0].q is None
    else:
        assert got[0].q == pytest.approx(np.quantile(known, p))


def test_mode_takes_the_smallest_on_ties_and_skips_nulls(spark):
    df = spark.createDataFrame(
        [("a", 10), ("a", 9), ("a", None), ("a", None), ("a", None), ("b", None)], "g string, v int"
    )
    got = {r.g: (r.mode, r.mode_cnt, r.value_cnt, r.obs_cnt) for r in ordered.mode(df, "v", ["g"]).collect()}
    assert got == {"a": (9, 1, 2, 5), "b": (None, None, 0, 1)}
