"""Readers, writers, views and the streaming forms."""

import random

from pyspark.sql import functions as F

from ledgerline.operators.profile import null_profile
from ledgerline.plans import donors
from ledgerline.sources import records, tables
from ledgerline.streaming import events


def test_csv_with_mark_quotes_and_null_text(spark, tmp_path):
    path = tmp_path / "clients.csv"
    path.write_text('﻿client_id,full_name,address\n1,"a, b",null\n2,,"x ""y"""\n', encoding="utf-8")
    got = tables.read_csv(spark, str(path), "client_id int, full_name string, address string")
    assert [tuple(r) for r in got.orderBy("client_id").collect()] == [(1, "a, b", None), (2, None, 'x "y"')]


def test_other_separators(spark, tmp_path):
    for sep in (";", "\t"):
        path = tmp_path / f"t{ord(sep)}.csv"
        path.write_text(f"a{sep}b\n1{sep}1,6\n")
        assert tuple(tables.read_csv(spark, str(path), "a int, b string", sep).first()) == (1, "1,6")


def test_dirty_csv_keeps_broken_rows(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('a,b\n1,"two\nlines"\n1\n3,4,5\n\n')
    got = tables.read_dirty_csv(spark, str(path), ["a", "b"]).collect()
    assert len(got) == 3 and sum(r[tables.BAD_ROW] is not None for r in got) == 2
    assert ("1", "two\nlines", None) in [tuple(r) for r in got]


def quoted(rows):
    return "a,b\n" + "".join(",".join('"' + v.replace('"', '""') + '"' for v in row) + "\n" for row in rows)


def test_records_across_many_blocks(spark, tmp_path):
    """Blocks of a few bytes: records, quotes and long runs of lines cross their edges."""
    rnd = random.Random(1)
    files = []
    for n in range(3):
        rows = [
            (str(i), "".join(rnd.choice(["x", "\n", '"', ",", "é", "\n\n", '""']) for _ in range(rnd.choice([0, 3, 60, 400]))))
            for i in range(60)
        ]
        files.append(rows)
        (tmp_path / f"f{n}.csv").write_text(quoted(rows), encoding="utf-8")
    want = sorted(row for rows in files for row in rows)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for block in ("64b", "257b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            lines = records._lines(spark, str(tmp_path))
            starts = records.block_starts(lines)
            got = tables.read_dirty_csv(spark, str(tmp_path), ["a", "b"]).collect()
            assert sorted((r.a, r.b or "") for r in got) == want and all(r[tables.BAD_ROW] is None for r in got)
            assert (starts.filter("inside = 1").count() > 20) == (block != "1m")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quotes_that_are_never_closed(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,x\n2,"open\n' + "line,line\n" * 50)
    got = tables.read_dirty_csv(spark, str(tmp_path), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in got if r[tables.BAD_ROW] is None] == [("1", "x")]
    assert len(got) == 2
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        pieces = [r.record for r in records.records(spark, str(tmp_path), longest=200).filter("broken").collect()]
        assert len(pieces) > 3 and sum(p.count("line,line") for p in pieces) == 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_files_have_no_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("a,b\n")
    assert tables.read_dirty_csv(spark, str(tmp_path), ["a", "b"]).collect() == []


def test_round_trip_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    tables.write_csv(df, str(tmp_path / "out"), ";")
    back = tables.read_csv(spark, str(tmp_path / "out"), "id int, s string", ";")
    assert back.filter("id = 1").first().s == "x" and back.count() == 2
    tables.export({"a": df, "b": df.withColumn("segment", F.lit("s"))}, str(tmp_path / "x"), "segment")
    assert spark.read.parquet(str(tmp_path / "x" / "b")).columns == ["id", "s", "segment"]


def test_rfm_export(spark, tmp_path):
    rows = [(i, i % 9, f"2024-01-{1 + i % 28:02d} 00:00:00", float(i), "success") for i in range(60)]
    donations = spark.createDataFrame(rows, "donation_id int, donor_id int, at string, amount double, status string")
    donations = donations.withColumn("donated_at", F.col("at").cast("timestamp"))
    scores = donors.rfm_scores(donations, "2024-02-01")
    donors.export_rfm(scores, str(tmp_path))
    parts = [spark.read.parquet(str(tmp_path / n)) for n in ("rfm", "segments", "ids")]
    assert parts[0].count() == 9 == parts[2].count()
    assert parts[1].agg(F.round(F.sum("money_share"), 1)).first()[0] in (99.9, 100.0, 100.1)
    assert set(parts[2].columns) == {"segment", "donor_id"}


def test_views_and_probes(spark):
    df = tables.inline(spark, [(1, None), (2, "b")], "k int, s string")
    tables.session_view(df, "probe_view")
    assert tables.read_table(spark, "probe_view").count() == 2
    assert tables.drop_view(spark, "probe_view") and not tables.drop_view(spark, "probe_view")
    assert tuple(tables.shape(df).first()) == (2, 2)
    assert [tuple(r) for r in tables.peek(df, "k").collect()] == [(1, "k", "1"), (1, "s", None)]
    assert {r["column"]: r.null_cnt for r in null_profile(df).collect()} == {"k": 0, "s": 1}


def test_streamed_hours_equal_batch_hours(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:{i % 60:02d}:00", i % 7, "error" if i % 3 == 0 else "view") for i in range(300)]
    batch = spark.createDataFrame(rows, "event_id int, t string, user_id int, event_type string")
    batch = batch.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")
    late = spark.createDataFrame([(999, 0, "view")], "event_id int, user_id int, event_type string").select(
        "event_id", F.lit("2024-01-09").cast("timestamp_ntz").alias("ts"), "user_id", "event_type"
    )
    batch.write.parquet(str(tmp_path / "in" / "a"))
    late.write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(batch.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run goes on where the first has ended
        query = events.write_stream(events.hourly_counts(stream), str(tmp_path), "hours", str(tmp_path / "progress"))
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "hours"))
    want = batch.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(
        F.count("*").alias("orders"), F.count_if(F.col("event_type") == "error").alias("canceled_orders")
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    bursts = events.failure_bursts(stream, 5)
    assert bursts.isStreaming and bursts.columns == ["user_id", "window_start", "failures"]
