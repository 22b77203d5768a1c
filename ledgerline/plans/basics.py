"""Table-level probes and small relational building blocks on the test tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import cents, from_cents, half_even, half_up
from ledgerline.operators.cleaning import canonicalize_by_table
from ledgerline.operators.ordered import mode, quantiles
from ledgerline.operators.profile import (
    box_stats,
    correlation,
    describe,
    duplicate_report,
    group_stats,
    histogram,
    iqr_report,
    null_profile,
)
from ledgerline.operators.relational import missing_members, whole
from ledgerline.session import checkpoint_folder
from ledgerline.sources.tables import (
    BAD_ROW,
    drop_view,
    export,
    inline,
    peek,
    read_csv,
    read_dirty_csv,
    read_table,
    session_view,
    shape,
    write_csv,
)


def extreme_rows(df: DataFrame, value: str) -> DataFrame:
    """Rows holding the largest or smallest value."""
    return df.filter(
        (F.col(value) == whole(df, F.max(value))) | (F.col(value) == whole(df, F.min(value)))
    )


def names_per_region(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Joined text per group, sorted; both tables are small dimensions."""
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(
        F.array_join(F.array_sort(F.collect_list("n_name")), " ").alias("nations")
    )


def revenue_by_flag(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("cnt"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
        from_cents(F.sum(cents("l_extendedprice"))).alias("price"),
        half_up(F.avg("l_discount"), 4).alias("avg_discount"),
    )


def rounding(lineitem: DataFrame) -> DataFrame:
    """Both rounding rules on the same half values."""
    value = F.col("l_quantity") / 2
    return lineitem.groupBy(value.alias("value")).agg(F.count("*").alias("cnt")).select(
        "value", "cnt", half_up("value").alias("half_up"), half_even("value").alias("half_even")
    )


def short_types(part: DataFrame) -> DataFrame:
    """Synonyms kept in a table: first three letters for each part type."""
    synonyms = part.select(
        F.col("p_type").alias("variant"), F.lower(F.substring("p_type", 1, 3)).alias("canonical")
    ).distinct()
    return canonicalize_by_table(part.select("p_partkey", "p_type"), "p_type", synonyms)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

def _scratch(t, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def csv_round_trip(t) -> DataFrame:
    """A table written as delimited text and read again with its schema."""
    folder = _scratch(t, "csv")
    write_csv(t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), folder, ";")
    return read_csv(t.spark, folder, "c_custkey bigint, c_name string, c_mktsegment string, c_nationkey int", ";")


def dirty_csv_round_trip(t) -> DataFrame:
    """The same through the reader that takes every column as text."""
    folder, columns = _scratch(t, "dirty"), ["p_partkey", "p_name", "p_type"]
    write_csv(t.part.select(columns), folder)
    return read_dirty_csv(t.spark, folder, columns).select(*columns, F.col(BAD_ROW).isNull().alias("whole"))


def quoted_csv_round_trip(t) -> DataFrame:
    """Whole texts with line breaks inside quotes, read by tasks that each see a block of a file."""
    folder, columns = _scratch(t, "quoted"), ["doc_id", "source", "text"]
    texts = t.documents.select("doc_id", "source", F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    texts.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    back = read_dirty_csv(t.spark, folder, columns)
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "source",
        F.length("text").cast("bigint").alias("chars"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint").alias("line_breaks"),
        F.md5("text").alias("text_md5"),
        F.col(BAD_ROW).isNull().alias("whole"),
    )


def separated_round_trips(t) -> DataFrame:
    """The same rows by semicolon, tab and comma, with quoted separators, a mark at the file's start and texts for null."""
    rows = t.nation.select(
        "n_nationkey",
        F.concat("n_name", F.lit(', "'), F.col("n_regionkey").cast("string"), F.lit('"; x')).alias("label"),
        F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("name"),
    )
    out = None
    for kind, sep in (("semicolon", ";"), ("tab", "\t"), ("comma", ",")):
        folder = _scratch(t, kind)
        # the first header name carries the byte-order mark, as some editors write it
        marked = rows.withColumnRenamed("n_nationkey", "\ufeffn_nationkey")
        marked.write.option("header", True).option("sep", sep).option("escape", '"').option("nullValue", "null").csv(folder)
        back = read_csv(t.spark, folder, "n_nationkey int, label string, name string", sep).withColumn("kind", F.lit(kind))
        out = back if out is None else out.union(back)
    return out


def inlined(t) -> DataFrame:
    """A small list kept in the program, joined with a table."""
    listed = inline(t.spark, [("AUTOMOBILE", 1.5), ("BUILDING", 2.0), ("NOWHERE", 9.0)], "segment string, weight double")
    counts = t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))
    return listed.join(counts, "segment", "left").select("segment", "weight", "customers")


def exported(t) -> DataFrame:
    """Tables written side by side, one of them by status, and read again."""
    folder = _scratch(t, "export")
    export({"orders": t.orders.select("o_orderkey", "o_orderstatus")}, folder, "o_orderstatus")
    back = t.spark.read.parquet(f"{folder}/orders")
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last_order"))


def viewed(t) -> DataFrame:
    """A session view read by its name."""
    name = session_view(t.nation.select("n_nationkey", "n_name"), f"nations_{uuid.uuid4().hex}")
    rows = read_table(t.spark, name)
    drop_view(t.spark, name)
    return rows


QUERIES = {
    "tab_csv": csv_round_trip,
    "tab_dirty_csv": dirty_csv_round_trip,
    "tab_quoted_csv": quoted_csv_round_trip,
    "tab_separated": separated_round_trips,
    "tab_inline": inlined,
    "tab_export": exported,
    "tab_view": viewed,
    "tab_shape": lambda t: shape(t.lineitem),
    "tab_peek": lambda t: peek(t.customer, "c_custkey", 2),
    "tab_null_profile": lambda t: null_profile(
        t.lineitem.withColumns({"l_tax": F.nullif("l_tax", F.lit(0.0)), "l_discount": F.nullif("l_discount", F.lit(0.0))})
    ),
    "tab_duplicates": lambda t: duplicate_report(t.lineitem.select("l_orderkey", "l_linenumber")),
    "tab_describe": lambda t: describe(t.lineitem, MEASURES),
    "tab_iqr": lambda t: iqr_report(t.events.select("value"), ["value"]),
    "tab_box": lambda t: box_stats(t.events, "value", ["event_type"]),
    "tab_histogram": lambda t: histogram(t.events, "value", 0, 100, 20),
    "tab_quantiles": lambda t: quantiles(t.lineitem, "l_quantity", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ["l_suppkey"]),
    "tab_median_price": lambda t: group_stats(t.lineitem, "l_extendedprice", ["l_returnflag"], digits=2),
    "tab_mode": lambda t: mode(t.lineitem, "l_linenumber", ["l_suppkey"]),
    "tab_correlation": lambda t: t.lineitem.agg(correlation("l_quantity", "l_extendedprice").alias("r")),
    "tab_extreme_rows": lambda t: extreme_rows(t.part, "p_retailprice"),
    "tab_string_agg": lambda t: names_per_region(t.nation, t.region),
    "tab_flag_summary": lambda t: revenue_by_flag(t.lineitem),
    "tab_rounding": lambda t: rounding(t.lineitem),
    "tab_synonym_table": lambda t: short_types(t.part),
    "tab_missing_members": lambda t: missing_members(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey")), t.lineitem, "l_orderkey"
    ),
}
