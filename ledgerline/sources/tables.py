"""CSV, table and inline sources; CSV and multi-table sinks; shape and peek."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerline.sources.records import records

BAD_ROW = "_bad_row"


def read_csv(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", null: str = "null") -> DataFrame:
    """Delimited text with a header and a fixed schema; ``null`` text is null, quotes may hold the separator."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep)
    return reader.option("quote", '"').option("escape", '"').option("nullValue", null).csv(path)


def read_dirty_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Wide text with mixed types: every column a string, broken rows kept in ``_bad_row``.

    Quoted values may hold line breaks, which become ``\\n``; a file of any size is split over tasks all the
    same. Each file starts with a header. Blank lines are skipped; rows with too few or too many values, and
    rows whose quotes are never closed, count as broken.
    """
    fields = [StructField(c, StringType()) for c in (*columns, BAD_ROW)]
    ddl = ", ".join(f"`{f.name}` string" for f in fields)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_ROW}
    rows = records(spark, path).filter(~F.col("first") & (F.length(F.btrim("record")) > 0))
    parsed = rows.select("record", "broken", F.from_csv("record", F.lit(ddl), options).alias("row"))
    values = [F.when(~F.col("broken"), F.col("row")[c]).alias(c) for c in columns]
    return parsed.select(*values, F.when(F.col("broken"), F.col("record")).otherwise(F.col("row")[BAD_ROW]).alias(BAD_ROW))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by (qualified) name; mixed-case parts are quoted for the caller."""
    return spark.table(".".join(f"`{part}`" for part in name.split(".")))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high)
    return reader.option("numPartitions", parts).options(**options).load()


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small literal relation (parameters, mapping lists)."""
    return spark.createDataFrame(list(rows), schema)


def session_view(df: DataFrame, name: str) -> str:
    """Register a session-scoped view; ``drop_view`` removes it."""
    df.createOrReplaceTempView(name)
    return name


def drop_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def export(tables: Mapping[str, DataFrame], folder: str, partition_by: str | None = None) -> None:
    """Write several tables side by side as Parquet, optionally partitioned by one column."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by and partition_by in df.columns:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{folder}/{name}")


def shape(df: DataFrame) -> DataFrame:
    """Row and column count; Parquet answers the row count from its footers."""
    return df.agg(F.count("*").alias("row_cnt")).withColumn("column_cnt", F.lit(len(df.columns)).cast("bigint"))


def types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def peek(df: DataFrame, order: str, n: int = 1) -> DataFrame:
    """The first rows in a stated order, turned into (row, column, value) text."""
    first = df.orderBy(order).limit(n)
    texts = first.select(F.col(order).alias("_row"), *[F.col(c).cast("string").alias(c) for c in df.columns])
    return texts.unpivot(["_row"], df.columns, "column", "value").withColumnRenamed("_row", "row_key")
