"""JSON text columns to typed columns, without per-row code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ledgerline.functions.numbers import col


def json_columns(df: DataFrame, column: str, schema: str, prefix: str = "") -> DataFrame:
    """A JSON object column becomes one column per field; malformed text gives nulls."""
    fields = StructType.fromDDL(schema).names
    parsed = df.withColumn("_json", F.from_json(column, schema))
    names = [F.col("_json").getField(f).alias(prefix + f) for f in fields]
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *names)


def first_item(text: Column | str, field: str) -> Column:
    """A field of the first object in a JSON array; null when there is none."""
    items = F.from_json(col(text), f"array<struct<{field}:string>>")
    return F.get(items, F.lit(0)).getField(field)


def longest_array(df: DataFrame, column: str) -> int:
    """Items of the longest JSON array in a column; malformed text and null have none."""
    return df.agg(F.max(F.json_array_length(column))).first()[0] or 0


def numbered_items(
    text: Column | str, fields: Sequence[str], nested: Mapping[str, Sequence[str]], size: int
) -> list[Column]:
    """``field_1``, ``field_2`` … and ``field_1_sub`` … for ``size`` array items, see ``longest_array``."""
    parts = [f"{f}:string" for f in fields]
    parts += [f"{f}:struct<{','.join(f'{s}:string' for s in subs)}>" for f, subs in nested.items()]
    items = F.from_json(col(text), f"array<struct<{','.join(parts)}>>")
    out = []
    for i in range(size):
        item = F.get(items, F.lit(i))
        out += [item.getField(f).alias(f"{f}_{i + 1}") for f in fields]
        for f, subs in nested.items():
            out += [item.getField(f).getField(s).alias(f"{f}_{i + 1}_{s}") for s in subs]
    return out


def item_rows(df: DataFrame, key: str, text: str, item_schema: str) -> DataFrame:
    """Long form for arrays of any length: (key, position from 1, fields…)."""
    fields = StructType.fromDDL(item_schema).names
    items = F.from_json(F.col(text), ArrayType(StructType.fromDDL(item_schema)))
    rows = df.select(key, F.posexplode(items).alias("_pos", "_item"))
    return rows.select(
        key, (F.col("_pos") + 1).cast("bigint").alias("position"), *[F.col("_item").getField(f).alias(f) for f in fields]
    )


def json_get(text: Column | str, field: str, default: str = "") -> Column:
    """A text field with a default for missing fields and malformed text."""
    return F.coalesce(F.get_json_object(col(text), f"$.{field}"), F.lit(default))
