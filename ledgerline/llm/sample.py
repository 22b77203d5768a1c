"""A bounded, repeatable sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows looked at for each row wanted, on average, so that enough are found.
MARGIN = 8
_STEPS = 1 << 30


def least_hashed(keys: DataFrame, id_col: str, label: str, most: int) -> DataFrame:
    """Up to ``most`` different ids of each label, those with the least hash of the id.

    Labels are counted first; then only rows whose hash is low enough to be among the first few times
    ``most`` of their label leave their task to be ranked, so that a frequent label is no large group. There
    may be any number of labels.
    """
    rows = keys.select(id_col, label).filter(F.col(label).isNotNull())
    counts = rows.groupBy(F.col(label).alias("__label")).agg((F.lit(float(MARGIN * most)) / F.count("*")).alias("__limit"))
    near = (
        rows.withColumn("__place", F.pmod(F.xxhash64(id_col), F.lit(_STEPS)))
        .join(counts, F.col(label) == F.col("__label"))
        .filter(F.col("__place") / F.lit(float(_STEPS)) <= F.col("__limit"))
        .select(id_col, label, "__place")
        .distinct()
    )
    nth = F.row_number().over(Window.partitionBy(label).orderBy("__place", id_col))
    return near.withColumn("__nth", nth).filter(F.col("__nth") <= most).select(id_col, label)
