"""Tables that lie in buckets of a key, so that joins and groups by that key need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import checkpoint_folder


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a catalog table in buckets of ``key``, sorted by it, and read it back.

    Tables with equal numbers of buckets join on the key bucket by bucket; by default there are as many as
    shuffle partitions. Each bucket is one file, written by one task. The files lie in this application's part
    of the shared folder and go with it; the table's name is its own. A key with most of the rows makes one
    large bucket: reduce the rows to what is needed of a key first, where that bounds them.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, F.col(key)).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{checkpoint_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
