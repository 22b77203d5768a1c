"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Skewed shuffle joins are split by AQE even
# when the split costs one more exchange; nothing here depends on the data size.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # HotSpot does not compile methods above 8000 bytes; fall back to split code instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}

# What a task reads of a shuffle is compressed, and sorts and groups hold ten to twenty times as much. So tasks
# become more with the input, not larger. A size that the user has set is kept.
TASK_BYTES = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")


_emptied: set[str] = set()  # folders that are removed when the session ends


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    if spark.conf.get(TASK_BYTES[0], None) is None:
        spark.conf.set(*TASK_BYTES)
    return spark


def local_session(cores: str = "*", app: str = "ledgerline") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    n = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def refuse_own_folder(master: str, own: bool, folder: str) -> None:
    """Raise if a cluster's executors would each write to a folder of their own machine."""
    if own and not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"set spark.checkpoint.dir: {folder} is not shared between the machines of {master}")


def checkpoint_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder in ``spark.checkpoint.dir``, emptied when it ends.

    Without that setting it lies below the warehouse. On a cluster that has to be a folder that all executors
    share, so one on the machine's own file system is refused there.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
            place = context._jvm.org.apache.hadoop.fs.Path(shared)
            own = place.getFileSystem(context._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
            refuse_own_folder(context.master, own, shared)
        context.setCheckpointDir(shared)
    folder = context.getCheckpointDir()
    if folder not in _emptied:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        _emptied.add(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    Used where two consumers must see the very same rows (for example rows tagged with
    their partition number), also after an executor is lost.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
