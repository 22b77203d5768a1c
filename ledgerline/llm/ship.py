"""Sends this package to the executors, which do not see the driver's folders."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: dict[str, str] = {}


#: What an executor and a Python worker hold at once on their way to each other. Texts are long, and the
#: default of 10,000 rows or 64 MB, several times over, may not fit beside the heap.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's modules to the session's Python files, once for each application, and keep the
    batches of texts small."""
    context = spark.sparkContext
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    if context.applicationId not in _sent:
        package = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp(prefix="ledgerline-py-")) / "ledgerline_llm.zip"
        with zipfile.ZipFile(out, "w") as z:
            for path in [package / "__init__.py", package / "session.py", *sorted((package / "llm").glob("*.py"))]:
                z.write(path, str(path.relative_to(package.parent)))
        context.addPyFile(str(out))
        _sent[context.applicationId] = str(out)
    return spark
