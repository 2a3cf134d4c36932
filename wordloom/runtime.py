"""What a session needs before it runs this package's functions on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Spark's own value of spark.sql.execution.arrow.maxBytesPerBatch.
_DEFAULT_BYTES = "67108864b"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="wordloom-"), "wordloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches to Python hold 4 MB or a row, where the session does not say otherwise.

    For applications, as the registered queries and the pipeline are; operators leave the session as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == _DEFAULT_BYTES:
        spark.conf.set(key, str(1 << 22))


def spread(scan: DataFrame, always: bool = False) -> DataFrame:
    """The rows of a scan, dealt to all cores if its files give fewer partitions than there are cores.

    A row group is read by one task, so a small table in one file would keep one core busy. Larger tables stay where they
    are read, without a shuffle. always: those, too, are dealt evenly, for narrow rows that take far longer than their
    shuffle, as many partitions of such a scan can be empty.
    """
    cores, parts = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    return scan.repartition(max(cores, parts)) if always or parts < cores else scan
