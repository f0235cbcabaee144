"""The shared work folder.

The cluster names it in ``spark.checkpoint.dir``; a session without that setting uses the
checkpoint folder of its context, or the warehouse.
"""

from __future__ import annotations

import atexit
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_owned: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    # The warehouse always has a value, by default a folder of the driver's machine.
    found = spark.conf.get("spark.sql.warehouse.dir", None) or ""
    local = spark.sparkContext.master.startswith("local")
    if not found or (not local and found.startswith(("file:", "/"))):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A path nothing has been written to yet.  It goes when the application ends."""
    own = f"{shared_root(spark)}/dwell/{spark.sparkContext.applicationId}"
    _owned.add(own)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


@atexit.register
def clean_up() -> None:
    """Delete what this application wrote to the shared folder."""
    while _owned:
        try:
            fs, path = pafs.FileSystem.from_uri(_owned.pop())
            fs.delete_dir(path)
        except (OSError, ValueError):
            pass  # nothing was written, or the store is one that only Spark reaches


def spread(scan: DataFrame, partitions: int | None = None) -> DataFrame:
    """Give a small scan one partition per core before costly per-row work.

    Acts only on a table with fewer files than cores; a larger one stays unshuffled.
    """
    cores = partitions or scan.sparkSession.sparkContext.defaultParallelism
    return scan if len(scan.inputFiles()) >= cores else scan.repartition(cores)
