"""Cutting lineage into the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and Spark runs in this process, one is made and set.

    Raises on a cluster without that setting: executors do not see a folder of the driver's machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='hexweave-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder and read again: survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _scopes:
        _scopes[-1].tables.append((table, path))
    return table


_scopes: list[Scope] = []


class Scope:
    """Tables that are cut inside a `with` block, to be removed once newer ones hold what they held.

    What is left at the end of the block is the enclosing block's; without one it stays. A table is to be removed only when
    all that is computed from it has been written.
    """

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scope:
        _scopes.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _scopes.remove(self)
        if _scopes:
            _scopes[-1].tables += self.tables

    def keep_only(self, *wanted: DataFrame) -> None:
        """Removes all other tables of this block."""
        for table, path in [x for x in self.tables if not any(x[0] is w for w in wanted)]:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        self.tables = [x for x in self.tables if any(x[0] is w for w in wanted)]
