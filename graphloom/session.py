"""Session settings the operators rely on, and where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# All settable at run time, so a session made elsewhere can be adjusted too.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows widen after a shuffle (texts made of keys, rules over files), so tasks are measured on fewer bytes than the default.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the split costs another shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# How tables of rows between steps are packed.
CODEC = "zstd"

# While a table is written: its shuffle files go as soon as it is there.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "graphloom-workers.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session, ship the package to its workers and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode one is made up if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session while a block runs."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the checkpoint folder and read it back.

    Cuts the lineage, so a lost executor costs a read, and later readers agree on the
    rows. As a table it is computed once, and read by the columns that are needed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/graphloom-{uuid.uuid4().hex}"
    with settings(spark, FREED):
        df.write.option("compression", CODEC).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more, frames still to be run included."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
