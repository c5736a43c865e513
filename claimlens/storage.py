"""Shared scratch tables and package shipping.

Intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir``: every executor can read it, so a lost executor costs
only the tasks it was running. A folder is chosen here only if none is set.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()
_scopes: list[list[DataFrame]] = []
#: While a scratch table is written: its shuffles go at the end, as nothing reads them again, and rows pass to Python in small batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one is set only where the session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="claimlens-")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    root = f"{shared_dir(spark)}/claimlens-{spark.sparkContext.applicationId}"
    if root not in _made:
        _made.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, root: str) -> None:
    """Delete a scratch folder."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone by now
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and stops recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    for tables in _scopes:
        tables.append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._scratch)


@contextmanager
def discarding() -> Iterator[list[DataFrame]]:
    """Scratch tables made inside are deleted at the end, but for those taken out of the list."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        release(*made)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="claimlens-"), "claimlens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, dirs, names in os.walk(here):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores ahead of costly Python work where the input is small.

    A small file is one row group and so one busy task, however it is split. Larger inputs have row
    groups for every core and stay as they are, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * (128 << 20) else df
