"""Tables written to the folder that driver and executors share, to cut lineage and to read a source once."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary folder of its own, removed at exit."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local:
        folder = tempfile.mkdtemp(prefix="twinfold-")
        _local[context.applicationId] = "file://" + folder
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _local[context.applicationId]


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a new table, which ``release`` will delete."""
    folder = f"{shared_dir(spark)}/twinfold-{uuid.uuid4().hex}"
    _staged.append((spark, folder))
    return f"{folder}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation, and later stages prune columns.
    """
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, staged; the tables that it staged on its way are deleted once the result is written."""
    before = len(_staged)
    out = stage(make(), name)
    for _, path in _staged[before:-1]:
        deleted(spark, path)
    del _staged[before:-1]
    return out


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df``, staged if its plan groups or joins, so that it is made once where it is used several times; what is read from a table stays as it is."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return stage(df, name) if re.search(r"\b(Aggregate|Join|Window|Distinct|MapInArrow|RelationV2)\b", plan) else df


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark reads, with all below it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def release() -> None:
    """Delete every staged table of this process; call it once the results that read them are written."""
    while _staged:
        spark, path = _staged.pop()
        try:
            deleted(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(release)
