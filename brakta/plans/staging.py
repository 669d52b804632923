"""Cutting lineage: intermediate tables in the folder that the whole cluster shares.

A staged table is read back from Parquet, so an executor that is lost afterwards
costs a re-read and not a recomputation, and no plan grows with the number of
iterations.  ``localCheckpoint`` is never used: its blocks die with their executor.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="brakta-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return f"file://{_LOCAL['dir']}"


def folder(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, deleted with the tables staged beside it."""
    path = f"{shared_dir(spark)}/brakta/{tag}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder (this runs it) and read it back."""
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def unstage(df: DataFrame) -> None:
    """Delete a staged table once nothing reads it any more."""
    for name in _folders(df):
        if "/brakta/" in name:
            _delete(df.sparkSession, name)


def stage_alone(df: DataFrame, tag: str, since: int) -> DataFrame:
    """Stage ``df`` and delete whatever else was staged since the mark that ``staged()`` gave: its rows read nothing else any more."""
    spark, out = df.sparkSession, stage(df, tag)
    for path in _STAGED[since:-1]:
        _delete(spark, path)
    del _STAGED[since:-1]
    return out


def staged() -> int:
    """A mark: how many tables this process has staged and not taken back by ``stage_alone``."""
    return len(_STAGED)
