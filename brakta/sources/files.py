"""Files as byte ranges, written and read by tasks in whatever store a URI names."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI with its scheme, as the cluster's default file system has it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; s3a and s3n are s3, ``file:/x`` is ``file:///x``.

    The store must be one that Arrow reads (local or shared folders, S3, GCS, HDFS); others raise.
    """
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else uri).lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
