"""Tables and files in the folder that the driver and all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting is
absent, as in tests, a folder of this process is made and set.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go when it has ended, not when the driver next collects its garbage.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quaymark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns the reading of it.

    This cuts the lineage: a lost executor costs a new read, not a new computation, and a table
    used twice is computed once.
    """
    path = new_path(df.sparkSession, name)
    write_parquet(df, path, *partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """Writes ``df``; nothing needs its shuffle files after that, and they go at once."""
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_go(df.sparkSession):
        writer.parquet(path)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FILES_GO, None)
    spark.conf.set(FILES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(FILES_GO) if before is None else spark.conf.set(FILES_GO, before)


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a URI, inside tasks; plain paths are local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
