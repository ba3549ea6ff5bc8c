"""Cutting lineage through tables in a folder that the whole cluster shares, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}
#: Paths that written() has made, of each open scope.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get("folder")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="leafloom-")
        atexit.register(shutil.rmtree, folder[7:], True)
        _own["folder"] = folder
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a new Parquet table in the shared folder, read back; lost executors cost no recomputation of it. Results are read from such
    tables lazily, so they stay until a scope around the caller ends (see cleared()), or the folder's owner clears it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Around work whose results are stored before it ends: its tables in the shared folder are deleted then, but for those that were given to
    the function which this yields."""
    scope, kept = [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(scope[-1:])  # the table written last
        return df

    _scopes.append(scope)
    try:
        yield keep
    finally:
        _scopes.remove(scope)
        for path in scope:
            if path not in kept:
                remove(spark, path)


def small(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcasting if it has at most `most` rows, else df: the planner then shuffles both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows in an Arrow batch, at most: texts of some MB go to a Python worker at once, beside the JVM's copy of them.
ARROW_ROWS = 1000


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most ARROW_ROWS rows from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
