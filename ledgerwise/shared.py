"""The folder that every executor can reach, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
_job: ContextVar[str | None] = ContextVar("job", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder given to ``setCheckpointDir``.

    Only a local master may do without one: its executors are this process, and a temporary folder serves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="ledgerwise-")
    return _local_folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody has written yet, so that a retried job never meets its own leftovers."""
    return f"{_job.get() or shared_dir(spark) + '/ledgerwise'}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop file system that holds ``path``, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at ``path``, on whatever file system the cluster uses?  Lists nothing."""
    system, target = file_system(spark, path)
    return system.exists(target)


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """Staged tables of a job in a folder of their own, removed when the job ends, well or badly.

    What the job returns lazily may read them: use it inside.  The folder belongs to the thread or task that opened it:
    what others stage meanwhile lies elsewhere.
    """
    folder = new_path(spark, "job")
    token = _job.set(folder)
    try:
        yield folder
    finally:
        _job.reset(token)
        system, path = file_system(spark, folder)
        system.delete(path, True)


def staged(df: DataFrame, label: str, by: str | None = None, session: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``by`` names a column that later filters select on.

    The result survives lost executors, is not computed twice by a plan that uses it twice, and carries its real
    size, so Catalyst broadcasts it exactly when it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = new_path(df.sparkSession, label)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)
