"""The folder that driver and executors share, and tables in it that cut the lineage of what follows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_ours: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names in ``spark.checkpoint.dir``.

    Only on one machine, where it may be unset, a temporary folder is made and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("logweave.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name its shared folder in spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="logweave-")
        spark.conf.set("logweave.shared.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared one; it goes when the session stops or the driver's program ends."""
    path = f"{shared_dir(spark)}/logweave-{spark.sparkContext.applicationId}"
    if path not in _ours:
        _ours[path] = spark
        _leave_before_stop(spark.sparkContext)
    return path


def _leave_before_stop(context: SparkContext) -> None:
    """Delete the folders of an application when its context stops: afterwards its filesystems are gone."""
    stop = context.stop

    def stopped() -> None:
        for path in [p for p, spark in _ours.items() if spark.sparkContext is context]:
            with contextlib.suppress(Exception):  # the JVM may have died before
                _delete(_ours[path], path)
            del _ours[path]
        stop()

    context.stop = stopped


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _leave() -> None:
    for path, spark in _ours.items():
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            _delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread, with its lineage cut.

    Losing executors costs no more than the tasks that they ran: what is written stays.
    """
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def checkpoint(df: DataFrame) -> DataFrame:
    return written(df, "checkpoint")


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` gave, once all that is made of them is written too."""
    for table in tables:
        _delete(table.sparkSession, table.written_to)
