"""Session settings the operators count on, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: deletes the shuffle files of a query when it has ended; Spark else waits until the driver happens to collect its garbage
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SETTINGS = {
    # sizes partitions from what the shuffles really hold, splits skewed join partitions and
    # turns joins into broadcasts only when a measured side is small
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "remitlens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local session without one gets a temporary folder, which ends with the process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that all executors and the driver share")
    path = tempfile.mkdtemp(prefix="spark-checkpoint-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's written tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/remitlens-{spark.sparkContext.applicationId}"


def clear_run(spark: SparkSession) -> None:
    """Delete this application's written tables, when nothing that was made from them is needed any more."""
    _delete(spark, run_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_written: ContextVar[tuple[list, list] | None] = ContextVar("written", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """``with scratch():`` or ``@scratch()``: tables that ``cut_lineage`` writes inside are deleted at the end, but for those written with ``keep``,
    which belong to the surrounding scratch, if there is one. Whatever leaves the block may read tables of the second kind only."""
    outer, own = _written.get(), []
    token = _written.set((own, outer[0] if outer else []))
    try:
        yield
    finally:
        _written.reset(token)
        for spark, path in own:
            _delete(spark, path)


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from there.

    Later stages that use it several times read the columns they need from the files instead of running its
    plan again, and a lost executor costs a file read, not a recomputation. The plan runs once, where
    an eager ``checkpoint()`` runs its last stage twice. ``clear_run`` deletes all tables of a run,
    ``scratch`` those of a block. The shuffles of the plan are deleted once the table is there.
    """
    spark, path = df.sparkSession, f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if lists := _written.get():
        lists[keep].append((spark, path))
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
