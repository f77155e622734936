"""Session settings and lineage-cutting stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "weekcast", master: str | None = None,
                  **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps.

    No machine sizes are set here: on a cluster they come from the submit
    command. Pass them as ``settings`` for local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # building wide plans is several times faster without call-site capture
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one if unset.

    A machine-local folder is only ever chosen on a local master, where the
    driver and the executors are the same machine.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get(CHECKPOINT_SETTING) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a shared folder")
    if sc.applicationId not in _local_folders:
        _local_folders[sc.applicationId] = tempfile.mkdtemp(prefix="weekcast-")
    return _local_folders[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/weekcast/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes made here remove their shuffle files from all executors once they are done.

    What is written is read from its files, so nothing asks for these shuffles again; else
    they would stay on disk until the driver happens to collect its garbage.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    Cuts lineage in a way that survives the loss of executors. Being parquet,
    later reads still prune columns and push filters, and the optimizer knows
    the file size, so whether a staged table is broadcast is decided by its
    measured size. With ``partition_by`` (a column of few values) readers of
    one value skip the files of the others.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    with shuffles_removed(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
