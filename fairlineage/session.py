"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "fairlineage", **conf: str) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings win where it has them."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for written working tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session that has none gets a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        or spark.sparkContext.getCheckpointDir()
    )
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="fairlineage-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_recorders: list[list[str]] = []


@contextmanager
def recorded_tables():
    """Collects the paths of the working tables written inside, so that a run can delete its own when it is done."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def working_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder, known to the recorders that are open."""
    path = os.path.join(shared_folder(spark), "fairlineage", uuid.uuid4().hex)
    for made in _recorders:
        made.append(path)
    return path


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete working tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """What a write inside shuffles is deleted from the executors' disks as soon as the write is done; else it stays there
    until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, **metrics) -> DataFrame | tuple[DataFrame, dict]:
    """Write ``df`` once to the shared folder and go on from the written table.

    The written table survives the loss of executors, is columnar, and gives the optimizer a
    true size for its join choices. ``metrics`` are aggregate columns taken during the same
    write (no second job); with metrics given, ``(table, values)`` comes back.
    """
    spark = df.sparkSession
    path = working_folder(spark)
    observation = None
    source = df
    if metrics:
        observation = Observation()
        source = df.observe(observation, *[m.alias(name) for name, m in metrics.items()])
    with shuffles_deleted(spark):
        source.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return (table, observation.get) if observation is not None else table


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package's source to the Python workers, once per application, so that they need no installation."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="fairlineage-source-"), "fairlineage_source.zip")
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
