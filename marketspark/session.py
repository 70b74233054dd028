"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marketspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    Shuffle partitions and memory stay with the cluster's own defaults unless given
    in ``conf`` (dots written as double underscores).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_code(spark)
    return spark


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in tasks are pickled by reference, so executors must be able to import
    the package whether or not it is installed there.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):
        archive = os.path.join(tempfile.mkdtemp(prefix="marketspark-code-"), "marketspark.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(package):
                for name in sorted(files):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
    _shipped.add(context.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and hand-over tables.

    A cluster names it in ``spark.checkpoint.dir``; only on one machine (master ``local[...]``)
    is a new temporary folder made where neither that setting nor a checkpoint folder exists.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return root or current.get()
    if not root and not context.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or tempfile.mkdtemp(prefix="marketspark-")
    context.setCheckpointDir(root)
    return root


_made: dict[str, list[tuple[int, str]]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used before; ``clean`` removes what was written there."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append((threading.get_ident(), path))
    return path


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder in whatever store it lies; whether there was one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def handed_over(spark: SparkSession) -> list[str]:
    """The paths that ``new_path`` gave to this thread and that were not cleaned since, oldest first."""
    return [path for thread, path in _made.get(spark.sparkContext.applicationId, []) if thread == threading.get_ident()]


def clean(spark: SparkSession, paths: Collection[str] | None = None) -> int:
    """Remove the hand-over tables of this application, or only ``paths`` of them; to be called when they have been read."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    gone = {path for _, path in made if paths is None or path in paths}
    if left := [x for x in made if x[1] not in gone]:
        _made[spark.sparkContext.applicationId] = left
    return sum(remove(spark, path) for path in sorted(gone))


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage with a reliable checkpoint that outlives executors."""
    ship_code(df.sparkSession)
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
