"""Session settings and shared scratch tables."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Runtime SQL settings the operators rely on.
SQL_SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Per-group samples of up to this many rows are cut before their shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
}

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", memory: str = "8g", name: str = "eventloom") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application.

    A driver that found it on its own path would otherwise be the only process
    that can import it; Python tasks on other machines would fail.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    bundle = io.BytesIO()
    with zipfile.ZipFile(bundle, "w") as out:
        for path, _, names in sorted(os.walk(home)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(path, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(home)))
    # Executors fetch it when their first task starts, so it stays where it is written.
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "package"), f"{os.path.basename(home)}.zip")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(path)
    stream.write(bytearray(bundle.getvalue()))
    stream.close()
    context.addPyFile(files.makeQualified(path).toString())
    _shipped.add(context.applicationId)


_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder.

    Where the setting is absent a folder is made, but only for a local master:
    executors on other machines could not read it.
    """
    named = spark.conf.get(_CHECKPOINT_KEY, None)
    if named is None:
        named = spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors can reach")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="eventloom-")
    return _local_root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one table written by :func:`pin`; other paths are refused."""
    if not path.startswith(shared_root(spark)):
        raise ValueError(f"{path} is not a scratch table")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage of iterative jobs, survives the loss of executors, and
    gives Catalyst real sizes for its join choice. It also fixes row positions
    where a later pass depends on them.
    """
    return pin_at(df, label)[0]


def pin_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """:func:`pin`, with the path for :func:`drop_scratch`."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go.

    Spark removes them once the driver has collected the plans they belong to, which
    may be long after the disks of the executors are full.
    """
    for _ in range(2):  # plans are let go by the first round, their files by the second
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
