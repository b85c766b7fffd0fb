"""Session helpers. The caller owns the session; nothing here changes its settings
except the checkpoint folder, and that only where none is configured."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(app: str = "hanok", cores: str | int = "*", **conf) -> SparkSession:
    """Session for tests and the bench. On a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="hanok-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


_scopes = threading.local()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, never reused between runs."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`scratch_path` named, in whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Folders named inside are removed at the end, unless they were taken out of the list: for steps whose result is
    written, so that nothing lazy reads them any more."""
    before = getattr(_scopes, "open", [])
    made: list[str] = []
    _scopes.open = [*before, made]
    try:
        yield made
    finally:
        _scopes.open = before
        for path in made:
            remove(spark, path)


def cut(df):
    """Cut the lineage of a loop step through the shared folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df, label: str = "settled"):
    """Like :func:`cut`; within a :func:`scratch_scope` a written table that goes with the scope, as checkpoints would stay."""
    if not getattr(_scopes, "open", []):
        return cut(df)
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
