"""Session set-up shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Spark's setting by which the shuffle files of a query are removed at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the Python workers, once per application.

    Functions of the package run inside ``mapInPandas`` and the file source, so
    the executors must be able to import it. Where the package is installed on
    the cluster (or given by ``--py-files``) this call is not needed.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="iocscan-"), "iocscan.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go at their end, not when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def has_at_most(df, limit: int) -> bool:
    """Whether ``df`` has no more than ``limit`` rows, reading at most ``limit + 1``."""
    with shuffles_freed(df.sparkSession):
        return df.limit(limit + 1).count() <= limit


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for data that Spark writes and reads again.

    On a cluster this is below the shared folder in ``spark.checkpoint.dir``; without one only a session in
    a single process gets a temporary folder, as executors would each write to their own disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/iocscan/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"iocscan-{name}-")
