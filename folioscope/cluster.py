"""What operators need of a cluster: this package in its Python workers, and a folder that all share."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """One machine only: the driver's folders are those of the workers."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession | None = None) -> None:
    """Send the package to the workers once an application.

    Every operator whose Python functions run there calls this. Nothing is sent where workers
    find the package themselves: on one machine, if the driver runs in the repository's
    folder or has it on PYTHONPATH, which workers inherit.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if is_local(spark) and any(p and Path(p).resolve() == root for p in known):
        return
    archive = Path(tempfile.mkdtemp(prefix="folioscope-")) / "folioscope.zip"
    atexit.register(shutil.rmtree, str(archive.parent), True)
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "folioscope").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    sys.path[:] = [p for p in sys.path if p != str(archive)]
    _SHIPPED.add(spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, a laptop) is a temporary
    folder made and set; a cluster without the setting is an error, since every executor
    would write its own disk and the tables read back would be incomplete.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        atexit.register(shutil.rmtree, found[len("file://") :], True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    if spark.sparkContext._jsc is None:  # the session has ended; a local folder can still go
        local = path.removeprefix("file://")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
