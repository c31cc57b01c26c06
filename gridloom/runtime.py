"""Scratch tables in the shared folder, and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_shipped: set[str] = set()
_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode and where that is unset, a temporary folder."""
    global _own
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _own, True)
    return _own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of this application's; all of them go when the driver's JVM ends."""
    base = f"{shared_dir(spark)}/gridloom/{spark.sparkContext.applicationId}"
    if base not in _used:
        _used.add(base)
        at = spark._jvm.org.apache.hadoop.fs.Path(base)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing reads any more."""
    files = df.inputFiles()
    if files and "/gridloom/" in files[0]:
        delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def clean_scratch(spark: SparkSession, hours: float) -> list[str]:
    """Delete scratch folders of other applications that are older than so many hours; their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    base = path(f"{shared_dir(spark)}/gridloom")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for s in fs.listStatus(base) if fs.exists(base) else []:
        name = s.getPath().getName()
        if name != spark.sparkContext.applicationId and time.time() - s.getModificationTime() / 1000 >= hours * 3600:
            fs.delete(s.getPath(), True)
            out.append(name)
    return sorted(out)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        at = os.path.join(tempfile.mkdtemp(prefix="gridloom-code-"), "gridloom_code.zip")
        with zipfile.ZipFile(at, "w") as z:
            for d, _, names in os.walk(root):
                for x in names:
                    if x.endswith(".py"):
                        full = os.path.join(d, x)
                        z.write(full, os.path.join("gridloom", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(at)
        atexit.register(shutil.rmtree, os.path.dirname(at), True)
    _shipped.add(app)
