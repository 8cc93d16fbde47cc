"""Session defaults, table access and ways to cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", shuffle_partitions).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table: a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in spark.checkpoint.dir; only on one machine (a local master) may that be unset, and
    a temporary folder is made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="querymill-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """An unused full path in the shared folder, below a folder of this application that is removed when the driver ends."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    known = _folders.get(key)
    if known is None:
        at, fs = _hadoop(spark, f"{key[1]}/querymill-{key[0]}")
        known = fs.makeQualified(at).toString()
        if known.startswith("file:/") and not known.startswith("file://"):
            known = known.replace("file:/", "file:///", 1)
        _folders[key] = known
        atexit.register(release, spark)
    path = f"{known}/{label}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


_folders: dict[tuple[str, str], str] = {}
_open: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _hadoop(spark, path)
    fs.delete(at, True)


def release(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application; DataFrames that read them can't be used any more."""
    own = spark.sparkContext.applicationId if spark.sparkContext._jsc else ""
    for key in [k for k in _folders if k[0] == own]:
        try:
            _delete(spark, _folders.pop(key))
        except Exception:  # the session may be gone when the driver ends
            pass


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written inside are removed at the end, so results must be written or collected inside too."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open[:] = [x for x in _open if x is not made]
        for path in made:
            _delete(spark, path)


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a table into the shared folder and reads it back, so that a lost executor costs nothing
    before this point and no later step computes it again. Runs a Spark job when called. See scratch() and release() for when tables go."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a full path or of a local one, for workers that read single files or footers."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where they couldn't otherwise: sends it to them once, as a zip."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root in {os.path.abspath(p) for p in known if p} or getattr(spark.sparkContext, "_querymill_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="querymill-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "querymill-package"), "zip", root, "querymill"))
    spark.sparkContext._querymill_shipped = True
