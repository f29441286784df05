"""Session construction and stages in the shared folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def build_session(app: str = "meetlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on and UTC time; sizes stay with the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a folder of its own only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="meetlake-stage-")
    return _LOCAL[app]


def fresh_folder(spark: SparkSession, name: str, below: str | None = None) -> str:
    """A path that no other run uses, below the given folder or the shared one."""
    return f"{below or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame, below: str | None = None) -> DataFrame:
    """Write a reduced table once as Parquet and read it back, so that several consumers share one pass.

    Readers still prune columns and push filters down, and a lost executor costs only its own tasks.
    """
    path = fresh_folder(df.sparkSession, "stage", below)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, size and time of every file below a folder (none if there is no such folder)."""
    root, system = _folder(spark, path)
    out = []
    if system.exists(root):
        files = system.listFiles(root, True)
        while files.hasNext():
            status = files.next()
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(out)


def file_stamp(spark: SparkSession, folder: str) -> tuple:
    """What a result that is kept for the session depends on: all files below a folder."""
    return tuple(folder_files(spark, folder))


def remove_folder(spark: SparkSession, path: str) -> None:
    root, system = _folder(spark, path)
    system.delete(root, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, for sessions that did not start from its folder."""
    if spark.sparkContext.master.startswith("local["):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='meetlake-ship-')}/meetlake", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)  # the driver serves it to the executors
