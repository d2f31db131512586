"""Sessions and small shared helpers for reading the input tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "tracewright", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested under (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRACEWRIGHT_DRIVER_MEMORY", "6g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be of any file system Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application.

    Harmless where they have it already; without it, a UDF of this package can only be
    loaded where the package is installed on every node.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    held = Path(tempfile.mkdtemp(prefix="tracewright-")) / f"{here.name}-{sc.applicationId}.zip"
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    sc.addPyFile(str(held))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir.

    Where that is unset (tests, a local session) a temporary folder of this machine is
    made once and set, which is right only in local mode; on a cluster it's an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_WRITTEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


def discard_tables(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder; how many paths there were.

    Results are read from these tables when they are used, so this is for the end of a job.
    """
    gone = 0
    while _WRITTEN:
        gone += _delete(spark, _WRITTEN.pop())
    return gone


def materialize(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there,
    a lost executor costs nothing that is already written, and both sides of a later
    self-join read the same rows. If ``release``, the shuffles that made it go at once;
    else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, "false")
    spark.conf.set(key, "true" if release else held)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, held)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)
