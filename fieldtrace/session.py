"""Session factory, table access and lineage cutting."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "fieldtrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC wall clock and adaptive execution.

    Cluster sizes (executors, memory, shuffle partitions) stay with the caller.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session's context; they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_fieldtrace_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="spark-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._fieldtrace_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of parquet files; the workers are sent the package on the way."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all machines of a cluster must see.

    Only on a local master, as in tests, a temporary one is taken where none is
    set; elsewhere that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder named by spark.checkpoint.dir.

    Survives the loss of executors.  df is computed when this is called.
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
