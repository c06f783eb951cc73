"""Session settings and shared storage.

Everything that is kept between jobs (checkpoints, blocking-key tables, representative mappings) goes to the folder
that the session names in ``spark.checkpoint.dir``; only where that is unset, as in tests, is a folder of this process used.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "ledgerloom", **conf: str) -> SparkSession:
    """A session with the library's settings; an existing session is returned as it is."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; set to a temporary folder only where unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        had = spark.sparkContext.getCheckpointDir()
        named = had if had else "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(df: DataFrame) -> None:
    """Deletes the folder of a table that ``stored`` wrote and nothing reads any more; of any other table it deletes nothing."""
    path = getattr(df, "_stored_at", None)
    if path:
        drop_path(df.sparkSession, path)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark reads."""
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text beside its place and moves it there, so that a reader never sees half of it."""
    fs, at = _hadoop(spark, path)
    _, part = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(at, False)
    fs.rename(part, at)


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small text, None where there is none."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
