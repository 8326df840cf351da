"""The folder that all executors share, and folders of our own below it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder of this machine, and only if the
    executors run on it: elsewhere each would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wayfare-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of our own, not made yet; ``remove_all`` removes it."""
    path = f"{shared_folder(spark)}/wayfare-{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    system, where = _file(spark, path)
    system.delete(where, True)


def remove_all(spark: SparkSession) -> None:
    """Removes every folder that this application made: call it when no result of it is read any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, by the file system of its path."""
    system, where = _file(spark, path)
    out = system.create(where, True)
    out.write(data)
    out.close()


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table written below the shared folder and read back: its lineage ends here, and it is computed once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
