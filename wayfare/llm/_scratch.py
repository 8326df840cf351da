"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from ..storage import new_folder, remove, shared_folder

__all__ = ["Scratch", "shared_folder"]
#: Buckets of a table, at most: beyond, a file holds several values.
FILES = 1 << 16


def release_memory() -> None:
    """Gives back to the system what this process no longer uses: allocators keep it, and an operator's tables on the
    driver would count as long as the session lasts."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


_stage = -1


def start_of_task() -> None:
    """For Python functions of plans: gives back what stages before left in this worker, once for each stage. Workers are used
    again and again, and an executor's memory is that of all of them."""
    global _stage
    context = TaskContext.get()
    own = context.stageId() if context else _stage  # none outside a task
    if own != _stage:
        _stage = own
        release_memory()


class Scratch:
    """Tables of one operator run. ``keep`` writes and rereads a table; ``drop`` removes some that are no longer read,
    ``close`` all of them: call it when the operator's result is not read any more (``storage.remove_all`` closes all)."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        release_memory()
        self.spark, self.root = spark, new_folder(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """Like ``keep``, in buckets of a column: grouping by it needs no further shuffle. More than ``FILES`` buckets share
        files."""
        table, files = f"wayfare_{name}_{uuid.uuid4().hex[:12]}", min(buckets, FILES)
        writer = df.repartition(files, column).write.option("path", self.path(name)).option("compression", "zstd")
        writer.bucketBy(files, column).sortBy(column).saveAsTable(table)
        kept = self.spark.table(table)
        kept.schema  # resolved: the entry in the catalog is no longer needed, its files stay
        self.spark.sql(f"DROP TABLE {table}")
        return kept

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))

    def close(self) -> None:
        remove(self.spark, self.root)
