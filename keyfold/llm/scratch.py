"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, shared_root

#: Rows that go to a Python worker at once: batches of whole texts stay small on both sides.
ROWS_PER_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ROWS_PER_BATCH rows, also for what operators return before it runs."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ROWS_PER_BATCH:
        spark.conf.set(_BATCH, str(ROWS_PER_BATCH))


#: Rows of ids or hashes that may be broadcast, some 32 MB as a hashed relation.
FEW_ROWS = 1 << 18


def few(written: DataFrame) -> DataFrame:
    """``written``, a narrow table that is cheap to count, to be broadcast if it has no more than FEW_ROWS rows; beyond that
    the planner joins it by shuffling."""
    return F.broadcast(written) if written.limit(FEW_ROWS + 1).count() <= FEW_ROWS else written


class Scratch:
    """A folder of Parquet tables that cut lineage: a lost executor costs a reread, never a recomputation.

    Tables that the returned (lazy) DataFrame still reads must outlive the call, so the folder goes when the
    driver ends; ``drop`` removes a table earlier once nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/keyfold-{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        small_batches(spark)
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def release(self) -> None:
        """Shuffle files of finished work go once the driver's objects for them are collected; asks for that now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")
        self.names -= {*names}

    def keep(self, *names: str) -> None:
        """Drops all tables but these, and the shuffle files of what made them."""
        self.drop(*(self.names - {*names}))
        self.release()

    def close(self) -> None:
        if os.environ.get("KEYFOLD_KEEP_SCRATCH"):
            return
        try:
            delete(self.spark, self.path)
        except Exception:  # the JVM may have ended before Python
            pass
