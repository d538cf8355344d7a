"""Tables in the folder that the driver and all executors share.

Lineage is cut with written tables, never with localCheckpoint, so a lost
executor costs a re-read and nothing else.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or the context's own.

    Only where neither is set and Spark runs in this process (tests, a laptop) a
    temporary folder is made and registered as the checkpoint folder; on a
    cluster, whose executors couldn't see it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="gradus-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Folders of this process's runs, oldest first.
CREATED: list[str] = []


def remove_since(spark: SparkSession, mark: int) -> None:
    """Remove the folders made after CREATED held ``mark`` of them; for callers that have written their result."""
    while len(CREATED) > mark:
        remove(spark, CREATED.pop())


class Scratch:
    """Named intermediate tables of one run of an operator.

    A result that is still to be computed may read them, so only who has written
    the result may remove them (drop, remove_since).
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        CREATED.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return a DataFrame that reads it back."""
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables no later step reads."""
        for name in names:
            remove(self.spark, self.path(name))

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now (its cleaner works in the background)."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)


#: Rounds after which a loop that should have ended by itself fails.
MOST_ROUNDS = 1000


def rounds(first: int = 1, last: int | None = None):
    """first, first + 1, … to ``last`` where one is given; else until the caller's loop ends, and an error after MOST_ROUNDS."""
    yield from range(first, first + MOST_ROUNDS if last is None else last + 1)
    if last is None:
        raise RuntimeError(f"not done after {MOST_ROUNDS} rounds")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
