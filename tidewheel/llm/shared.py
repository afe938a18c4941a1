"""Small helpers that several training-data operators use."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Words of a text: runs of characters other than blank, tab, \n, \v, \f, \r (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Texts can be long, so a batch that goes to Python is bounded by its bytes; and shuffle files go when the query that wrote them ends.

    What a later step reads again is in the shared folder by then (``stash``). All queries use the same settings, as results are lazy.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_folder(spark: SparkSession) -> str:
    """A new path under the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a local master, as in tests, gets /tmp/checkpoints; on a cluster that is an error, as
    each executor would write to its own disk.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidewheel-{uuid.uuid4().hex}"


def tasks(spark: SparkSession, size: int | None, each: int = 64 << 20) -> int:
    """How many partitions ``size`` bytes are dealt over: the session's number, or more if a partition had more than ``each`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // each))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until ``df`` has no column of that name (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class Recent(dict):
    """Results by key, computed when they are missing. Of ``most`` entries and those before them, what is met again stays.

    Keys that are texts of more than ``longest`` characters are not kept.
    """

    def __init__(self, compute: Callable, most: int, longest: int = 40):
        super().__init__()
        self.compute, self.most, self.longest, self.before = compute, most, longest, {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.compute(key)
        if type(key) is int or len(key) <= self.longest:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = found
        return found


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
