"""Run a streaming DataFrame over what its source has, and read the result back as a batch."""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming import StreamingQueryListener

from ..session import configure


def shared_folder(spark: SparkSession) -> str:
    """A new path under the folder that driver and executors share; /tmp/checkpoints where none is set and the master is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_time(df: DataFrame, ts: str, lateness: str = "0 seconds") -> DataFrame:
    """Watermark on ``ts``; times without a zone are taken as UTC, as a watermark needs a zone."""
    if dict(df.dtypes)[ts] not in ("timestamp", "timestamp_ntz"):
        raise TypeError(f"{ts} is no timestamp")
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def ended(df: DataFrame, ts: str, at: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream with a source more, and a function that puts one row into that source: null but for its time ``at``.

    A watermark that stands at a bounded stream's last time passes it only with a later row. ``drain`` calls the function
    (``end``) when all other input has been read, so the row comes last. Operators see a null key or hold the row back.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    row = [(F.lit(at) if c == ts else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes]
    spark.createDataFrame([], df.schema).write.parquet(path)
    more = spark.readStream.schema(df.schema).parquet(path)
    return df.unionByName(more), lambda: spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(path)


def without_zone(df: DataFrame) -> DataFrame:
    """Times back to types without a zone, as the batch forms have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def drain(df: DataFrame, mode: str = "append", name: str | None = None, checkpoint: str | None = None, empty_batches: bool = True, end: Callable[[], None] | None = None) -> DataFrame:
    """All that the stream gives for the input there is now, in micro-batches, with ``_batch`` for its batch.

    In append mode windows that the watermark has not passed stay open and are not in the result; complete and update
    mode give a key's rows again in every batch that changes them. Each batch's folder is written once, and replaced if the batch
    runs again. A given ``checkpoint`` lets a later call go on; a new one starts from the beginning. Operators on the wall clock ask for
    another batch for ever: they need ``empty_batches`` False, which leaves out batches without new rows. ``end`` (see ``ended``) is called when
    all input has been read, and the stream then goes on to its new end.
    """
    spark = configure(df.sparkSession)
    path = shared_folder(spark)
    schema = df.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/_batch={number}")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write)
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    for go_on in (None, end) if end else (None,):
        if go_on:
            go_on()
        spark.conf.set(setting, str(empty_batches).lower())
        try:
            query = (writer.queryName(name) if name else writer).start()  # the query keeps the settings of its start
        finally:
            spark.conf.set(setting, before)
        query.awaitTermination()
    empty = spark.createDataFrame([], schema).withColumn("_batch", F.lit(0))
    try:
        return spark.read.schema(empty.schema).option("basePath", f"{path}/out").parquet(f"{path}/out")
    except Exception as error:  # no batch had to run
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return empty


class Progress(StreamingQueryListener):
    """What queries report of each micro-batch: ``table`` has it as rows. Add it with ``spark.streams.addListener``.

    One row a micro-batch is kept, the last ``most`` of them.
    """

    FIELDS = "name string, batch long, watermark string, input_rows long, state_rows long, late_rows long, ms long"

    def __init__(self, most: int = 10_000):
        self.rows: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = p.stateOperators or []
        late = sum(s.numRowsDroppedByWatermark for s in states)
        self.rows.append((p.name, p.batchId, dict(p.eventTime or {}).get("watermark"), p.numInputRows, sum(s.numRowsTotal for s in states), late, dict(p.durationMs or {}).get("triggerExecution")))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.FIELDS)


def state_table(spark: SparkSession, checkpoint: str, variable: str | None = None, operator: int = 0) -> DataFrame:
    """The state that a checkpoint holds, as rows: of a built-in aggregate or join, or of a processor's ``variable``."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    return (reader.option("stateVarName", variable) if variable else reader).load(checkpoint)


def last_state(drained: DataFrame, keys: list[str]) -> DataFrame:
    """Of an update-mode result, each key's row of the last batch that has it."""
    rest = [c for c in drained.columns if c not in keys and c != "_batch"]
    out = drained.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_s"))
    return out.select(*keys, *[F.col("_s")[c].alias(c) for c in rest])


def watermark_audit(df: DataFrame, ts: str, partition: str, offset: str) -> DataFrame:
    """Each row with the largest time before it in its partition, and whether it came later than that."""
    from pyspark.sql import Window

    w = Window.partitionBy(partition).orderBy(offset).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("watermark", F.max(ts).over(w)).withColumn("late", F.coalesce(F.col(ts) < F.col("watermark"), F.lit(False)))
