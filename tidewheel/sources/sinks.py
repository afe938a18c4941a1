"""Sinks and routing: dead letters, routes, continuous tables, format changes, and error budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import stash


def dead_letters(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, dead): rows that fail a check go unchanged to the second, with the first failing check's name in ``error``.

    A null condition fails. Both are filters of one tagged frame; on a stream write both from one ``foreachBatch``.
    """
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    tagged = df.withColumn("error", error)
    return tagged.filter("error is null").drop("error"), tagged.filter("error is not null")


def write_both(good_path: str, dead_path: str, checks: Mapping[str, Column]):
    """A ``foreachBatch`` function that writes good rows and dead letters of a batch; a batch that runs again replaces its own folders."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for frame, path in zip(dead_letters(held, checks), (good_path, dead_path), strict=True):
                frame.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            held.unpersist()

    return write


def upsert(batch: DataFrame, path: str, keys: Sequence[str], order: str, buckets: int, gone: Column | None = None) -> None:
    """Merge rows into the table at ``path``: of each key the row with the greatest ``order`` stays; where ``gone`` is true it deletes the key.

    The table is Parquet in ``buckets`` folders by a digest of the key, and only folders that the batch touches are read and written again. A
    deletion is kept as a row (``_gone``), so that older rows that come later do not bring the key back; ``upserted`` leaves it out. The merge
    depends on rows alone, not on how often they came, so a batch that runs again changes nothing. Of rows equal in key and order one that deletes stays.
    """
    spark = batch.sparkSession
    (bucket, dead) = ("_bucket", "_gone")
    rows = batch.withColumn(dead, F.coalesce(gone if gone is not None else F.lit(False), F.lit(False))).withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    rows = stash(rows)
    touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    try:
        held = spark.read.schema(rows.schema).parquet(path).filter(F.col(bucket).isin(touched))
        rows = rows.unionByName(held.select(*rows.columns))
    except AnalysisException as error:  # the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
    rest = [c for c in rows.columns if c not in (*keys, bucket)]
    merged = rows.groupBy(bucket, *keys).agg(F.max_by(F.struct(*rest), F.struct(order, dead)).alias("_last"))
    # Written aside first: what is read must not be what is replaced.
    merged = stash(merged.select(*keys, *[F.col("_last")[c].alias(c) for c in rest], bucket))
    merged.repartition(len(touched), bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``upsert`` keeps."""
    return spark.read.parquet(path).filter("not _gone").drop("_gone", "_bucket")


def upsert_sink(path: str, keys: Sequence[str], order: str, buckets: int, gone: Column | None = None):
    """A ``foreachBatch`` function that merges each batch of a stream of changes into the table at ``path``."""
    return lambda batch, number: upsert(batch, path, keys, order, buckets, gone)


def write_routes(df: DataFrame, route: str, path: str) -> None:
    """One folder for each value of ``route``; rows of a route stay where they are, no shuffle."""
    df.write.mode("append").partitionBy(route).parquet(path)


def routed(df: DataFrame, composite: str, delimiter: str, special: Sequence[str], yes: str, no: str) -> DataFrame:
    """The route of each row by the letters after the delimiter of a composite id."""
    from ..functions.scalars import composite_part

    return df.withColumn("route", F.when(composite_part(F.col(composite), delimiter).isin(*special), yes).otherwise(no))


def continuous_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """A stream into a table as long as there is input (``availableNow``); a batch frame is appended at once."""
    if not df.isStreaming:
        return df.write.mode("append").saveAsTable(name)
    return df.writeStream.queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).toTable(name)


def convert(df: DataFrame, path: str, fmt: str) -> None:
    """Write in another format: parquet, orc, json or csv, or avro and protobuf where their packages are installed."""
    df.write.mode("overwrite").format(fmt).save(path)


def repartitioned_copy(df: DataFrame, key: str, partitions: int, path: str) -> None:
    """A copy with another number of partitions, rows of a key together."""
    df.repartition(partitions, key).write.mode("overwrite").parquet(path)


def rekeyed(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """A new key; rows are dealt by it, once."""
    return df.withColumn(name, key).repartition(name)


def ordered_parallel(df: DataFrame, key: str, order: str, at_once: int, function, schema) -> DataFrame:
    """Rows of a key in order, at most ``at_once`` tasks at a time; ``function`` takes and returns batches."""
    return df.repartition(at_once, key).sortWithinPartitions(key, order).mapInPandas(lambda batches: map(function, batches), schema)


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    return df.observe(name, *[c.alias(n) for n, c in metrics.items()])


def error_log(df: DataFrame, message: str = "message") -> DataFrame:
    """Processing errors as rows: text of the error, its cause, and the record decoded from base64."""
    e = f"{message}.deserializationError"
    return df.select(F.col(f"{e}.errorMessage").alias("error"), F.col(f"{e}.cause").alias("cause"), F.decode(F.unbase64(F.col(f"{e}.recordB64")), "UTF-8").alias("record"))


def failure_budget(df: DataFrame, ts: str, failed: Column, most: int, interval: str) -> DataFrame:
    """Failures at which ``most`` or more fell within the ``interval`` up to them: where a query should stop.

    Failures are added up by second first, so the running frame is over seconds, at most 86,400 a day, not over rows.
    """
    second = F.date_trunc("second", ts)
    seconds = df.filter(failed).groupBy(second.alias("second")).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    day = seconds.withColumn("_day", F.explode(F.array(F.to_date("second"), F.to_date(F.col("second") + F.expr(f"interval {interval}"))))).distinct()
    over = f"over (partition by _day order by second range between interval {interval} preceding and current row)"
    counted = day.withColumn("failures", F.expr(f"sum(n) {over}"))
    return counted.filter((F.to_date("second") == F.col("_day")) & (F.col("failures") >= most)).select("last", "failures")


def check_budget(df: DataFrame, ts: str, failed: Column, most: int, interval: str) -> None:
    over = failure_budget(df, ts, failed, most, interval).limit(1).collect()
    if over:
        raise RuntimeError(f"{over[0].failures} failures within {interval} at {over[0].last}")


def run_with_restarts(start, most: int, within_seconds: float, clock=None) -> int:
    """Start a query and wait for it; restart it after a failure unless ``most`` failures fell within the last seconds. Returns the failures."""
    import time

    clock = clock or time.monotonic
    failures: list[float] = []
    count = 0
    while True:
        try:
            start().awaitTermination()
            return count
        except Exception:
            count += 1
            now = clock()
            failures = [t for t in failures if now - t <= within_seconds] + [now]
            if len(failures) >= most:
                raise


def numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    """Offsets within partitions of a landed topic: 0, 1, ... by order."""
    return df.withColumn("offset", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
