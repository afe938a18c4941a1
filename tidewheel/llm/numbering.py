"""Numbers for the rows of large groups, and what SQL needs to say the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

#: A task's rows are counted from its partition's number times this.
_STRIDE = 1 << 33


def number(rows: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int, name: str = "_i") -> DataFrame:
    """Add ``name``, each row's place (from 0) within its keys by ``order``, nulls first; keys must have no nulls.

    A key may hold a large part of all rows, so rows are dealt over tasks by range of keys and order, counted in each
    task, and moved on by what earlier tasks hold of the same key: one row for each task and key is all that is gathered.
    Rows that are equal in keys and order are numbered in any order.
    """
    by = [F.asc(c) for c in keys] + [F.asc_nulls_first(c) for c in order]
    dealt = rows.repartitionByRange(partitions, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = stash(dealt).withColumn("_task", F.expr(f"_at div {_STRIDE}"))
    held = placed.groupBy("_task", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("_task", *keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(starts, ["_task", *keys]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_task", "_at", "_shift")


def crc32_sql(number: str) -> str:
    """DuckDB's form of the unsigned crc32 of a number's decimal text, bit by bit."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(list_reduce({digits}, lambda c, b: list_reduce(range(8), lambda x, k: {bit}, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"
