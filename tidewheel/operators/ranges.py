"""Scans in order over groups of any size, or over a whole table, without bringing a group into one task.

Rows are dealt over tasks by range of key and order. What a scan needs from rows before a task's own is a small carry: each
task's part is reduced to one row, the driver goes over these rows (one a task), and each task's rows are completed with their carry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.replay import shared_folder
from .names import fresh


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, and fixes what was dealt by range."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Ranged:
    """``df`` dealt by range of ``keys`` (which may be none) and ``order``, nulls first; ``rows`` has the task's number in the column ``task``.

    ``order`` should tell rows apart: what is equal in keys and order lies in one task, in any order.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None, taken: Sequence[str] = ()):
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order, self.columns = list(keys), list(order), df.columns
        (self.task,) = fresh(df.select(*df.columns, *[F.lit(0).alias(t) for t in taken if t not in df.columns]), "task")
        by = [F.asc_nulls_first(F.col(f"`{c}`")) for c in (*keys, *order)]
        self.rows = stash(df.repartitionByRange(n, *by).withColumn(self.task, F.spark_partition_id()))

    def window(self):
        """A key's rows of one task, in order."""
        return Window.partitionBy(self.task, *[F.col(f"`{k}`") for k in self.keys]).orderBy(*[F.asc_nulls_first(F.col(f"`{c}`")) for c in self.order])

    def _key(self, *more: str) -> Column:
        return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in (*self.keys, *more)])

    def carried(self, reduced: DataFrame, names: Sequence[str], combine: Callable[[Row | None, Row, bool], tuple]) -> tuple[DataFrame, list[str]]:
        """``rows`` with one new column for each of ``names``: what the tasks before its own leave for its key, null where they have nothing of it.

        ``reduced`` has the task, the columns ``first`` and ``last`` (the first and last key of a task) and ``state`` (a struct with ``names``: what the
        task's rows of its last key come to). ``combine(carry, state)`` puts a carry before a state. One row a task goes over the driver.
        """
        kind = reduced.schema["state"].dataType
        table, carry, key = [], None, None
        for r in reduced.orderBy(self.task).collect():
            if key != r["first"]:
                carry = None
            table.append((r[self.task], tuple(r["first"]), carry))
            carry = combine(carry if r["first"] == r["last"] else None, tuple(r["state"]))
            key = r["last"]
        first, came = fresh(self.rows, "first_key", "carry")
        schema = T.StructType([T.StructField(self.task, T.IntegerType()), T.StructField(first, reduced.schema["first"].dataType), T.StructField(came, kind)])
        more = self.rows.join(F.broadcast(self.rows.sparkSession.createDataFrame(table, schema)), self.task, "left")
        own = self._key().eqNullSafe(F.col(first))
        new = fresh(self.rows, *[f"before_{n}" for n in names])
        return more.withColumns({b: F.when(own, F.col(came)[n]) for b, n in zip(new, names, strict=True)}).drop(first, came), new

    def lag(self, column: str, name: str) -> None:
        """Add ``name``: the column's value in the row before, of the same key."""
        reduced = self.rows.groupBy(self.task).agg(F.min(self._key()).alias("first"), F.max(self._key()).alias("last"), F.max_by(F.struct(F.col(f"`{column}`").alias("value")), self._key(*self.order)).alias("state"))
        rows, (before,) = self.carried(reduced, ["value"], lambda carry, state: state)
        w = self.window()
        self.rows = rows.withColumn(name, F.when(F.row_number().over(w) == 1, F.col(before)).otherwise(F.lag(F.col(f"`{column}`")).over(w))).drop(before)

    def sums(self, values: dict[str, Column], inclusive: bool = False) -> None:
        """Add for each name the sum of its value over the rows of the key before each row (``inclusive``: and itself); 0 where there is none."""
        names = list(values)
        totals = self.rows.groupBy(self.task, *[F.col(f"`{k}`") for k in self.keys]).agg(*[F.sum(v).alias(f"sum_{i}") for i, v in enumerate(values.values())])
        state = F.struct(*[F.col(f"sum_{i}").alias(f"s{i}") for i in range(len(names))])
        reduced = totals.groupBy(self.task).agg(F.min(self._key()).alias("first"), F.max(self._key()).alias("last"), F.max_by(state, self._key()).alias("state"))
        add = lambda carry, own: tuple(b if a is None else a if b is None else a + b for a, b in zip(carry or (None,) * len(own), own, strict=True))
        rows, before = self.carried(reduced, [f"s{i}" for i in range(len(names))], add)
        frame = self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        none = F.lit(0)
        out = {n: F.coalesce(F.sum(v).over(frame), none) + F.coalesce(F.col(b), none) for (n, v), b in zip(values.items(), before, strict=True)}
        self.rows = rows.withColumns(out).drop(*before)
