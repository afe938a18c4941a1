"""Joins: by time distance, as of a time, on foreign keys, against small or replicated tables, and to arrays.

No join here is a cross join. A side is broadcast only if it is declared small by the caller and its counted rows
prove it (``small``); otherwise Spark chooses, and splits skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import fresh

#: Rows, and bytes as text, up to which a static side is broadcast.
SMALL, SMALL_BYTES = 100_000, 32 << 20


def small(df: DataFrame, most: int = SMALL, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (counted up to that many) of ``most_bytes`` in all, written as JSON; else as it is."""
    if df.isStreaming:
        return df
    size = df.limit(most + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return F.broadcast(df) if size.n <= most and (size.bytes or 0) <= most_bytes else df


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_ts: str, right_ts: str, lower: str, upper: str, bucket_seconds: int | None = None) -> DataFrame:
    """Pairs with equal keys and right_ts in [left_ts + lower, left_ts + upper], bounds as interval texts ("0 seconds", "-10 minutes").

    A hot key is a problem of all its pairs of times: with ``bucket_seconds`` (at least the width of the bounds) rows also
    meet on their time bucket, so a key's rows are spread over its buckets and only near rows meet. Batch only.
    """
    l_names = {c: f"l_{c}" if c in right.columns else c for c in left.columns}
    a = left.withColumnsRenamed(l_names)
    on = [F.col(l_names[x]) == F.col(y) for x, y in keys]
    ts = F.col(l_names[left_ts])
    within = (F.col(right_ts) >= ts + F.expr(f"interval {lower}")) & (F.col(right_ts) <= ts + F.expr(f"interval {upper}"))
    if bucket_seconds:
        bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / bucket_seconds)
        b, c = fresh((*a.columns, *right.columns), "b", "c")
        a = a.withColumn(b, F.explode(F.sequence(bucket(ts + F.expr(f"interval {lower}")), bucket(ts + F.expr(f"interval {upper}")))))
        right = right.withColumn(c, bucket(F.col(right_ts)))
        on.append(F.col(b) == F.col(c))
    joined = a.join(right, [*on, within])
    return joined.drop(b, c) if bucket_seconds else joined


def symmetric_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_ts: str, right_ts: str, within: str, **how) -> DataFrame:
    """Pairs with equal keys whose times are at most ``within`` apart."""
    return interval_join(left, right, keys, left_ts, right_ts, f"-{within}", within, **how)


def lookup_with_ttl(df: DataFrame, key: str, ts_ms: str, value: str, side: str, ttl_ms: int) -> DataFrame:
    """Stacked rows of a stream (side 1) and a table (side 0): each stream row with the table's last value, unless that is older than the limit.

    key, ts_ms, left, right; a null value removes the key from the table, and at one time the table's rows come first. One window over both sides.
    """
    (seen,) = fresh(df, "seen")
    w = Window.partitionBy(key).orderBy(ts_ms, side).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(side) == 0, F.struct(F.col(ts_ms).alias("t"), F.col(value).alias("v"))), ignorenulls=True).over(w)
    rows = df.withColumn(seen, last).filter(F.col(side) == 1)
    return rows.select(key, ts_ms, F.col(value).alias("left"), F.when(F.col(ts_ms) - F.col(seen)["t"] <= ttl_ms, F.col(seen)["v"]).alias("right"))


def theta_join(left: DataFrame, right: DataFrame, key: tuple[str, str], residual: Column) -> DataFrame:
    """Equal keys and any further condition."""
    return left.join(right, (left[key[0]] == right[key[1]]) & residual)


def table_join(stream: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A stream, or rows, with the table's row of the same key (``how``: inner or left)."""
    return stream.join(table, list(on), how)


def replicated_join(stream: DataFrame, table: DataFrame, key: Column, table_key: str) -> DataFrame:
    """The stream is not moved if the table proves small."""
    return stream.join(small(table), key == table[table_key])


def foreign_key_join(child: DataFrame, parent: DataFrame, reference: str, parent_id: str, child_id: str, name: str = "id") -> DataFrame:
    """Each child with the parent that it refers to, under the id ``parent-child``."""
    joined = child.join(parent, child[reference] == parent[parent_id])
    return joined.withColumn(name, F.concat_ws("-", parent[parent_id].cast("string"), child[child_id].cast("string")))


def left_joins(stream: DataFrame, *tables: tuple[DataFrame, str]) -> DataFrame:
    """Left joins with several tables, each by its key of the same name."""
    for table, key in tables:
        stream = stream.join(table, key, "left")
    return stream


def as_of(left: DataFrame, versions: DataFrame, keys: Sequence[str], left_ts: str, version_ts: str, values: Sequence[str], retention: str | None = None, how: str = "left") -> DataFrame:
    """Each row with the values of its key's latest version at or before its time.

    Both sides are stacked, sorted once by key and time, and the last version is carried forward: linear in the rows,
    where a range join would pair every row with every version of its key. A version older than ``retention`` is
    no match. ``how``: left keeps rows without a version, inner drops them.
    """
    version = F.struct(F.col(version_ts).alias("_at"), *[F.col(v).alias(f"_{v}") for v in values])
    null = F.lit(None)
    tagged = versions.select(*keys, F.col(version_ts).alias("_ts"), F.lit(0).alias("_side"), version.alias("_version"), null.alias("_row"))
    row = F.struct(*left.columns)
    asked = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), null.alias("_version"), row.alias("_row"))
    version_type, row_type = tagged.schema["_version"].dataType, asked.schema["_row"].dataType
    both = tagged.withColumn("_row", null.cast(row_type)).unionByName(asked.withColumn("_version", null.cast(version_type)))
    w = Window.partitionBy(*keys).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_version", F.last("_version", ignorenulls=True).over(w)).filter("_side = 1")
    out = out.select("_row.*", "_version")
    if retention:
        fresh = F.col("_version._at") >= F.col(left_ts) - F.expr(f"interval {retention}")
        out = out.withColumn("_version", F.when(fresh, F.col("_version")))
    if how == "inner":
        out = out.filter("_version is not null")
    return out.select(*left.columns, *[F.col(f"_version._{v}").alias(v) for v in values])


def watch_list(stream: DataFrame, listed: DataFrame, key: str, listed_key: str, ts: str, size: str, more_than: int) -> DataFrame:
    """Listed keys with more than so many rows in a tumbling window."""
    met = stream.join(small(listed), stream[key] == listed[listed_key])
    counted = met.groupBy(F.window(ts, size).alias("window"), key).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)
    return counted.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def unnest(df: DataFrame, array: str, name: str, keep: Sequence[str]) -> DataFrame:
    """One row for each element; empty and null arrays have none."""
    return df.select(*keep, F.explode(array).alias(name))


def lateral(df: DataFrame, function, schema) -> DataFrame:
    """A table function for each batch of rows: it returns any number of rows."""
    return df.mapInPandas(lambda batches: map(function, batches), schema)


def with_own_count(df: DataFrame, key: str, order: Sequence[str], ts_ms: str, within_ms: int) -> DataFrame:
    """A stream joined with its own running count: each row meets the counts of its key emitted at most ``within_ms`` before or after it."""
    k, t, b, c = fresh(df, "k", "t", "b", "c")
    counts = df.select(F.col(key).alias(k), F.col(ts_ms).alias(t), F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long").alias("count"))
    span = within_ms + 1
    near = df.withColumn(b, F.explode(F.array(*[F.floor(F.col(ts_ms) / span) + d for d in (-1, 0, 1)])))
    counts = counts.withColumn(c, F.floor(F.col(t) / span))
    return near.join(counts, (F.col(key) == F.col(k)) & (F.col(b) == F.col(c)) & (F.abs(F.col(ts_ms) - F.col(t)) <= within_ms)).drop(b, c, k, t)
