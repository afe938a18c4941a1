"""Projection, filters, branches, aggregates, limits and set operations.

All are single expressions of built-in functions: filters and column choices reach the scan, aggregates
combine before their one shuffle. They work on streams too, except where a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import fresh


def where_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose ``column`` equals ``value``, with all columns; null never equals."""
    return df.filter(F.col(column) == F.lit(value))


def where_at_least(df: DataFrame, column: str, value, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the rows with ``column`` >= ``value``."""
    return df.filter(F.col(column) >= F.lit(value)).select(*columns)


def difference(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(a) - F.col(b))


def concatenated(df: DataFrame, name: str, *parts: Column) -> DataFrame:
    """The parts, cast to text, one after another; null if any part is null."""
    return df.withColumn(name, F.concat(*[p.cast("string") for p in parts]))


def branch(df: DataFrame, rules: Sequence[tuple[str, Column]], default: str | None = None, name: str = "branch") -> DataFrame:
    """Tag each row with the first rule that holds; a null condition does not. Rows without one get ``default``, or go if there is none."""
    first = reduce(lambda chain, rule: chain.when(rule[1], rule[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    tagged = df.withColumn(name, first.otherwise(F.lit(default)) if default is not None else first)
    return tagged if default is not None else tagged.filter(F.col(name).isNotNull())


def split_by(df: DataFrame, rules: Mapping[str, Column]) -> dict[str, DataFrame]:
    """One frame for each independent rule; a row may be in several or in none (a null condition is not met)."""
    return {name: df.filter(rule) for name, rule in rules.items()}


def split_title(df: DataFrame, column: str, first: str, second: str, delimiter: str = "::", errors: str | None = None) -> DataFrame:
    """``name::year`` into two columns. A bad year is null; ``errors`` names a column that then holds the input."""
    parts = F.split(column, "\\Q" + delimiter + "\\E")
    year = F.get(parts, F.lit(1)).try_cast("int")
    out = df.withColumn(first, F.get(parts, F.lit(0))).withColumn(second, year)
    return out.withColumn(errors, F.when(F.col(second).isNull(), F.col(column))) if errors else out


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Every leaf of the structs, at any depth, as a column named by its path; arrays and maps stay."""

    def leaves(fields: Sequence[T.StructField], path: tuple[str, ...]):
        for f in fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in leaves(df.schema.fields, ())])


def mask(df: DataFrame, *columns: str) -> DataFrame:
    """Upper case to X, lower case to x, digits to n, all else to -."""
    return df.withColumns({c: F.mask(c, F.lit("X"), F.lit("x"), F.lit("n"), F.lit("-")) for c in columns})


def mapped(df: DataFrame, column: str, values: Mapping, name: str, otherwise=None) -> DataFrame:
    """CASE column WHEN value THEN result ... END."""
    chain = reduce(lambda c, kv: c.when(F.col(column) == kv[0], kv[1]), list(values.items())[1:], F.when(F.col(column) == next(iter(values)), values[next(iter(values))]))
    return df.withColumn(name, chain.otherwise(F.lit(otherwise)))


def known(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def unknown(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def tagged(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def transform_rows(df: DataFrame, function, schema) -> DataFrame:
    """A record transform in Python that may drop rows: ``function`` takes and returns batches of rows as pandas frames."""
    return df.mapInPandas(lambda batches: (out for b in batches if len(out := function(b))), schema)


def count_by(df: DataFrame, *keys: str, column: str | None = None, name: str = "n") -> DataFrame:
    """Rows of each key, or its non-null values of ``column``."""
    return df.groupBy(*keys).agg(F.count(column or "*").alias(name))


def count_all(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def sum_by(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(column).alias(name))


def min_max_by(df: DataFrame, key, column: str, low: str, high: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(column).alias(low), F.max(column).alias(high))


def running_average(df: DataFrame, key: str, column: str) -> DataFrame:
    """The (count, sum) state and the average, by key."""
    return df.groupBy(key).agg(F.count(column).alias("count"), F.sum(column).alias("sum"), F.avg(column).alias("average"))


def custom_aggregate(df: DataFrame, key: str, column: str, function, returns: str, name: str) -> DataFrame:
    """An aggregate in Python over each key's values. The values of one key come together in one task: for keys of bounded size only."""
    own = F.pandas_udf(function, returns, F.PandasUDFType.GROUPED_AGG)
    return df.groupBy(key).agg(own(F.col(column)).alias(name))


def cogrouped_rollup(frames: Sequence[DataFrame], outer: str, inner: str) -> DataFrame:
    """Several keyed frames into one aggregate: the rows of each ``inner`` of each ``outer``, as ``n``; one row a pair, so an outer key may have any number."""
    union = reduce(DataFrame.unionByName, [f.select(outer, inner) for f in frames])
    return union.groupBy(outer, inner).agg(F.count("*").alias("n"))


def rollup_maps(counts: DataFrame, outer: str, inner: str) -> DataFrame:
    """The counts of each ``outer`` as one map: only for inner keys of bounded number, as a map is one row."""
    return counts.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "n")))).alias("counts"))


def having(df: DataFrame, keys: Sequence[str], least: int, name: str = "n") -> DataFrame:
    """Keys with more than ``least`` rows."""
    return count_by(df, *keys, name=name).filter(F.col(name) > least)


def integer_average(df: DataFrame, key, column: str, name: str) -> DataFrame:
    """SUM / COUNT in whole numbers, truncating."""
    return df.groupBy(key).agg(F.expr(f"sum({column}) div count({column})").alias(name))


def latest(df: DataFrame, key: str | Sequence[str], order: Sequence[str], delete: Column | None = None) -> DataFrame:
    """A stream as a table: each key's last row by ``order``; keys whose last row meets ``delete`` go."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest]).select(*df.columns)
    return out.filter(~F.coalesce(delete, F.lit(False))) if delete is not None else out


def earliest_value(df: DataFrame, key: str, value: str, order: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(name))


def _since_delete(df: DataFrame, key: str, order: str, delete: Column) -> DataFrame:
    """Each key's rows since its last delete marker."""
    w = Window.partitionBy(key).orderBy(order)
    run, last = fresh(df, "run", "last")
    marks = F.sum(F.when(delete, 1).otherwise(0)).over(w)
    marked = df.withColumn(run, marks).withColumn(last, F.max(run).over(Window.partitionBy(key)))
    return marked.filter((F.col(run) == F.col(last)) & ~F.coalesce(delete, F.lit(False))).drop(run, last)


def collected(df: DataFrame, key: str, value: str, order: str, delete: Column) -> DataFrame:
    """Each key's values in order since its last delete marker; keys that end with one go. For keys of bounded size only."""
    kept = _since_delete(df, key, order, delete)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def totals_since_delete(df: DataFrame, key: str, value: str, order: str, delete: Column, count: str, total: str) -> DataFrame:
    """How many rows each key has since its last delete marker, and their sum: nothing is collected."""
    return _since_delete(df, key, order, delete).groupBy(key).agg(F.count("*").alias(count), F.sum(value).alias(total))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; each task keeps k, so nothing is sorted as a whole. Batch only."""
    return df.orderBy(*order).limit(k)
