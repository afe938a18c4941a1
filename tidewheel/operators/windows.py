"""Time windows: tumbling, hopping, cumulating, session and sliding.

Each takes aggregates as keyword columns. On a stream with a watermark they run incrementally; results
are final in append mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .analytic import over_interval
from .names import fresh
from .ranges import Ranged


def _flat(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *names)


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str] = (), **aggregates: Column) -> DataFrame:
    grouped = df.groupBy(F.window(ts, size).alias("window"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return _flat(grouped, keys, list(aggregates))


def hopping(df: DataFrame, ts: str, size: str, step: str, keys: Sequence[str] = (), **aggregates: Column) -> DataFrame:
    grouped = df.groupBy(F.window(ts, size, step).alias("window"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return _flat(grouped, keys, list(aggregates))


def cumulating_sum(df: DataFrame, ts: str, step_seconds: int, most_seconds: int, value: Column, name: str, keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Sums over windows that grow by a step up to the largest and then start anew; windows whose span holds no row do not appear.

    Rows are first added up by step, so the expansion is of at most most / step rows for each step that has any. On a stream with a
    watermark the steps' sums come from one windowed aggregate and go on, with the time of their window, into a second one; the windows that begin at one time
    are given out when the watermark has passed the end of the largest.
    """
    if df.isStreaming:
        return _cumulating_stream(df, ts, step_seconds, most_seconds, value, name, keys, digits)
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    base = F.floor(seconds / most_seconds) * most_seconds
    steps = most_seconds // step_seconds
    summed = df.groupBy(*keys, base.alias("_base"), (F.floor((seconds - base) / step_seconds) + 1).alias("_step")).agg(F.sum(value).alias("_sum"))
    grown = summed.withColumn("_step", F.explode(F.sequence("_step", F.lit(steps).cast("long"))))
    total = F.sum("_sum")
    out = grown.groupBy(*keys, "_base", "_step").agg((F.round(total, digits) if digits is not None else total).alias(name))
    at = lambda x: F.timestamp_seconds(x).cast("timestamp_ntz")
    return out.select(*keys, at(F.col("_base")).alias("window_start"), at(F.col("_base") + F.col("_step") * step_seconds).alias("window_end"), name)


def _cumulating_stream(df: DataFrame, ts: str, step_seconds: int, most_seconds: int, value: Column, name: str, keys: Sequence[str], digits: int | None) -> DataFrame:
    steps = most_seconds // step_seconds
    at, summed_, step = fresh(df, "at", "sum", "step")
    summed = df.groupBy(F.window(ts, f"{step_seconds} seconds").alias("window"), *keys).agg(F.sum(value).alias(summed_)).withColumn(at, F.window_time("window"))
    place = F.expr(f"(unix_seconds(window.start) % {most_seconds}) div {step_seconds} + 1")
    grown = summed.select(*keys, at, summed_, F.explode(F.sequence(place, F.lit(steps).cast("long"))).alias(step))
    out = grown.groupBy(F.window(at, f"{most_seconds} seconds").alias("window"), step, *keys).agg((F.round(F.sum(summed_), digits) if digits is not None else F.sum(summed_)).alias(name))
    start = F.col("window.start")
    end = F.timestamp_seconds(F.unix_seconds(start) + F.col(step) * step_seconds)
    return out.select(*keys, start.cast("timestamp_ntz").alias("window_start"), end.cast("timestamp_ntz").alias("window_end"), name)


def session(df: DataFrame, ts: str, gap: str, keys: Sequence[str] = (), end: str = "gap", **aggregates: Column) -> DataFrame:
    """Sessions of rows at most ``gap`` apart. ``end``: "gap" is the last row's time plus the gap, "last" that time itself, with length_ms."""
    grouped = df.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    out = _flat(grouped, keys, list(aggregates))
    if end == "last":
        out = out.withColumn("window_end", F.col("window_end") - F.expr(f"interval {gap}"))
        ms = F.unix_millis(F.col("window_end").cast("timestamp")) - F.unix_millis(F.col("window_start").cast("timestamp"))
        out = out.withColumn("length_ms", ms)
    return out


def trailing_average(df: DataFrame, ts: str, key: str, value: str, milliseconds: int, name: str, digits: int = 2) -> DataFrame:
    """For each row the average of its key over the ``milliseconds`` up to it."""
    total, n = fresh(df, "total", "count")
    kind = df.schema[value].dataType
    exact = F.col(f"`{value}`") if isinstance(kind, DecimalType) else F.col(f"`{value}`").cast("double")
    out = over_interval(df, key, ts, milliseconds * 1000, {total: exact, n: F.when(exact.isNotNull(), 1).cast("long")})
    mean = (F.col(total) / F.col(n)).cast(df.select(F.avg(exact)).schema[0].dataType)
    return out.withColumn(name, F.round(mean, digits)).drop(total, n)


def sliding(df: DataFrame, ts_ms: str, key: str, value: str, milliseconds: int, digits: int = 2, scale: int = 6, partitions: int | None = None) -> DataFrame:
    """All sliding windows: one ends at each distinct time, one starts just after it if a later row falls inside.

    key, window_start, window_end (ms), n, average. Rows and the edges of windows are one list of events in order of time; a window is the
    difference of the running sums at its two edges, so no window meets a row, however dense the rows are. Rows are first added up by time.
    Running sums are taken by ranges, so a hot key is spread over tasks; values are added as decimals of ``scale`` places, as
    differences must be exact. Rows without a key or a time are in no window; a null value counts, but not in the average.
    """
    at, side, start, n, m, s, n_all, m_all, s_all = fresh(df.select(key, ts_ms), *"at side start n m s n_all m_all s_all".split())
    exact = F.col(value).cast(f"decimal(30,{scale})")
    times = df.filter(F.col(key).isNotNull() & F.col(ts_ms).isNotNull()).groupBy(key, F.col(ts_ms).cast("long").alias(at)).agg(F.count("*").alias(n), F.count(exact).alias(m), F.coalesce(F.sum(exact), F.lit(0)).cast(f"decimal(38,{scale})").alias(s))
    t = F.col(at)
    edge = lambda place, side_, from_: F.struct(place.alias(at), F.lit(side_).alias(side), from_.alias(start), F.lit(False).alias("own"))
    first, later = t - milliseconds, t + 1
    own = F.struct(t.alias(at), F.lit(1).alias(side), t.alias(start), F.lit(True).alias("own"))
    listed = F.array(own, edge(first, 0, first), edge(t, 2, first), edge(later, 0, later), edge(later + milliseconds, 2, later))
    events = times.select(key, n, m, s, F.explode(listed).alias("event"))
    counts = lambda c: F.when(F.col("event.own"), F.col(c)).otherwise(F.lit(0)).alias(c)
    events = events.select(key, F.col(f"event.{at}").alias(at), F.col(f"event.{side}").alias(side), F.col(f"event.{start}").alias(start), counts(n), counts(m), counts(s))
    ranged = Ranged(events, [key], [at, side, start], partitions, [n_all, m_all, s_all])
    ranged.sums({n_all: F.col(n), m_all: F.col(m), s_all: F.col(s)}, inclusive=True)
    # Before its low edge (side 0) lie the rows before the window, before its high edge (side 2) also those inside; equal windows have equal edges.
    edges = ranged.rows.filter(F.col(side) != 1)
    inside = lambda c: F.max(F.when(F.col(side) == 2, F.col(c))) - F.max(F.when(F.col(side) == 0, F.col(c)))
    windows = edges.groupBy(key, F.col(start).alias("window_start")).agg(inside(n_all).alias("n"), inside(m_all).alias(m_all), inside(s_all).alias(s_all)).filter("n > 0")
    average = F.round(F.when(F.col(m_all) > 0, F.col(s_all).cast("double") / F.col(m_all)), digits)
    return windows.select(key, "window_start", (F.col("window_start") + milliseconds).alias("window_end"), "n", average.alias("average"))


def bounds_as_text(df: DataFrame, pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    return df.withColumns({c: F.date_format(c, pattern) for c in ("window_start", "window_end")})


def windowed_top(df: DataFrame, ts: str, size: str, key: str, k: int) -> DataFrame:
    """The k keys with most rows in each tumbling window; ties by key."""
    counted = tumbling(df, ts, size, [key], n=F.count("*"))
    rank = F.row_number().over(Window.partitionBy("window_start", "window_end").orderBy(F.desc("n"), key)).cast("long")
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k)


def first_in_window(df: DataFrame, ts: str, size: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in each tumbling window, as one aggregate (so it also runs on streams)."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(F.window(ts, size).alias("window"), *keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return out.select(*keys, *[F.col("_first")[c].alias(c) for c in rest], F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"))
