"""Ranking, lag and frames over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import fresh


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark limits each group before and after the shuffle. ``order`` should end with a unique column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(name) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's first row, by one aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    (first,) = fresh(df, "first")
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias(first))
    return out.select(*keys, *[F.col(first)[c].alias(c) for c in rest]).select(*df.columns)


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))


def rising(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str = "previous") -> DataFrame:
    """Rows whose value is above the one before it; the first has none before."""
    return lagged(df, keys, order, column, name).filter(F.col(column) > F.col(name))


def over_interval(df: DataFrame, key: str, ts: str, microseconds: int, sums: dict[str, Column]) -> DataFrame:
    """Add for each name the sum of its value over each row's key in the interval up to the row; null where there is no value.

    Time is cut into blocks as long as the interval. The interval up to a row is the part of its own block up to it and the part of the block before from the
    interval's start on, so a running sum in each direction gives both: the work grows with the rows, however many an interval holds, and nothing
    is taken off a sum again. A block of a key is a window partition, so a hot key is spread over its blocks. Rows without a time have each other in
    their interval.
    """
    at, block, asks, rest = fresh(df.select("*", *[F.lit(0).alias(n) for n in sums if n not in df.columns]), "at", "block", "asks", "rest")
    kept = [c for c in df.columns if c not in sums]
    weights, here, before = ([f"{p}_{block}_{i}" for i in range(len(sums))] for p in ("weight", "here", "before"))
    column = lambda c: F.col(f"`{c}`")
    rows = df.select(F.struct(*map(column, kept)).alias(rest), column(key).alias(asks), F.unix_micros(column(ts).cast("timestamp")).alias(at), *[v.alias(w) for w, v in zip(weights, sums.values(), strict=True)])
    rows = rows.withColumn(block, F.expr(f"`{at}` - pmod(`{at}`, {microseconds}L)"))
    up_to = Window.partitionBy(asks, block).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({h: F.sum(w).over(up_to) for h, w in zip(here, weights, strict=True)})
    # Each row once as what is summed, and once, an interval earlier, as what asks for the sum from there on.
    (own,) = fresh(rows, "own")
    both = rows.withColumn(own, F.explode(F.array(F.lit(True), F.lit(False))))
    earlier = lambda c: F.when(F.col(own), F.col(c)).otherwise(F.col(c) - microseconds).alias(c)
    only = lambda c, mine: F.when(F.col(own) == mine, F.col(c)).alias(c)
    both = both.select(own, asks, earlier(at), earlier(block), only(rest, False), *[only(w, True) for w in weights], *[only(h, False) for h in here])
    from_ = Window.partitionBy(asks, block).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({b: F.sum(w).over(from_) for b, w in zip(before, weights, strict=True)}).filter(~F.col(own))
    total = lambda h, b: F.coalesce(F.when(F.col(at).isNotNull(), F.col(h) + F.col(b)), F.col(h), F.when(F.col(at).isNotNull(), F.col(b)))
    return both.select(*[F.col(rest)[c].alias(c) for c in kept], *[total(h, b).alias(n) for n, h, b in zip(sums, here, before, strict=True)])


def count_over_range(df: DataFrame, key: str, ts: str, microseconds: int, name: str = "n") -> DataFrame:
    """For each row, its key's rows in the interval up to it."""
    return over_interval(df, key, ts, microseconds, {name: F.lit(1).cast("long")})


def average_over_rows(df: DataFrame, order: Sequence[str], column: str, preceding: int, name: str, digits: int = 2, partitions: int | None = None) -> DataFrame:
    """For each row of the whole table in order, the average of it and the ``preceding`` rows before it.

    A window without a key would sort all rows in one task. Here rows are range-partitioned by the first
    ordering column, numbered within partitions, and the last ``preceding`` rows of each range are copied
    into the next (a halo), so each range is a window partition of its own. Ranges with fewer rows
    than the halo pass on what came to them: limits are chosen by sampled quantiles, and a range smaller than
    ``preceding`` rows is merged with its neighbour.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = order[0]
    at, range_, place, halo_ = fresh(df, "at", "range", "place", "halo")
    number = F.unix_micros(F.col(first).cast("timestamp")) if dict(df.dtypes)[first].startswith("timestamp") else F.col(first)
    rows = df.withColumn(at, number.cast("double"))
    limits = sorted(set(rows.agg(F.percentile_approx(at, [k / n for k in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    own = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < F.col(at))) if limits else F.lit(0)
    ranged = rows.withColumn(range_, own)
    sizes = dict(ranged.groupBy(range_).count().collect())  # one row a range
    merged, target, held = {}, 0, 0
    for r in sorted(sizes):
        merged[r] = target
        held += sizes[r]
        if held >= max(preceding, 1):
            target, held = target + 1, 0
    if held and target:  # the last range is too small to be one
        merged = {r: min(t, target - 1) for r, t in merged.items()}
    to = F.create_map(*[F.lit(x) for kv in merged.items() for x in kv]) if merged else None
    ranged = ranged.withColumn(range_, to[F.col(range_)] if to is not None else F.lit(0))
    back = F.row_number().over(Window.partitionBy(range_).orderBy(*[F.desc(c) for c in order]))
    halo = ranged.withColumn(place, back).filter(F.col(place) <= preceding).drop(place).withColumn(range_, F.col(range_) + 1).withColumn(halo_, F.lit(True))
    both = ranged.withColumn(halo_, F.lit(False)).unionByName(halo)
    frame = Window.partitionBy(range_).orderBy(*order).rowsBetween(-preceding, 0)
    return both.withColumn(name, F.round(F.avg(column).over(frame), digits)).filter(~F.col(halo_)).drop(at, range_, halo_)


def trailing_median(df: DataFrame, key: str, order: Sequence[str], column: str, n: int, name: str = "median") -> DataFrame:
    """The median of each key's last n values up to each row."""
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn(name, F.percentile(column, 0.5).over(frame))


def running_count(df: DataFrame, key: str, order: Sequence[str], name: str = "n") -> DataFrame:
    """A changelog of counts: what a continuous COUNT emits after each row."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def changelog(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Replay a continuous count by key: for every row after a key's first, the old count goes (-U) and the new one comes (+U)."""
    counted = running_count(df, key, order).select(key, *order, "n")
    after = counted.withColumn("kind", F.when(F.col("n") == 1, "+I").otherwise("+U"))
    before = counted.filter("n > 1").withColumn("n", F.col("n") - 1).withColumn("kind", F.lit("-U"))
    return after.unionByName(before)


def totals_at_ticks(df: DataFrame, key: str, order: Sequence[str], ts_ms: str, amount: str, tick_ms: int) -> DataFrame:
    """Each time that a key's time passes a tick, its total up to then: key, tick_ms, total."""
    total, tick, last = fresh(df, "total_before", "tick_of", "tick_before")
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.select(key, *dict.fromkeys([*order, ts_ms, amount])).withColumn(tick, F.expr(f"`{ts_ms}` div {tick_ms}"))
    rows = rows.withColumn(last, F.lag(tick).over(w)).withColumn(total, F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.filter(F.col(tick) > F.col(last)).select(key, ((F.col(last) + 1) * tick_ms).alias("tick_ms"), F.col(total).alias("total"))


def leader_at_ticks(df: DataFrame, key: str, ts_ms: str, amount: str, tick_ms: int) -> DataFrame:
    """Each time that time (of all keys) passes a tick, the key with the largest total of the rows before it, the smallest key among equals.

    tick_ms, key, total. Amounts must not be negative: a key's total then never falls, so the largest total so far is that of a leader. Totals
    are added up by key and tick first, and each tick keeps its best key; the last windows see one row a tick.
    """
    tick, best, most, rank = fresh(df, "tick_of", "total", "most", "rank")
    summed = df.groupBy(key, F.expr(f"`{ts_ms}` div {tick_ms}").alias(tick)).agg(F.sum(amount).alias(best))
    grown = summed.withColumn(best, F.sum(best).over(Window.partitionBy(key).orderBy(tick)))
    top = grown.withColumn(rank, F.row_number().over(Window.partitionBy(tick).orderBy(F.desc(best), key))).filter(F.col(rank) == 1)
    by_tick = Window.orderBy(tick).rowsBetween(Window.unboundedPreceding, 0)
    held = top.withColumn(most, F.max(best).over(by_tick)).withColumn(rank, F.lead(tick).over(Window.orderBy(tick)))
    leader = F.min(F.when(F.col(best) == F.col(most), F.col(key))).over(Window.partitionBy(most).orderBy(tick).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn(key, leader).filter(F.col(rank).isNotNull()).select(((F.col(tick) + 1) * tick_ms).alias("tick_ms"), key, F.col(most).alias("total"))
