"""Row patterns: fixed sequences, rising runs, and same-direction runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .automata import matches
from .names import fresh


def sequence_abc(df: DataFrame, key: str, order: Sequence[str], a: Column, b: Column, c: Column) -> DataFrame:
    """Matches of three following rows that meet a, b, c in turn, skipping past the last row of a match.

    The first row of each match, with ``third``, the third's ordering columns. The scan is the automaton's (``automata.matches``), linear in the rows.
    """
    keep = [x for x in df.columns if x not in (key, *order)]
    out = matches(df, [key], order, [(a, 1, 1), (b, 1, 1), (c, 1, 1)], keep)
    third = F.struct(*[F.col(f"last_{x}").alias(x) for x in order]).alias("third")
    return out.select(*[F.col(x if x == key else f"first_{x}").alias(x) for x in df.columns], third)


def rising_runs(df: DataFrame, key: str, order: Sequence[str], column: str, n: int, falling: bool = False) -> DataFrame:
    """Matches of n following rows, each above (or below) the one before, skipping past the last row of a match.

    key, first_*, last_* of the ordering columns and the value. A row that does not go on starts a new run; a
    run gives a match for every n rows.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(column).over(w)
    goes_on = F.coalesce((F.col(column) < before) if falling else (F.col(column) > before), F.lit(False))
    new, run, chunk, size, first, last = fresh(df, *"new run chunk size first last".split())
    runs = df.withColumn(new, F.when(goes_on, 0).otherwise(1)).withColumn(run, F.sum(new).over(w))
    place = F.row_number().over(Window.partitionBy(key, run).orderBy(*order)) - 1
    chunks = runs.withColumn(chunk, F.floor(place / n))
    at = F.struct(*order, column)
    out = chunks.groupBy(key, run, chunk).agg(F.count("*").alias(size), F.min(at).alias(first), F.max(at).alias(last)).filter(F.col(size) == n)
    return out.select(key, *[F.col(first)[c].alias(f"first_{c}") for c in (*order, column)], *[F.col(last)[c].alias(f"last_{c}") for c in (*order, column)])


def rising_or_falling(df: DataFrame, key: str, order: Sequence[str], column: str, n: int) -> DataFrame:
    """The union of rising and falling matches, without duplicates."""
    return rising_runs(df, key, order, column, n).union(rising_runs(df, key, order, column, n, falling=True)).distinct()


def scan_same_direction(values: list[float], n: int) -> list[tuple[int, int]]:
    """First and last places of the matches: n rows that all rise or all fall, the turning row open to both until a match takes it."""
    out, start = [], 0
    while start + n <= len(values):
        steps = [b - a for a, b in zip(values[start : start + n - 1], values[start + 1 : start + n], strict=True)]
        if all(s > 0 for s in steps) or all(s < 0 for s in steps):
            out.append((start, start + n - 1))
            start += n
        else:
            start += 1
    return out


def same_direction(df: DataFrame, key: str, order: Sequence[str], column: str, n: int) -> DataFrame:
    """Matches of n (2 or more) following rows that rise or fall throughout, skipping past the last row: key, first_* and last_* columns.

    A stretch is a run of steps in one direction with the row before it, which it shares with the stretch before. It gives a
    match for every n rows from its first free row on, so all that one stretch tells the next is whether a match took the
    shared row. With m steps it did if m + 1 - (taken before) is a multiple of n: a stretch passes the bit on, turns it round, or sets it
    to 0. The bit is therefore the parity of the turns since the last reset, a running sum over the key's rows in order; all windows
    share one sort. Rows without a value, and rows equal to the one before, start anew.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    i, sign, turn, start, steps, reset, swap, swaps, base, first, taken = fresh(df, *"i sign turn start steps reset swap swaps base first taken".split())
    rows = df.select(key, *order, column).withColumn(i, F.row_number().over(w)).withColumn(sign, F.signum(F.col(column) - F.lag(column).over(w)))
    rows = rows.withColumn(first, F.lag(F.struct(*order, column), n - 1).over(w))
    moves = F.coalesce(F.col(sign) != 0, F.lit(False))
    rows = rows.withColumn(turn, ~moves | ~F.col(sign).eqNullSafe(F.lag(sign).over(w)))
    rows = rows.withColumn(start, F.max(F.when(F.col(turn), F.col(i))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn(steps, F.col(i) - F.col(start) + 1)
    ends = F.coalesce(F.lead(turn).over(w), F.lit(True))
    m = F.col(steps)
    rows = rows.withColumn(reset, ends & (~moves | ((m % n != 0) & ((m + 1) % n != 0)))).withColumn(swap, (ends & moves & ((m + 1) % n == 0)).cast("int"))
    rows = rows.withColumn(swaps, F.sum(swap).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn(base, F.coalesce(F.max(F.when(F.col(reset), F.col(swaps))).over(before), F.lit(0)))
    rows = rows.withColumn(taken, (F.coalesce(F.lag(swaps).over(w), F.lit(0)) - F.col(base)) % 2)
    # Within a stretch the sums before a row are those before the stretch: only its last row adds to them.
    free = m + 1 - F.col(taken)
    out = rows.filter(moves & (free >= n) & (free % n == 0))
    return out.select(key, *[F.col(first)[c].alias(f"first_{c}") for c in (*order, column)], *[F.col(c).alias(f"last_{c}") for c in (*order, column)])
