"""Stateful operators: a scan over each key's rows with a small state, on streams and in batch, and event-time timers.

A scan calls ``step(state, row)`` for each row of a key in order and gives out what it returns. On a stream
the state lives in the state store between micro-batches (transformWithState); rows are ordered within a micro-batch. With ``idle_ms``
a key that has no rows for so long by the wall clock leaves the store; without, it stays for good. In batch the same
steps run over each key's rows, sorted by the shuffle, in Arrow batches, so a hot key is read as a sequence and not collected.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.names import fresh

Step = Callable[[dict, dict], tuple[dict, list[dict]]]


class _Scan(StatefulProcessor):
    """The state is kept as bytes (pickle), so that it may hold times, dates, decimals and binary values as rows have them."""

    def __init__(self, order: list[str], initial: dict, step: Step, names: list[str], idle_ms: int | None):
        self.order, self.initial, self.step, self.names, self.idle_ms = order, initial, step, names, idle_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("scan", "value binary", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else copy.deepcopy(self.initial)
        make = Row(*self.names)
        for row in sorted(rows, key=lambda r: tuple((r[n] is not None, r[n]) if r[n] is not None else (False,) for n in self.order)):
            state, given = self.step(state, row.asDict())
            for new in given:
                yield make(*[new.get(n) for n in self.names])
        self.state.update((pickle.dumps(state),))

    def close(self) -> None:
        pass


def scan(df: DataFrame, key: str, order: list[str], initial: dict, step: Step, schema: str, idle_ms: int | None = None) -> DataFrame:
    """``step`` over each key's rows; ``schema`` is that of the rows it gives. ``idle_ms``: see above; streams only."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    if df.isStreaming:
        return df.groupBy(key).transformWithState(_Scan(order, initial, step, names, idle_ms), schema, "Append", "ProcessingTime" if idle_ms else "None")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now, begun = None, None, False
        for pdf in batches:
            out: list[dict] = []
            for row in pdf.to_dict("records"):
                same = begun and (row[key] == now or (pd.isna(row[key]) and pd.isna(now)))
                if not same:
                    state, now, begun = copy.deepcopy(initial), row[key], True
                state, given = step(state, row)
                out += given
            yield pd.DataFrame(out, columns=names)

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _ms(t) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


def _us(t) -> int:
    return int(pd.Timestamp(t).as_unit("ns").value // 1_000)


def lag_step(key: str, ts: str, value: str) -> Step:
    """Each row with the value before it."""

    def step(state, row):
        out = {key: row[key], ts: row[ts], value: row[value], "previous": state.get("v")}
        return {"v": row[value]}, [out]

    return step


def median_step(key: str, ts: str, value: str, n: int) -> Step:
    """The median of the last n values."""

    def step(state, row):
        last = [*state.get("last", []), row[value]][-n:]
        return {"last": last}, [{key: row[key], ts: row[ts], value: row[value], "median": float(median(last))}]

    return step


def same_direction_step(key: str, ts: str, value: str, n: int) -> Step:
    """Matches of n rows that all rise or all fall; the state is the run that may still become one."""

    def step(state, row):
        run = [*state.get("run", []), [_ms(row[ts]), row[value]]]
        while len(run) > 1:
            steps = [b[1] - a[1] for a, b in zip(run, run[1:], strict=False)]
            if all(s > 0 for s in steps) or all(s < 0 for s in steps):
                break
            run = run[1:]
        if len(run) == n:
            return {}, [{key: row[key], "first_ms": run[0][0], "first_value": run[0][1], "last_ms": run[-1][0], "last_value": run[-1][1]}]
        return {"run": run}, []

    return step


def dedup_step(key: str, ts: str, within_ms: int, keep: list[str]) -> Step:
    """The first row of a key; later ones only if none came within the time before them. A duplicate refreshes the key.

    ``within_ms`` is half of the store's window. Rows without a key should not be sent here: they pass.
    """

    def step(state, row):
        now, seen = _ms(row[ts]), state.get("seen")
        double = seen is not None and abs(now - seen) <= within_ms
        return {"seen": max(now, seen if seen is not None else now)}, [] if double else [{c: row[c] for c in keep}]

    return step


def sliding_step(key: str, ts_ms: str, value: str, milliseconds: int, digits: int = 2) -> Step:
    """For each row the average of its key's rows that came so far in the ``milliseconds`` up to it. The state is the rows of that time."""

    def step(state, row):
        now = int(row[ts_ms])
        rows = [(t, v) for t, v in state.get("rows", []) if t >= now - milliseconds] + [(now, row[value])]
        inside = [v for t, v in rows if t <= now and v is not None and not pd.isna(v)]
        return {"rows": rows}, [{key: row[key], ts_ms: now, "average": round(sum(inside) / len(inside), digits) if inside else None}]

    return step


def own_count_step(key: str, ts_ms: str, row_id: str, within_ms: int, lateness_ms: int = 0) -> Step:
    """A stream joined with its own running count by key: each row with the counts that its key had at most ``within_ms`` before or after it.

    The state is the key's count and its rows that one still to come may meet: those up to ``within_ms`` and ``lateness_ms`` before the latest.
    """

    def step(state, row):
        now, n = int(row[ts_ms]), state.get("n", 0) + 1
        near = [r for r in state.get("rows", []) if abs(r[0] - now) <= within_ms]
        out = [{key: row[key], row_id: i, "count": n} for _, i, _ in near] + [{key: row[key], row_id: row[row_id], "count": c} for _, _, c in near]
        rows = [*state.get("rows", []), (now, row[row_id], n)]
        last = max(t for t, _, _ in rows)
        return {"n": n, "rows": [r for r in rows if r[0] >= last - within_ms - lateness_ms]}, [*out, {key: row[key], row_id: row[row_id], "count": n}]

    return step


def ttl_join_step(key: str, ts_ms: str, value: str, side: str, ttl_ms: int) -> Step:
    """Stacked rows of a stream (side 1) and a table (side 0): each stream row with the table's value, unless it is idle for more than the limit."""

    def step(state, row):
        now = int(row[ts_ms])
        if row[side] == 0:
            return ({"v": row[value], "t": now} if row[value] is not None and not pd.isna(row[value]) else {}), []
        fresh = "v" in state and now - state["t"] <= ttl_ms
        return (state if fresh else {}), [{key: row[key], ts_ms: now, "left": row[value], "right": state["v"] if fresh else None}]

    return step


def ttl_list_step(key: str, ts_ms: str, value: str, idle_ms: int) -> Step:
    """The list of a key's values, started anew after it has been idle for more than the limit; null removes the key."""

    def step(state, row):
        now = int(row[ts_ms])
        held = state.get("list", []) if "t" in state and now - state["t"] <= idle_ms else []
        if row[value] is None or pd.isna(row[value]):
            return {}, [{key: row[key], ts_ms: now, "items": None}]
        held = [*held, row[value]]
        return {"list": held, "t": now}, [{key: row[key], ts_ms: now, "items": ",".join(map(str, held))}]

    return step


def accumulate_step(key: str, ts_ms: str, amount: str, tick_ms: int) -> Step:
    """A running total by key; each time that stream time passes a tick, the total at the tick is given out."""

    def step(state, row):
        now, total = int(row[ts_ms]), state.get("total", 0)
        tick = state.get("tick", (now // tick_ms + 1) * tick_ms)
        out = []
        if now >= tick:
            out.append({key: row[key], "tick_ms": tick, "total": total})
            tick = (now // tick_ms + 1) * tick_ms
        return {"total": total + row[amount], "tick": tick}, out

    return step


def changelog_join_step(key: str, ts_ms: str, value: str, side: str) -> Step:
    """A table-table join: stacked changes of both tables; each change that leaves both sides known gives the joined row."""

    def step(state, row):
        state = dict(state)
        name = "r" if row[side] else "l"
        if row[value] is None or pd.isna(row[value]):
            state.pop(name, None)
        else:
            state[name] = row[value]
        both = "l" in state and "r" in state
        return state, [{key: row[key], ts_ms: int(row[ts_ms]), "left": state["l"], "right": state["r"]}] if both else []

    return step


class _Reorder(StatefulProcessor):
    """Holds rows by event time, with their types, and gives them out in order when the watermark passes the end of their interval."""

    def __init__(self, interval_ms: int, row: StructType):
        self.interval_ms, self.row = interval_ms, row

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "us long", self.row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            now = row[-1]
            if now is not None and not self.held.containsKey((now,)):  # of rows with one time, the first to arrive stays
                self.held.updateValue((now,), tuple(row)[:-1])
                self.handle.registerTimer((now // (1000 * self.interval_ms) + 1) * self.interval_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        make = Row(*self.row.names)
        for us in sorted(k[0] for k, _ in self.held.iterator() if k[0] < 1000 * until):
            yield make(*tuple(self.held.getValue((us,))))
            self.held.removeKey((us,))

    def close(self) -> None:
        pass


def reorder(df: DataFrame, key: str, ts: str, interval_ms: int, arrival: str | None = None) -> DataFrame:
    """Rows of each key in order of event time (to the microsecond), an interval at a time; of rows with the same time the first to arrive stays.

    On a stream with a watermark an interval is given out when the watermark has passed it. In batch ``arrival`` names the
    column that tells the order of arrival, such as an offset; without it the least row by its other columns counts as the first.
    """
    if df.isStreaming:
        (us,) = fresh(df, "us")
        timed = df.withColumn(us, F.unix_micros(F.col(ts).cast("timestamp")))
        return timed.groupBy(key).transformWithState(_Reorder(interval_ms, df.schema), df.schema, "Append", "EventTime")
    from pyspark.sql import Window

    millis = F.unix_millis(F.col(ts).cast("timestamp"))
    came = Window.partitionBy(key, ts).orderBy(*([arrival] if arrival else [c for c in df.columns if c not in (key, ts)] or [ts]))
    (turn,) = fresh(df, "turn")
    once = df.withColumn(turn, F.row_number().over(came)).filter(F.col(turn) == 1).drop(turn)
    w = Window.partitionBy(key).orderBy(ts)
    return once.withColumn("interval", F.floor(millis / interval_ms)).withColumn("place", F.row_number().over(w).cast("long"))


class _Expire(StatefulProcessor):
    """Holds the time of each key's last row; a timer gives a tombstone and forgets the key when event time has passed its age."""

    def __init__(self, ts: str, value: str, age_ms: int, names: list[str]):
        self.ts, self.value, self.age_ms, self.names = ts, value, age_ms, names

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        self._forget()
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for now, gone in zip(map(_us, pdf[self.ts]), pdf[self.value].isna(), strict=True):
            if last is not None and now > last + 1000 * self.age_ms:
                out.append([key[0], pd.Timestamp(last + 1000 * self.age_ms, unit="us")])
            last = None if gone else now
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
            self.handle.registerTimer(last // 1000 + self.age_ms + 1)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            yield pd.DataFrame(columns=self.names)
            return
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame([[key[0], pd.Timestamp(last + 1000 * self.age_ms, unit="us")]], columns=self.names)

    def close(self) -> None:
        pass


def tombstones(df: DataFrame, key: str, ts: str, value: str, age_ms: int) -> DataFrame:
    """(key, ts) of a tombstone for each time that a key has had no row for ``age_ms`` of event time; a null value removes the key without one.

    On a stream with a watermark the tombstone comes, and the key leaves the store, when the watermark has passed the age. In batch
    event time is that of the whole table: a key's last row gives one if the latest row of all is past its age.
    """
    kind = dict(df.dtypes)
    if df.isStreaming:
        return df.groupBy(key).transformWithStateInPandas(_Expire(ts, value, age_ms, [key, ts]), f"`{key}` {kind[key]}, `{ts}` {kind[ts]}", "Append", "EventTime")
    from pyspark.sql import Window

    due, after, latest = fresh(df, "due", "after", "latest")
    rows = df.withColumn(due, F.col(ts) + F.expr(f"interval '{age_ms / 1000:.3f}' second")).withColumn(after, F.lead(ts).over(Window.partitionBy(key).orderBy(ts)))
    end = df.agg(F.max(ts).alias(latest))  # one row
    ended = rows.join(F.broadcast(end), F.coalesce(F.col(after), F.col(latest)) > F.col(due))
    return ended.filter(F.col(value).isNotNull()).select(key, F.col(due).alias(ts))


class _WallClock(StatefulProcessor):
    """Running totals that a processing-time timer sets to zero."""

    def __init__(self, amount: str, every_ms: int, names: list[str]):
        self.amount, self.every_ms, self.names = amount, every_ms, names

    def init(self, handle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.total.get()[0] if self.total.exists() else 0.0
        if not self.total.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every_ms)
        total = before + sum(float(pdf[self.amount].sum()) for pdf in rows)
        self.total.update((total,))
        yield pd.DataFrame([[key[0], total]], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.total.update((0.0,))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every_ms)
        yield pd.DataFrame([[key[0], 0.0]], columns=self.names)

    def close(self) -> None:
        pass


def reset_totals(df: DataFrame, key: str, amount: str, every_ms: int) -> DataFrame:
    """Totals by key, set to zero each so many milliseconds of the wall clock. Streams only."""
    kind = dict(df.dtypes)[key]
    return df.groupBy(key).transformWithStateInPandas(_WallClock(amount, every_ms, [key, "total"]), f"{key} {kind}, total double", "Update", "ProcessingTime")


def dedup_islands(df: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """The batch form of ``dedup_step``: rows of a key at most ``within`` apart are one island, of which the first stays. Null keys pass."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(ts)
    apart = F.lag(ts).over(w).isNull() | (F.col(ts) - F.lag(ts).over(w) > F.expr(f"interval {within}"))
    (name,) = fresh(df, "apart")
    known = df.filter(F.col(key).isNotNull()).withColumn(name, apart).filter(F.col(name)).drop(name)
    return known.unionByName(df.filter(F.col(key).isNull()))


def first_arrivals(df: DataFrame, *keys: str) -> DataFrame:
    """Built-in deduplication on a stream with a watermark: the first row of a key to arrive; no refresh."""
    return df.dropDuplicatesWithinWatermark(list(keys))
