"""Row patterns of any length as finite automata, scanned by ranges.

A pattern is a list of elements: a condition, and how many rows in a row meet it (least, most). A run is a match that has begun; its
position says which of the pattern's rows it has come to. The runs of a key at a row, oldest first, are a state of the
deterministic automaton (of two at one position the older stays); a row's symbol is the set of conditions that it meets. A match is given out when
it is complete; of those complete at one row it is the one that began first; what began up to its last row is
then dropped (skip past the last row). So a quantified element takes as few rows as the elements after it allow.

A key's rows may lie in many tasks. Each task reduces its rows to a map: for each state that it may be entered in, the state
that it is left in, where each run began, and the matches on the way. Only its first key can be entered in another state than the
empty one, and most entries soon meet. The maps, some rows a task, are put together on the driver in order of tasks,
which tells every task's true entry; matches of other entries then drop out. Work is linear in the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import fresh
from .ranges import stash

#: States of the deterministic automaton at most: a bound of the maps, not of matches.
STATES = 2048

Element = tuple[Column, int, int | None]
State = tuple[int, ...]


class Automaton:
    """Positions, states and moves of a pattern given by the (least, most) of its elements; most None is without end."""

    def __init__(self, counts: Sequence[tuple[int, int | None]]):
        self.element: list[int] = []
        self.after: list[list[int]] = []
        self.starts: list[int] = []
        into, optional = self.starts, True  # the lists of positions that may come next; whether nothing has been needed so far
        open_: list[list[int]] = [self.starts]
        leaves: list[int] = []
        for e, (least, most) in enumerate(counts):
            if least < 0 or (most is not None and most < max(least, 1)):
                raise ValueError(f"element {e} has no possible number of rows")
            first, n = len(self.element), max(least, 1) if most is None else most
            for into in open_:
                into.append(first)
            self.element += [e] * n
            self.after += [[first + k + 1] for k in range(n - 1)] + [[first + n - 1] if most is None else []]
            own = [first + k for k in range(n) if k + 1 >= least]
            leaves = own + (leaves if least == 0 else [])
            open_ = [self.after[p] for p in own] + (open_ if least == 0 else [])
            optional = optional and least == 0
        if optional:
            raise ValueError("a pattern must take at least one row")
        self.ends = set(leaves)
        self._moves: dict[tuple[State, int], tuple[State, tuple[int, ...], int | None]] = {}

    def move(self, state: State, symbol: int) -> tuple[State, tuple[int, ...], int | None]:
        """The state after a row, for each of its runs which run of ``state`` it was (-1: new), and which run has come to a match (or None)."""
        found = self._moves.get((state, symbol))
        if found is None:
            to: dict[int, int] = {}
            done = None
            for i, nexts in (*enumerate(self.after[p] for p in state), (-1, self.starts)):
                met = [q for q in nexts if symbol >> self.element[q] & 1]
                if done is None and self.ends.intersection(met):
                    done = i
                for q in met:
                    to.setdefault(q, i)
            found = ((), (), done) if done is not None else (tuple(to), tuple(to.values()), None)
            self._moves[state, symbol] = found
        return found

    def states(self, symbols: int) -> list[State]:
        """The states that symbols below ``symbols`` lead to, the empty one first."""
        seen: dict[State, None] = {(): None}
        todo: list[State] = [()]
        while todo:
            state = todo.pop()
            for symbol in range(symbols):
                to = self.move(state, symbol)[0]
                if to not in seen:
                    seen[to] = None
                    todo.append(to)
            if len(seen) > STATES:
                raise ValueError(f"the pattern has more than {STATES} states")
        return list(seen)


class _Path:
    """Where a task stands for some entry states: each run's first row by its place, or -1 - i for the i-th run that it was entered with."""

    __slots__ = ("state", "began", "entries")

    def __init__(self, state: State, entries: list[int]):
        self.state, self.began, self.entries = state, tuple(-1 - i for i in range(len(state))), entries


def matches(df: DataFrame, keys: Sequence[str], order: Sequence[str], pattern: Sequence[Element], keep: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Matches of ``pattern`` in each key's rows: keys, first_* and last_* of the ordering columns and of ``keep``.

    ``keys`` may be none: the whole table is one sequence. A condition that is null is not met. Nulls come first in keys (null is a key) and order;
    ``order`` should tell a key's rows apart, as rows that are equal in it have no order.
    """
    automaton = Automaton([(least, most) for _, least, most in pattern])
    payload = list(dict.fromkeys([*order, *keep]))
    (symbol,) = fresh(df, "symbol")
    bits = F.lit(0)
    for i, (condition, _, _) in enumerate(pattern):
        bits = bits.bitwiseOR(F.when(condition.cast("boolean"), 1 << i).otherwise(0))
    columns = list(dict.fromkeys([*keys, *payload]))
    rows = df.select(*[F.col(f"`{c}`") for c in columns], bits.alias(symbol))
    states = automaton.states(1 << len(pattern))
    begins = sum({1 << automaton.element[p] for p in automaton.starts})
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_first(F.col(f"`{c}`")) for c in (*keys, *order)]
    numbers = ["task", "kind", "entry", "state", "run", "start"]
    kinds = rows.schema
    fields = [T.StructField(c, T.LongType()) for c in numbers]
    fields += [T.StructField(f"key_{c}", kinds[c].dataType) for c in keys] + [T.StructField(f"{side}_{c}", kinds[c].dataType) for side in ("first", "last") for c in payload]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0: a match (``start``: the run that it was entered with, or -1); 1: a run of an exit; 2: an exit; 3: the first key.

        ``entry`` is the entry state for which a row holds, -1 for all.
        """
        from pyspark import TaskContext

        task, base, now, opening, paths, held, types = TaskContext.get().partitionId(), 0, None, True, [], {}, {}
        blank = (None,) * len(payload)
        out: list[tuple] = []

        def give() -> pa.RecordBatch:
            sides = list(zip(*out, strict=True)) if out else [()] * len(fields)
            kept = [types[c] for c in (*keys, *payload, *payload)]
            arrays = [pa.array(v, t) for v, t in zip(sides, [pa.int64()] * len(numbers) + kept, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

        for batch in batches:
            types.update({f.name: f.type for f in batch.schema})
            at = dict(zip(batch.schema.names, batch.columns, strict=True))
            symbols = at[symbol].to_numpy()
            values = [at[c] for c in payload]
            names = list(zip(*[at[k].to_pylist() for k in keys], strict=True)) if keys else []
            new = [i for i in range(1, len(names)) if names[i] != names[i - 1]] if keys else []
            if batch.num_rows and (now is None or (keys and names[0] != now)):
                new.insert(0, 0)
            # Where there is no run, only rows that begin one, or another key, matter.
            stops = np.union1d(np.flatnonzero(symbols & begins), np.array(new, np.int64)).tolist()
            changes, s, i = set(new), 0, 0
            while i < len(symbols):
                if i in changes:
                    if now is not None:
                        opening = False
                    now = names[i] if keys else ()
                    held.clear()
                    paths = [_Path(e, [k]) for k, e in enumerate(states)] if opening else [_Path((), [-1])]
                    if opening:
                        out.append((task, 3, -1, -1, -1, -1, *now, *blank, *blank))
                elif not any(p.state for p in paths):
                    while s < len(stops) and stops[s] < i:
                        s += 1
                    if s == len(stops):
                        break
                    if stops[s] > i:
                        i = stops[s]
                        continue
                met: dict[tuple, _Path] = {}
                row = None
                for path in paths:
                    to, came, done = automaton.move(path.state, int(symbols[i]))
                    if done is not None:
                        row = row or tuple(v[i].as_py() for v in values)
                        began = base + i if done < 0 else path.began[done]
                        first = blank if began < 0 else row if began == base + i else held[began]
                        for entry in [-1] if not opening or len(path.entries) == len(states) else path.entries:
                            out.append((task, 0, entry, -1, -1, -1 - began if began < 0 else -1, *now, *first, *row))
                    began = tuple(base + i if k < 0 else path.began[k] for k in came)
                    if -1 in came:
                        row = row or tuple(v[i].as_py() for v in values)
                        held[base + i] = row
                    path.state, path.began = to, began
                    if (to, began) in met:
                        met[to, began].entries += path.entries
                    else:
                        met[to, began] = path
                paths = list(met.values())
                if len(held) > 256:
                    live = {b for p in paths for b in p.began}
                    held = {b: r for b, r in held.items() if b in live}
                i += 1
            base += len(symbols)
            if out:
                yield give()
        if now is None:
            return
        for path in paths:
            for entry in path.entries:
                out.append((task, 2, entry, states.index(path.state), -1, -1, *now, *blank, *blank))
                for j, b in enumerate(path.began):
                    out.append((task, 1, entry, -1, j, -1 - b if b < 0 else -1, *now, *(blank if b < 0 else held[b]), *blank))
        yield give()

    parts = stash(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(scan, T.StructType(fields)))
    entries, entered = _entries(parts.filter("kind > 0").collect(), [f"key_{k}" for k in keys], [f"first_{c}" for c in payload], states)
    spark = df.sparkSession
    true = spark.createDataFrame(entries, "task long, true_entry long")
    points = T.StructType([*fields[:1], T.StructField("start", T.LongType()), *[T.StructField(f"was_{c}", kinds[c].dataType) for c in payload]])
    found = parts.filter("kind = 0").join(F.broadcast(true), "task").filter("entry = -1 or entry = true_entry")
    found = found.join(F.broadcast(spark.createDataFrame(entered, points)), ["task", "start"], "left")
    first = [F.when(F.col("start") >= 0, F.col(f"was_{c}")).otherwise(F.col(f"first_{c}")).alias(f"first_{c}") for c in payload]
    return found.select(*[F.col(f"key_{k}").alias(k) for k in keys], *first, *[f"last_{c}" for c in payload])


def _entries(rows: list, key: list[str], payload: list[str], states: list[State]) -> tuple[list[tuple], list[tuple]]:
    """Put the tasks' maps together: (task, true entry state) and (task, run, its first row) for the runs that a task is entered with."""
    tasks: dict[int, dict] = {}
    for r in rows:
        own = tasks.setdefault(r.task, {"exit": {}, "runs": {}})
        name = tuple(r[k] for k in key)
        if r.kind == 3:
            own["first"] = name
        elif r.kind == 2:
            own["last"] = name
            own["exit"][r.entry] = r.state
        else:
            own["runs"][r.entry, r.run] = (r.start, tuple(r[c] for c in payload))
    now, state, runs = None, 0, []
    entries, entered = [], []
    for task in sorted(tasks):
        own = tasks[task]
        if now is None or own["first"] != now:
            state, runs = 0, []
        entries.append((task, state))
        entered += [(task, i, *r) for i, r in enumerate(runs)]
        entry = state if own["first"] == own["last"] else -1
        now, state = own["last"], own["exit"][entry]
        runs = [runs[start] if start >= 0 else row for start, row in (own["runs"][entry, j] for j in range(len(states[state])))]
    return entries, entered
