"""Changing tables on streams: joins as of a time, foreign-key joins of two changing tables, and ranks as a changelog.

State is typed (transformWithState over rows, or a join of streams): columns keep their Spark types in the store, whatever they are. Rows of a
key are taken in their stated order within a micro-batch, and micro-batches as they come.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .replay import event_time

#: Rows that go into a list of the store with one call.
LISTED = 4096


def _schema(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, df.select(F.col(f"`{n}`")).schema[0].dataType) for n in names]


def _empty(fields: Sequence[T.StructField]) -> Column:
    return F.lit(None).cast(T.StructType(list(fields)))


def _parts(struct) -> tuple:
    """The fields of a struct, which comes as a row or, inside another, as a dict."""
    return tuple(struct.values()) if isinstance(struct, dict) else tuple(struct)


def _least_first(rows: Iterator[Row], *names: str) -> list[Row]:
    """In order of the named columns, nulls first; rows that are equal in them stay as they came."""
    return sorted(rows, key=lambda r: tuple((r[n] is not None, r[n]) if r[n] is not None else (False,) for n in names))


class _AsOf(StatefulProcessor):
    """A key's versions by time, and rows that wait until no version of their time can come any more.

    A micro-batch adds what it has of a key to two lists, and has one timer at the earliest time in it. When a timer is due, all that
    is due is done in one pass over the lists, and what remains gets a timer at its own earliest time.
    """

    def __init__(self, row: T.StructType, version: T.StructType, names: list[str], retention_us: int | None, inner: bool):
        self.row, self.version, self.names, self.retention_us, self.inner = row, version, names, retention_us, inner

    def init(self, handle) -> None:
        # Fields by place: their own names may clash.
        timed = lambda kind: T.StructType([T.StructField("us", T.LongType()), *[T.StructField(f"f{i}", f.dataType) for i, f in enumerate(kind)]])
        self.handle = handle
        self.versions = handle.getListState("versions", timed(self.version))
        self.waiting = handle.getListState("waiting", timed(self.row))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        asked, told = [], []
        for row in rows:
            us, version = row["_us"], row["_version"]
            if us is None:
                continue
            if version is None:
                asked.append((us, *_parts(row["_row"])))
            else:
                told.append((us, *_parts(version)))
        for state, new in ((self.waiting, asked), (self.versions, told)):
            for k in range(0, len(new), LISTED):
                state.appendList(new[k : k + LISTED])
        self._timer(asked + told)
        return iter(())

    def _timer(self, rows: list[tuple]) -> None:
        """At the earliest time of the rows: a watermark of this many milliseconds is past it."""
        if rows:
            self.handle.registerTimer(min(r[0] for r in rows) // 1000 + 1)

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        state.clear()
        for k in range(0, len(rows), LISTED):
            state.appendList(rows[k : k + LISTED])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = 1000 * timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for row in self.waiting.get():
            (due if row[0] < until else later).append(row)
        due.sort(key=lambda r: r[0])
        told = list(self.versions.get())
        known = {v[0]: v[1:] for v in told}  # of one time the last to arrive
        history = sorted(known)
        i, make, none = -1, Row(*self.names), (None,) * len(self.version)
        for row in due:
            us = row[0]
            while i + 1 < len(history) and history[i + 1] <= us:
                i += 1
            if i >= 0 and (self.retention_us is None or history[i] >= us - self.retention_us):
                yield make(*row[1:], *known[history[i]])
            elif not self.inner:
                yield make(*row[1:], *none)
        # Rows still to come are at or after the watermark: of the versions before it only the last can be theirs.
        past = [us for us in history if us < until]
        held = past[-1:] if self.retention_us is None or (past and past[-1] >= until - self.retention_us) else []
        ahead = [(us, *known[us]) for us in history[len(past) :]]
        if due:
            self._keep(self.waiting, later)
        if len(held) + len(ahead) < len(told):
            self._keep(self.versions, [*[(us, *known[us]) for us in held], *ahead])
        self._timer(later + ahead)

    def close(self) -> None:
        pass


def as_of(
    left: DataFrame, versions: DataFrame, keys: Sequence[str], left_ts: str, version_ts: str, values: Sequence[str], retention_us: int | None = None, how: str = "left", lateness: str = "0 seconds"
) -> DataFrame:
    """The stream form of ``joins.as_of``: each row of ``left`` with the ``values`` of its key's latest version at or before its time.

    A row is held until the watermark (of both streams together, ``lateness`` behind the latest time) has passed its time, so versions that come after it
    still count; later ones play no part. Of versions with one time the last to arrive stays. Older versions than the one that holds at the
    watermark leave the store, and with ``retention_us`` those that no row can match any more. Rows without a time are left out. Null keys
    are a key. Times have the type timestamp; the stream's end holds back what its watermark has not passed (``replay.ended``).
    """
    row, version = _schema(left, left.columns), _schema(versions, values)
    keyed = [f"_k{i}" for i in range(len(keys))]
    at = lambda c: F.col(f"`{c}`").cast("timestamp").alias("_at")
    asked = left.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, keyed, strict=True)], at(left_ts), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), _empty(version).alias("_version"))
    told = versions.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, keyed, strict=True)], at(version_ts), _empty(row).alias("_row"), F.struct(*[F.col(f"`{v}`") for v in values]).alias("_version"))
    both = event_time(asked.unionByName(told), "_at", lateness).withColumn("_us", F.unix_micros("_at"))
    names = [*left.columns, *values]
    # Fields of one name in both are told apart by place: rows are made by position.
    processor = _AsOf(T.StructType(row), T.StructType(version), names, retention_us, how == "inner")
    return both.groupBy(*keyed).transformWithState(processor, T.StructType([*row, *version]), "Append", "EventTime")


def foreign_key_join(
    child: DataFrame, parent: DataFrame, child_id: str, reference: str, child_values: Sequence[str], parent_id: str, parent_values: Sequence[str], child_order: str, parent_order: str,
    child_gone: Column | None = None, parent_gone: Column | None = None, how: str = "inner",
) -> DataFrame:
    """The changelog of two changing tables joined on the child's ``reference`` to the parent: child_id, reference, child_values, parent_values, deleted, version, step.

    ``child`` and ``parent`` are streams of changes, the last row of an id by its order column being its state; rows for which ``..._gone`` is true
    delete it. ``version`` and ``step`` are the micro-batch and the order of the child's and the parent's change. A child's state is its row with the
    greatest (version, step), see ``current``; if that is ``deleted`` it has none. Each change of a child gives a row of its own first (step null), which takes back
    what its former reference gave (a null reference joins nothing), and one row for each change of its parent. ``how``: inner, or left, where a child without a
    parent keeps nulls. Rows without an id are left out.

    The changes meet in Spark's join of two streams, without a call of Python for any row. Its state holds the changes of both sides, also those that were
    replaced: they take part in later rows, too, which their version or step tells to be out of date.
    """
    no = F.lit(False)
    ref, ident = _schema(child, [reference])[0], _schema(child, [child_id])[0]
    of = lambda kinds, names: [F.col(f"`{n}`").alias(f"{kinds}{i}") for i, n in enumerate(names)]
    # In a stream this is the micro-batch's time, the same if the batch runs again.
    when = lambda order: F.struct(F.current_timestamp().alias("at"), F.col(f"`{order}`").alias("order"))
    gone = lambda c: F.coalesce(c if c is not None else no, no)
    changes = child.filter(F.col(f"`{child_id}`").isNotNull()).select(F.col(f"`{child_id}`").alias("_child"), F.when(~gone(child_gone), F.col(f"`{reference}`")).alias("_ref"), *of("_c", child_values), when(child_order).alias("_version"))
    told = parent.filter(F.col(f"`{parent_id}`").isNotNull()).select(F.col(f"`{parent_id}`").cast(ref.dataType).alias("_parent"), *of("_p", parent_values), gone(parent_gone).alias("_gone"), when(parent_order).alias("_step"))
    left, step = how == "left", told.schema["_step"].dataType
    row, values = [f"_c{i}" for i in range(len(child_values))], [f"_p{i}" for i in range(len(parent_values))]
    nulls = [F.lit(None).cast(told.schema[v].dataType).alias(v) for v in values]
    alone = changes.select("_child", "_ref", *row, *nulls, (F.col("_ref").isNull() if left else F.lit(True)).alias("_deleted"), "_version", F.lit(None).cast(step).alias("_step"))
    met = changes.join(told, F.col("_ref") == F.col("_parent")).select("_child", "_ref", *row, *[F.when(~F.col("_gone"), F.col(v)).alias(v) for v in values], (no if left else F.col("_gone")).alias("_deleted"), "_version", "_step")
    return alone.unionByName(met).toDF(ident.name, ref.name, *child_values, *parent_values, "deleted", "version", "step")


def current(changelog: DataFrame, child_id: str) -> DataFrame:
    """The state that a foreign-key join's changelog, read as a batch, leaves: one row a child that has one."""
    names = [c for c in changelog.columns if c not in (child_id, "version", "step", "_batch")]
    last = changelog.groupBy(child_id).agg(F.max_by(F.struct(*names), F.struct("version", "step")).alias("_last"))
    return last.filter(~F.col("_last.deleted")).select(child_id, *[F.col("_last")[n].alias(n) for n in names if n != "deleted"])


class _Ranks(StatefulProcessor):
    """A group's members and the first n of them."""

    def __init__(self, group: list[str], member: T.StructField, score: T.StructField, n: int):
        self.group, self.member, self.score, self.n = group, member, score, n

    def init(self, handle) -> None:
        pair = T.StructType([T.StructField("member", self.member.dataType), T.StructField("score", self.score.dataType)])
        self.members = handle.getMapState("members", T.StructType(pair.fields[:1]), T.StructType(pair.fields[1:]))
        self.top = handle.getValueState("top", T.StructType([T.StructField("rows", T.ArrayType(pair)), T.StructField("seq", T.LongType())]))

    @staticmethod
    def _sorted(pairs: list[tuple]) -> list[tuple]:
        """Greatest score first, nulls last, ties by member."""
        return sorted(sorted(pairs, key=lambda p: p[0]), key=lambda p: (p[1] is not None, p[1]) if p[1] is not None else (False,), reverse=True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.top.get() if self.top.exists() else ([], 0)
        top, seq = [_parts(p) for p in held[0]], held[1]
        make = Row(*self.group, self.member.name, self.score.name, "rank", "kind", "seq")
        for r in _least_first(rows, "_order"):
            member, known = r["_member"], self.members.containsKey((r["_member"],))
            if r["_gone"]:
                if not known:
                    continue
                self.members.removeKey((member,))
            else:
                self.members.updateValue((member,), (r["_score"],))
            new = [p for p in top if p[0] != member]
            stays = not r["_gone"] and top and self._sorted([(member, r["_score"]), top[-1]])[0] == (member, r["_score"])
            if len(new) < len(top) == self.n and not stays:
                # One of the first n has fallen or gone: another member may take its place.
                best = []
                for k, v in self.members.iterator():
                    best.append((k[0], v[0]))
                    if len(best) > 4 * self.n + 64:
                        best = self._sorted(best)[: self.n]
                new = self._sorted(best)[: self.n]
            elif not r["_gone"]:
                new = self._sorted([*new, (member, r["_score"])])[: self.n]
            for k in range(max(len(top), len(new))):
                old, now = top[k] if k < len(top) else None, new[k] if k < len(new) else None
                if old == now:
                    continue
                for pair, kind in ((old, "-U" if now else "-D"), (now, "+U" if old else "+I")):
                    if pair is not None:
                        seq += 1
                        yield make(*key, *pair, k + 1, kind, seq)
            top = new
        self.top.update((top, seq))

    def close(self) -> None:
        pass


def top_n(df: DataFrame, group: Sequence[str], member: str, score: str, n: int, order: str, gone: Column | None = None) -> DataFrame:
    """The changelog of each group's n members of greatest score: group, member, score, rank, kind (+I, -U, +U, -D), seq.

    A stream of changes: a member's last row by ``order`` is its score, and where ``gone`` is true the member leaves. Ranks that move give their
    old row and their new one, by rank, as seq tells. Ties go to the smaller member; a null score comes last. Rows without a member are left out.
    """
    no = F.lit(False)
    fields = _schema(df, [*group, member, score])
    who, what = fields[-2], fields[-1]
    rows = df.filter(F.col(f"`{member}`").isNotNull()).select(
        *[F.col(f"`{g}`") for g in group], F.col(f"`{member}`").alias("_member"), F.col(f"`{score}`").alias("_score"), F.col(f"`{order}`").alias("_order"), F.coalesce(gone if gone is not None else no, no).alias("_gone")
    )
    out = T.StructType([*fields, T.StructField("rank", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("seq", T.LongType())])
    return rows.groupBy(*group).transformWithState(_Ranks(list(group), who, what, n), out, "Append", "None")


def replayed(changelog: DataFrame, group: Sequence[str]) -> DataFrame:
    """The ranks that a Top-N changelog, read as a batch, leaves: the last row of each rank unless it went."""
    names = [c for c in changelog.columns if c not in (*group, "rank", "seq", "_batch")]
    w = Window.partitionBy(*group, "rank").orderBy(F.desc("seq"))
    last = changelog.withColumn("_last", F.row_number().over(w)).filter("_last = 1 and kind in ('+I', '+U')")
    return last.select(*group, *[n for n in names if n != "kind"], "rank")
