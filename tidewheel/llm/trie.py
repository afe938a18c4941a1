"""The prefix trie of rebuilt conversations, with sums over subtrees by the Euler-tour technique.

A node is a distinct sequence of first turns. Its turns have digests of 128 bits, mixed with their place; the XOR of a prefix's
digests names the node. (smallest member, depth) is a name, too, and the one that the tour uses.

1. Rows are sorted by conversation and turn over all tasks; each task counts its own rows and is moved on by what the tasks
   before it hold of its first conversation, so a conversation may be longer than a task.
2. Sorted again by the rebuilt place, prefix digests come in the same way; one aggregate then gives the nodes.
3. Each node is sorted before its children, which follow by smallest member. A node and the row after it give one arc of
   the tour each: down into the first child, from a child over to the next, or back up to the parent.
4. The tour is ranked: arcs lie sorted by conversation, entering arcs downwards and then leaving arcs upwards, so most arcs
   lead to a neighbour. Each task first draws its own runs of arcs together; the runs that are left are ranked by pointer
   jumping, one join a round, and the ranks go back to the arcs.
5. A subtree's sum is the sum from its entering arc on less that from its leaving arc on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import crc32_sql
from .shared import stash

#: Fixed values of the contract: conversations of one base, first turns that may come from it.
BASE, FIRST = 5, 9
#: Rows that a task holds at most, give or take the range sampler's error.
ROWS = 1 << 20
#: An arc's place in its conversation: its depth, or for a leaving arc this less its depth.
TURN = 1 << 40


def _sorted(rows: DataFrame, by: list[str], run: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Deal ``rows`` over tasks by range of ``by`` (unique, so that ranges are even) and give ``run`` each task's rows in order. Written once.

    ``_task``, the task's number, is added. Columns are 64-bit numbers.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    names = rows.columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        out = run({c: held.column(c).to_numpy() for c in names})
        size = len(next(iter(out.values())))
        columns = {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in out.items()} | {"_task": pa.array(np.full(size, TaskContext.get().partitionId(), np.int32))}
        yield from pa.table(columns).to_batches(10_000)

    return stash(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(whole, schema + ", _task int"))


def _starts(keys: np.ndarray) -> np.ndarray:
    """For each row the first of its run of equal keys."""
    new = np.r_[True, keys[1:] != keys[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def _carried(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    """``rows`` with what their task gets from others: at most one row a task, broadcast."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, schema)), "_task", "left")


def turns(conversations: DataFrame) -> DataFrame:
    """Turns with a conversation: conv, turn, the turn's digest d1, d2 (in the order of its hex text) and the bytes of its text. A null role or text is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda k: F.conv(F.substring(sha, k, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    rows = conversations.filter(F.col("conv_id").isNotNull())
    return stash(rows.select(F.col("conv_id").cast("long").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), part(1).alias("d1"), part(17).alias("d2"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")))


def placed(rows: DataFrame) -> DataFrame:
    """``turns`` with ``base``, ``pos``, the place in the conversation from 0, and ``held``, for conversations other than their base the base's turns."""
    base = F.col("conv") - F.col("conv") % BASE
    keyed = rows.select(base.alias("base"), (F.col("conv") != base).cast("long").alias("other"), *rows.columns)

    def run(c: dict) -> dict:
        start = _starts(c["base"])
        own = np.arange(len(start)) - np.maximum(_starts(c["conv"]), start)
        before = np.cumsum(1 - c["other"])
        return {k: c[k] for k in ("base", "other", "conv", "d1", "d2", "bytes")} | {"pos": own, "held": before - (before - (1 - c["other"]))[start]}

    local = _sorted(keyed, ["base", "other", "conv", "turn", "d1", "d2", "row"], run, "base long, other long, conv long, d1 long, d2 long, bytes long, pos long, held long")
    at = lambda *more: F.struct("base", "other", "conv", *more)
    ends = local.groupBy("_task").agg(F.min(at()).alias("first"), F.max(at("pos")).alias("last"), F.max(F.struct("base", "held")).alias("held")).orderBy("_task").collect()  # one row a task
    table, conv, n, group, held = [], None, 0, None, 0
    for r in ends:
        n, held = (n if conv == r.first.conv else 0), (held if group == r.first.base else 0)
        table.append((r._task, r.first.base, r.first.conv, n, held))
        n = r.last.pos + 1 + (n if r.last.conv == r.first.conv else 0)
        held = r.held.held + (held if r.held.base == r.first.base else 0)
        conv, group = r.last.conv, r.last.base
    more = _carried(local, table, "_task int, _base long, _conv long, _pos long, _held long")
    add = lambda name, key: F.col(name) + F.when(F.col(key) == F.col(f"_{key}"), F.col(f"_{name}")).otherwise(0)
    return more.select("base", "other", "conv", "d1", "d2", "bytes", add("pos", "conv").alias("pos"), add("held", "base").alias("held"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv, depth, x1, x2, bytes: the turns of each rebuilt conversation from depth 1, their digests mixed with the depth, and a row of depth 0."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % FIRST
    rows = rows.withColumn("h", h)
    taken = F.when(F.col("other") == 0, F.col("h")).otherwise(F.least("h", "held"))
    own = rows.filter(F.col("pos") >= F.col("h")).select("conv", (F.col("pos") - F.col("h") + taken + 1).alias("depth"), "d1", "d2", "bytes")
    convs = rows.filter("pos = 0").select("conv", "base", "h")
    # At most FIRST turns of a base meet at most 2 * BASE conversations.
    heads = rows.filter((F.col("other") == 0) & (F.col("pos") < FIRST)).select("base", "pos", "d1", "d2", "bytes")
    grafted = heads.join(convs, "base").filter(F.col("pos") < F.col("h")).select("conv", (F.col("pos") + 1).alias("depth"), "d1", "d2", "bytes")
    mixed = own.unionByName(grafted).select("conv", "depth", F.xxhash64("depth", "d1", "d2").alias("x1"), F.xxhash64("d2", "d1", "depth").alias("x2"), "bytes")
    zero = F.lit(0).cast("long")
    return mixed.unionByName(convs.select("conv", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("bytes")))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, depth, a, b (the prefix), p, q (the prefix before it), bytes and ``end``, whether it is the whole conversation."""

    def run(c: dict) -> dict:
        start = _starts(c["conv"])
        out = {}
        for x, a in (("x1", "a"), ("x2", "b")):
            all_ = np.bitwise_xor.accumulate(c[x])
            out[a] = all_ ^ (all_ ^ c[x])[start]
        last = np.r_[c["conv"][1:] != c["conv"][:-1], True]
        return {k: c[k] for k in ("conv", "depth", "x1", "x2", "bytes")} | out | {"last": last.astype(np.int64)}

    local = _sorted(stash(rows), ["conv", "depth"], run, "conv long, depth long, x1 long, x2 long, bytes long, a long, b long, last long")
    ends = local.groupBy("_task").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "depth", "a", "b")).alias("last")).orderBy("_task").collect()  # one row a task
    table, conv, a, b = [], None, 0, 0
    for k, r in enumerate(ends):
        a, b = (a, b) if conv == r.first else (0, 0)
        goes_on = k + 1 < len(ends) and ends[k + 1].first == r.last.conv
        table.append((r._task, r.first, a, b, r.last.conv if goes_on else None))
        same = r.last.conv == r.first
        a, b, conv = r.last.a ^ (a if same else 0), r.last.b ^ (b if same else 0), r.last.conv
    more = _carried(local, table, "_task int, _conv long, _a long, _b long, _on long")
    fix = lambda n: F.col(n).bitwiseXOR(F.when(F.col("conv") == F.col("_conv"), F.col(f"_{n}")).otherwise(0))
    more = more.withColumns({"a": fix("a"), "b": fix("b"), "end": (F.col("last") == 1) & ~F.col("conv").eqNullSafe(F.col("_on"))})
    return more.select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("x1")).alias("p"), F.col("b").bitwiseXOR(F.col("x2")).alias("q"), "bytes", "end")


def ending(rows: DataFrame) -> DataFrame:
    """a, b, depth, sha: the SHA-256 of the ids, in order and comma-joined, of the conversations that end at a node.

    A node whose ids lie in one task is done there. Of others each task gives its ids as one text; these texts, at most two a task, are
    hashed one after the other. (SHA-256 of one list cannot be split; what can, sorting and writing the ids, is.)
    """

    def run(c: dict) -> dict:
        new = np.r_[True, (c["a"][1:] != c["a"][:-1]) | (c["b"][1:] != c["b"][:-1]) | (c["depth"][1:] != c["depth"][:-1])]
        at = [*np.flatnonzero(new), len(new)]
        texts = [",".join(map(str, c["conv"][i:j].tolist())) for i, j in zip(at[:-1], at[1:], strict=True)]
        inner = lambda k: 0 < k < len(texts) - 1
        return {k: c[k][at[:-1]] for k in ("a", "b", "depth")} | {
            "sha": pa.array([hashlib.sha256(t.encode()).hexdigest() if inner(k) else None for k, t in enumerate(texts)], pa.string()),
            "ids": pa.array([None if inner(k) else t for k, t in enumerate(texts)], pa.string()),
        }

    key = ["a", "b", "depth"]
    local = _sorted(rows.filter("end").select(*key, "conv"), [*key, "conv"], run, "a long, b long, depth long, sha string, ids string")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        give = lambda: pa.RecordBatch.from_pylist([{**dict(zip(key, now, strict=True)), "sha": sha.hexdigest()}])
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in key)
                if own != now:
                    if now is not None:
                        yield give()
                    now, sha = own, hashlib.sha256(row["ids"].encode())
                else:
                    sha.update(b"," + row["ids"].encode())
        if now is not None:
            yield give()

    parts = local.filter("ids is not null").select(*key, "_task", "ids").repartition(*key).sortWithinPartitions(*key, "_task")
    return local.filter("ids is null").select(*key, "sha").unionByName(parts.mapInArrow(chained, "a long, b long, depth long, sha string"))


def nodes(rows: DataFrame) -> DataFrame:
    """a, b, depth, p, q, conv (the smallest member), n (members), bytes and ``sha`` of each node."""
    key = ["a", "b", "depth"]
    found = rows.groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.max("p").alias("p"), F.max("q").alias("q"))
    none = hashlib.sha256(b"").hexdigest()
    return stash(found.join(ending(rows), key, "left").withColumn("sha", F.coalesce("sha", F.lit(none))))


def families(found: DataFrame) -> DataFrame:
    """Each node as a parent (tag 0) and, but for the root, as a child (tag 1): tag, conv, depth of the parent, n, bytes, parent, and tag and conv of the row after it."""
    both = found.select("a", "b", F.col("depth").alias("d"), F.lit(0).cast("long").alias("tag"), "conv", "n", "bytes")
    both = both.unionByName(found.filter("depth > 0").select(F.col("p").alias("a"), F.col("q").alias("b"), (F.col("depth") - 1).alias("d"), F.lit(1).cast("long").alias("tag"), "conv", "n", "bytes"))

    def run(c: dict) -> dict:
        i = np.arange(len(c["tag"]))
        last = np.maximum.accumulate(np.where(c["tag"] == 0, i, -1))
        end = i == len(i) - 1
        return {k: c[k] for k in ("a", "b", "d", "tag", "conv", "n", "bytes")} | {
            "parent": pa.array(c["conv"][np.maximum(last, 0)], mask=last < 0),
            "next_tag": pa.array(np.r_[c["tag"][1:], 0], mask=end),
            "next": pa.array(np.r_[c["conv"][1:], 0], mask=end),
        }

    by = ["a", "b", "d", "tag", "conv"]
    local = _sorted(both, by, run, "a long, b long, d long, tag long, conv long, n long, bytes long, parent long, next_tag long, next long")
    whole = F.struct(*by)
    ends = local.groupBy("_task").agg(F.min(whole).alias("first"), F.max(F.when(F.col("tag") == 0, whole)).alias("parent")).orderBy("_task").collect()  # one row a task
    table, parent = [], None
    for k, r in enumerate(ends):
        after = ends[k + 1].first if k + 1 < len(ends) else None
        table.append((r._task, parent, after.tag if after else 0, after.conv if after else None))
        parent = r.parent.conv if r.parent else parent
    more = _carried(local, table, "_task int, _parent long, _tag long, _next long")
    last = F.col("next_tag").isNull()
    return more.select("tag", "conv", "d", "n", "bytes", F.coalesce("parent", "_parent").alias("parent"), F.when(last, F.col("_tag")).otherwise(F.col("next_tag")).alias("next_tag"), F.when(last, F.col("_next")).otherwise(F.col("next")).alias("next"))


def arcs(family: DataFrame) -> DataFrame:
    """conv, at: the arc; to, to_at: the one after it (null at the end); leaf and saved, what it adds to sums."""
    d, one, none = F.col("d"), F.lit(1).cast("long"), F.lit(0).cast("long")
    more = F.col("next_tag") == 1
    leave = lambda depth: F.lit(TURN) - depth
    down = family.filter("tag = 0").select(
        "conv", d.alias("at"), F.when(more, F.col("next")).otherwise(F.col("conv")).alias("to"), F.when(more, d + 1).otherwise(leave(d)).alias("to_at"),
        F.when(more, none).otherwise(one).alias("leaf"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"),
    )
    up = family.filter("tag = 1").select(
        "conv", leave(d + 1).alias("at"), F.when(more, F.col("next")).otherwise(F.col("parent")).alias("to"), F.when(more, d + 1).otherwise(leave(d)).alias("to_at"),
        none.alias("leaf"), none.alias("saved"),
    )
    null = F.lit(None).cast("long")
    end = family.filter("tag = 0 and d = 0").select("conv", F.lit(TURN).alias("at"), null.alias("to"), null.alias("to_at"), none.alias("leaf"), none.alias("saved"))
    return down.unionByName(up).unionByName(end)


def drawn(tour: DataFrame) -> DataFrame:
    """Arcs with the sums from them to the end of their run in one task, ``to``, ``to_at`` now the run after it, and whether they are a run's ``head``."""
    gone = -(1 << 62)
    filled = stash(tour.withColumns({"to": F.coalesce("to", F.lit(gone)), "to_at": F.coalesce("to_at", F.lit(0).cast("long"))}))

    def run(c: dict) -> dict:
        convs, rank = np.unique(c["conv"], return_inverse=True)
        key = rank.astype(np.int64) << 41 | c["at"]
        k = np.minimum(np.searchsorted(convs, c["to"]), len(convs) - 1)
        want = np.where(convs[k] == c["to"], k.astype(np.int64) << 41 | c["to_at"], -1)
        i = np.minimum(np.searchsorted(key, want), len(key) - 1)
        follow = np.where(key[i] == want, i, -1)
        head = np.ones(len(key), np.int64)
        head[follow[follow >= 0]] = 0
        leaf, saved, last = c["leaf"].copy(), c["saved"].copy(), np.arange(len(key))
        while (m := np.flatnonzero(follow >= 0)).size:  # jumps of twice the length each time
            t = follow[m]
            leaf[m], saved[m], last[m], follow[m] = leaf[m] + leaf[t], saved[m] + saved[t], last[t], follow[t]
        none = c["to"][last] == gone
        return {"conv": c["conv"], "at": c["at"], "to": pa.array(c["to"][last], mask=none), "to_at": pa.array(c["to_at"][last], mask=none), "leaf": leaf, "saved": saved, "head": head}

    return _sorted(filled, ["conv", "at"], run, "conv long, at long, to long, to_at long, leaf long, saved long, head long")


def ranked(runs: DataFrame) -> DataFrame:
    """conv, at, leaf, saved: the sums from each run's head to the end of the tour, by pointer jumping; a round doubles what a run has seen."""
    now = stash(runs.select("conv", "at", "to", "to_at", "leaf", "saved"))
    while now.filter("to is not null").limit(1).count():
        ahead = now.select(F.col("conv").alias("to"), F.col("at").alias("to_at"), F.col("to").alias("_to"), F.col("to_at").alias("_to_at"), F.col("leaf").alias("_leaf"), F.col("saved").alias("_saved"))
        jumped = now.filter("to is not null").join(ahead, ["to", "to_at"])
        jumped = jumped.select("conv", "at", F.col("_to").alias("to"), F.col("_to_at").alias("to_at"), (F.col("leaf") + F.col("_leaf")).alias("leaf"), (F.col("saved") + F.col("_saved")).alias("saved"))
        now = stash(now.filter("to is null").unionByName(jumped))
    return now.select("conv", "at", "leaf", "saved")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty, a null turn comes first; turns with equal numbers follow each other by the SHA-256 of role and text, and
    equal rows are as many turns. Rows without a conv_id belong to no conversation. The base of a negative id is that of SQL's
    remainder (-3 has base 0). Other columns play no part. An empty table has no nodes, not even a root.
    """
    found = nodes(stash(prefixes(rebuilt(stash(placed(turns(conversations)))))))
    family = stash(families(found))
    lines = drawn(arcs(family))
    ranks = ranked(lines.filter("head = 1"))
    ahead = ranks.select(F.col("conv").alias("to"), F.col("at").alias("to_at"), F.col("leaf").alias("_leaf"), F.col("saved").alias("_saved"))
    sums = lines.join(ahead, ["to", "to_at"], "left")
    leaving = F.col("at") > TURN // 2
    sign = F.when(leaving, -1).otherwise(1)
    null, none = F.lit(None).cast("long"), F.lit(0).cast("long")
    parts = sums.select(
        "conv", F.when(leaving, TURN - F.col("at")).otherwise(F.col("at")).alias("depth"), (sign * (F.col("leaf") + F.coalesce("_leaf", none))).alias("leaf"),
        (sign * (F.col("saved") + F.coalesce("_saved", none))).alias("saved"), null.alias("parent"), none.alias("children"), null.alias("n"), F.lit(None).cast("string").alias("sha"),
    )
    child = family.filter("tag = 1")
    zero = [none.alias("leaf"), none.alias("saved")]
    parts = parts.unionByName(child.select("conv", (F.col("d") + 1).alias("depth"), *zero, "parent", none.alias("children"), null.alias("n"), F.lit(None).cast("string").alias("sha")))
    counted = child.groupBy(F.col("parent").alias("conv"), F.col("d").alias("depth")).agg(F.count("*").alias("children"))
    parts = parts.unionByName(counted.select("conv", "depth", *zero, null.alias("parent"), "children", null.alias("n"), F.lit(None).cast("string").alias("sha")))
    parts = parts.unionByName(found.select("conv", "depth", *zero, null.alias("parent"), none.alias("children"), "n", "sha"))
    out = parts.groupBy("conv", "depth").agg(
        F.max("parent").alias("parent_conv_id"), F.max("n").alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("sha").alias("ends_sha256")
    )
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE = f"""
WITH t AS (SELECT conv_id AS c, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS s, strlen(coalesce(text, '')) AS b, turn
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, s, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, s) AS i FROM t),
g AS (SELECT c, c - c % {BASE} AS base, {crc32_sql("c")} % {FIRST} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT g.c, 0 AS part, o.i, o.s, o.b FROM g JOIN o ON o.c = g.base AND o.i <= g.h UNION ALL SELECT g.c, 1, o.i, o.s, o.b FROM g JOIN o ON o.c = g.c AND o.i > g.h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, s, b FROM r),
p AS (SELECT c, d, sha256(string_agg(s, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS k, b FROM d
      UNION ALL SELECT c, 0, '', 0 FROM g),
e AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS whole FROM p),
n AS (SELECT d, k, min(c) AS c, count(*) AS n, max(b) AS b, sha256(coalesce(string_agg(CASE WHEN whole THEN c::VARCHAR END, ',' ORDER BY c), '')) AS sha FROM e GROUP BY d, k),
up AS (SELECT n.d, n.k, n.c, q.c AS parent, q.k AS pk FROM n JOIN p ON p.c = n.c AND p.d = n.d - 1 JOIN n q ON q.d = p.d AND q.k = p.k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS kids FROM up GROUP BY ALL),
own AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (d, k)),
above AS (SELECT p.d, p.k, sum(CASE WHEN own.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((own.n - 1) * own.b) AS saved FROM own JOIN p ON p.c = own.c AND p.d <= own.d GROUP BY p.d, p.k)
SELECT own.c AS conv_id, own.d AS depth, up.parent AS parent_conv_id, own.n AS n_convs, own.kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, own.sha AS ends_sha256
FROM own JOIN above USING (d, k) LEFT JOIN up USING (d, k)
"""
