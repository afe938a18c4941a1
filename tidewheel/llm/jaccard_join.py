"""Exact Jaccard self-join on word shingles by T-occurrence search.

Documents with equal shingle sets form a class; classes are joined, copies never pair up. Two sets with a
Jaccard similarity of 3/4 or more share at least T = 3/7 of the sum of their sizes.

1. Index. Of each set, the shingles whose hash is below a fixed cut (``CUT`` of the hash range) are
   indexed, at least the floor(n / 4) + 1 smallest. Linked sets then share an indexed shingle; and as both
   know how many of their shingles lie above the cut, they share at least T minus the smaller of those two
   numbers of them, mostly a third of what is indexed or more. Sets with unusually few hashes below the cut (odd ones)
   have weak bounds; they search with threshold 1, so that pairs with them are found from their side.
2. Inverted lists. One shuffle brings a shingle's classes together; a task streams them in order. Lists of
   one class are dropped, lists of up to ``SHORT`` classes stay whole, longer ones are hot. Equal lists are
   merged into one with a weight.
3. Search. For each class, DivideSkip: the longest lists are set apart as long as their weights stay below
   the threshold, the short ones are heap-merged, and what they find is binary-probed in the long
   ones. Classes that reach the required overlap (hot lists counting in full) are candidates.
4. Hot lists. A pair without a common short list must meet the threshold in hot lists alone; few classes have
   that many. Of those, each is first compared with the smallest class of each of its hot lists. Lists
   whose classes are then all connected are done; the others are compared in blocks. Odd sets are compared
   with all classes of like size in their hot lists.
5. Verification. Candidates come together in groups with their whole sets, and a local T-occurrence
   search over all shingles finds every link of the group. Connected components of the links give the result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import stash, tasks
from .words import mix64, shingle_hashes, word_hashes

SHINGLE = 5
CUT = 0.3
SHORT = 64
BLOCK = 1024
BITS = 1 << 24
SEEN = 200_000
BYTES = 1 << 18
_LIMIT = np.int64(round((CUT - 0.5) * 2**64))  # hashes are compared as signed numbers


def document_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as signed 64-bit numbers; texts are hashed a few at once."""
    k = 0
    while k < len(texts):
        m, size = k, 0
        while m < len(texts) and (m == k or size + len(texts[m]) <= BYTES):
            size += len(texts[m])
            m += 1
        hashes, offsets = shingle_hashes(*word_hashes(texts[k:m]), SHINGLE)
        signed = hashes.view(np.int64)
        for i in range(m - k):
            yield np.unique(signed[offsets[i] : offsets[i + 1]])
        k = m


def set_key(own: np.ndarray) -> int:
    """The same for equal sets: a 64-bit digest."""
    total = np.add.reduce(mix64(own.view(np.uint64)), dtype=np.uint64, keepdims=True) + np.uint64(len(own))
    return int(mix64(total).view(np.int64)[0])


def indexed(own: np.ndarray) -> int:
    """How many of a set's smallest hashes are indexed."""
    return max(int(np.searchsorted(own, _LIMIT)), len(own) // 4 + 1) if len(own) else 0


def needed(n: int, m: int) -> int:
    """The least number of common shingles of linked sets of n and m: 100 * common >= 75 * (n + m - common)."""
    return -(-3 * (n + m) // 7)


def least_threshold(n: int, below: int) -> int:
    """The least number of indexed shingles that a set of n with ``below`` hashes below the cut shares with any linked set that is not odd.

    Linked sets of n and m share needed(n, m) shingles; above the cut they share no more than either has there,
    and a set of m that is not odd has at most 4 / 5 of m there.
    """
    if odd(n, below):
        return 1
    low, high = -(-3 * n // 4), 4 * n // 3
    turn = min(max(low, 5 * (n - below) // 4), high)
    return max(1, min(needed(n, m) - min(n - below, 4 * m // 5) for m in {low, high, *range(max(low, turn - 9), min(high, turn + 9) + 1)}))


def odd(n: int, below: int) -> bool:
    """Whether unusually few of a set's hashes lie below the cut, so that it bounds little."""
    return 5 * below < n


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


CLASSES = "doc_id long, same long, _key long, n long, below int"


def classes(docs: DataFrame) -> DataFrame:
    """Each row's text digest (``same``), class (``_key``), set size and number of hashes below the cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, below = [], [], []
            for own in document_sets(_encoded(batch.column(2))):
                keys.append(set_key(own))
                sizes.append(len(own))
                below.append(int(np.searchsorted(own, _LIMIT)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(below, pa.int32())], names=["doc_id", "same", "_key", "n", "below"])

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"), "text").mapInArrow(run, CLASSES)


def postings(docs: DataFrame) -> DataFrame:
    """(shingle, _key) of all indexed shingles. A task leaves out copies of classes that it has seen lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, parts = [], []
            for own in document_sets(_encoded(batch.column(0))):
                if not len(own) or (key := set_key(own)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                parts.append(own[: indexed(own)])
                keys.append(key)
            for k in range(0, len(parts), 64):
                some = parts[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some)), pa.array(np.repeat(np.array(keys[k : k + 64], np.int64), [len(x) for x in some]))], names=["shingle", "_key"])

    return docs.select("text").mapInArrow(run, "shingle long, _key long")


LISTS = "shingle long, sig long, members array<long>, hot long"


def inverted_lists(posted: DataFrame, partitions: int, short: int = SHORT) -> DataFrame:
    """Lists of 2 to ``short`` classes (sig, members), and a row (shingle, hot) for each class of a longer list."""
    ordered = posted.repartition(partitions, "shingle").sortWithinPartitions("shingle", "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Lists(short)
        for batch in batches:
            yield from reader.feed(batch.column(0).to_numpy(), batch.column(1).to_numpy(), False)
        yield from reader.feed(np.zeros(0, np.int64), np.zeros(0, np.int64), True)

    return ordered.mapInArrow(run, LISTS)


class _Lists:
    """Cuts sorted (shingle, class) rows into lists, with no more than one short list held back between batches."""

    schema = pa.schema([("shingle", pa.int64()), ("sig", pa.int64()), ("members", pa.list_(pa.int64())), ("hot", pa.int64())])

    def __init__(self, short: int):
        self.short = short
        self.s, self.k = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.longer: int | None = None  # the shingle of a hot list of which rows are out already

    def feed(self, s: np.ndarray, k: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        s, k = np.concatenate([self.s, s]), np.concatenate([self.k, k])
        if not len(s):
            return
        fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])])  # copies that came from other tasks
        s, k = s[fresh], k[fresh]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        counts = np.diff(np.concatenate([first, [len(s)]]))
        hot = counts > self.short
        if self.longer is not None and s[0] == self.longer:
            hot[0] = True
        if not last:
            if hot[-1]:  # give out what is there, but for the last row, which the next batch may repeat
                keep, self.longer = 1, int(s[-1])
                counts[-1] -= 1
            else:
                keep, self.longer = counts[-1], None
                first, counts, hot = first[:-1], counts[:-1], hot[:-1]
            self.s, self.k = s[len(s) - keep :], k[len(k) - keep :]
        if hot.any():
            at = np.concatenate([np.arange(f, f + c) for f, c in zip(first[hot], counts[hot], strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(s[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.list_(pa.int64())), pa.array(k[at])], schema=self.schema)
        whole = ~hot & (counts > 1)
        if whole.any():
            f, c = first[whole], counts[whole]
            offsets = np.concatenate([[0], np.cumsum(c)])
            members = k[np.repeat(f - offsets[:-1], c) + np.arange(offsets[-1])]
            sigs = mix64(np.add.reduceat(mix64(members.view(np.uint64)), offsets[:-1]) + c.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s[f]), pa.array(sigs), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(members)), pa.nulls(len(f), pa.int64())], schema=self.schema)


def divide_skip(own: int, lists: list[tuple[int, list[int]]], enough: int) -> dict[int, int]:
    """Members other than ``own`` whose lists (weight, sorted members) weigh ``enough`` or more, with that weight.

    The longest lists whose weights together stay below ``enough`` are probed; the others are merged.
    """
    lists = sorted(lists, key=lambda x: -len(x[1]))
    k, apart = 0, 0
    while k < len(lists) and apart + lists[k][0] < enough:
        apart += lists[k][0]
        k += 1
    found: dict[int, int] = {}
    heap = []
    for weight, members in lists[k:]:
        heap.append((members[0], 0, weight, members))
    heapq.heapify(heap)
    while heap:
        member, total = heap[0][0], 0
        while heap and heap[0][0] == member:
            _, at, weight, members = heap[0]
            total += weight
            if at + 1 < len(members):
                heapq.heapreplace(heap, (members[at + 1], at + 1, weight, members))
            else:
                heapq.heappop(heap)
        if member == own or total < enough - apart:
            continue
        for weight, members in lists[:k]:
            at = bisect_left(members, member)
            if at < len(members) and members[at] == member:
                total += weight
        if total >= enough:
            found[member] = total
    return found


def search(lists: DataFrame, info: DataFrame, partitions: int) -> DataFrame:
    """Candidates (a, b), a < b: b shares enough indexed shingles with a, whose hot ones (``info.hot``) count as shared."""
    merged = lists.filter("sig is not null").groupBy("sig").agg(F.count("*").alias("weight"), F.first("members").alias("members"))
    asked = merged.select(F.explode("members").alias("_key"), "weight", "members")
    rows = asked.join(info, "_key").select("_key", "least", "hot", "weight", "members").repartition(partitions, "_key").sortWithinPartitions("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, enough, lists = None, 1, []

        def answer():
            found = divide_skip(key, lists, enough) if key is not None else {}
            return [(min(key, b), max(key, b), c) for b, c in found.items()]

        for batch in batches:
            out = []
            for k, least, hot, weight, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    out += answer()
                    key, enough, lists = k, max(1, least - hot), []
                lists.append((weight, members))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "common"])
        if out := answer():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "common"])

    found = rows.mapInArrow(run, "a long, b long, common long")
    side = lambda x: info.select(F.col("_key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "below", "hot")])
    both = found.join(side("a"), "a").join(side("b"), "b")
    reach = F.ceil((F.col("n_a") + F.col("n_b")) * 3 / 7)
    rest = F.least(F.col("n_a") - F.col("below_a"), F.col("n_b") - F.col("below_b"))
    sized = 4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")
    return both.filter(sized & (F.col("common") + F.least("hot_a", "hot_b") >= reach - rest)).select("a", "b").distinct()


def links_among(keys: list[int], sets: list[np.ndarray], parts: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of all links among the given classes, by a T-occurrence search over inverted lists.

    Each set merges the short lists of its shingles; of the longest, fewer than its least overlap, those over ``SHORT``
    are set apart and binary-probed in the sets of members that can still reach theirs. Classes of one part (``parts``: equal numbers)
    are known to be connected: links within it are not looked for.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    keys, sets = [keys[i] for i in order], [sets[i] for i in order]
    part = np.unique(np.asarray(parts)[order], return_inverse=True)[1] if parts is not None else np.arange(len(sets))
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(flat)]])) if len(flat) else np.zeros(0, np.int64)
    names = flat[first] if len(flat) else flat
    out = []
    for i in range(1, len(sets)):
        low = int(np.searchsorted(sizes, -(-3 * int(sizes[i]) // 4)))  # smaller partners start here
        if (part[low:i] == part[i]).all():
            continue
        at = np.searchsorted(names, sets[i])
        at = at[counts[at] > 1]
        at = at[np.argsort(counts[at], kind="stable")]
        least = needed(int(sizes[i]), int(sizes[low]))
        probed = min(least - 1, int(np.sum(counts[at] > SHORT)))
        merged = at[: len(at) - probed]
        if not len(merged):
            continue
        c = counts[merged]
        members = owner[np.repeat(first[merged] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())]
        total = np.bincount(members[(members < i) & (members >= low)], minlength=i)
        goal = -(-3 * (sizes[:i] + sizes[i]) // 7)
        apart = names[at[len(at) - probed :]]
        for j in np.flatnonzero((total > 0) & (total + probed >= goal)):
            if part[i] == part[j]:
                continue
            place = np.minimum(np.searchsorted(sets[j], apart), sizes[j] - 1)
            if total[j] + int(np.sum(sets[j][place] == apart)) >= goal[j]:
                part[part == part[i]] = part[j]
                out.append((keys[i], keys[j]))
    return out


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_key, shingles) of the classes in ``wanted`` (_key, rep). A bit map of fixed size spares most other texts the work."""
    place = F.pmod(F.xxhash64("rep"), F.lit(BITS))
    bits = wanted.select(place.alias("p")).groupBy(F.expr("cast(p div 32 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("b"))
    words = np.zeros(BITS // 32, np.int64)
    for row in bits.collect():  # BITS / 32 rows at most
        words[row.w] = row.b
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            at = batch.column(1).to_numpy()
            some = batch.filter(pa.array(((table[at >> 5] >> (at & 31)) & 1) == 1))
            if some.num_rows:
                keys, sets = [], []
                for own in document_sets(_encoded(some.column(2))):
                    keys.append(set_key(own))
                    sets.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "_key", "shingles"])

    rep = F.coalesce("doc_id", F.lit(-(2**63)))
    rows = docs.select(rep.alias("rep"), "text").select("rep", F.pmod(F.xxhash64("rep"), F.lit(BITS)).alias("at"), "text").mapInArrow(run, "rep long, _key long, shingles binary")
    return stash(rows.join(wanted, ["rep", "_key"], "left_semi").dropDuplicates(["_key"]).select("_key", "shingles"))


def verify(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among the classes of each group (g, _key, part); classes of one part are connected already. Groups are of bounded size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = links_among(pdf["_key"].tolist(), [np.frombuffer(x, np.int64) for x in pdf["shingles"]], pdf["part"].tolist())
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype="int64")

    return groups.distinct().join(sets, "_key").select("g", "_key", "part", "shingles").groupBy("g").applyInPandas(run, "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; see ``grouped``."""
    return grouped(docs).drop("same", "root")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, same (a digest of the text), n_shingles, component_id, root of every row of ``docs`` (doc_id, text).

    ``root`` tells components apart even where ids repeat: rows are in one component if they have one root.

    A text without words has no shingles and is linked with nothing; its component is its own doc_id. Rows
    with the same set are linked. A null doc_id counts as smaller than any other id.
    """
    own = stash(classes(docs))
    rep = F.coalesce("doc_id", F.lit(-(2**63)))
    table = own.filter("n > 0").groupBy("_key").agg(F.min(rep).alias("rep"), F.first("n").alias("n"), F.first("below").alias("below"))

    # A posting has 16 bytes; about CUT of all shingles are indexed.
    n = tasks(docs.sparkSession, int(16 * CUT * (own.agg(F.sum("n")).first()[0] or 0)))
    lists = stash(inverted_lists(postings(docs), n))
    hot = lists.filter("hot is not null").select("shingle", F.col("hot").alias("_key"))

    @F.pandas_udf("int")
    def least(n: pd.Series, below: pd.Series) -> pd.Series:
        return pd.Series([least_threshold(int(a), int(b)) for a, b in zip(n, below, strict=True)])

    info = stash(table.join(hot.groupBy("_key").agg(F.count("*").alias("hot")), "_key", "left").select("_key", "rep", "n", "below", F.coalesce("hot", F.lit(0)).alias("hot"), least("n", "below").alias("least")))
    pairs = stash(search(lists, info, n))

    # Equal hot lists are one token with a weight, as those of one shared passage are.
    listed = hot.groupBy("shingle").agg(F.count("*").alias("m"), F.sum(F.xxhash64("_key").cast("decimal(38,0)")).alias("sig"))
    named_lists = listed.select("shingle", "m", F.xxhash64("m", "sig").alias("token"))
    tokens = stash(hot.join(named_lists, "shingle").groupBy("token", "m", "_key").agg(F.count("*").alias("weight")))

    # Classes that can meet the threshold in hot lists alone, in the lists that a partner must share one of: rare ones
    # first, up to where the rest weighs less than the threshold.
    heavy = tokens.join(info.filter("hot >= least and 5 * below >= n").select("_key", "hot", "least"), "_key")
    earlier = Window.partitionBy("_key").orderBy("m", "token").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    heavy = stash(heavy.withColumn("_spent", spent).filter(F.col("hot") - F.col("_spent") >= F.col("least")).select("token", "_key"))
    pivots = heavy.groupBy("token").agg(F.min("_key").alias("pivot"))
    stars = heavy.join(pivots, "token").filter("_key <> pivot").select(F.col("pivot").alias("a"), F.col("_key").alias("b")).distinct()

    # Odd classes with the others of like size in their hot lists; sizes in steps of 4 / 3, so like sizes are in neighbouring steps.
    step = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("long")
    sized = tokens.join(info.select("_key", step.alias("step"), (5 * F.col("below") < F.col("n")).alias("odd")), "_key")
    strange = sized.filter("odd").groupBy("token", F.col("step").alias("y")).agg(F.count("*").alias("_odds"))
    around = sized.select("token", "_key", "odd", "step", F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("y"))
    around = around.join(strange, ["token", "y"])
    crowd = around.groupBy("token", "y").agg(F.count("*").alias("_all"))
    around = around.join(crowd, ["token", "y"])
    odds, alls = F.ceil(F.col("_odds") / BLOCK).cast("int"), F.ceil(F.col("_all") / BLOCK).cast("int")
    own_odd = around.filter("odd and step = y").select("token", "y", "_key", F.pmod(F.xxhash64("_key"), odds).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), alls - 1)).alias("j"))
    beside = around.select("token", "y", "_key", F.explode(F.sequence(F.lit(0), odds - 1)).alias("i"), F.pmod(F.xxhash64("_key"), alls).cast("int").alias("j"))
    sides = stash(own_odd.unionByName(beside).select(_group(F.col("token"), F.col("y"), -1 - F.col("i").cast("long") * 2**31 - F.col("j")).alias("g"), "_key").distinct())

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_key")).unionByName(heavy.select("_key")).unionByName(sides.select("_key")).distinct().join(info.select("_key", "rep"), "_key").select("rep", "_key")
    sets = whole_sets(docs, stash(wanted))

    # Group candidates around the smallest neighbour of each; a short list's classes mostly share it.
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l"))
    named = pairs.join(near.select("a", F.col("l").alias("la")), "a").join(near.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b")
    cold = named.select(_group(F.least("la", "lb"), F.greatest("la", "lb"), F.lit(0)).alias("g"), F.explode(F.array("a", "b")).alias("_key"))
    size = stars.groupBy("a").agg(F.count("*").alias("m"))
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / BLOCK))
    warm = stars.join(size, "a").select(_group(F.col("a"), F.col("a"), chunk + 1).alias("g"), F.explode(F.array("a", "b")).alias("_key"))
    links = stash(verify(cold.unionByName(warm).unionByName(sides).withColumn("part", F.col("_key")), sets))

    first = components(links)
    labelled = heavy.join(first.withColumnRenamed("node", "_key"), "_key", "left").select("token", "_key", F.coalesce("root", "_key").alias("root"))
    # Lists with several components left, under the component that most of their classes have: the lists of one family
    # of near copies are nearly the same and are compared once, as one group.
    shares = labelled.groupBy("token", "root").agg(F.count("*").alias("n"))
    open_lists = shares.groupBy("token").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("n", "root")).alias("most")).filter("parts > 1")
    gathered = stash(labelled.join(open_lists.select("token", "most"), "token").select("most", "_key", "root").distinct())
    # Blocks of a group, in all pairs: only what no pivot has connected gets here.
    blocks = gathered.groupBy("most").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    placed = gathered.join(blocks, "most").withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")).cast("int"))
    other = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    rest = other.select(_group(F.col("most"), F.least("_block", "_other"), F.greatest("_block", "_other")).alias("g"), "_key", F.col("root").alias("part"))
    more = stash(verify(rest, sets))

    # The stars of the first components stand for their links, so that only what is new takes rounds.
    final = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    # Components by class; the result is the smallest doc_id of all classes of a component.
    rooted = info.select("_key", "rep").join(final.withColumnRenamed("node", "_key"), "_key", "left").select("_key", "rep", F.coalesce("root", "_key").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = rooted.join(smallest, "root").select("_key", "component_id", "root")
    component = F.coalesce("component_id", "doc_id")
    return own.join(of, "_key", "left").select("doc_id", "same", F.col("n").alias("n_shingles"), F.when(component != -(2**63), component).alias("component_id"), "root")


def _group(x: Column, y: Column, z: Column) -> Column:
    """The key of a group that is verified together."""
    return F.named_struct(F.lit("x"), x.cast("long"), F.lit("y"), y.cast("long"), F.lit("z"), z.cast("long"))
