"""Removal of repeated passages by a column-wise multi-document construction.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.

The construction inserts one symbol of each string a round, from the last column to the first, and keeps
the collection sorted by what has been inserted so far: the stable sort by the new column's symbols is the
Burrows-Wheeler step, and the common prefixes of neighbours are updated with it (one more than the least
common prefix between two neighbours of equal symbol, else none). Strings that share 50 symbols from a
column on are then neighbours with common prefixes of 50 or more.

Rounds over whole texts, one shuffle for each of up to 10 ** 5 symbols, cannot meet any limit. Only strings of
50 bytes matter, so the collection is cut where they agree: each 50-byte string names its anchor, the
24 bytes in it with the least hash. Equal strings have equal anchors at equal places. The strings of one anchor
in a document are a window of at most 76 bytes, so windows of equal anchors are built together, aligned
at the anchor, in 76 rounds. Spark's sorted shuffle files are the external files that a task reads in sequence.

1. Exact copies are found by digest and need no more work.
2. Anchors that occur in several documents are found by one aggregate; a bit map of fixed size of them
   (false positives cost work, not correctness) tells the second scan which windows to send.
3. The windows of each anchor are built as above; covered places go back to their documents.
4. An anchor with more than ``WINDOWS`` windows is hot. The first scan counts them, and a second bit map marks them
   (false positives cost work). Its windows are dealt over ``SALTS`` groups, and each build settles what it can: a string
   that a smaller document of the same build has is covered. Strings that were first in their build are
   dealt again by their own hash, so only equal strings meet, at most a few for each build, and the smallest document
   is known when they are read in order. No build is carried on, and no task reads the whole anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash, tasks
from .words import _BASE, _CODE, _INVERSE, _power, mix64

LENGTH = 50
ANCHOR = 24
PLACES = LENGTH - ANCHOR + 1  # of an anchor in a string
WIDTH = LENGTH + PLACES - 1
ANCHOR_BITS, DOC_BITS, HOT_BITS = 27, 24, 20
#: Bytes hashed and windows built at once.
BYTES, WINDOWS = 1 << 18, 60_000
#: Groups that a hot anchor's windows are dealt over, and strings that are cut out of its builds at once.
SALTS, STRINGS = 64, 20_000
_U = np.uint64
_PLAIN = mix64(np.arange(256, dtype=_U) ^ _CODE[0])
ID = -(2**63)


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, and first and last string start of every anchor in the joined texts ``raw`` that end at ``ends``."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none.view(_U), none, none, none
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_PLAIN[raw] * _power(_BASE, len(raw)), dtype=_U, out=sums[1:])
    n = len(raw) - ANCHOR + 1
    hashes = mix64((sums[ANCHOR:] - sums[:n]) * _power(_INVERSE, len(raw))[:n])
    least = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)  # equal hashes: the leftmost
    span = 1
    while span * 2 <= PLACES:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (PLACES - span)], least[PLACES - span :]) if span < PLACES else least
    inside = np.ones(len(least), bool)
    for e in ends:
        inside[max(0, e - LENGTH + 1) : e] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none.view(_U), none, none, none
    place = (least[starts] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    # Least hashes crowd together; mixed once more they spread evenly over the bit map.
    return mix64(hashes[place[new]]), place[new], starts[new], starts[last]


def repeated(windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each string start (row) and window (column), whether a window of a smaller document has the same 50 bytes there.

    ``windows`` has a row for each of the WIDTH columns of the aligned windows; 256 stands for no byte.
    """
    n = windows.shape[1]
    order, common = np.arange(n), np.zeros(n, np.int16)
    out = np.zeros((PLACES, n), bool)
    for column in range(WIDTH - 1, -1, -1):
        symbols = windows[column, order]
        by = np.argsort(symbols, kind="stable")
        symbols = symbols[by]
        after = np.zeros(n, np.int16)
        same = np.flatnonzero((symbols[1:] == symbols[:-1]) & (symbols[1:] < 256)) + 1
        if len(same):
            # The least common prefix between two neighbours that had others between them before.
            spans = np.empty(2 * len(same), np.int64)
            spans[::2], spans[1::2] = by[same - 1] + 1, by[same] + 1
            spans[-1] = min(spans[-1], n)
            padded = np.concatenate([common, [np.int16(0)]])
            after[same] = np.minimum(np.minimum.reduceat(padded, spans)[::2] + 1, LENGTH)
        order, common = order[by], after
        if column < PLACES:
            begin = np.flatnonzero(common < LENGTH)
            if len(begin) < n:
                own = docs[order]
                first = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.concatenate([begin, [n]])))
                out[column, order] = own > first
    return out


def _aligned(flat: np.ndarray, offsets: np.ndarray, shift: np.ndarray) -> np.ndarray:
    lengths = np.diff(offsets)
    out = np.full((WIDTH, len(shift)), 256, np.uint16)
    within = np.arange(len(flat)) - np.repeat(offsets[:-1], lengths)
    out[within + np.repeat(PLACES - 1 - shift, lengths), np.repeat(np.arange(len(shift)), lengths)] = flat
    return out


def bit_map(hashes: DataFrame, bits: int, hot: Column | None = None) -> np.ndarray:
    """A bit for each value of the top ``bits`` bits of column ``h``: 2 ** bits / 8 bytes, whatever the input.

    With ``hot``, the top HOT_BITS bits of the rows that meet it have bits of their own behind these, got in the same pass.
    """
    low = min(20, bits)
    place = F.shiftrightunsigned("h", 64 - bits)
    if hot is not None:
        place = F.explode(F.array_compact(F.array(place, F.when(hot, F.shiftrightunsigned("h", 64 - HOT_BITS) + F.lit(1 << bits)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << low, bool)
        own[pdf["p"].to_numpy() & ((1 << low) - 1)] = True
        return pd.DataFrame({"c": [int(pdf["p"].iloc[0]) >> low], "b": [np.packbits(own, bitorder="little").tobytes()]})

    rows = hashes.select(place.alias("p")).distinct().groupBy(F.shiftright("p", low).alias("c")).applyInPandas(run, "c long, b binary").collect()
    out = np.zeros((1 << (bits - 3)) + ((1 << (HOT_BITS - 3)) if hot is not None else 0), np.uint8)
    for r in rows:
        at = r.c << (low - 3)
        out[at : at + len(r.b)] = np.frombuffer(r.b, np.uint8)
    return out


def _hit(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> _U(64 - bits)
    return (table[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name), F.lit(ID))


def _routed(rows: DataFrame, table, wanted: bool) -> DataFrame:
    """Rows (.., text) whose id may be in the bit map, or surely is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _hit(table.value, batch.column(2).to_numpy().view(_U), DOC_BITS)
            yield batch.filter(pa.array(hit if wanted else ~hit))

    return rows.select("id", "same", F.xxhash64("id").alias("h"), "text").mapInArrow(run, "id long, same int, h long, text string").drop("h")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined bytes, their texts' starts and ends, and row numbers, of a few texts at once."""
    texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
    k = 0
    while k < len(texts):
        m, size = k, 0
        while m < len(texts) and (m == k or size + len(texts[m]) <= BYTES):
            size += len(texts[m])
            m += 1
        ends = np.cumsum([len(t) for t in texts[k:m]])
        yield np.frombuffer(b"".join(texts[k:m]), np.uint8), np.concatenate([[0], ends[:-1]]), ends, np.arange(k, m)
        k = m


def remove(docs: DataFrame, hot_windows: int = WINDOWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text).

    A null text is empty; a null doc_id counts as smaller than any other. Rows with one doc_id never remove
    each other's bytes. Anchors with more than ``hot_windows`` windows are split over tasks.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(_id().alias("id"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("same"), text.alias("text"))
    base = stash(docs.select("doc_id", _id().alias("id"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("same"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")))

    groups = base.filter(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = stash(base.join(groups.select("sha", "first"), "sha").filter("id > first").select("id", "same").distinct())
    copied = spark.sparkContext.broadcast(bit_map(copies.select(F.xxhash64("id").alias("h")), DOC_BITS))
    firsts = _routed(rows, copied, False).unionByName(_routed(rows, copied, True).join(copies, ["id", "same"], "left_anti"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for raw, _, ends, at in _chunks(batch):
                h, place, *_ = anchors(raw, ends)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[at[np.searchsorted(ends, place, "right")]])], names=["h", "id"])

    shared = firsts.mapInArrow(scan, "h long, id long").groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).filter("a < b")
    marks = bit_map(shared, ANCHOR_BITS, F.col("n") > hot_windows)
    any_hot = bool(marks[1 << (ANCHOR_BITS - 3) :].any())
    several = spark.sparkContext.broadcast(marks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, same = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for raw, starts, ends, at in _chunks(batch):
                h, place, first, last = anchors(raw, ends)
                some = np.flatnonzero(_hit(several.value, h, ANCHOR_BITS))
                hot = np.zeros(len(h), bool)
                if any_hot:
                    hot = _hit(several.value[1 << (ANCHOR_BITS - 3) :], h, HOT_BITS)
                    salts = mix64(ids[at[np.searchsorted(ends, place, "right")]].astype(np.int64).view(_U)) % _U(SALTS)
                    h = np.where(hot, mix64(h + salts + _U(1)), h)
                for k in range(0, len(some), 20_000):
                    part = some[k : k + 20_000]
                    f, size = first[part], last[part] + LENGTH - first[part]
                    offsets = np.concatenate([[0], np.cumsum(size)])
                    data = raw[np.repeat(f - offsets[:-1], size) + np.arange(offsets[-1])]
                    own = np.searchsorted(ends, place[part], "right")
                    windows = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(ids[at[own]]), pa.array(same[at[own]]), pa.array((f - starts[own]).astype(np.int32)), pa.array((place[part] - f).astype(np.int8)), windows, pa.array(hot[part])], names=["h", "id", "same", "at", "shift", "bytes", "hot"])

    # Windows overlap: of texts that repeat throughout, some three times their bytes are sent.
    n = tasks(spark, 3 * (base.agg(F.sum("n_bytes")).first()[0] or 0))
    sent = firsts.mapInArrow(cut, "h long, id long, same int, at int, shift byte, bytes binary, hot boolean").repartition(n, "h").sortWithinPartitions("h", "id")
    spans = sent.mapInArrow(_build, "h long, id long, same int, start int, end int, string binary")
    if any_hot:
        spans = spans.repartition(n, "h").sortWithinPartitions("h", "id").mapInArrow(_settle, "id long, same int, start int, end int")
    covered = stash(spans.groupBy("id", "same").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))

    touched = spark.sparkContext.broadcast(bit_map(covered.select(F.xxhash64("id").alias("h")), DOC_BITS))
    partly = _routed(rows, touched, True).join(covered, ["id", "same"]).select("id", "same", "text", "spans").mapInArrow(_keep, "id long, same int, n_removed long, n_spans long, kept string")
    partly = partly.dropDuplicates(["id", "same"])
    whole = copies.withColumn("copy", F.lit(True))
    result = base.join(partly, ["id", "same"], "left").join(whole, ["id", "same"], "left")
    copy = F.coalesce("copy", F.lit(False))
    return result.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered places, from windows sorted by anchor and document.

    An anchor's windows may be more than are built at once: of those done, only the windows that are the first with
    some string are held for the next batch, in place of all. Of hot anchors nothing is held: the strings that are
    first in a build are given out with their hash, for ``_settle``.
    """
    held: list[pa.Table] = []
    count = 0
    old = 0  # windows at the front that have given their places already

    def rows(table: pa.Table, pick: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, string: pa.Array) -> pa.RecordBatch:
        at = pa.array(pick)
        own = [table.column(c).combine_chunks().take(at) for c in ("id", "same")]
        return pa.RecordBatch.from_arrays([pa.array(h), *own, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), string], names=["h", "id", "same", "start", "end", "string"])

    def build(table: pa.Table, old: int) -> tuple[list[pa.RecordBatch], np.ndarray]:
        column = table.column("bytes").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        shift = table.column("shift").to_numpy().astype(np.int64)
        found = repeated(_aligned(flat, offsets, shift), table.column("id").to_numpy())
        strings = np.diff(offsets) - LENGTH + 1
        owner = np.flatnonzero(found.sum(axis=0) < strings)
        found[:, :old] = False
        edge = np.diff(np.pad(found, ((1, 1), (0, 0))).astype(np.int8), axis=0).T
        row, start = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        zero = table.column("at").to_numpy() + shift - (PLACES - 1)
        out = []
        if len(row):
            dealt = mix64(np.arange(len(row), dtype=_U)).view(np.int64)  # spans are final: any task may pass them on
            out.append(rows(table, row, dealt, zero[row] + start, zero[row] + end - 1 + LENGTH, pa.nulls(len(row), pa.binary())))
        hot = np.flatnonzero(table.column("hot").to_numpy())
        for k in range(0, len(hot), STRINGS // PLACES):
            part = hot[k : k + STRINGS // PLACES]
            begin = PLACES - 1 - shift[part]
            place = np.arange(PLACES)[:, None]
            open_ = ~found[:, part] & (place >= begin) & (place < begin + strings[part])
            start, own = np.nonzero(open_)
            text = flat[(offsets[part[own]] + start - begin[own])[:, None] + np.arange(LENGTH)]
            data = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(0, (len(own) + 1) * LENGTH, LENGTH, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
            at = zero[part[own]] + start
            out.append(rows(table, part[own], _hash_rows(text), at, at + LENGTH, data))
        return out, owner

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count - old < WINDOWS:
            continue
        table = pa.concat_tables(held)
        h = table.column("h").to_numpy()
        other = np.flatnonzero(h != h[-1])
        tail = int(other[-1]) + 1 if len(other) else 0
        if tail:  # whole anchors, and one that may go on
            out, _ = build(table.slice(0, tail), old)
            held, count, old = [table.slice(tail)], len(h) - tail, 0
        else:
            out, owner = build(table, old)
            if table.column("hot")[0].as_py():
                owner = owner[:0]
            table = table.take(pa.array(owner))
            held, count, old = [table], len(owner), len(owner)
        yield from out
    if count:
        yield from build(pa.concat_tables(held), old)[0]


def _hash_rows(text: np.ndarray) -> np.ndarray:
    """A hash of each row of LENGTH bytes."""
    words = np.zeros((len(text), -(-LENGTH // 8) * 8), np.uint8)
    words[:, :LENGTH] = text
    out = np.zeros(len(text), _U)
    for word in words.view(_U).T:
        out = mix64(out ^ word)
    return out.view(np.int64)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans as they are, and of the strings, sorted by hash and document, those that a smaller document has too.

    What is held is the smallest document of each string of one hash.
    """
    last, firsts = None, {}
    for batch in batches:
        keep = []
        for h, i, string in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5).to_pylist(), strict=True):
            if string is not None and h != last:
                last, firsts = h, {}
            keep.append(string is None or i > firsts.setdefault(string, i))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["id", "same", "start", "end"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, kept = [], [], []
        for text, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw, out, n, runs = text.encode(), [], 0, 0
            end = -1
            for p in places:
                if p["start"] > end:
                    out.append(raw[max(end, 0) : p["start"]])
                    runs += 1
                    n += p["end"] - p["start"]
                    end = p["end"]
                elif p["end"] > end:
                    n += p["end"] - end
                    end = p["end"]
            out.append(raw[max(end, 0) :])
            removed.append(n)
            spans.append(runs)
            kept.append(hashlib.sha256(b"".join(out)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["id", "same", "n_removed", "n_spans", "kept"])
