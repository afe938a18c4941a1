"""Pack tokenised documents into sequences of fixed length whose token mixture follows target proportions.

Each source is a queue of documents. Deficit round-robin serves the queues: in every round, worth one sequence, each queue is credited
its quantum (target share times the length, in 1/65536 of a token), gives out as many whole chunks as its credit pays for, and
carries what is left, its deficit, into the next round. The rounds in order are one stream of tokens without gaps; sequences are cut from it.

What a queue has given after k rounds is min(tokens, chunks that k quanta pay for), so its deficit at any round, and with it the place
in the stream of any token of any queue, follow from the queues' totals alone. A task that packs the middle of a queue thus starts
with the deficits that the tasks before it leave, without waiting for them. Only documents are dealt: by range of
queue and id, so that a source that holds a large part of all rows is packed by many tasks.

All sequences are full but those at the end of the stream: what is left there is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Recent, stash, tasks

#: Fixed values of the contract.
LENGTH = 4096
END = 2
#: Tokens that a queue gives out at once, so that no piece is cut smaller but at the ends of documents and sequences.
CHUNK = 64
#: Parts of a token in a quantum.
UNIT = 1 << 16
#: Queues at most; of more sources several share one.
QUEUES = 1024
#: The one letter whose lower case depends on its place, in one library and not in the other.
FINAL_SIGMA = "\u03a3"
#: Stretches between blanks whose ids a worker remembers (in two tables of this size), and twice the words.
REMEMBERED = 500_000


class Encoder:
    """The ids that a tokenizer file gives a text, as bytes of little-endian 32-bit numbers.

    Splitting at a pattern and encoding the words one by one gives the same ids as the library's whole pass if the
    file's steps are those named in ``STEPS`` and the pattern sees each character as the library does, which is asked once a
    character. As no word goes over a blank, text is split at blanks first, and stretches and words that come again are not
    encoded again. All else goes through the library's whole pass.
    """

    STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
    #: The pattern's classes as the faster of two pattern libraries has them (nearly: characters that differ are found and refused).
    PLAIN = {r"[^\s\p{L}\p{N}]": r"(?:[^\s\w]|_)", r"[\p{L}]": r"[^\W\d_]", r"[\p{N}]": r"\d"}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        normal, split = ((told.get(a) or {}).get(b) or [] for a, b in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self.words = Recent(self._word, REMEMBERED // 2)
        self.cased: set[str] = set()
        self.uncased: set[str] = set()
        self.patterns = []
        if ([s["type"] for s in normal], [s["type"] for s in split]) == self.STEPS and split[0]["invert"] and told["model"]["type"] == "BPE":
            pattern = plain = split[0]["pattern"]["Regex"]
            for theirs, ours in self.PLAIN.items():
                plain = plain.replace(theirs, ours)
            self.patterns = [_Pattern(regex.compile(pattern), self.library, self.words)]
            if r"\p" not in plain:
                self.patterns.insert(0, _Pattern(re.compile(plain), self.library, self.words))
        self.special = [t["content"] for t in told.get("added_tokens") or []]

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isprintable() else "".join([m for m, _ in self.library.pre_tokenizer.pre_tokenize_str(word)])
        return array("I", [t.id for t in self.library.model.tokenize(mapped)]).tobytes()

    def _lowered(self, text: str) -> str:
        """The text as the library's normalizer has it, but for white space. Composed text of characters that Python lowers alike needs no library."""
        if text.isascii():
            return text.lower()
        own = set(text)
        for c in own.difference(self.cased):
            self.cased.add(c)
            low = self.library.normalizer.normalize_str(c)
            if c == FINAL_SIGMA or (low != c.lower() and not (low.isspace() and c.isspace())):
                self.uncased.add(c)
        plain = self.uncased.isdisjoint(own) and unicodedata.is_normalized("NFC", text)
        return text.lower() if plain else self.library.normalizer.normalize_str(text)

    def encode(self, text: str) -> bytes:
        if self.patterns and not any(s in text for s in self.special):
            plain = self._lowered(text)
            own = set(plain)
            for pattern in self.patterns:
                if pattern.serves(own):
                    return b"".join(map(pattern.chunks.__getitem__, plain.split()))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Pattern:
    """A pattern, with the characters around which it splits as the library does, and the ids of what stands between blanks."""

    def __init__(self, pattern, library, words: Recent):
        self.pattern, self.library = pattern, library
        self.chunks = Recent(lambda chunk: b"".join(map(words.__getitem__, pattern.findall(chunk))), REMEMBERED)
        self.known: set[str] = set()
        self.refused: set[str] = set()

    def serves(self, characters: set[str]) -> bool:
        for c in characters.difference(self.known):
            self.known.add(c)
            probe = f"a{c}{c}1{c}"
            spans = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(probe)]
            blank = all(e <= 1 or s >= 3 for s, e in spans)
            if [m.span() for m in self.pattern.finditer(probe)] != spans or c.isspace() != blank:
                self.refused.add(c)
        return self.refused.isdisjoint(characters)


#: One encoder a worker process and file: what a task has remembered serves the next.
_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Rounds:
    """The closed form of deficit round-robin over queues with ``totals`` tokens and target ``shares``."""

    def __init__(self, totals: list[int], shares: list[float], length: int = LENGTH, chunk: int = CHUNK):
        self.totals = np.array(totals, np.int64)
        self.quanta = np.maximum(np.round(np.array(shares, np.float64) / max(sum(shares), 1e-300) * length * UNIT), 1).astype(np.int64)
        self.length, self.chunk, self.all = length, chunk, int(self.totals.sum())
        full, rest = divmod(self.all, length)
        powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.full, self.tail = full, full * length + np.cumsum([0, *powers])

    def given(self, rounds: np.ndarray) -> np.ndarray:
        """What each queue (columns) has given after each number of rounds (rows)."""
        return np.minimum(self.totals, rounds[:, None] * self.quanta // (UNIT * self.chunk) * self.chunk)

    def stream(self, queue: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of documents that start at ``first`` of their queue: document, start, length, place in the stream. Runs end with rounds."""
        n = (first + length - 1) // self.chunk - first // self.chunk + 1
        doc = np.repeat(np.arange(len(first)), n)
        chunk = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first // self.chunk, n)
        q = queue[doc]
        rounds = -(-(chunk + 1) * (UNIT * self.chunk) // self.quanta[q])
        start = np.maximum(chunk * self.chunk, first[doc])
        new = np.r_[True, (doc[1:] != doc[:-1]) | (rounds[1:] != rounds[:-1])][: len(doc)]
        doc, q, rounds, start = doc[new], q[new], rounds[new], start[new]
        end = np.r_[start[1:], 0][: len(doc)]
        last = np.r_[doc[1:] != doc[:-1], True][: len(doc)]
        end[last] = (first + length)[doc[last]]
        place = np.empty(len(doc), np.int64)
        each, back = np.unique(rounds, return_inverse=True)
        for k in range(0, len(each), 256):
            before, after = self.given(each[k : k + 256] - 1), self.given(each[k : k + 256])
            # A round starts where all queues have come to; within it, earlier queues come first.
            begins = before.sum(1)[:, None] + np.cumsum(after - before, 1) - (after - before) - before
            own = (back >= k) & (back < k + 256)
            place[own] = begins[back[own] - k, q[own]] + start[own]
        return doc, start - first[doc], end - start, place

    def pieces(self, queue: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same runs, joined where the stream goes on and cut at the ends of sequences: document, start, length, sequence, offset."""
        doc, start, size, place = self.stream(queue, first, length)
        if not len(doc):
            return doc, start, size, place, place
        new = np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + size[:-1])]
        at = np.flatnonzero(new)
        doc, start, place, size = doc[at], start[at], place[at], np.add.reduceat(size, at)
        n = (place + size - 1) // self.length - place // self.length + 1
        k = np.repeat(np.arange(len(doc)), n)
        window = place[k] // self.length + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        low, high = np.maximum(place[k], window * self.length), np.minimum((place + size)[k], (window + 1) * self.length)
        out = [(d, s, l, w, o) for d, s, l, w, o in zip(doc[k], start[k] + low - place[k], high - low, window, low - window * self.length, strict=True) if w < self.full]
        for i in np.flatnonzero(window >= self.full):
            for j, (left, right) in enumerate(zip(self.tail[:-1], self.tail[1:], strict=True)):
                a, b = max(low[i], left), min(high[i], right)
                if a < b:
                    out.append((doc[k[i]], start[k[i]] + a - place[k[i]], b - a, self.full + j, a - left))
        return tuple(np.array(out, np.int64).reshape(-1, 5).T)


def queued(docs: DataFrame, tokenizer: str, end: int, others: list[str]) -> DataFrame:
    """Documents in queue order with ``_ids`` (bytes), ``_n`` and ``_first``, the place of their first token in their queue."""
    spark = docs.sparkSession
    n = tasks(spark, docs.agg(F.sum(F.octet_length("text"))).first()[0])
    known, name = F.col("source").isNotNull(), F.coalesce(F.col("source").cast("string"), F.lit(""))
    if docs.select("source").distinct().count() > QUEUES:  # a queue for each digest
        known, name = F.lit(True), F.pmod(F.xxhash64("source"), F.lit(QUEUES)).cast("string")
    by = ["_known", "_queue", "doc_id", "_tie"]
    rows = docs.select(known.alias("_known"), name.alias("_queue"), "doc_id", F.xxhash64("text").alias("_tie"), *[F.col(f"`{c}`") for c in others], F.coalesce("text", F.lit("")).alias("_text"))
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, at, now = TaskContext.get().partitionId(), encoder_of(tokenizer), 0, None
        stop = np.array([end], "<u4").tobytes()
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            ids, firsts = [], []
            for queue, text in zip(zip(columns["_known"].to_pylist(), columns["_queue"].to_pylist(), strict=True), columns["_text"], strict=True):
                if queue != now:
                    now, at = queue, 0
                ids.append(encoder.encode(text.as_py()) + stop)
                firsts.append(at)
                at += len(ids[-1]) // 4
            sizes = pa.array([len(b) // 4 for b in ids], pa.int64())
            new = [pa.array(ids, pa.binary()), sizes, pa.array(firsts, pa.int64()), pa.array([task] * len(ids), pa.int32())]
            yield pa.RecordBatch.from_arrays([*[columns[c] for c in kept], *new], names=[*kept, "_ids", "_n", "_first", "_task"])

    kept = ["_known", "_queue", *dict.fromkeys(["doc_id", *others])]
    types = ", ".join(f"`{c}` {t}" for c, t in dealt.select(*[f"`{c}`" for c in kept]).dtypes)
    held = stash(dealt.mapInArrow(run, f"{types}, _ids binary, _n long, _first long, _task int"))
    before = Window.partitionBy("_known", "_queue").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("_known", "_queue", "_task").agg(F.sum("_n").alias("_sum"))
    starts = sums.select("_known", "_queue", "_task", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    # A row for each task and each queue that begins in it: at most the tasks and QUEUES more.
    return held.join(F.broadcast(starts), ["_known", "_queue", "_task"]).withColumn("_first", F.col("_first") + F.col("_before")).drop("_task", "_before")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, chunk: int = CHUNK, targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, source and ``ids``, little-endian 32-bit numbers as bytes.

    ``docs`` has doc_id, source and text. A document is its ids and ``end``; a null text is empty, so is its document but for ``end``. Null
    sources are one queue, the first; queues follow by code point, documents in them by id (nulls first), rows with one id by a digest of their
    text; equal rows follow each other. ``targets`` are weights of sources (0 where missing: such queues are served one unit a
    round); by default a source weighs what it holds, so all queues end together and every sequence has the mixture of
    the whole. When a queue ends the others go on by their weights. Other columns of ``docs`` play no part. An empty table has no pieces.
    """
    rows = queued(docs, tokenizer, end, ["source"])
    sums = rows.groupBy("_known", "_queue").agg(F.sum("_n").alias("n")).orderBy("_known", "_queue").collect()  # at most QUEUES rows
    place = {(r[0], r[1]): k for k, r in enumerate(sums)}
    if targets is not None and len(sums) == QUEUES and docs.select("source").distinct().count() > QUEUES:
        raise ValueError(f"targets are for at most {QUEUES} sources")
    share = [float(r.n) if targets is None else float(targets.get(r[1] if r[0] else None, 0)) for r in sums]
    rounds = Rounds([r.n for r in sums], share, length, chunk)
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            queue = np.array([place[q] for q in zip(c["_known"].to_pylist(), c["_queue"].to_pylist(), strict=True)], np.int64)
            sizes = c["_n"].to_numpy()
            doc, start, size, sequence, offset = rounds.pieces(queue, c["_first"].to_numpy(), sizes)
            ids = [memoryview(b.as_buffer()) for b in c["_ids"]]
            cut = [bytes(ids[d][4 * s : 4 * (s + n)]) for d, s, n in zip(doc, start, size, strict=True)]
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [c["doc_id"].take(at), *map(pa.array, (start, size, sizes[doc], sequence, offset)), c["source"].take(at), pa.array(cut, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "ids"],
            )

    wanted = f"doc_id {kind['doc_id']}, start long, length long, doc_tokens long, sequence_id long, offset long, source {kind['source']}, ids binary"
    return rows.select("doc_id", "source", "_known", "_queue", "_n", "_first", "_ids").mapInArrow(run, wanted)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
