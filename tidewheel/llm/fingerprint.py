"""Document fingerprints by consistent weighted sampling.

A document is a set of words weighted by their counts. For sample k and word w, random numbers that
depend on (k, w) alone are drawn: r and c from Gamma(2, 1) and b uniform. With weight x,
t = floor(ln x / r + b), ln y = r (t - b) and ln a = ln c - ln y - r; the sample is the (word, t) with the
smallest a. Two documents get the same sample with a probability equal to their generalised Jaccard
similarity, the sum of minima over the sum of maxima of their word counts. A fingerprint holds 16 bits of
each sample, in hexadecimal; likeness is the share of equal samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tasks
from .words import mix64, word_hashes

SAMPLES = 64
_U = np.uint64
#: Unique (word, count) pairs that are sampled at once, and pairs of documents reduced at once: bounds memory.
CHUNK = 16_384
_SALTS = mix64(np.arange(1, 3 * SAMPLES + 1, dtype=_U)).reshape(3, SAMPLES)


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1), from 32 bits."""
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)


def log_samples(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """ln a for every (term, count) and sample."""
    low, shift = _U(0xFFFFFFFF), _U(32)
    h = mix64(terms[:, None] ^ _SALTS[0])
    # Bits 0 and all-ones would round to 0 or 1 in single precision: both stay inside by clipping.
    tiny, one = np.float32(1e-10), np.float32(1 - 6e-8)
    r = -np.log(np.clip(_uniform(h & low), tiny, one)) - np.log(np.clip(_uniform(h >> shift), tiny, one))
    h = mix64(terms[:, None] ^ _SALTS[1])
    c = -np.log(np.clip(_uniform(h & low), tiny, one)) - np.log(np.clip(_uniform(h >> shift), tiny, one))
    b = np.clip(_uniform(mix64(terms[:, None] ^ _SALTS[2]) >> shift), 0, one)
    t = np.floor(np.log(counts.astype(np.float32))[:, None] / r + b)
    return np.log(c) - r * (t - b) - r


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of 16-bit samples for every text; a text without words has a row of zeros, others none that is all zeros."""
    hashes, offsets = word_hashes(texts)
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    if not len(hashes):
        return out
    doc = np.repeat(np.arange(len(texts), dtype=_U), np.diff(offsets))
    keys = np.sort((doc << _U(44)) | (hashes >> _U(20)))  # up to a million texts a call
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    doc, terms = (keys >> _U(44)).astype(np.int64), keys & _U((1 << 44) - 1)
    pairs, at = np.unique((terms << _U(20)) | np.minimum(counts, (1 << 20) - 1).astype(_U), return_inverse=True)
    table = np.empty((len(pairs), SAMPLES), np.float32)
    for k in range(0, len(pairs), CHUNK):
        part = pairs[k : k + CHUNK]
        table[k : k + CHUNK] = log_samples(part >> _U(20), part & _U((1 << 20) - 1))
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    end = np.concatenate([begin[1:], [len(doc)]])
    least = np.empty((len(begin), SAMPLES), np.float32)
    k = 0
    while k < len(begin):  # as many documents at once as have CHUNK terms, one at least
        m = max(k + 1, int(np.searchsorted(end, begin[k] + CHUNK, "right")))
        least[k:m] = np.minimum.reduceat(table[at[begin[k] : end[m - 1]]], begin[k:m] - begin[k], axis=0)
        k = m
    bits = (mix64(least.view(np.uint32).astype(_U)) >> _U(48)).astype(np.uint16)
    out[doc[begin]] = np.maximum(bits, 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples; texts without words are like each other, and like no other text."""
    return (a == b).mean(axis=1)


def hexadecimal(rows: np.ndarray) -> list[str]:
    """The big-endian samples in hexadecimal; an empty string for a text without words."""
    return [r.tobytes().hex() if r.any() else "" for r in rows.astype(">u2")]


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add column ``name``, the fingerprint of the whole text; null counts as empty, and an empty text has an empty fingerprint."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column exists already: {name}")

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        return pd.Series(hexadecimal(fingerprints([(t or "").encode() for t in texts])))

    return df.withColumn(name, run(F.col(f"`{text}`")))


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """Range-partition (doc_id, text) by doc_id and lay each partition out in descending order.

    Adds ``_range`` and ``_halo``: each range also gets the row that follows its last one, the first row of
    the next lower range (for the lowest, the highest document), marked ``_halo`` and put last. Only the
    range limits and each range's largest id, ``partitions`` values at most, go through the driver.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    shares = [k / partitions for k in range(1, partitions)]
    limits = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 10 * max(partitions, 1000))).first()[0] or [])) if shares else []
    own = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x <= F.col("doc_id"))) if limits else F.lit(0)
    tops = sorted(tuple(r) for r in ids.groupBy(own.alias("r")).agg(F.max("doc_id")).collect())
    halo = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]
    follow = spark.createDataFrame(halo, "_top long, _to int")
    rows = docs.select("doc_id", "text", own.alias("_own")).join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("_top")), "left")
    both = F.array(F.struct(F.col("_own").alias("_range"), F.lit(False).alias("_halo")), F.struct(F.col("_to").alias("_range"), F.lit(True).alias("_halo")))
    return (
        rows.select("doc_id", "text", F.inline(both))
        .filter(F.col("_range").isNotNull())
        .repartition(partitions, "_range")
        .sortWithinPartitions("_range", "_halo", F.desc_nulls_last("doc_id"), "text")
    )


RESULT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprint every document and its edited text.

    In descending order of doc_id, the last n_chars // 2 code points of a document give way to the first as
    many (or all) of the next document; after the last comes the first. Rows with the same doc_id follow
    each other by text, nulls first; null ids come last. A null text counts as empty.
    """
    n = partitions or tasks(docs.sparkSession, docs.agg(F.sum(F.octet_length("text"))).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose next one is still to come: range, id, text, fingerprint
        for batch in batches:
            ids, texts, ranges, halos = (c.to_pylist() for c in batch.columns)
            texts = [t or "" for t in texts]
            prints = fingerprints([t.encode() for t in texts])
            done = []
            for k in range(len(ids)):
                if held is not None and held[0] == ranges[k]:
                    done.append((held, texts[k], prints[k]))
                held = None if halos[k] else (ranges[k], ids[k], texts[k], prints[k])
            if done:
                news = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for (_, _, t, _), after, _ in done]
                own = np.array([h[3] for h, _, _ in done])
                changed = fingerprints([t.encode() for t in news])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([h[1] for h, _, _ in done], pa.int64()),
                        "n_chars": pa.array([len(h[2]) for h, _, _ in done], pa.int64()),
                        "edited": pa.array(news, pa.string()),
                        "fingerprint": hexadecimal(own),
                        "edited_fingerprint": hexadecimal(changed),
                        "near_edited": likeness(own, changed),
                        "near_next": likeness(own, np.array([f for _, _, f in done])),
                    }
                )

    return with_next(docs, n).mapInArrow(run, RESULT)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and their likenesses of each row of ``docs``; cases are those of ``edited``."""
    return edited(docs).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
