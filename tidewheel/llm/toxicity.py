"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. A character language model: trigram counts over all texts of the corpus, gathered by Spark. The letters
   share 64 classes, so the table has a fixed size; what is counted grows with the corpus.
2. Deobfuscation: runs of letters and look-alike signs that hold both, spaced-out letters, and letters repeated
   three times or more become a lattice of readings: a sign may be itself or a letter that it looks like, a repeated
   letter may be dropped, a gap inside a spaced-out word may be dropped or be a word break, and punctuation before or behind a word may
   be left out. Viterbi finds the reading with the best sum of channel costs and language model. Full-width and other
   compatible forms are written plainly first. Of a longer run of one character three are read. All of it is linear in the text.
3. Scoring: logistic regression on the restored text's words and word beginnings. It is fitted on at most
   ``SAMPLE`` labelled rows, those with the smallest digests of their ids; features are the ``FEATURES``
   most telling ones of the sample, seen in three of its documents at least and ``FAR`` standard deviations from its toxic
   share. All these bounds are parameters or constants here, whatever the corpus. Weights are what is broadcast.

Scores depend on the text alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Recent, stash

SAMPLE = 20_000
FEATURES = 4096
BEGINNING = 4
THRESHOLD = 0.7
CLASSES = 64
#: Features whose toxic share is nearer to the sample's than so many standard deviations are noise.
FAR = 4.0

#: What a sign may be read as.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h"}
KEEP, READ, DROP = 6.0, 0.7, 0.3  # channel costs: a sign kept as it is, read as a letter, a character dropped
#: Signs that may be mere punctuation before or behind a word, and the cost of leaving them out there.
BEFORE, BEHIND, EDGE = "(*#|", "!(*#|", 3.0
#: Costs of a gap of a spaced-out word: a word break at a gap as short as any, and at a longer one; no break at a longer one.
BREAK, WIDE_BREAK, WIDE_DROP = 1.0, 0.0, 1.5
#: Tokens that a worker remembers.
REMEMBERED = 50_000
_SIGNS = re.escape("".join(LOOKS_LIKE))
_LETTER = r"[^\W\d_]"
_ONE = rf"(?:{_LETTER}|[{_SIGNS}])"
# No sign is a separator and runs are possessive, so no text makes these try a place more than once.
SPACED = re.compile(rf"(?<!\w){_ONE}(?:[ .\-_]{{1,3}}{_ONE}){{2,}}(?!\w)")
RUN = re.compile(f"{_ONE}++")
_TRIPLE = re.compile(rf"({_LETTER})\1\1")
_LONG = re.compile(r"(.)\1{3,}", re.DOTALL)
_GAP = re.compile(r"[ .\-_]+")
WORDS = re.compile(rf"{_LETTER}+")
#: Stripped from plain tokens: only characters that LOOKS_LIKE does not read.
_ENDS = ".,;:?'\")\n"


def class_of(char: str) -> int:
    """0 for what is no letter, 1-26 for a-z, one of the rest for other letters."""
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 + ord(char) % (CLASSES - 27) if char.isalpha() else 0


_table: list[np.ndarray] = []


def _classes(text: str) -> np.ndarray:
    if not _table:
        _table.append(np.array([class_of(chr(c)) for c in range(0x250)], np.uint8))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = points >= 0x250
    out = _table[0][np.where(wide, 0, points)]
    if wide.any():
        out[wide] = [class_of(chr(c)) for c in points[wide]]
    return out


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(code, n) over all texts: each task adds up its own counts, then Spark adds those of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            joined = _classes("  ".join(t or "" for t in batch.column(0).to_pylist()).lower()).astype(np.int64)
            keep = np.concatenate([[True], (joined[1:] != 0) | (joined[:-1] != 0)]) if len(joined) else np.zeros(0, bool)
            x = np.concatenate([[0], joined[keep], [0]])
            total += np.bincount(x[:-2] * CLASSES * CLASSES + x[1:-1] * CLASSES + x[2:], minlength=CLASSES**3)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(total[codes], pa.int64())], names=["code", "n"])

    return docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: dict[int, int]) -> np.ndarray:
    """-ln P(third | first, second) for all triples of classes, interpolated with lower orders."""
    tri = np.zeros(CLASSES**3)
    for code, n in counts.items():
        tri[code] = n
    tri = tri.reshape(CLASSES, CLASSES, CLASSES)
    bi = tri.sum(axis=0)
    uni = bi.sum(axis=0)
    p1 = (uni + 1) / (uni.sum() + CLASSES)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3)


def _spelled(token: str) -> bool:
    """Whether letters alternate with one and the same sign, as in f*u*c*k."""
    return len(token) >= 5 and len(token) % 2 == 1 and len(set(token[1::2])) == 1 and token[1] in LOOKS_LIKE and token[::2].isalpha()


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each character or gap what it may be read as ('' is dropped), with costs."""
    token = _LONG.sub(r"\1\1\1", token)
    spaced, spelled = bool(SPACED.fullmatch(token)), _spelled(token)
    gaps = [m.span() for m in _GAP.finditer(token)] if spaced else []
    least = min((e - s for s, e in gaps), default=0)
    out = []
    first, last = len(token) - len(token.lstrip(BEFORE)), len(token.rstrip(BEHIND))
    wide = dict(gaps)
    k = 0
    while k < len(token):
        c = token[k]
        if k in wide:
            out.append([("", DROP), (" ", BREAK)] if wide[k] - k == least else [(" ", WIDE_BREAK), ("", WIDE_DROP)])
            k = wide[k]
            continue
        if c.isalpha():
            own = [(c, 0.0)]
            run = k > 0 and token[k - 1] == c
            if run:
                triple = (k > 1 and token[k - 2] == c) or (k + 1 < len(token) and token[k + 1] == c)
                own.append(("", DROP if triple else 4.0))
                if triple:
                    own[0] = (c, 2.0)
            out.append(own)
        else:
            own = [(x, READ) for x in LOOKS_LIKE.get(c, "")] + [(c, KEEP)]
            if (k > 0 and token[k - 1] == c) or (spelled and k % 2):
                own.append(("", DROP))
            elif k < first or k >= last:
                own.append(("", DROP if c == token[k + 1 : k + 2] else EDGE))
            out.append(own)
        k += 1
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The reading of the lattice with the least cost; states are the last two classes. Ties go to the reading listed first."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in readings(token.lower()):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, back) in best.items():
            for letter, price in options:
                if letter:
                    c = class_of(letter)
                    state, total = (b, c), cost + price + model[a, b, c]
                else:
                    state, total = (a, b), cost + price
                if state not in after or total < after[state][0]:
                    after[state] = (total, (back, letter))
        best = after
    _, back = min(((cost + model[a, b, 0], k), back) for k, ((a, b), (cost, back)) in enumerate(best.items()))
    out = []
    while back:
        back, letter = back
        out.append(letter)
    return "".join(reversed(out))


def suspect(run: str) -> bool:
    """Whether a run of letters and signs may be obfuscated: it has both, or a letter three times in a row."""
    if run.isalpha():
        return bool(_TRIPLE.search(run))
    return any(map(str.isalpha, run))


def _spread(spaced: str) -> bool:
    """Whether spaced-out characters are letters rather than numbers and signs."""
    letters = sum(map(str.isalpha, spaced))
    return letters >= 2 and 2 * letters >= len(_GAP.sub("", spaced))


_known: list[tuple[np.ndarray, Recent]] = []


def _decoded(model: np.ndarray) -> Recent:
    """decode() under ``model``, with what a worker has read lately."""
    if not _known or _known[0][0] is not model:
        _known[:] = [(model, Recent(lambda token: decode(token, model), REMEMBERED))]
    return _known[0][1]


def restore(text: str, model: np.ndarray) -> str:
    """The text in lower case with every suspect token replaced by its best reading.

    Cheap tests come first, as nearly all tokens are plain: words of letters alone are left out at once.
    """
    text = unicodedata.normalize("NFKC", text.lower())
    known = _decoded(model)
    spaced = SPACED.sub(lambda m: known[m[0]] if _spread(m[0]) else m[0], text)
    parts = spaced.split(" ")
    tripled = [3 * c for c in set(spaced) if c.isalpha() and 3 * c in spaced]
    for k, part in enumerate(parts):
        if (part.isalpha() or part.strip(_ENDS).isalpha()) and not (tripled and any(t in part for t in tripled)):
            continue
        parts[k] = RUN.sub(lambda m: known[m[0]] if suspect(m[0]) else m[0], part)
    return " ".join(parts)


def words_of(text: str) -> set[str]:
    parts = set(text.split(" "))
    words = {p for p in parts if p.isalpha()}
    return words.union(*map(WORDS.findall, parts - words))


def features(text: str) -> set[str]:
    words = words_of(text)
    return words | {w[:BEGINNING] + "-" for w in words if len(w) > BEGINNING}


def fit(sample: list[tuple[list[int], int]], n_features: int, rounds: int = 400, penalty: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic regression by full gradient steps (Adagrad); classes weigh by their shares. Same input, same weights."""
    y = np.array([label for _, label in sample], float)
    lengths = np.array([len(f) for f, _ in sample], np.int64)
    column = np.array([i for f, _ in sample for i in f], np.int64)
    row = np.repeat(np.arange(len(sample)), lengths)
    w, b = np.zeros(n_features), 0.0
    if not len(y) or y.min() == y.max():
        return w, (10.0 if len(y) and y.min() == 1 else -10.0)
    gw, gb = np.full(n_features, 1e-6), 1e-6
    for _ in range(rounds):
        z = np.bincount(row, w[column], len(y)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d = p - y
        g = np.bincount(column, d[row], n_features) + penalty * w
        gw += g * g
        w -= 0.5 * g / np.sqrt(gw)
        gb += d.sum() ** 2
        b -= 0.5 * d.sum() / np.sqrt(gb)
    return w, b


def held_out(doc_id: str) -> Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> tuple[np.ndarray, dict[str, float], float]:
    """Language model, weight of each feature, and intercept. Rows without a label teach nothing; of several labels of a document the highest counts, and of several texts the smallest."""
    spark = docs.sparkSession
    model = language_model(dict(count_trigrams(docs).collect()))  # CLASSES ** 3 rows at most
    table = spark.sparkContext.broadcast(model)
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(sample)
    )

    @F.pandas_udf("array<string>")
    def seen(texts):
        import pandas as pd

        return pd.Series([sorted(features(restore(t or "", table.value))) for t in texts])

    # One text for each chosen id, the smallest where an id repeats: what goes to the driver is bounded by ``sample``.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text"))
    rows = stash(texts.select("doc_id", "toxic", seen("text").alias("seen")))
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = rows.select("toxic", F.explode("seen").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).filter("n >= 3")
    # How far the toxic share of a feature's documents is from that of the sample, in standard deviations.
    share = positive / max(n, 1)
    far = F.abs(F.col("p") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    top = [r.feature for r in counts.filter(far >= FAR).orderBy(F.desc(far), "feature").limit(n_features).collect()]
    number = {f: k for k, f in enumerate(top)}
    known = F.array_intersect("seen", F.array(*map(F.lit, top)).cast("array<string>")) if top else F.array().cast("array<string>")
    kept = rows.select("doc_id", "toxic", known.alias("seen")).orderBy("doc_id", "toxic").collect()  # ``sample`` documents at most
    w, b = fit([([number[f] for f in r.seen], r.toxic) for r in kept], len(top))
    return model, {f: float(w[k]) for f, k in number.items() if abs(w[k]) > 1e-9}, float(b)


def score(docs: DataFrame, trained: tuple[np.ndarray, dict[str, float], float], text: str = "text", name: str = "score") -> DataFrame:
    """Add ``name``, the probability of being toxic by the whole restored text; null counts as empty."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column exists already: {name}")
    shared = docs.sparkSession.sparkContext.broadcast(trained)

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        model, weights, intercept = shared.value
        z = []
        for t in texts:
            words = words_of(restore(t or "", model))
            own = (words & weights.keys()) | ({w[:BEGINNING] + "-" for w in words if len(w) > BEGINNING} & weights.keys())
            z.append(intercept + sum(weights[f] for f in sorted(own)))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))

    return docs.withColumn(name, run(F.col(f"`{text}`")))


def predict(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **how))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
