"""Personal data and secrets: base patterns, and bootstrapped contextual extraction of what they miss.

One pass over the texts finds the base entities (email, ip, card, phone), values assigned to a name that tells a secret, and beside them candidates:
runs of tokens with digits or an at sign that are none of these. All alike are instances that stand in lexical patterns:
the three words before, the two words before, and the word before with the word after.

Entities and secrets are seeds. Spark then scores the graph of patterns and instances in a few rounds. A
pattern's confidence for a kind is the mean score of its distinct instances, damped by one; it must hold
``min_support`` known instances of the kind. A candidate's score is one minus the product of (1 - confidence) over its
accepted patterns, so candidates that reach ``min_score`` count as known in the next round and induce new
patterns. All their occurrences become spans of that kind. Base spans always stay; secrets are spans that the method adds. Scores are rounded
before they are compared, so the order of sums decides nothing.

An instance of more than ``LONGEST`` characters is named by its beginning and a digest, and of a longer context word the nearest ``LONGEST``
characters count, so keys have a bounded size. A run of candidate tokens is cut at known spans and after each ``TOKENS`` tokens. A text's words are
found once, so work is linear in the text also where it has no blanks.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: Fixed values, in the contract's order.
KINDS = ("email", "ip", "card", "phone")
#: A kind that the contract's list does not have; its spans are added ones.
SECRET = 4
NAMES = (*KINDS, "secret")
ROUNDS = 3
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.7
MIN_SCORE = 0.8
LONGEST, TOKENS = 64, 8

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match never starts inside a run of digits: what fails at the run's first digit fails at the others too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ASSIGNED = re.compile(r"[:=]")
_VALUE = re.compile(r"[\x20\t]{0,3}[\"']?([^\s\"',;<>]{8,128})")
#: Ends of names, without signs, whose values are secrets.
_SECRET_NAMES = ("token", "secret", "passwd", "password", "apikey", "accesskey")
_DIGIT = re.compile("[0-9]")
_MARK = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")
_WORD = re.compile(r"\S+")
_EDGE = "\"'.,;:!?()[]{}<>="


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at sign: the run of local characters before it, and the domain after it. Linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        else:
            end = max(end, at + 1)  # an at sign ends any later run of local characters
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every base entity, in that order; code points, end exclusive."""
    spans = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if not _MARK.search(text):
        return spans
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans)


def secret_spans(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Values that are assigned to a name that tells a secret, as spans like ``base_spans`` gives; none that meets one of ``spans``."""
    out, k, last = [], 0, 0
    for sign in _ASSIGNED.finditer(text):
        at = sign.start()
        if at < last:
            continue
        name = text[max(0, at - 24) : at].rstrip("\x20\t\"'").lower().replace("_", "").replace("-", "")
        if not name.endswith(_SECRET_NAMES) or not (m := _VALUE.match(text, at + 1)):
            continue
        start, end = m.span(1)
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        if not any(s < end and e > start for s, _, e in spans[k : k + 4]):
            out.append((start, SECRET, end))
            last = end
    return out


def _named(text: str) -> str:
    """The text itself, or for a long one its beginning and a digest."""
    return text if len(text) <= LONGEST else f"{text[:16]}~{hashlib.md5(text.encode('utf-8', 'surrogatepass')).hexdigest()}"


class _Context:
    """The words of a text, found once, for the words around any place of it. Of a word longer than ``LONGEST`` characters the nearest ones count."""

    def __init__(self, text: str):
        self.text = text
        bounds = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [s for s, _ in bounds], [e for _, e in bounds]

    def before(self, start: int, n: int) -> list[str]:
        """The ``n`` words before a place, nearest last, fewer at the text's start; the first may be the part of a word that ends there."""
        i, out = bisect_left(self.starts, start) - 1, []
        while i >= 0 and len(out) < n:
            end = min(self.ends[i], start)
            out.append(_plain(self.text[max(self.starts[i], end - LONGEST) : end]))
            i -= 1
        return out[::-1]

    def after(self, end: int) -> str:
        i = bisect_right(self.ends, end)
        if i == len(self.ends):
            return ""
        start = max(self.starts[i], end)
        return _plain(self.text[start : min(self.ends[i], start + LONGEST)].rstrip(".,;:!?"))


def _plain(word: str) -> str:
    return _DIGIT.sub("0", word.lower())


def patterns(context: _Context, start: int, end: int) -> list[str]:
    """The lexical patterns that an instance stands in: three words before, two, and the word before with the word after."""
    words, after = context.before(start, 3), context.after(end)
    out = [" ".join([*words[-n:], "_"]) for n in (3, 2) if len(words) >= n]
    return out + ([f"{words[-1]} _ {after}"] if words and after else [])


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of neighbouring tokens with a digit or an at sign, less all ``spans`` and the punctuation around what is left."""
    runs: list[list[int]] = []
    tokens = 0
    m = _MARK.search(text)
    while m:
        at = m.start()
        stop = _BLANK.search(text, at)
        end = stop.start() if stop else len(text)
        # back to the token's start, never before the token handled last
        start, low = at, runs[-1][1] if runs else 0
        while start > low and not text[start - 1].isspace():
            start -= 1
        if runs and tokens < TOKENS and start - runs[-1][1] == 1 and text[start - 1] == " ":
            runs[-1][1] = end
            tokens += 1
        else:
            runs.append([start, end])
            tokens = 1
        m = _MARK.search(text, end)
    free, k = [], 0
    for start, end in runs:
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        pieces, j = [], k
        while j < len(spans) and spans[j][0] < end:
            pieces.append((start, spans[j][0]))
            start = max(start, spans[j][2])
            j += 1
        for s, e in [*pieces, (start, end)]:
            own = text[s:e] if s < e else ""
            s += len(own) - len(own.lstrip(_EDGE + " "))
            own = own.strip(_EDGE + " ")
            if len(own) >= 5 and _MARK.search(own):
                free.append((s, s + len(own)))
    return free


FOUND = "_id long, _same long, doc_id long, base array<struct<start:long,kind:int,end:long>>, seen array<struct<start:long,end:long,kind:int,instance:string,patterns:array<string>>>"


def find(docs: DataFrame) -> DataFrame:
    """The base spans of each row, and every instance with its patterns (kind -1: a candidate). Stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        seen_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
        for batch in batches:
            base, seen = [], []
            for text in batch.column(3).to_pylist():
                text = text or ""
                spans = base_spans(text)
                known = sorted(spans + secret_spans(text, spans))
                places = [(s, e, k) for s, k, e in known]
                if known or _MARK.search(text):
                    places += [(s, e, -1) for s, e in candidates(text, known)]
                context = _Context(text) if places else None
                own = [{"start": s, "end": e, "kind": k, "instance": _named(text[s:e].lower()), "patterns": patterns(context, s, e)} for s, e, k in places]
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                seen.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(base, span), pa.array(seen, seen_type)], names=["_id", "_same", "doc_id", "base", "seen"])

    row = [F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_same")]
    return stash(docs.select(*row, "doc_id", "text").mapInArrow(run, FOUND))


def bootstrap(found: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> DataFrame:
    """(instance, kind) of the candidates that the scored graph takes for entities; ties go to the first kind listed.

    ``found`` is as of ``find``. An edge counts once, however many rows hold it; instances without patterns, as of texts of one
    word, are never taken, and an empty table gives none.
    """
    seen = found.select(F.explode("seen").alias("s")).select("s.instance", "s.kind", F.explode("s.patterns").alias("pattern"))
    # One edge for each pair, however often it occurs: the aggregate combines before the shuffle.
    edges = stash(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    known = edges.filter("kind >= 0").select("instance", "kind").distinct().select("instance", "kind", F.lit(1.0).alias("score"))
    taken = None
    for _ in range(rounds):
        scored = edges.select("pattern", "instance").join(known, "instance")
        sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        patterns = (
            scored.groupBy("pattern", "kind")
            .agg(F.sum("score").alias("sum"), F.count("*").alias("support"))
            .filter(F.col("support") >= min_support)
            .join(sizes, "pattern")
            .withColumn("confidence", F.round(F.col("sum") / (F.col("n") + 1), 9))
            .filter(F.col("confidence") >= min_confidence)
            .select("pattern", F.col("kind").alias("_kind"), "confidence")
        )
        votes = edges.filter("kind < 0").select("pattern", "instance").join(patterns, "pattern")
        scores = votes.groupBy("instance", "_kind").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("confidence")))), 9).alias("score")).filter(F.col("score") >= min_score)
        best = scores.groupBy("instance").agg(F.max_by(F.struct(F.col("_kind").alias("kind"), "score"), F.struct("score", -F.col("_kind"))).alias("b"))
        taken = stash(best.select("instance", "b.kind", "b.score"))
        known = edges.filter("kind >= 0").select("instance", "kind").distinct().select("instance", "kind", F.lit(1.0).alias("score")).unionByName(taken)
    return taken.select("instance", "kind")


def extract(docs: DataFrame, **how) -> DataFrame:
    """doc_id, base and all spans (arrays of start, kind number, end) of each row of ``docs`` (doc_id, text).

    A null text counts as empty and has no spans. Rows that share id and text get the same spans.
    """
    found = find(docs)
    new = bootstrap(found, **how)
    places = found.select("_id", "_same", F.explode("seen").alias("s")).select("_id", "_same", "s.start", "s.end", "s.instance", "s.kind")
    own = ["_id", "_same", "start", "kind", "end"]
    more = (
        places.filter("kind < 0").drop("kind").join(new, "instance").select(*own)
        .unionByName(places.filter(f"kind = {SECRET}").select(*own))
        .groupBy("_id", "_same")
        .agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return found.join(more, ["_id", "_same"], "left").select("_id", "_same", "doc_id", "base", F.sort_array(F.concat("base", F.coalesce("more", none))).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and the number and text of all spans, of each row; a null text is empty, repeated rows get the same result."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return extract(docs).select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or group of overlapping spans, becomes the name of its first kind in angle brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"<{NAMES[kind].upper()}>"]
        at, k = end, k + 1
    return "".join(out) + text[at:]
