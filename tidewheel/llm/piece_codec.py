"""SentencePiece encoding and decoding with a merge-type prefix table.

A BPE encoding is correct exactly if each adjacent pair of its tokens is compatible, that is, if
encoding the two tokens' joined text gives the same two tokens. So every prefix of a text has one
possible last token. The encoder runs an Aho-Corasick automaton of all pieces over a text, stores that
token for each prefix (a match whose left neighbour, the last token of the shorter prefix, is
compatible), and reads the ids off backwards from the end.

Texts are cut before each run of blanks, which no merge crosses, and words between letters and other
signs where no piece of the model has both. What a worker has cut lately is remembered in tables of bounded size.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Recent

BLANK = "▁"
#: Entries of each table that a worker remembers before it keeps only those that it meets again.
REMEMBERED = 100_000
#: Texts of more characters are cut one piece after another, so that their words are never all there at once.
AT_ONCE = 1_000_000
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
PARTS = re.compile(f"{BLANK}*[{LETTER}]+|{BLANK}*[^{LETTER}{BLANK}]+|{BLANK}+")
#: A model whose ids of these texts differ from the library's is refused.
PROBES = ("", " ", "a", "  two  blanks  ", "Ａ ﬁ ² ½ é", "word, word. (word)\n\tword", "1234 56.7", "naïve – 漢字 🙂 \x00", "            ", "tokenization of internationalisation", "a\u2581b")


class Vocabulary(NamedTuple):
    """Pieces by id, with scores; ``first_byte`` is the id of the piece for byte 0."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    special: frozenset[int]
    first_byte: int


def load_vocabulary(path: str) -> Vocabulary:
    """Read pieces and scores of a BPE model with byte fallback from ``path`` on the driver.

    A ValueError tells of a model that this codec does not encode as the library does: other types than BPE, a
    normaliser, no blank put before the text, or pieces with a blank behind another character.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = frozenset(i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
    first_byte = next((i for i in ids if model.is_byte(i)), -1)
    if first_byte < 0:
        raise ValueError("the model has no byte pieces")
    found = Vocabulary(tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), special, first_byte)
    if odd := [p for i, p in enumerate(found.pieces) if i not in special and BLANK in p.strip(BLANK)]:
        raise ValueError(f"pieces with blanks inside: {odd[:3]}")
    codec = Codec(found)
    for text in PROBES:
        own = codec.encode(text)
        if own.tolist() != model.encode(text) or codec.decode(own.tolist()) != model.decode(model.encode(text)):
            raise ValueError(f"the library encodes {text!r} in another way: no BPE model, or one with a normaliser")
    return found


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.pieces, self.scores, special, self.first_byte = vocabulary
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if piece.strip(BLANK) or len(piece) == 1:  # longer runs of blanks share a score: see blanks()
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.whole = Recent(lambda token: len(self.merged(self.pieces[token])) == 1, REMEMBERED)
        self.pairs = Recent(self.compatible, 2 * REMEMBERED)
        self.runs = Recent(self.blanks, 1000)
        self.known = Recent(self.cut, REMEMBERED)
        #: Words are cut between letters and other signs if no piece has both.
        self.cuts = PARTS if all(len(PARTS.findall(piece)) == 1 for piece in self.ids) else WORDS
        self.texts = plain_texts(vocabulary)

    def merged(self, text: str) -> list[str]:
        """Merge best score first, the leftmost among equals; for the short texts of the tests of pairs and for runs of blanks."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, pair: int) -> bool:
        """Whether the two tokens' joined text gives the same two tokens; ``pair`` has one in its upper bits, one in its lower 24."""
        left, right = self.pieces[pair >> 24], self.pieces[pair & 0xFFFFFF]
        return self.merged(left + right) == [left, right]

    def prefix_table(self, text: str) -> list[int]:
        """The last token of each prefix; -1 where there is none. Entry 0 stands for the empty prefix."""
        last = [-1] * (len(text) + 1)
        pairs = self.pairs
        for end, (length, token) in self.automaton.iter(text):
            if last[end + 1] < 0:
                start = end + 1 - length
                if start:
                    before = last[start]
                    if before >= 0 and pairs[before << 24 | token]:
                        last[end + 1] = token
                elif self.whole[token]:
                    last[end + 1] = token
        return last

    def segment(self, text: str) -> list[int]:
        """Ids of a text without runs of blanks; characters that no piece has become byte pieces."""
        last = self.prefix_table(text)
        if last[-1] < 0:  # some character has no piece: it stands alone, what is around it merges apart
            lone = next((k for k, c in enumerate(text) if c not in self.ids), None)
            if lone is None:
                raise ValueError("a piece's character is not itself a piece")
            left = self.segment(text[:lone]) if lone else []
            right = self.segment(text[lone + 1 :]) if lone + 1 < len(text) else []
            return left + [self.first_byte + b for b in text[lone].encode()] + right
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= len(self.pieces[last[at]])
        return ids[::-1]

    def blanks(self, n: int) -> tuple[int, ...]:
        """Ids of n blanks: their pieces share one score, so the leftmost pair merges first."""
        lengths: list[int] = []
        for _ in range(n):
            lengths.append(1)
            while len(lengths) > 1 and BLANK * (lengths[-1] + lengths[-2]) in self.ids:
                lengths[-2:] = [lengths[-1] + lengths[-2]]
        return tuple(self.ids[BLANK * k] for k in lengths)

    def cut(self, text: str) -> bytes:
        """Ids of a run of blanks and what stands behind it, as int32."""
        word = text.lstrip(BLANK)
        n = len(text) - len(word)
        if not word:
            ids = self.runs[n]
        else:
            ids = self.long(BLANK + word if n else word)  # every other merge goes before those of blanks alone
            if n > 1:
                ids = [*self.runs[n], *ids[1:]] if ids[0] == self.ids[BLANK] else [*self.runs[n - 1], *ids]
        return array("i", ids).tobytes()

    def long(self, text: str) -> list[int]:
        """segment() without recursion: first cut at the characters that have no piece."""
        if len(text) < 64:
            return self.segment(text)
        ids, start = [], 0
        for k, c in enumerate(text):
            if c not in self.ids:
                ids += self.segment(text[start:k]) if k > start else []
                ids += [self.first_byte + b for b in c.encode()]
                start = k + 1
        return ids + (self.segment(text[start:]) if start < len(text) else [])

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = BLANK + text.replace(" ", BLANK)
        known = self.known
        if len(text) <= AT_ONCE:
            return np.frombuffer(b"".join(map(known.__getitem__, self.cuts.findall(text))), np.int32)
        ids = bytearray()
        for m in self.cuts.finditer(text):
            ids += known[m[0]]
        return np.frombuffer(ids, np.int32)

    def decode(self, ids: list[int]) -> str:
        return text_of(ids, self.texts, self.first_byte)


def plain_texts(vocabulary: Vocabulary) -> list[str]:
    """What each id but those of bytes stands for."""
    texts = ["" if i in vocabulary.special else p.replace(BLANK, " ") for i, p in enumerate(vocabulary.pieces)]
    if vocabulary.pieces[0] == "<unk>":
        texts[0] = " ⁇ "
    return texts


def text_of(ids: list[int], texts: list[str], first_byte: int) -> str:
    out: list[str] = []
    raw = bytearray()
    for i in ids:
        if first_byte <= i < first_byte + 256:
            raw.append(i - first_byte)
            continue
        if raw:
            out.append(raw.decode(errors="replace"))
            raw.clear()
        out.append(texts[i])
    if raw:
        out.append(raw.decode(errors="replace"))
    text = "".join(out)
    return text[1:] if text[:1] == " " else text


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each worker process and vocabulary, with what it has learnt."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(shared.value)
    return _codecs[shared.id]


class _Shared(NamedTuple):
    id: str
    broadcast: object

    @property
    def value(self):
        return self.broadcast.value


_sent: dict[tuple[str, str], _Shared] = {}


def share(spark: SparkSession, path: str) -> _Shared:
    """Broadcast the vocabulary: its size is that of the model file, whatever the corpus."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        _sent[key] = _Shared(f"{key}", spark.sparkContext.broadcast(load_vocabulary(path)))
    return _sent[key]


def _free(df: DataFrame, *names: str) -> None:
    """New columns must not clash with those of the input (case is ignored, as Spark does)."""
    clash = {n.lower() for n in names} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")


def _ids_of(texts: pa.Array, codec: Codec) -> pa.Array:
    """The ids of each text of a batch, as an Arrow list."""
    parts, ends = [], [0]
    for value in texts:
        own = codec.encode(value.as_py())
        parts.append(own)
        ends.append(ends[-1] + len(own))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _texts_of(ids: pa.Array, texts: list[str], first_byte: int) -> pa.Array:
    """The text of each list of ids; a null list is empty."""
    out = []
    for value in ids:
        own = np.zeros(0, np.int32) if not value.is_valid else value.values.to_numpy(zero_copy_only=False)
        if own.size and ((own >= first_byte) & (own < first_byte + 256)).any():
            out.append(text_of(own.tolist(), texts, first_byte))
        else:
            joined = "".join([texts[i] for i in own.tolist()])
            out.append(joined[1:] if joined[:1] == " " else joined)
    return pa.array(out, pa.string())


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Replace column ``text`` by ``ids`` (array<int>), the tokens of the whole text, and add ``decoded`` if named: their text.

    A null or empty text has no tokens, and an empty text of them. Other columns are kept; if one is called like a new one, a
    ValueError says so. One Python worker does both ways, so a task holds one copy of the tables.
    """
    kept = df.drop(text)
    names = [ids] if decoded is None else [ids, decoded]
    _free(kept, *names)
    shared = share(df.sparkSession, model)
    others = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            new = [_ids_of(batch.column(batch.num_columns - 1), codec)]
            if decoded is not None:
                new.append(_texts_of(new[0], codec.texts, codec.first_byte))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *names])

    types = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + [T.StructField(n, T.StringType()) for n in names[1:]]
    return df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`")).mapInArrow(run, T.StructType([*kept.schema.fields, *types]))


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the text of the tokens in ``ids``; null ids give an empty text. Only the pieces' texts are held, no automaton."""
    _free(df, text)
    shared = share(df.sparkSession, model)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        texts = plain_texts(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts_of(batch.column(at), texts, vocabulary.first_byte)], names=[*batch.schema.names, text])

    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    return df.mapInArrow(run, schema)


def digests(df: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, from the real ids and decoded texts."""
    both = encode(df.select("doc_id", "text"), model, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
