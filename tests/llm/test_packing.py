import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewheel.llm import packing
from tidewheel.llm.queries import word_tokenizer

SCHEMA = "doc_id long, text string, source string, ids int, _queue string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_tokenizer())


def served(queues, shares, length, chunk):
    """Deficit round-robin, a round at a time: the stream of (source, token of its queue)."""
    quanta = [max(1, round(s / max(sum(shares), 1e-300) * length * packing.UNIT)) for s in shares]
    credit, done, out = [0] * len(queues), [0] * len(queues), []
    while any(d < q for d, q in zip(done, queues, strict=True)):
        for s, total in enumerate(queues):
            credit[s] += quanta[s]
            n = credit[s] // (packing.UNIT * chunk)
            credit[s] -= n * packing.UNIT * chunk
            for _ in range(min(n * chunk, total - done[s])):
                out.append((s, done[s]))
                done[s] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_closed_form_is_deficit_round_robin(seed):
    rng = random.Random(seed)
    length, chunk = rng.choice([(64, 4), (32, 8), (128, 1)])
    lengths = [[rng.randrange(1, 200) for _ in range(rng.randrange(1, 15))] for _ in range(rng.randrange(1, 6))]
    queues = [sum(q) for q in lengths]
    shares = [float(q) for q in queues] if seed % 2 else [rng.randrange(1, 50) for _ in queues]
    want = served(queues, shares, length, chunk)
    rounds = packing.Rounds(queues, shares, length, chunk)
    flat = [(s, sum(q[:k]), n) for s, q in enumerate(lengths) for k, n in enumerate(q)]
    queue, first, size = (np.array(c) for c in zip(*flat, strict=True))
    got = {}
    for d, start, n, sequence, offset in zip(*rounds.pieces(queue, first, size), strict=True):
        for t in range(n):
            got[int(sequence), int(offset + t)] = (int(queue[d]), int(first[d] + start + t))
    ends = [*range(0, len(want) - len(want) % length, length), *rounds.tail.tolist()]
    places = [(k, p - a) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) for p in range(a, b)] if len(ends) > 1 else []
    assert len(got) == len(want) and [got[p] for p in places] == want


def table(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "don't", "Été", "naïve", "x9y", "$$%", "中文字", "😀", "İstanbul", "ΣΑΣ", "‍", "á"]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(400))), rng.choice(["hot"] * 6 + ["b", "c", None]), 1, "x") for k in range(n)]


def test_every_token_once_and_mixture(spark, library):
    rows = table(1, 300) + [(900, None, "b", 1, ""), (901, "", None, 1, ""), (None, "no id", "hot", 1, ""), (902, "long " * 40_000, "hot", 1, ""), (903, "y" * 20_000, "b", 1, "")] + [(905, "same row", "c", 1, "")] * 9
    rows += [(906, "a <|endoftext|> b", "c", 1, "")]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), word_tokenizer()).collect()
    want = Counter()
    for r in rows:
        want[(r[0], np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        sequences[p.sequence_id].append(p)
        documents[p.doc_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
    assert sorted(sequences) == list(range(len(sequences)))
    lengths = [sum(p.length for p in sequences[k]) for k in sorted(sequences)]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in lengths)
    total = Counter()
    for own in documents.values():
        for p in own:
            total[p.source] += p.length
    for key, n in want.items():
        own = sorted((p.start, p.ids) for p in documents[key[0]])
        assert len(own) >= n and (n > 1 or b"".join(bytes(i) for _, i in own) == key[1])
    assert sum(total.values()) == sum(len(i) // 4 * n for (_, i), n in want.items())
    for k, n in enumerate(lengths):
        if n == 4096 and k:
            share = Counter()
            for p in sequences[k]:
                share[p.source] += p.length
            assert all(abs(share[s] - 4096 * total[s] / sum(total.values())) <= 3 * packing.CHUNK for s in total)


def test_ids_of_single_texts(library):
    encoder = packing.Encoder(word_tokenizer())
    rng = random.Random(4)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0x3000), rng.randrange(0x1F000, 0x1FFFF), rng.randrange(0xD7FF)])) for _ in range(30)) for _ in range(1500)]
    texts += ["", "\x1c\x1f \x85 ", "İI", "ΑΣ Σ", "it's 'S 'ſ don''t", "<|startoftext|>x", "À́", "ﬀ ß ẞ"]
    for t in texts:
        assert encoder.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert all(0 < len(p.known) - len(p.refused) for p in encoder.patterns) and encoder.patterns[0].refused


def test_targets_and_empty(spark):
    rows = [(k, "word " * 3000, "ab"[k % 2], 1, "") for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = Counter()
    for p in packing.pack(df, word_tokenizer(), targets={"a": 3, "b": 1}).filter("sequence_id < 7").collect():
        first[p.source] += p.length
    assert abs(first["a"] - 3 * 7 * 1024) <= 2 * packing.CHUNK
    assert packing.pack(spark.createDataFrame([], SCHEMA), word_tokenizer()).collect() == []
    one = packing.digests(spark.createDataFrame([(1, None, None, 1, "")], SCHEMA), word_tokenizer()).collect()
    assert [tuple(r) for r in one] == [(1, 0, 1, zlib.crc32(b"\x02\0\0\0"), 1, 0, 0)]
