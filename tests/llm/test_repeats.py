import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewheel.llm import repeats

SCHEMA = "doc_id long, text string, id int, same string"


def brute(rows):
    first = {}
    for d, t, *_ in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            g = raw[s : s + 50]
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < d:
                gone[s : s + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "naïve", "and", "a", "x", "tion", "re", "日本"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randrange(8, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            t = rng.choice(rows)[1]
        elif rows and kind < 0.35:
            t = rng.choice(rows)[1]
            p = rng.randrange(len(t) + 1)
            t = t[:p] + rng.choice(["", "!", "zz"]) + t[p + rng.randrange(3) :]
        else:
            t = " ".join([text(rng.randrange(40))] + [rng.choice(passages), text(rng.randrange(20))] * rng.randrange(3))
        rows.append((rng.randrange(10**6) * 1000 + i, t, 1, "x"))
    return rows


@pytest.mark.parametrize(("seed", "windows"), [(1, 60_000), (2, 40), (3, 7)])
def test_like_brute_force(spark, monkeypatch, seed, windows):
    monkeypatch.setattr(repeats, "WINDOWS", windows)
    rows = corpus(seed, 250)
    got = repeats.remove(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edges(spark):
    long = "ab " * 30_000
    rows = [(1, None, 1, "x"), (2, "", 1, "x"), (3, "short", 1, "x"), (4, "short", 1, "x"), (9, long, 1, "x"), (8, long, 1, "x"), (7, "q" * 50, 1, "x"), (10, "q" * 49, 1, "x"), (11, "z" + "q" * 51, 1, "x"), (12, "a" * 300, 1, "x"), (12, "a" * 300, 1, "x"), (12, "b" * 60 + "a" * 99, 1, "x"), (13, "b" * 60, 1, "x")]
    got = repeats.remove(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert repeats.remove(spark.createDataFrame([], SCHEMA)).collect() == []
    got = repeats.remove(spark.createDataFrame([(None, "k" * 60, 1, "x"), (5, "k" * 60, 1, "x")], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 60), (True, 0)]


def test_construction_like_brute_force():
    rng = np.random.default_rng(2)
    n = 120
    windows = rng.integers(97, 99, (repeats.WIDTH, n)).astype(np.uint16)
    windows[:, n // 2 :] = windows[:, : n // 2]
    flips = rng.integers(0, repeats.WIDTH, n)
    windows[flips, np.arange(n)] = 120
    windows[:5, ::3] = 256
    docs = rng.permutation(n)
    got = repeats.repeated(windows, docs)
    for s in range(repeats.PLACES):
        own = [bytes(c.astype(np.uint8)) if (c < 256).all() else None for c in windows[s : s + 50].T]
        for i in range(n):
            assert got[s, i] == (own[i] is not None and any(own[j] == own[i] and docs[j] < docs[i] for j in range(n)))


def test_hot_anchors_are_split_like_brute_force(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz "
    noise = lambda k: "".join(rng.choice(letters) for _ in range(k))
    phrase = "a phrase of some forty bytes, all documents"
    edges = [noise(40) for _ in range(8)]
    rows = [(i * 7919 % 1009, f"{noise(30)}{rng.choice(edges)}{phrase}{rng.choice(edges)}{noise(30)}" if i % 3 else f"{noise(60)}{phrase}{noise(60)}", 1, "x") for i in range(300)]
    rows += corpus(5, 60)
    for hot in (0, 40):
        got = repeats.remove(spark.createDataFrame(rows, SCHEMA), hot_windows=hot).collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_hot_anchor_is_not_carried_on(monkeypatch):
    sizes, real = [], repeats.repeated
    monkeypatch.setattr(repeats, "WINDOWS", 400)
    monkeypatch.setattr(repeats, "repeated", lambda windows, docs: sizes.append(windows.shape[1]) or real(windows, docs))
    rng = random.Random(1)
    n = 100  # a batch; every window has strings that no other has
    names = ["h", "id", "same", "at", "shift", "bytes", "hot"]
    window = lambda: bytes(rng.randrange(256) for _ in range(26)) + b"x" * 24 + bytes(rng.randrange(256) for _ in range(26))
    columns = lambda k: [[1] * n, list(range(k * n, (k + 1) * n)), [0] * n, [0] * n, [26] * n, [window() for _ in range(n)], [True] * n]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.binary(), pa.bool_()]
    batches = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns(k), types, strict=True)], names=names) for k in range(20))
    out = list(repeats._build(batches))
    assert max(sizes) <= 500 and sum(sizes) == 20 * n
    assert sum(b.num_rows for b in out) == 20 * n * 27
