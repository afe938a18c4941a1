import hashlib
import random
from collections import Counter

import numpy as np

from tidewheel.llm import fingerprint
from tidewheel.llm.words import shingle_hashes, word_hashes

SCHEMA = "doc_id long, text string, fingerprint string, _range int"


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def test_words():
    texts = [b"", b"  The cat\tTHE\x0bdog ", b"x", "é É the".encode(), b"a b c d e f", b"a b c d e"]
    h, o = word_hashes(texts)
    assert np.diff(o).tolist() == [0, 4, 1, 3, 6, 5]
    assert h[0] == h[2] == h[7] and h[5] != h[6] and len(set(h.tolist())) == 4 + 1 + 2 - 1 - 0 + 6
    s, p = shingle_hashes(h, o, 5)
    assert np.diff(p).tolist() == [0, 1, 1, 1, 2, 1]
    assert s[3] == s[5] and len(set(s.tolist())) == 5
    assert shingle_hashes(*word_hashes([]), 5)[1].tolist() == [0]


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    gaps = []
    for _ in range(200):
        a = [rng.choice(words) for _ in range(80)]
        b = a[: rng.randrange(80)] + [rng.choice(words) for _ in range(40)]
        a, b = " ".join(a), " ".join(b)
        f = fingerprint.fingerprints([a.encode(), b.encode()])
        gaps.append(fingerprint.likeness(f[:1], f[1:])[0] - jaccard(a, b))
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.09


def test_edited_like_brute_force(spark):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choice(["the", "ça", "x", "yy"]) for _ in range(rng.randrange(40))), "c", 1) for i in range(300)]
    rows += [(1000, None, None, 1), (1001, "", "c", 1), (1002, "long word " * 20_000, "c", 1), (1003, rows[5][1], "c", 1)]
    want = {}
    order = sorted(rows, reverse=True)
    for k, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[d] = (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in fingerprint.digests(df).collect()}
    assert {d: (r.n_chars, r.edited_sha256) for d, r in got.items()} == want
    assert got[1003].fingerprint == got[15].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert got[1000].fingerprint == "" and got[1001].near_next == 1


def test_edges(spark):
    assert fingerprint.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    (one,) = fingerprint.digests(spark.createDataFrame([(7, "abcd", "", 1)], SCHEMA)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    rows = [(None, "a b", "", 1), (5, "c d", "", 1), (5, "c d", "", 1), (None, None, "", 1)]
    assert len(fingerprint.digests(spark.createDataFrame(rows, SCHEMA)).collect()) == 4
    assert fingerprint.fingerprint(spark.createDataFrame(rows, SCHEMA), name="fp").count() == 4
