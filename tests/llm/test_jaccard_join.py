import random

import numpy as np
import pytest

from tidewheel.llm import jaccard_join
from tidewheel.llm.components import components

SCHEMA = "doc_id long, text string, n int, _key string"


def shingles(t):
    w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    ids = [d for d, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def corpus(seed, n, edits):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            t = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(edits)):
                if t:
                    p = rng.randrange(len(t))
                    t[p : p + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
        else:
            t = [rng.choice(words) for _ in range(rng.randrange(90))]
            if kind > 0.7:
                t += passage
        rows.append((i, " ".join(t), 1, "x"))
    return rows


@pytest.mark.parametrize("short", [2, 64])
@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, monkeypatch, seed, short):
    """With lists of two already hot, nearly everything goes the way of hot lists, in small blocks."""
    rows = corpus(seed, 350, 9)
    if short == 2:
        lists = jaccard_join.inverted_lists
        monkeypatch.setattr(jaccard_join, "inverted_lists", lambda posted, partitions: lists(posted, partitions, 2))
        monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    got = jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edges(spark):
    rows = [(5, None, 1, "x"), (6, "", 1, "x"), (7, " \n", 1, "x"), (9, "A b", 1, "x"), (8, "a B", 1, "x"), (8, "a B", 1, "x"), (10, "a b c d e", 1, "x"), (11, "e d " * 30_000, 1, "x"), (12, "e d " * 29_000, 1, "x")]
    got = jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert jaccard_join.join(spark.createDataFrame([], SCHEMA)).collect() == []
    (one,) = jaccard_join.join(spark.createDataFrame([(None, "a b c d e f", 1, "x")], SCHEMA)).collect()
    assert tuple(one) == (None, 2, None)


def test_thresholds():
    """No linked pair shares fewer indexed shingles than the bound says."""
    rng = np.random.default_rng(3)
    for _ in range(4000):
        n = int(rng.integers(1, 120))
        a = rng.integers(-(2**63), 2**63, n)
        b = np.concatenate([a[: int(len(a) * rng.uniform(0.7, 1))], rng.integers(-(2**63), 2**63, int(rng.integers(0, n // 4 + 2)))])
        a, b = np.unique(a), np.unique(b)
        if not len(b) or 4 * len(np.intersect1d(a, b)) < 3 * len(np.union1d(a, b)):
            continue
        below = [int(np.searchsorted(x, jaccard_join._LIMIT)) for x in (a, b)]
        common = len(np.intersect1d(a[: jaccard_join.indexed(a)], b[: jaccard_join.indexed(b)]))
        assert common >= max(1, jaccard_join.needed(len(a), len(b)) - min(len(a) - below[0], len(b) - below[1]))
        if not jaccard_join.odd(len(b), below[1]):
            assert common >= jaccard_join.least_threshold(len(a), below[0])


def test_divide_skip():
    rng = random.Random(9)
    for _ in range(500):
        lists = [(rng.randrange(1, 4), sorted(rng.sample(range(30), rng.randrange(1, 25)))) for _ in range(rng.randrange(1, 9))]
        enough = rng.randrange(1, 9)
        want = {m: t for m in range(30) if m != 5 and (t := sum(w for w, x in lists if m in x)) >= enough}
        assert jaccard_join.divide_skip(5, lists, enough) == want


def test_links_among_like_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.integers(0, 500, 120)
        sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(1, 110))), rng.integers(0, 500, int(rng.integers(0, 9)))])) for _ in range(90)]
        links = jaccard_join.links_among(list(range(90)), sets)
        label = list(range(90))
        for a, b in links:
            assert 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))
            x, y = label[a], label[b]
            label = [y if v == x else v for v in label]
        for a in range(90):
            for b in range(a):
                assert label[a] == label[b] or 4 * len(np.intersect1d(sets[a], sets[b])) < 3 * len(np.union1d(sets[a], sets[b]))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(50)] + [(3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
