import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidewheel.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, conv string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    for c in own:
        own[c] = [t[3:] for t in sorted(own[c])]
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        new = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(new) + 1):
            members[tuple(new[:d])].append(c)
        ends[tuple(new)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha))
    return sorted(out, key=str)


def table(seed, convs, texts, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            rows.append((c * rng.choice([1, 1, 1, 3]), rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(texts), 1, "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "ROWS", 60)  # so that conversations, families and runs go over several tasks
    rows = table(seed, 60, ["", None, "é", "hello", "bye 😀"] if seed == 1 else [f"t{k}" for k in range(3)], 14)
    if seed == 1:
        rows += [(500, t, "user", "hot", 1, "x") for t in range(300)] + [(501, t, "user", "hot", 1, "x") for t in range(300)] + [(502, None, "user", "same", 1, "x")] * 150
    rows += [(-3, 0, "a", "negative", 1, "x"), (-10, 4, "a", "n", 1, "x"), (None, 1, "a", "no id", 1, "x"), (997, 0, "a", "absent base", 1, "x")]
    random.Random(3).shuffle(rows)
    got = trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_equal_conversations_and_empty(spark):
    rows = [(c, t, "u", f"t{t}", 1, "") for c in range(400) for t in range(3)]
    got = trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
