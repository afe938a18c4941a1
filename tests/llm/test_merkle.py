import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import merkle
from tidewheel.llm.numbering import number

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, _h string, _i int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(nodes, fanout):
    """Levels of a tree, from the leaves up."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def path(tree, i, fanout):
    steps = []
    for level in tree[:-1]:
        run = level[i // fanout * fanout : i // fanout * fanout + fanout]
        steps.append((run[: i % fanout], run[i % fanout + 1 :]))
        i //= fanout
    return steps


def brute(rows, fanout=16):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]], fanout)
    top = climb([trees[s][-1][0] for s in names], fanout)
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            steps = path(trees[s], i, fanout) + path(top, j, fanout)
            touched = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if touched else leaf(r)
            for left, right in steps:
                now = h(*left, now, *right)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*[x for left, right in steps for x in left + right]), now, now == root))
    return sorted(out, key=str)


def table(seed, n, sources):
    rng = random.Random(seed)
    rows = [(i * 3, rng.choice(sources), rng.choice(["en", None, "é"]), rng.choice([None, i]), rng.choice([None, "", "abc é", "Text With Capitals " * rng.randrange(3)]), "x", 1) for i in range(n)]
    return rows


def test_against_brute_force(spark):
    rows = table(1, 700, ["hot"] * 8 + ["b", "Z", "é", "😀", None, ""]) + [(None, "b", None, None, None, "x", 1), (7, "only", "en", 1, "A" * 100_000, "x", 1)]
    rows += [rows[5]] * 40 + [(rows[9][0], rows[9][1], "xx", 1, "Another", "x", 1)]
    rng = random.Random(2)
    rng.shuffle(rows)
    got = merkle.verified(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert 0 < sum(r.verified for r in got) < len(got)


def test_many_sources_and_one_row(spark):
    rows = table(3, 60, [f"s{k}" for k in range(40)])
    assert sorted(map(tuple, merkle.verified(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    one = rows[:1]
    assert sorted(map(tuple, merkle.verified(spark.createDataFrame(one, SCHEMA)).collect()), key=str) == brute(one)
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("fanout", [2, 3])
def test_other_fanouts(spark, fanout):
    rows = table(4, 50, ["a", "b", "c", None])
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout)
    got = got.select("doc_id", F.lower(F.hex("_root")).alias("root"), merkle.folded(F.lower(F.hex("_leaf")), F.col("_path")).alias("back"), F.sha2(merkle.proof(F.col("_path")), 256).alias("proof")).collect()
    want = {r[0]: r for r in brute(rows, fanout)}
    assert all(r.root == r.back == want[r.doc_id][3] and r.proof == want[r.doc_id][4] for r in got) and len(got) == 50


def test_numbers_of_a_hot_key(spark):
    rows = [("hot", k % 50) for k in range(5000)] + [(s, k) for s in "abc" for k in range(7)]
    got = number(spark.createDataFrame(rows, "k string, v int").repartition(6), ["k"], ["v"], 8).collect()
    for key in "hot", "a", "b", "c":
        own = sorted((r._i, r.v) for r in got if r.k == key)
        assert [i for i, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
