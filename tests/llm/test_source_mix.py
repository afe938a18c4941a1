import hashlib
import random
from collections import Counter

from tidewheel.llm import source_mix

SCHEMA = "doc_id long, text string, source string, size int, _left string"


def water(sizes, weights, most):
    """Share by weight, stop at the limit, share the excess again."""
    total, target = sum(sizes), [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(total)
    while free:
        share = left / sum(weights[i] for i in free)
        over = {i for i in free if share * weights[i] > most * sizes[i]}
        if not over:
            for i in free:
                target[i] = share * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        free -= over
    return target


def test_targets_and_taken(spark):
    rng = random.Random(3)
    sources = ["a", "b", "z", "é", None]
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 80))), rng.choice(sources[:3] if i % 7 else sources), 1, "x") for i in range(900)]
    got = source_mix.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    size = {s: sum(len(t.split()) for _, t, o, _, _ in rows if o == s) for s in sources}
    want = dict(zip(sources, water([size[s] for s in sources], [5, 2, 1, 5, 2], 3), strict=True))
    of = {r[0]: r[2] for r in rows}
    for s in sources:
        own = [r for r in got if of[r.doc_id] == s]
        assert {round(r.target, 6) for r in own} == {round(want[s], 6)}
        assert {r.source_size for r in own} == {size[s]}
        assert abs(sum(r.taken for r in own) - want[s]) <= 40
        assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in own)
    again = source_mix.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_edges(spark):
    assert source_mix.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, None, 1, "x"), (1, None, None, 1, "x"), (None, "", "s", 1, "x")]
    assert {r.taken for r in source_mix.mix(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}
    rows = [(5, "a b", "s", 1, "x")] * 10
    assert sum(r.taken for r in source_mix.mix(spark.createDataFrame(rows, SCHEMA)).collect()) == 20


def brute(rows, most=3):
    """copies and odds by row, from the method's own words: whole copies, then Pareto's order up to the words left."""
    sources = sorted({(o is None, o or "") for _, _, o, *_ in rows})
    size = lambda t: len((t or "").split())
    total = {s: sum(size(t) for _, t, o, *_ in rows if (o is None, o or "") == s) for s in sources}
    want = dict(zip(sources, water([total[s] for s in sources], [(5, 2, 1)[k % 3] for k in range(len(sources))], most), strict=True))
    out = []
    for s in sources:
        own = [(d, t, size(t)) for d, t, o, *_ in rows if (o is None, o or "") == s]
        low, high = 0.0, 10.0 * most
        for _ in range(200):  # c by bisection
            c = (low + high) / 2
            low, high = (c, high) if sum(min(most, c * n.bit_length()) * n for _, _, n in own) < want[s] else (low, c)
        copies = [min(most, high * n.bit_length()) if n else 0.0 for _, _, n in own]
        whole = [int(x + 1e-7) for x in copies]
        left = want[s] - sum(w * n for w, (_, _, n) in zip(whole, own, strict=True))
        rank = []
        for k, (d, t, n) in enumerate(own):
            p = copies[k] - whole[k]
            number = int(hashlib.md5(f"mix:{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16)
            u = (number + 0.5) / 2**52
            if p > 1e-7:
                rank.append((u / (1 - u) / (p / (1 - p)), k))
        extra, used = set(), 0
        for _, k in sorted(rank):
            if used + own[k][2] / 2 <= left:
                extra.add(k)
            used += own[k][2]
        out += [(d, n, whole[k] + (k in extra), round(max(0.0, copies[k] - whole[k]), 6)) for k, (d, _, n) in enumerate(own)]
    return sorted(out, key=str)


def test_like_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * int(2 ** rng.uniform(0, 9))), rng.choice(["a", "b", "b", "b", "c", None]), 1, "x") for i in range(1500)]
    rows += [(None, "a b c", "b", 1, "x"), (7, None, "b", 1, "x"), (8, "", None, 1, "x")]
    got = source_mix.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r["size"], r.copies, round(r.odds, 6)) for r in got), key=str) == brute(rows)
    assert len({round(r.odds, 6) for r in got if r.odds > 0}) > 8


def test_inclusion_frequencies_are_the_odds(spark):
    """Over many seeds, a document is taken about as often as its inclusion odds say."""
    rows = [(i, " ".join(["w"] * (3 if i % 2 else 40)), "one" if i % 4 else "two", 1, "x") for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    total, odds, whole = Counter(), {}, {}
    seeds = 6
    for seed in range(seeds):
        for r in source_mix.mix(df, seed=f"s{seed}").collect():
            key = (rows[r.doc_id][2], r["size"])
            odds[key] = r.odds
            whole[key] = min(whole.get(key, 9), r.copies)
            total[key] += r.copies
    count = Counter((s, len(t.split())) for _, t, s, *_ in rows)
    assert len({round(x, 3) for x in odds.values() if x}) >= 2
    for key, p in odds.items():
        if p:
            share = total[key] / (seeds * count[key]) - whole[key]
            assert abs(share - p) < 0.06, (key, share, p)
