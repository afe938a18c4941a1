import random
from collections import Counter, defaultdict

from tidewheel.llm import line_quality

SCHEMA = "doc_id long, text string, source string, n_words int, _rows int"


def words(t):
    return [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]


def brute(rows):
    holders, hosts, out = defaultdict(set), defaultdict(set), []
    key = lambda line: " ".join(words("".join("0" if c in "0123456789" else c for c in line))).lower()
    for d, t, s, *_ in rows:
        hosts[s].add(d)
        for line in (t or "").split("\n"):
            if words(line):
                holders[s, key(line)].add(d)
    for d, t, s, *_ in rows:
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        removed = sum(len(words(x)) for x in lines if len(holders[s, key(x)]) >= 20 and len(holders[s, key(x)]) > 0.05 * len(hosts[s]))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed and removed <= 0.5 * len(w), removed))
    return sorted(out, key=str)


def test_like_brute_force(spark):
    rng = random.Random(8)
    boiler = "Accept all 99 cookies  to go on"
    rows = []
    for i in range(400):
        lines = [" ".join(rng.choice("a b c d e f g h #1 é".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(14))]
        if i % 3 == 0:
            lines += [f"{boiler.replace('99', str(10 + i % 90))} {'abcdefghijkl'[k]}1 {'mnopqrstuvwx'[k]}2 {k}y {k}z q{k} r{k}" for k in range(12)][: rng.randrange(13)]
        rows.append((i, "\n".join(lines), rng.choice(["x", "y", None]), 1, 1))
    rows += [(1000 + i, rows[3][1], "x", 1, 1) for i in range(60)]
    rows += [(2000, None, "x", 1, 1), (2001, "", None, 1, 1), (2002, "\n\n \t", "x", 1, 1), (2003, "same words here " * 20_000, "y", 1, 1), (2003, "same words here " * 20_000, "y", 1, 1), (None, "a b", "x", 1, 1), (None, "a b", "x", 1, 1), (3, "another text of a known id", "x", 1, 1)]
    got = line_quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert any(r.n_removed_words and not r.kept and not r.base_failed for r in got)


def test_empty(spark):
    assert line_quality.assess(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_line_of_too_many_documents_goes_however_large_the_host(spark):
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = [(i, "\n".join(f"{name(i)} {k} unlike any other line" for k in "abcdefghij") + ("\nshared line of all words " * 12 if i < 60 else ""), "x", 1, 1) for i in range(2000)]
    got = {r.doc_id: r for r in line_quality.assess(spark.createDataFrame(rows, SCHEMA), max_documents=50, max_share=0.5).collect()}
    assert all((got[i].n_removed_words > 0) == (i < 60) for i in range(2000) if i % 10 == 0)
    got = line_quality.assess(spark.createDataFrame(rows, SCHEMA), max_share=0.5).collect()
    assert not any(r.n_removed_words for r in got)
