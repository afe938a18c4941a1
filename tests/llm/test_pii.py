import hashlib
import random
import re
import time
from collections import Counter, defaultdict

from tidewheel.llm import pii

SCHEMA = "doc_id long, text string, spans int, base int"


def brute(text):
    """The contract's patterns as they stand."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        luhn = sum(sum(divmod(x * 2, 10)) if k % 2 else x for k, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and luhn % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_patterns_like_brute_force():
    rng = random.Random(4)
    for alphabet in ("a.@-%", "0123.", "0 -4", "+1 ()-.5", "ab@c.d1+ 5-\n.é٣", "4242 4242-"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(70)))
            assert pii.base_spans(text) == brute(text), repr(text)
    assert pii.base_spans("x 4111 1111 1111 1111, 0.0.0.256 1.2.3.4.5.6.7.8") == brute("x 4111 1111 1111 1111, 0.0.0.256 1.2.3.4.5.6.7.8")


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 200_000, "a@" * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.candidates(text, pii.base_spans(text))


def test_bootstrap_finds_what_the_patterns_miss(spark):
    rows = [(i, f"Hello there, call me at +1 555 010 {1000 + i} today. ", 1, 1) for i in range(40)]
    rows += [(100 + i, f"Please call me at 555-01{i:02d}-77 today or so", 1, 1) for i in range(6)]
    rows += [(200, "In room 5550-12 at noon, order 12345-77 and 99 apples", 1, 1), (201, None, 1, 1), (202, "", 1, 1), (None, "a@b.cd", 1, 1), (7, rows[7][1], 1, 1)]
    got = pii.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, text, *_ in rows:
        spans = brute(text or "")
        assert by[d].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert [by[d].n_email, by[d].n_ip, by[d].n_card, by[d].n_phone] == [sum(k == x for _, k, _ in spans) for x in range(4)]
        assert set(by[d].spans.split(",")) >= {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans} or not spans
    assert all(by[100 + i].spans == "phone:18:29" for i in range(6))
    assert by[200].spans == "" and by[201].spans == ""


def graph(edges, rounds=pii.ROUNDS, min_support=pii.MIN_SUPPORT, min_confidence=pii.MIN_CONFIDENCE, min_score=pii.MIN_SCORE):
    """(instance, kind) by the rounds as the method states them; ``edges``: {(pattern, instance): kind}."""
    seeds = {(i, k): 1.0 for (_, i), k in edges.items() if k >= 0}
    known, taken = dict(seeds), {}
    size = Counter(p for p, _ in edges)
    for _ in range(rounds):
        sums, support = defaultdict(float), Counter()
        for p, i in edges:
            for (other, kind), score in known.items():
                if other == i:
                    sums[p, kind] += score
                    support[p, kind] += 1
        confidence = {pk: round(s / (size[pk[0]] + 1), 9) for pk, s in sums.items() if support[pk] >= min_support}
        rest = defaultdict(lambda: 1.0)
        for (p, i), k in edges.items():
            for (q, kind), c in confidence.items():
                if k < 0 and q == p and c >= min_confidence:
                    rest[i, kind] *= 1 - c
        best = {}
        for (i, kind), r in rest.items():
            score = round(1 - r, 9)
            if score >= min_score and (i not in best or (score, -kind) > (best[i][1], -best[i][0])):
                best[i] = (kind, score)
        taken = {i: kind for i, (kind, _) in best.items()}
        known = {**seeds, **{(i, kind): score for i, (kind, score) in best.items()}}
    return sorted(taken.items())


def test_graph_like_brute_force(spark):
    rng, some = random.Random(11), 0
    for _ in range(3):
        pairs = {}
        kinds = {i: rng.choice([0, 0, 1, 3]) if i < 60 else -1 for i in range(90)}
        for p in range(14):
            for i in rng.sample(range(90), rng.randrange(6, 26)):
                if p < 9 or i < 60 or rng.random() < 0.15:
                    pairs[f"p{p}", f"i{i}"] = kinds[i] if p > 6 or kinds[i] < 0 else p % 2
        kind_of = {}
        for (p, i), k in pairs.items():
            kind_of.setdefault(i, k)
        pairs = {(p, i): kind_of[i] for p, i in pairs}
        seen = [(0, kind, i, [p]) for (p, i), kind in pairs.items() for _ in range(rng.randrange(1, 3))]
        rows = [(1, 1, 1, [], [(s, s, k, i, p) for s, k, i, p in seen[a : a + 40]]) for a in range(0, len(seen), 40)] + [(None, 2, None, None, None), (2, 2, 2, [], [])]
        got = pii.bootstrap(spark.createDataFrame(rows, pii.FOUND), min_support=2, min_confidence=0.3, min_score=0.5).collect()
        want = graph(pairs, min_support=2, min_confidence=0.3, min_score=0.5)
        assert sorted(map(tuple, got)) == want
        some += len(want)
    assert some
    assert pii.bootstrap(spark.createDataFrame([], pii.FOUND)).collect() == []


def test_recall_of_planted_identifiers(spark):
    """Identifiers that no base pattern has, in contexts that known ones share with them, and in contexts of their own."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        known = i % 4
        number = f"+49 30 {rng.randrange(10**6, 10**7)}" if known else f"030-{rng.randrange(1000, 9999)}-{rng.randrange(10, 99)}"
        before = rng.choice(["please call me at", "you may phone us at", "my number is now"])
        rows.append((i, f"Text {'abc'[i % 3]} and more, {before} {number} {rng.choice(['today', 'before noon', 'or write'])}. The end", 1, 1))
    rows += [(1000 + i, f"the order of {rng.randrange(1000, 9999)}-{rng.randrange(10, 99)} pieces went to room {rng.randrange(10000, 99999)}", 1, 1) for i in range(100)]
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(bool(got[i]) for i in range(0, 400, 4)) / 100 >= 0.9
    assert not any(got[1000 + i] for i in range(100))


def test_candidates_beside_base_spans_and_long_context():
    text = "write 555-123-4567 a@b.org or 1.2.3.4 99-88-77"
    spans = pii.base_spans(text)
    assert [text[s:e] for s, e in pii.candidates(text, spans)] == ["555-123-4567", "99-88-77"]
    text = " ".join(["12345"] * 40)
    assert [text[s:e].count(" ") for s, e in pii.candidates(text, [])] == [7] * 5
    long = "x" * 100_000
    text = f"{long}1 {long} 55-12345 {long}"
    context = pii._Context(text)
    at = text.index("55-")
    assert [len(w) for w in context.before(at, 3)] == [64, 64] and len(context.after(at + 8)) == 64
    assert pii._Context("a" + " " * 5000 + "b 12345").before(5003, 3) == ["a", "b"]
    context = pii._Context('my token = "abc12345", so')
    assert context.before(12, 3) == ["token", "=", '"'] and context.after(20) == '"' and context.after(22) == "so" and context.after(25) == "" and context.before(0, 3) == []
    assert pii.patterns(context, 12, 20) == ['token = " _', '= " _', '" _ "']


def test_text_without_blanks_takes_linear_time():
    for unit in ("+4915112345678,", "a@b.co,", "token=abcdefgh,", '{"n":12345},'):
        took = []
        for n in (1 << 18, 1 << 20):
            text = unit * (n // len(unit))
            began = time.process_time()
            spans = pii.base_spans(text)
            known = sorted(spans + pii.secret_spans(text, spans))
            context = pii._Context(text)
            for s, _, e in known:
                pii.patterns(context, s, e)
            for s, e in pii.candidates(text, known):
                pii.patterns(context, s, e)
            took.append(time.process_time() - began)
        assert took[1] < 5 and took[1] < 8 * took[0] + 0.5


def test_secrets_are_found_and_lead_to_others(spark):
    rng = random.Random(13)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'In file {"xyz"[i % 3]} set token = "{hexes()}" and go', 1, 1) for i in range(60)]
    rows += [(100 + i, f'In file {"xyz"[i % 3]} set passphrase1 = "{hexes()}" and go', 1, 1) for i in range(5)]
    rows += [(200, "the token of 12345678 is not = 7 tokens: none", 1, 1), (201, "mail token=a@bcdefg.org now", 1, 1), (202, "key: 5, token:", 1, 1)]
    got = {r.doc_id: r for r in pii.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].spans == f"secret:{rows[i][1].index(chr(34)) + 1}:{rows[i][1].index(chr(34)) + 41}" and got[i].n_spans == 1 for i in range(60))
    assert all(got[100 + i].spans.startswith("secret:") for i in range(5))
    assert got[200].spans == "" and got[201].spans == "email:11:23" and got[202].n_spans == 0


def test_empty_and_redact(spark):
    assert pii.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "mail a@b.cd or +1 555 010 1000!"
    assert pii.redact(text, pii.base_spans(text)) == "mail <EMAIL> or <PHONE>!"
    assert pii.redact(text, []) == text
