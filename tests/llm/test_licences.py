import random
import re

from tidewheel.llm import licences

SCHEMA = "doc_id long, text string, n_words int, _w string"


def brute(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_like_brute_force_and_own_labels(spark):
    filler = " ".join(f"word{i}" for i in range(40))
    texts = ["Released under the MIT License.", "the mit-licenses; MIT  license, mit\nlicense", "GNU General Public License and the Apache License, Version 2.0", "general public licence, public license", None, "", "é" * 50, "mitélicense mit é license", "license " * 30_000 + "mit license"]
    texts += [f"{filler} Licensed under CC BY-NC 4.0.", f"{filler} Redistribution and use in source and binary forms, with or without modification, are permitted", f"{filler} a license of some kind by nc or cc"]
    texts += [f"plain text {i} of the and to in with" for i in range(200)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1, "x"), (None, texts[1], 1, "x")]
    got = licences.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        assert tuple(by[i])[1:6] == brute(t), t
        assert set(filter(None, by[i].base_labels.split(","))) <= set(by[i].labels.split(",")) and 0 <= by[i].score <= 1
    assert by[9].labels == "cc-by" and by[10].labels == "bsd" and by[11].labels == "" and by[9].score > 0.6
    assert tuple(by[None])[1:] == tuple(by[1])[1:]


def test_notices_do_not_take_each_others_lookups(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    free = "This is free and unencumbered software released into the public domain"
    prose = "a person may license the domain under terms of a version subject to redistribution of binary forms and modification in source"
    texts = [f"{mit}. {bsd}.", f"{bsd}. {mit}. {free}.", f"{prose}. {mit}.", mit, bsd, prose] + [f"plain text number{i}" for i in range(200)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert [got[i].labels for i in range(7)] == ["bsd,mit", "bsd,mit,unlicense", "mit", "mit", "bsd", "", ""]
    assert got[0].score == 1.0


def method(texts):
    """labels and score of each text, from the method's own words."""
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
    docs = [split(t) for t in texts]
    templates = [(label, licences.plain_words(t), phrase) for label, t, phrase in licences.TEMPLATES]
    idf = {x: licences.weight(len(docs), sum(x in d for d in docs)) for _, t, _ in templates for x in t}
    out = []
    for w in docs:
        padded, best = f" {' '.join(w)} ", {}
        for label, t, phrase in templates:
            if f" {phrase} " not in padded:
                continue
            order = sorted(set(t), key=lambda x: (-idf[x], x))
            looked = [x for x in order if x in w][: licences.LOOKED_UP]
            top = 0
            votes = {(i - p, x) for i, x in enumerate(w) if x in looked for p, y in enumerate(t) if x == y}
            for band in {start // licences.BAND - k for start, _ in votes for k in (0, 1)}:
                voters = {x for start, x in votes if band <= start // licences.BAND <= band + 1}
                top = max(top, sum(idf[x] for x in voters))
            share = min(1.0, top / sum(idf[x] for x in order[: licences.LOOKED_UP]))
            if share >= licences.SHARE:
                best[label] = max(best.get(label, 0), share)
        base = {label for label, p in (("mit", " mit license "), ("apache", " apache license "), ("gpl", " general public license ")) if p in padded}
        out.append((",".join(sorted({*best, *base})), 1.0 if base else max(best.values(), default=0.0)))
    return out


def test_random_tables_like_the_method(spark):
    rng = random.Random(4)
    notices = [t for _, t, _ in licences.TEMPLATES]
    pool = sorted({x for t in notices for x in licences.plain_words(t)})
    for n in (1, 2, 10, 300):
        texts = []
        for _ in range(n):
            parts = []
            for _ in range(rng.randrange(4)):
                w = licences.plain_words(rng.choice(notices))
                for _ in range(rng.randrange(4)):
                    w[rng.randrange(len(w))] = rng.choice(pool)
                parts += [" ".join(w[rng.randrange(3) :]), " ".join(rng.choice(pool) for _ in range(rng.randrange(12)))]
            texts.append(". ".join(parts) if rng.random() < 0.9 else None)
        rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
        got = {r.doc_id: (r.labels, r.score) for r in licences.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert [got[i] for i in range(n)] == method(texts)


def test_labels_do_not_depend_on_other_rows_or_copies(spark):
    labels = sorted({x for x, _, _ in licences.TEMPLATES})
    everything = "\n".join(t for _, t, _ in licences.TEMPLATES)
    for rows in ([(1, "mozilla public license")], [(1, "mozilla public license")] * 2, [(k, "Mozilla Public License." if k < 2 else "plain") for k in range(10)], [(1, everything)], [(k, everything) for k in range(20)]):
        got = licences.scan(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
        want = {"mozilla public license": "mpl", "Mozilla Public License.": "mpl", "plain": "", everything: ",".join(labels)}
        assert all(r.labels == want[dict(rows)[r.doc_id]] for r in got), [r.labels for r in got]


def test_notices_with_words_put_in_or_left_out(spark):
    """Whole notices keep their label with a word more or less anywhere outside of the key phrase, and with several words more in one place."""
    cases = []
    for label, text, phrase in licences.TEMPLATES:
        w, p = licences.plain_words(text), phrase.split()
        if len(w) < 25:
            continue
        at = next(i for i in range(len(w)) if w[i : i + len(p)] == p)
        for part in (1 / 4, 1 / 3, 1 / 2, 2 / 3, 3 / 4):
            k = int(part * len(w))
            if not at < k < at + len(p):
                cases += [(label, " ".join([*w[:k], *more, *w[k:]])) for more in (["either"], ["so", "called", "the", "owner"])]
            if not at <= k < at + len(p):
                cases.append((label, " ".join(w[:k] + w[k + 1 :])))
    cases += [("mit", "# SPDX-License-Identifier: MIT\nimport os"), ("bsd", "// SPDX-License-Identifier: BSD-3-Clause")]
    cases.append(("bsd", "Redistribution and use in source and binary forms, either with or without modification, are permitted"))
    rows = [(i, f"some code {t} and on", 1, "x") for i, (_, t) in enumerate(cases)] + [(9000 + i, f"plain text number{i}", 1, "x") for i in range(300)]
    got = {r.doc_id: r.labels.split(",") for r in licences.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    lost = [(label, t) for i, (label, t) in enumerate(cases) if label not in got[i]]
    assert len(cases) > 100 and not lost, lost[:3]
    assert all(got[9000 + i] == [""] for i in range(300))


def test_empty(spark):
    assert licences.scan(spark.createDataFrame([], SCHEMA)).collect() == []
