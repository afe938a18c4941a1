import itertools
import math
import random
import time
import zlib

import pytest

from tidewheel.llm import toxicity

DOCS, LABELS = "doc_id long, text string, score int", "doc_id long, toxic int, text string"
GOOD = "the river and a small house with green trees near some quiet water where children often play until late evening".split()
BAD = ["idiot", "moron", "scumbag", "pathetic"]


def corpus(n=600):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randrange(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words), 1))
        labels.append((i, int(toxic), "x"))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus()
    return toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))


def test_restore(trained):
    model = trained[0]
    for written, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("p@thetic", "pathetic"), ("i d i o t", "idiot"), ("p.a.t.h.e.t.i.c", "pathetic"), ("idiiiiot", "idiot"), ("mooooron", "moron"), ("5cumb@g", "scumbag")):
        assert toxicity.restore(f"the {written} house", model) == f"the {meant} house"
    for plain in ("the green trees, 42 of them (1990)", "", "see the small house"):
        assert toxicity.restore(plain, model) == plain


def test_restore_signs_at_the_ends(trained):
    model = trained[0]
    for written, meant in (("idi07", "idiot"), ("1d107", "idiot"), ("1d!0+", "idiot"), ("!diot", "idiot"), ("idiot!", "idiot"), ("m0r0n!!", "moron"), ("(m0r0n)", "moron)"), ("water###", "water"), ("i d i o t,", "idiot,")):
        assert toxicity.restore(f"the {written} house", model) == f"the {meant} house", written
    for written in ("a$$", "sh!7", "fu**", "(unt", "p@thet!("):  # the lattice gets the whole word
        assert toxicity.suspect(written) and toxicity.restore(written, model) == toxicity.decode(written, model), written


def test_spacing_of_all_kinds(trained):
    model = trained[0]
    for written, meant in (("\ni d i o t\n", "\nidiot\n"), ("m  o  r  o  n", "moron"), ("i*d*i*o*t", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("ｍ ｏ ｒ ｏ ｎ", "moron"), ("1 d i 0 t", "idiot"), ("m-o-r-o-n", "moron"), ("i_d_i_o_t", "idiot")):
        assert toxicity.restore(written, model) == meant, written
    assert toxicity.restore("s o m e  i d i o t", model) == "some idiot"
    assert toxicity.restore("n e a r s o m e h o u s e", model).replace(" ", "") == "nearsomehouse"
    for plain in ("1 2 3 4 5", "a 1 2 3", "1.2.3-4"):
        assert toxicity.restore(plain, model) == plain


def test_viterbi_finds_the_least_of_all_readings(trained):
    model, rng = trained[0], random.Random(3)

    def cost(reading):
        a = b = 0
        total = 0.0
        for letter, price in reading:
            total += price
            if letter:
                c = toxicity.class_of(letter)
                total += model[a, b, c]
                a, b = b, c
        return total + model[a, b, 0]

    for _ in range(120):
        token = "".join(rng.choice("aid0t1o@*!4n") for _ in range(rng.randrange(1, 8)))
        token = token if rng.random() < 0.6 else rng.choice([" ", "-", "  "]).join(token)
        every = {}
        for r in itertools.product(*toxicity.readings(token)):
            text = "".join(x for x, _ in r)
            every[text] = min(cost(r), every.get(text, math.inf))
        assert every[toxicity.decode(token, model)] == pytest.approx(min(every.values())), token


@pytest.mark.parametrize("text", ["a" * 200_000 + "_", "a1" * 100_000, "*" * 200_000 + "a", "a " * 100_000 + "b1", "a_" * 100_000 + "bc", "0123456789abcdef" * 12_500, "a*" * 100_000, "ab_" * 70_000, "! ! " * 50_000, "1 2 " * 50_000 + "x"])
def test_long_tokens_are_read_in_linear_time(trained, text):
    began = time.perf_counter()
    toxicity.restore(text, trained[0])
    assert time.perf_counter() - began < 20


def test_planted_obfuscations_are_found(spark, trained):
    rng = random.Random(9)
    leet = str.maketrans("aeiost", "@31057")

    def hide(word, kind):
        if kind == 0:
            return word.translate(leet)
        if kind == 1:
            return rng.choice([" ", ".", "-", "  "]).join(word)
        at = rng.randrange(len(word))
        return word[:at] + word[at] * rng.randrange(3, 6) + word[at:]

    rows = []
    for i in range(300):
        words = [rng.choice(GOOD) for _ in range(rng.randrange(20, 60))]
        if i % 2:
            words[rng.randrange(len(words))] = hide(rng.choice(BAD), i % 3)
        rows.append((i, " ".join(words), 1))
    got = {r.doc_id: r.s for r in toxicity.score(spark.createDataFrame(rows, DOCS), trained, name="s").collect()}
    found = [got[i] >= toxicity.THRESHOLD for i in range(300)]
    assert sum(found[1::2]) / 150 >= 0.9 and sum(found[::2]) == 0


def test_repeated_ids_and_labels(spark):
    docs, labels = corpus(300)
    twice = spark.createDataFrame(docs + docs + [(3, None, 1), (10, "", 1)], DOCS)
    got = toxicity.predict(twice, spark.createDataFrame(labels + [(i, 0, "y") for i in range(0, 300, 5)], LABELS)).collect()
    assert len(got) == 602 and len({(r.doc_id, r.score) for r in got}) <= 302
    once = {(r.doc_id, r.score) for r in toxicity.predict(spark.createDataFrame(docs + docs + [(3, None, 1), (10, "", 1)], DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert once == {(r.doc_id, r.score) for r in got}


def test_held_out_accuracy(spark, trained):
    docs, labels = corpus()
    got = toxicity.predict(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    truth = {d: t for d, t, _ in labels}
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    hidden = [(1, "a quiet river and the 1d10t near green trees", 1), (2, "some m o r o n with a small house", 1), (3, "a quiet river and green trees", 1), (4, None, 1), (5, "", 1), (6, "the river " * 30_000, 1)]
    scores = {r.doc_id: r.s for r in toxicity.score(spark.createDataFrame(hidden, DOCS), trained, name="s").collect()}
    assert scores[1] >= 0.7 and scores[2] >= 0.7 and max(scores[k] for k in (3, 4, 5, 6)) < 0.5
    with pytest.raises(ValueError):
        toxicity.score(spark.createDataFrame(hidden, DOCS), trained)


def test_edges(spark):
    none, no_label = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert toxicity.predict(none, no_label).collect() == []
    (one,) = toxicity.predict(spark.createDataFrame([(None, None, 1)], DOCS), no_label).collect()
    assert one.predicted == 0 and 0 <= one.score <= 1 and not one.held_out
