import random

import sentencepiece

import corpus_pipeline
from tidewheel.llm import pii, source_mix
from tidewheel.llm.queries import piece_model
from tests.llm.test_jaccard_join import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the river and a small house with green trees near some quiet water where children often play until late evening".split()


def corpus():
    rng = random.Random(2)
    rows = []
    for i in range(240):
        t = " ".join(f"{rng.choice(WORDS)}{rng.choice(['', 's', 'ly', 'er'])}" for _ in range(rng.randrange(20, 70)))
        t += " you moron" if i % 6 == 0 else f" mail me.{i}@site.example.org" if i % 6 == 1 else ""
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    return rows + [(1000 + i, rows[i * 7 + 1][1], "en", "s1", 1) for i in range(20)] + [(2000, "", "en", None, 0), (2001, None, None, "s2", None)]


def test_stages_like_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("moron" in (t or ""))) for i, t, *_ in rows if i < 1000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = docs.collect()
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [r for r in rows if "moron" not in (r[1] or "")]
    assert sorted(map(tuple, after["toxicity"]), key=str) == sorted(want, key=str)
    keep = {d for d, _, c in brute(want) if d == c}
    want = [r for r in want if r[0] in keep]
    assert sorted(map(tuple, after["dedupe"]), key=str) == sorted(want, key=str)
    assert sorted(r.text or "" for r in after["pii"]) == sorted(pii.redact(t or "", pii.base_spans(t or "")) for _, t, *_ in want)
    assert any("<EMAIL>" in (r.text or "") for r in after["pii"])
    mix = source_mix.mix(spark.read.parquet(f"{tmp_path}/pii")).collect()
    assert sorted(r.doc_id for r in after["mix"]) == sorted(r.doc_id for r in mix for _ in range(r.copies))
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = {r.doc_id: r.text or "" for r in after["pii"]}
    assert all(r.exact and r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in after["encode"])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, after["encode"]))


EXTRA = DOCS + ", _id int, same string, _spans int, turn int, score string"


def test_repeated_ids_clashing_columns_nulls_and_long_texts(spark, tmp_path):
    text = lambda k: " ".join(f"{WORDS[(k * 7 + j * (k + 3)) % len(WORDS)]}{k}" for j in range(30))
    rows = [(3, text(2), "en", "a", 1), (5, text(1), "en", "a", 1), (5, text(2), "en", "b", 1), (6, text(4), "en", "a", 1), (6, text(4), "en", "a", 1), (6, text(4), "fr", "a", 1)]
    rows += [(None, text(5), "en", None, None), (None, text(6), "en", "a", 1), (9, text(5), "en", "a", 1), (10, None, None, None, None), (10, "", "en", "a", 0), (10, "", "en", "a", 0)]
    rows += [(11, "river " * 40_000 + "a.b@site.example.org", "en", "b", 1)]
    table = spark.createDataFrame([(*r, 7, "s", 8, 9, "x") for r in rows], EXTRA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    keep = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert sorted(map(str, keep.collect())) == sorted(map(str, table.collect()))
    once = corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect()
    want = [rows[0], rows[1], rows[3], rows[6], rows[7], *rows[9:13]]
    assert sorted(str(tuple(r)) for r in once) == sorted(str((*r, 7, "s", 8, 9, "x")) for r in want)
    clean = corpus_pipeline.redact(spark, docs, str(tmp_path)).collect()
    assert len(clean) == len(rows) and [r.text for r in clean if r.doc_id == 11] == ["river " * 40_000 + "<EMAIL>"]
    assert all(tuple(r)[5:] == (7, "s", 8, 9, "x") for r in clean) and sum(r.text is None for r in clean) == 1
    assert sorted(str(tuple(r)) for r in clean if r.doc_id != 11) == sorted(str((*r, 7, "s", 8, 9, "x")) for r in rows[:-1])
    mix = corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()
    taken = source_mix.mix(docs).collect()
    assert sorted(str(r.doc_id) for r in mix) == sorted(str(r.doc_id) for r in taken for _ in range(r.copies))
    sizes = sum(len((r.text or "").split()) for r in mix)
    assert sizes == sum(r.taken for r in taken)
    ids = corpus_pipeline.encoded(spark, docs, str(tmp_path)).collect()
    assert len(ids) == len(rows) and all(r.exact for r in ids)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], EXTRA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
