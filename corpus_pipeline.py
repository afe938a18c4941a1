"""A corpus pipeline of five stages over ``documents``: each works on all that the one before it kept.

1. toxicity: fitted on the labelled rows of the stage's own input that are not held out; documents scored
   at the threshold or above go.
2. dedupe: n-gram Jaccard join; of each component, one document stays, that with the smallest doc_id.
3. pii: base and discovered personal data give way to placeholders, and n_chars is that of the new text.
4. mix: Pareto order sampling; a document appears as many times as the mix takes it.
5. encode: SentencePiece ids of every text, and whether they decode to it.

Columns of the input that are called like a helper column stay as they are; rows with one doc_id are told apart by their
texts. Each stage but the last returns the columns of documents. ``run`` writes what each stage returns to the shared
folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm import jaccard_join, pii, piece_codec, source_mix, toxicity
from tidewheel.llm.queries import piece_model
from tidewheel.llm.shared import fresh, small_batches, stash, table

#: Toxicity is learnt, PII patterns are bootstrapped and pieces come from a model file: no SQL for the whole.
ORACLE_SQL = None


def _digest() -> Column:
    """What tells texts apart, as the operators have it; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the threshold, unchanged; null and empty texts are scored as empty ones."""
    small_batches(spark)
    trained = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "score")
    return toxicity.score(docs, trained, name=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked texts: that of the smallest doc_id (null is smallest), of its texts the one with the least digest.

    Of rows that share id and text, the least by all its columns stays. Texts without words are linked with nothing, so all of them stay.
    """
    small_batches(spark)
    groups = stash(jaccard_join.grouped(docs).filter("n_shingles > 0").groupBy("root", "doc_id", "same").agg(F.count("*").alias("n")))
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "same")).alias("first"))
    decided = groups.join(first, "root").select("doc_id", "same", "n", F.struct("doc_id", "same").eqNullSafe(F.col("first")).alias("stays"))
    # Ids and digests of rows to drop, without texts: the join shuffles each text once at most.
    own_id, own_same, place = fresh(docs, "id", "same", "place")
    gone = decided.filter(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias(own_id), F.col("same").alias(own_same))
    several = decided.filter(F.col("stays") & (F.col("n") > 1)).select(F.col("doc_id").alias(own_id), F.col("same").alias(own_same))
    same_row = lambda other: docs["doc_id"].eqNullSafe(other[own_id]) & (_digest() == other[own_same])
    once = docs.join(gone, same_row(gone), "left_anti").select(*docs.columns)
    order = Window.partitionBy("doc_id", _digest()).orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = docs.join(several, same_row(several), "left_semi").select(*docs.columns).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return once.unionByName(repeated)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced; texts without any stay as they are, null stays null."""
    small_batches(spark)
    own_id, own_same, places = fresh(docs, "id", "same", "spans")
    spans = pii.extract(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias(own_id), F.col("_same").alias(own_same), F.col("spans").alias(places)).dropDuplicates([own_id, own_same])

    @F.pandas_udf("string")
    def replaced(texts, found):
        import pandas as pd

        return pd.Series([t if p is None else pii.redact(t, [(s["start"], s["kind"], s["end"]) for s in p]) for t, p in zip(texts, found, strict=True)])

    both = docs.join(spans, docs["doc_id"].eqNullSafe(spans[own_id]) & (_digest() == spans[own_same]), "left")
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(replaced("text", places))
    new = both.withColumn("text", text).withColumn("n_chars", F.when(F.col(places).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return new.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it. Rows that share doc_id, text and source share their copies: the first by all columns get one more."""
    own_id, own_same, own_source, copies, rows, turn = fresh(docs, "id", "same", "of", "copies", "rows", "turn")
    key = [own_id, own_same, own_source]
    taken = source_mix.mix(docs, also={"same": _digest(), "of": F.col("source")})
    taken = stash(taken.groupBy(F.col("doc_id").alias(own_id), F.col("same").alias(own_same), F.col("of").alias(own_source)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).filter(F.col(copies) > 0))

    def with_copies(some: DataFrame) -> DataFrame:
        return docs.join(some, docs["doc_id"].eqNullSafe(some[own_id]) & (_digest() == some[own_same]) & docs["source"].eqNullSafe(some[own_source]))

    one = with_copies(taken.filter(F.col(rows) == 1)).withColumn(turn, F.col(copies))
    order = Window.partitionBy(*key).orderBy(*[docs[f"`{c}`"] for c in docs.columns])
    several = with_copies(taken.filter(F.col(rows) > 1)).withColumn(turn, F.row_number().over(order))
    several = several.withColumn(turn, F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(turn) <= F.col(copies) % F.col(rows), 1).otherwise(0))
    both = one.unionByName(several).filter(F.col(turn) > 0)
    return both.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(turn)))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and whether the ids decode to the text (with blanks as the model writes them)."""
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", F.sha2(F.replace(text, F.lit(piece_codec.BLANK), F.lit(" ")), 256).alias("sha"), "text")
    out = piece_codec.encode(rows, piece_model(), decoded="decoded")
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("sha")).alias("exact"))


STAGES = [("toxicity", drop_toxic), ("dedupe", one_of_each), ("pii", redact), ("mix", mixed), ("encode", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
