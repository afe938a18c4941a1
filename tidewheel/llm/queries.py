"""The registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, jaccard_join, licences, line_quality, merkle, packing, pii, piece_codec, repeats, source_mix, toxicity, trie, warc
from .shared import shared_folder, small_batches, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base entities, secrets and what they lead to, in every document."""
    small_batches(spark)
    return pii.digests(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ``pages`` as WARC archives with revisits, and read them back."""
    small_batches(spark)
    archives = warc.write(table(spark, sf_dir, "pages"), shared_folder(spark))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` under the links of their word shingles."""
    small_batches(spark)
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules and line frequency by host, for every document."""
    return line_quality.assess(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents that are not held out; score all."""
    small_batches(spark)
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove what repeats, byte for byte, of documents with smaller ids."""
    small_batches(spark)
    return repeats.remove(table(spark, sf_dir, "documents"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    small_batches(spark)
    return fingerprint.digests(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return source_mix.mix(table(spark, sf_dir, "documents"))


def piece_model() -> str:
    """Path of the vocabulary that the contract names."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    small_batches(spark)
    return piece_codec.digests(table(spark, sf_dir, "documents"), piece_model())


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt ``conversations``, a row a node."""
    small_batches(spark)
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, a row for each of them, with its proof checked against the root."""
    small_batches(spark)
    return merkle.verified(table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    """Path of the tokenizer file that the contract names."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 4096, each with the mixture of sources of the whole table."""
    small_batches(spark)
    return packing.digests(table(spark, sf_dir, "documents"), word_tokenizer())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline`` over all ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_warc, op3_jaccard_join, op4_line_quality, op5_toxicity, op6_licences, op7_repeats, op8_fingerprint, op9_source_mix, op10_sentencepiece, op11_trie, op12_merkle, op13_packing, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.ORACLE, "op4_line_quality": line_quality.ORACLE, "op9_source_mix": source_mix.ORACLE, "op11_trie": trie.ORACLE, "op12_merkle": merkle.oracle()}
