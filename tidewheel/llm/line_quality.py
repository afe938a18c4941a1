"""Quality rules on lines and words, with DataFrame functions only.

Rules on one text: too few words, or too many words in three-word windows that the text repeats.

Across documents: lines are normalised (lower case, digits to 0, runs of blanks to one) and hashed; for each
host (``source``) the distinct documents that hold a line are counted, by their ids: exact copies are documents too. A
line is above the limit if ``min_documents`` of a host's documents hold it and they are more than ``max_share`` of the host's, or
more than ``max_documents``, whatever the host's size. Such lines are removed, and a document that loses more than
``max_removed`` of its words is rejected as depleted.

Every count is an aggregate that combines before its shuffle; a line that a third of all documents hold is spread over
its documents first, then it is a few partial counts. The join back is on (host, line), with lines above the limit only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, stash

BLANKS = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent
MAX_SHARE = 0.05
MIN_DOCUMENTS = 20
MAX_DOCUMENTS = 1000
MAX_REMOVED = 0.5


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _text_rules(docs: DataFrame) -> DataFrame:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Each step uses the one before once or cheaply."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    first = docs.select(
        "*",
        words(text).alias("_words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (lines).alias("_lines"),
    )
    second = first.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    ).drop("_words", "_lines")
    n = F.size("_hashes")
    pairs = F.zip_with("_hashes", F.slice("_hashes", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    third = second.select("*", F.when(n >= 3, F.slice(F.zip_with(pairs, F.slice("_hashes", 3, F.greatest(n - 2, F.lit(0))), lambda ab, c: F.xxhash64(ab, c)), 1, F.greatest(n - 2, F.lit(0)))).alias("_windows")).drop("_hashes")
    # Most texts repeat no window: only the others are sorted.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    fourth = third.select("*", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted")).drop("_windows")
    m = F.size("_sorted")
    same = F.zip_with("_sorted", F.slice("_sorted", 2, F.greatest(m - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    fifth = fourth.select("*", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))).alias("_starts")).drop("_sorted")
    k = F.size("_starts")
    covered = F.zip_with("_starts", F.slice("_starts", 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return fifth.select("*", F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_repeat_words")).drop("_starts")


def assess(
    docs: DataFrame,
    max_share: float = MAX_SHARE,
    min_documents: int = MIN_DOCUMENTS,
    max_documents: int = MAX_DOCUMENTS,
    max_removed: float = MAX_REMOVED,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words for each row.

    A null text counts as empty, so it fails; null hosts are one host, and rows with a null doc_id are one document, as are
    those that share any other id. Rows that share id, text and host get the same result. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    row = [F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.xxhash64(text).alias("_same"), F.xxhash64("source").alias("_host")]
    key = ["_id", "_same", "_host"]
    own = docs.select("doc_id", "text", *row)
    base = stash(_text_rules(own).drop("text"))

    normal = F.trim(F.lower(F.regexp_replace(F.regexp_replace("_line", "[0-9]", "0"), BLANKS, " ")))
    lines = own.select(*key, F.explode(F.split(text, "\n", -1)).alias("_line")).filter(F.col("_line").rlike(WORD))
    lines = stash(lines.select(*key, F.xxhash64(normal).alias("_key"), F.regexp_count("_line", F.lit(WORD)).alias("_n")))
    holders = lines.select("_host", "_key", "_id").distinct().groupBy("_host", "_key").agg(F.count("*").alias("_holders"))
    hosts = base.select("_host", "_id").distinct().groupBy("_host").agg(F.count("*").alias("_documents"))
    above = (F.col("_holders") > max_share * F.col("_documents")) | (F.col("_holders") > max_documents)
    frequent = holders.filter(F.col("_holders") >= min_documents).join(hosts, "_host").filter(above).select("_host", "_key")
    # Rows that share a key have the same lines: each has its part of the sum.
    rows = base.groupBy(*key).agg(F.count("*").alias("_rows"))
    removed = lines.join(frequent, ["_host", "_key"], "left_semi").groupBy(*key).agg(F.sum("_n").alias("_removed")).join(rows, key)

    result = base.join(removed, key, "left").withColumn("n_removed_words", F.coalesce(F.expr("_removed div _rows"), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    kept = ~F.col("base_failed") & (F.col("n_removed_words") <= max_removed * F.col("n_words"))
    return result.withColumn("base_failed", failed).withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
            FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
raw AS (SELECT r, source, id, line FROM (SELECT r, source, id, unnest(string_split(t, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw GROUP BY r),
lines AS (SELECT r, source, id, trim(lower(regexp_replace(regexp_replace(line, '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS k,
                 len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM raw),
hosts AS (SELECT source, count(DISTINCT id) AS documents FROM d GROUP BY source),
frequent AS (SELECT l.source, k FROM (SELECT source, k, count(DISTINCT id) AS holders FROM lines GROUP BY source, k) l
             JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE holders >= 20 AND (holders > 0.05 * documents OR holders > 1000)),
removed AS (SELECT r, sum(n) AS n FROM lines l WHERE EXISTS (SELECT 1 FROM frequent f WHERE f.source IS NOT DISTINCT FROM l.source AND f.k = l.k) GROUP BY r),
all_rules AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN covered USING (r) LEFT JOIN dup USING (r) LEFT JOIN removed USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words AS kept FROM all_rules
"""
