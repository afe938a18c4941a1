"""Mix sources to target weights by Pareto order sampling, with DataFrame functions only.

1. A document's size is its number of words. Sources, in code-point order with null last, weigh 5, 2, 1,
   5, 2, 1, ... A target is the share of all sizes that the weight asks for, but at most ``most`` times its
   source's size; the excess goes to the other sources by weight until no target is above.
2. Within a source, a document's expected copies grow with the binary digits of its size, so that scraps of a few words
   are repeated less than full texts, but are at most ``most``: copies = min(most, c * digits), with c such that
   the expected words of the source are its target. Documents without words get none.
3. The whole copies are certain. The fraction left is the document's inclusion odds p for one further copy.
4. Documents are ranked by Pareto's ratio, random odds over inclusion odds: u / (1 - u) / (p / (1 - p)),
   with u from a digest of the seed and the document's id and text, so reruns agree. The sample has a fixed size
   in words: documents are taken in that order up to what the whole copies leave of the target.

Step 4 needs running sums over the documents of a source, which may hold a third of all rows. They are
taken by ranges of the ratio: sums of ``RANGES`` ranges for each source, then of as many parts of the one range in
which the sum passes the target, then rows of that part. Near the passing point a range holds no more than an even share of a source,
as the odds of u and of p are equal there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, stash

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Ranges of a level and levels of ranges.
RANGES, LEVELS = 4096, 2
SEED = "mix"
#: What is nearer to a whole number of copies than this is whole.
NEAR = 1e-9


def _level(cap: Column, weight: Column, total: Column, by) -> Column:
    """The level L at which the sum of min(cap, L * weight) is ``total``; ``by`` orders by cap / weight, least first.

    With the first k rows at their caps the level is (total - their caps) / (weights of the rest); the largest of these is it.
    """
    before = F.coalesce(F.sum(cap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(weight).over(by.rowsBetween(0, Window.unboundedFollowing))
    return (total - before) / after


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """One row a source (keys ``_none``, ``_source``): source_size and target."""
    sources = sizes.groupBy("_none", "_source").agg(F.sum("_words").alias("source_size"))
    # One row a source from here on: the global windows see no documents.
    rank = F.row_number().over(Window.orderBy("_none", "_source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    weighed = sources.withColumn("_weight", weight)
    whole = Window.partitionBy()
    by = Window.orderBy(F.col("source_size") * most / F.col("_weight"), "_none", "_source")
    level = _level(F.col("source_size") * most, F.col("_weight"), F.sum("source_size").over(whole), by)
    filled = weighed.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    target = F.least((F.col("source_size") * most).cast("double"), F.col("_level") * F.col("_weight"))
    return filled.select("_none", "_source", "source_size", target.alias("target"))


def odds(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each source and number of digits of a size: _whole (certain copies), _odds (of one more), _left (words still to take)."""
    key = ["_none", "_source"]
    classes = sizes.groupBy(*key, "_digits").agg(F.sum("size").alias("_words")).join(targets(sizes.withColumnRenamed("size", "_words"), most), key)
    own = Window.partitionBy(*key)
    weight = F.col("_words") * F.col("_digits")
    level = F.when(weight > 0, _level(F.col("_words") * most, weight, F.col("target"), own.orderBy(F.desc("_digits"))))
    filled = classes.withColumn("_level", level).withColumn("_level", F.max("_level").over(own))
    copies = F.coalesce(F.least(F.lit(float(most)), F.col("_level") * F.col("_digits")), F.lit(0.0))
    split = filled.withColumn("_copies", copies).withColumn("_whole", F.floor(F.col("_copies") + NEAR))
    split = split.withColumn("_odds", F.when(F.col("_copies") - F.col("_whole") > NEAR, F.col("_copies") - F.col("_whole")).otherwise(0.0))
    left = F.col("target") - F.sum(F.col("_whole") * F.col("_words")).over(own)
    return split.withColumn("_left", left).select(*key, "_digits", "source_size", "target", "_whole", "_odds", "_left")


def mix(docs: DataFrame, seed: str = SEED, most: int = MOST, also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), copies, odds for every row of ``docs`` (doc_id, text, source).

    Null text: size 0, nothing taken, as of any text without words. Null source: a source of its own, sorted last. Null doc_id: the number
    is that of the text alone. Rows with the same doc_id and text get the same number; equal rows are told apart
    by nothing, so which of them gets the last copy is open, the multiset of results is not. ``also`` names
    further columns of ``docs`` for the result.
    """
    also = also or {}
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)), 1, 13), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stash(
        docs.select("doc_id", size.alias("size"), F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), number.alias("_number"), *[c.alias(n) for n, c in also.items()])
        .withColumn("_digits", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))
    )
    key = ["_none", "_source"]
    u = (F.col("_number") + 0.5) / float(2**52)
    ratio = F.when(F.col("_odds") > 0, u / (1 - u) / (F.col("_odds") / (1 - F.col("_odds"))))
    rows = sizes.join(stash(odds(sizes, most)), [*key, "_digits"]).withColumn("_ratio", ratio)
    settled = rows.filter(F.col("_ratio").isNull()).withColumn("_extra", F.lit(0))
    open_ = rows.filter(F.col("_ratio").isNotNull()).withColumn("_before", F.lit(0).cast("long"))
    place = F.col("_ratio") / (1 + F.col("_ratio"))
    for k in range(1, LEVELS + 1):
        cell = F.least(F.floor(place * float(RANGES**k)), F.lit(RANGES**k - 1)) % RANGES
        open_ = open_.withColumn("_cell", cell.cast("int"))
        running = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        sums = open_.groupBy(*key, "_cell").agg(F.sum("size").alias("_sum"), F.max("_before").alias("_start"))
        sums = sums.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_sum").over(running), F.lit(0)))
        placed = open_.drop("_before").join(sums, [*key, "_cell"])
        passing = (F.col("_start") <= F.col("_left")) & (F.col("_start") + F.col("_sum") > F.col("_left"))
        settled = settled.unionByName(placed.filter(~passing).withColumn("_extra", (F.col("_start") + F.col("_sum") <= F.col("_left")).cast("int")).select(settled.columns))
        open_ = placed.filter(passing).withColumnRenamed("_start", "_before").drop("_cell", "_sum")
    inside = Window.partitionBy(*key).orderBy("_ratio", "_number", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # A document is taken if more than half of it fits, so that the sum ends as near the target as it can.
    half = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2 <= F.col("_left")
    both = settled.unionByName(open_.withColumn("_extra", half.cast("int")).select(settled.columns))
    copies = (F.col("_whole") + F.col("_extra")).cast("long")
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.col("_odds").alias("odds"), *also)


ORACLE = """
WITH sizes AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         source IS NULL AS none, coalesce(source, '') AS src,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS number
  FROM documents),
digits AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END::BIGINT AS digits FROM sizes),
sources AS (SELECT none, src, sum(size)::BIGINT AS source_size FROM sizes GROUP BY ALL),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY none, src) - 1) % 3 + 1)::INT] AS weight FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size) OVER (ORDER BY source_size * 3 / weight, none, src
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3)::DOUBLE
          / sum(weight) OVER (ORDER BY source_size * 3 / weight, none, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
filled AS (SELECT none, src, source_size, least((source_size * 3)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
classes AS (SELECT none, src, digits, sum(size)::BIGINT AS words FROM digits GROUP BY ALL),
-- c for each number of longest classes that are held at 3 copies; the largest is the one that meets the target
rates AS (
  SELECT c.*, f.source_size, f.target,
         CASE WHEN words * digits > 0 THEN
           (target - coalesce(sum(words) OVER (PARTITION BY none, src ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 3)
           / (sum(words * digits) OVER (PARTITION BY none, src ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE END AS c
  FROM classes c JOIN filled f USING (none, src)),
wanted AS (SELECT *, coalesce(least(3.0::DOUBLE, max(c) OVER (PARTITION BY none, src) * digits), 0.0::DOUBLE) AS copies FROM rates),
parts AS (SELECT *, floor(copies + 1e-9)::BIGINT AS whole FROM wanted),
fractions AS (SELECT *, CASE WHEN copies - whole > 1e-9 THEN copies - whole ELSE 0.0::DOUBLE END AS odds,
                     target - (sum(whole * words) OVER (PARTITION BY none, src))::DOUBLE AS remaining FROM parts),
numbered AS (SELECT *, (number + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM digits JOIN fractions USING (none, src, digits)),
ranked AS (SELECT *, CASE WHEN odds > 0 THEN u / (1 - u) / (odds / (1 - odds)) END AS ratio FROM numbered),
running AS (
  SELECT *, coalesce(sum(CASE WHEN odds > 0 THEN size ELSE 0 END) OVER (PARTITION BY none, src ORDER BY ratio NULLS LAST, number, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM ranked)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, odds FROM (
  SELECT doc_id, size, source_size, target, odds, whole + CASE WHEN odds > 0 AND before + size / 2 <= remaining THEN 1 ELSE 0 END AS copies FROM running)
"""
