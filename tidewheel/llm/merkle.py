"""A Merkle manifest of a table: a tree for each source, a tree over the sources, and a proof for each row.

A node is (keys, place in its level, digest). In each level every node meets its siblings, the others of its run of ``fanout``,
by an equijoin on computed places: its own with the last bit turned (XOR) in a binary tree, else its run's first place plus each other
slot. Rows of slot zero then give out the parents, as they know the whole run. A node at place 0 without siblings is
alone in its level and so the root of its keys. From the top down each node gets its path, the siblings of every level above,
by a join with its parent; no group is larger than a run, however large a source is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import crc32_sql, number
from .shared import stash, tasks

#: Fixed values of the contract.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
TAMPERED = 5


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' texts."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value's text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def with_siblings(nodes: DataFrame, keys: Sequence[str], fanout: int) -> DataFrame:
    """Add ``_slot``, a node's place in its run, and ``_others``, the digests of the run's other nodes in order."""
    slot = F.col("_i") % fanout
    if fanout == 2:
        meets = F.array(F.col("_i").bitwiseXOR(F.lit(1).cast("long")))
    else:
        meets = F.transform(F.array(*[F.lit(k).cast("long") for k in range(1, fanout)]), lambda k: F.col("_i") - slot + (slot + k) % fanout)
    offered = nodes.select(*keys, F.explode(meets).alias("_i"), F.named_struct(F.lit("slot"), slot, F.lit("h"), F.col("_h")).alias("_other"))
    met = nodes.join(offered, [*keys, "_i"], "left").groupBy(*nodes.columns).agg(F.sort_array(F.collect_list("_other")).alias("_others"))
    return met.withColumn("_slot", slot.cast("int")).withColumn("_others", F.col("_others.h"))


_ALONE = "_i = 0 and size(_others) = 0"


def levels(leaves: DataFrame, keys: Sequence[str], fanout: int) -> list[DataFrame]:
    """The levels from the leaves up, each with its siblings and written once. Keys whose level has one node are not in the next."""
    nodes, out = leaves, []
    most = (leaves.agg(F.max("_i")).first()[0] or 0) + 1
    while True:
        out.append(stash(with_siblings(nodes, keys, fanout)))
        if most == 1:
            return out
        parent = F.unhex(digest(F.lower(F.hex("_h")), _hex(F.col("_others"))))
        nodes = out[-1].filter((F.col("_slot") == 0) & ~F.expr(_ALONE)).select(*keys, F.expr(f"_i div {fanout}").alias("_i"), parent.alias("_h"))
        most = -(-most // fanout)


def roots(tree: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, _h): the root of each key."""
    out = None
    for level in tree:
        alone = level.filter(_ALONE).select(*keys, "_h")
        out = alone if out is None else out.unionByName(alone)
    return out


def paths(tree: list[DataFrame], keys: Sequence[str], fanout: int, above: DataFrame) -> DataFrame:
    """The leaves with ``_path``, an array of (place, others) for each level from theirs up to the root, then what ``above`` has for the key.

    ``above`` has one row a key: the path from the key's root on, and any further columns, which are handed down.
    """
    carried = [c for c in above.columns if c not in keys]
    step = F.array(F.struct(F.col("_slot").alias("place"), F.col("_others").alias("others")))
    upper = None
    for level in reversed(tree):
        own = [c for c in level.columns if c not in ("_slot", "_others")]
        done = level.filter(_ALONE).join(above, list(keys)).select(*own, *carried)
        if upper is not None:
            parents = upper.select(*keys, F.col("_i").alias("_parent"), *carried)
            rest = level.filter(~F.expr(_ALONE)).withColumn("_parent", F.expr(f"_i div {fanout}")).join(parents, [*keys, "_parent"])
            done = done.unionByName(rest.withColumn("_path", F.concat(step, F.col("_path"))).select(*own, *carried))
        upper = done
    return upper


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and a path give."""
    join = lambda own, step: digest(_hex(F.slice(step["others"], 1, step["place"])), own, _hex(F.slice(step["others"], step["place"] + 1, F.size(step["others"]))))
    # A step without siblings is the whole run of one: its parent is the digest of it alone.
    return F.aggregate(path, leaf, join)


def proof(path: Column) -> Column:
    """The siblings of all levels, as hex texts, level by level."""
    return F.array_join(F.transform(path, lambda step: _hex(step["others"])), "")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", altered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row for each of ``docs``: ``order``, _leaf, _altered (binary digests), _subroot, _root, _path.

    ``altered`` gives other values for some fields; _altered is the leaf with them. Nulls: each field's is ``-``, the group null is a
    group of its own and the first, order null comes first. Rows of the same group and order follow each other by leaf; equal rows get
    neighbouring places, a row each. An empty table gives no rows. Columns that are no field count for nothing.
    """
    altered = altered or {}
    spark = docs.sparkSession
    leaf = digest(*[encoded(F.col(f"`{c}`")) for c in fields])
    other = digest(*[encoded(altered.get(c, F.col(f"`{c}`"))) for c in fields])
    rows = stash(
        docs.select(
            F.col(f"`{order}`").alias("_order"),
            F.col(f"`{group}`").isNotNull().alias("_known"),
            F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("")).alias("_group"),
            F.unhex(leaf).alias("_h"),
            F.unhex(other).alias("_altered"),
        )
    )
    n = tasks(spark, rows.count() * 100)
    keys = ["_known", "_group"]
    own = levels(number(rows, keys, ["_order", "_h"], n), keys, fanout)
    # One row a source from here on; they are numbered and joined in the same way.
    sources = stash(roots(own, keys).withColumn("_all", F.lit(0)))
    over = levels(number(sources, ["_all"], keys, n), ["_all"], fanout)
    top = roots(over, ["_all"]).select("_all", F.col("_h").alias("_root"), F.array().cast("array<struct<place:int,others:array<binary>>>").alias("_path"))
    above = paths(over, ["_all"], fanout, top).select(*keys, "_path", F.col("_h").alias("_subroot"), "_root")
    return paths(own, keys, fanout, stash(above)).select(F.col("_order").alias(order), F.col("_h").alias("_leaf"), "_altered", "_subroot", "_root", "_path")


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of documents, each proven against the root; where 5 divides the id's crc32, from a leaf whose text is lower-cased (A-Z).

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. A null text or id stays as it is. For other cases see ``manifest``.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    text = F.when(touched, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    rows = manifest(docs, altered={"text": text})
    low = lambda c: F.lower(F.hex(c))
    out = rows.select(
        "doc_id", low("_leaf").alias("leaf"), low("_subroot").alias("subroot"), low("_root").alias("root"),
        F.sha2(proof(F.col("_path")), 256).alias("proof_sha256"), folded(low("_altered"), F.col("_path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(most_levels: int = 8) -> str:
    """DuckDB SQL for ``verified``; trees of up to ``most_levels`` levels of 16."""
    one = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(one(text if c == "text" else c) for c in FIELDS) + ")"
    low = f"CASE WHEN {crc32_sql('doc_id')} % {TAMPERED} = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    parts = [
        f"rows AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(f'({low})')} AS other FROM documents)",
        "a0 AS (SELECT source AS k, doc_id, leaf, other, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM rows)",
        "a0n AS (SELECT k, i, h FROM a0)",
    ]

    def climb(name: str, first: str) -> None:
        """Level tables (k, i, h, hs, n): the run's digests and whether the key has more than one node."""
        source = first
        for level in range(most_levels):
            parts.append(f"{name}r{level} AS (SELECT k, i // 16 AS p, list(h ORDER BY i) AS hs FROM {source} GROUP BY ALL)")
            parts.append(f"{name}l{level} AS (SELECT n.k, n.i, n.h, r.hs, count(*) OVER (PARTITION BY n.k) AS n FROM {source} n JOIN {name}r{level} r ON n.k IS NOT DISTINCT FROM r.k AND n.i // 16 = r.p)")
            parts.append(f"{name}n{level + 1} AS (SELECT DISTINCT k, i // 16 AS i, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE h END AS h FROM {name}l{level})")
            source = f"{name}n{level + 1}"

    climb("a", "a0n")
    parts.append(f"subs AS (SELECT k AS s, h AS sub FROM an{most_levels})")
    parts.append("b0n AS (SELECT 0 AS k, row_number() OVER (ORDER BY encode(s) NULLS FIRST) - 1 AS i, sub AS h FROM subs)")
    parts.append("b0 AS (SELECT s, sub, row_number() OVER (ORDER BY encode(s) NULLS FIRST) - 1 AS i FROM subs)")
    climb("b", "b0n")
    parts.append(f"root AS (SELECT h AS root FROM bn{most_levels})")
    state = "SELECT a.doc_id, a.leaf, b.sub AS subroot, a.other AS f, '' AS proof, a.k, a.i, b.i AS j FROM a0 a JOIN b0 b ON a.k IS NOT DISTINCT FROM b.s"
    parts.append(f"s0 AS ({state})")
    step = 0
    for name, place, key in (("a", "i", "s.k IS NOT DISTINCT FROM l.k"), ("b", "j", "true")):
        for level in range(most_levels):
            left, right = f"array_to_string(l.hs[1:(s.{place} % 16)::INT], '')", f"array_to_string(l.hs[(s.{place} % 16 + 2)::INT:], '')"
            parts.append(
                f"s{step + 1} AS (SELECT doc_id, leaf, subroot, CASE WHEN l.n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f, "
                f"CASE WHEN l.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, s.k, {'s.i // 16 AS i, s.j' if name == 'a' else 's.i, s.j // 16 AS j'} "
                f"FROM s{step} s JOIN {name}l{level} l ON {key} AND l.i = s.{place})"
            )
            step += 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM s{step}, root"
