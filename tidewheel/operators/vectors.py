"""Text embeddings by a pluggable model, and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that one broadcast block holds, about.
BLOCK_BYTES = 32 << 20
#: Rows that an index is fitted on at most.
SAMPLE = 20_000
#: Rows, and queries, of a cell that meet in one group, about.
GROUP = 20_000


def hashed_ngrams(texts: list[str], width: int = 64, n: int = 3) -> np.ndarray:
    """A deterministic embedding: counts of character n-grams in hashed places, of length 1."""
    out = np.zeros((len(texts), width), np.float32)
    for k, t in enumerate(texts):
        points = np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(points) >= n:
            code = np.zeros(len(points) - n + 1, np.uint64)
            for j in range(n):
                code = code * np.uint64(1000003) + points[j : len(points) - n + 1 + j]
            code ^= code >> np.uint64(15)
            out[k] = np.bincount((code % np.uint64(width)).astype(np.int64), minlength=width)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def embed(df: DataFrame, text: str, name: str = "vector", model: Callable[[list[str]], np.ndarray] = hashed_ngrams) -> DataFrame:
    """Add the model's vector of each text (null counts as empty), in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model([t or "" for t in texts])))

    return df.withColumn(name, run(F.col(text)))


def complete(df: DataFrame, prompt: Column, model: Callable[[list[str]], list[str]], name: str = "completion") -> DataFrame:
    """Add what ``model`` returns for each prompt; it is called with batches of prompts. A null prompt gives null."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        asked = prompts.notna()
        out = pd.Series([None] * len(prompts), dtype=object)
        out[asked] = model(prompts[asked].tolist())
        return out

    return df.withColumn(name, run(prompt))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(vectors) -> np.ndarray:
    own = np.stack(list(vectors)).astype(np.float64)
    return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores of each row, ties by name: only what reaches the k-th greatest is sorted."""
    if scores.shape[1] > 4 * k:
        least = np.partition(scores, -k, axis=1)[:, -k]
        return [c[np.lexsort((names[c], -row[c]))[:k]] for row, c in ((row, np.flatnonzero(row >= low)) for row, low in zip(scores, least, strict=True))]
    return [np.lexsort((names, -row))[:k] for row in scores]


def nearest(table: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k rows of ``table`` most like each query by cosine: query_key, key, similarity, rank; ties by key.

    The queries are the stated set that is held against all rows: as many as ``block_bytes`` hold are broadcast to one pass over the
    table, in which a task keeps k rows a query, by a matrix product a batch; then the tasks' rows are merged. More queries take more
    passes. For many queries see ``search``. Null vectors and queries without one are left out.
    """
    spark = table.sparkSession
    known = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_key).alias("id"), F.col(query_vector).alias("v"))
    size = known.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    blocks = max(1, -(-size.n * (size.width or 1) * 8 // block_bytes))
    out = None
    for b in range(blocks):
        held = (known.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else known).collect()  # a block, of proven size
        if held:
            passed = _pass(table, key, vector, spark.sparkContext.broadcast(([r.id for r in held], _unit([r.v for r in held]))), query_key, k)
            out = passed if out is None else out.unionByName(passed)
    if out is None:
        out = spark.createDataFrame([], f"{query_key} long, {key} long, similarity double")
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), key)).cast("long")
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _pass(table: DataFrame, key: str, vector: str, shared, query_key: str, k: int) -> DataFrame:
    def run(batches):
        ids, matrix = shared.value
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for pdf in batches:
            pdf = pdf[pdf[vector].notna()]
            if len(pdf):
                names = pdf[key].to_numpy()
                scores = matrix @ _unit(pdf[vector]).T
                for q, top in enumerate(_best(scores, names, k)):
                    best[q] = sorted([*best[q], *((-scores[q, i], names[i]) for i in top)])[:k]
        yield pd.DataFrame([(ids[q], n, -s) for q in range(len(ids)) for s, n in best[q]], columns=[query_key, key, "similarity"])

    return table.select(key, vector).mapInPandas(run, f"{query_key} long, {key} long, similarity double")


def fit_cells(table: DataFrame, vector: str, cells: int | None = None, sample: int = SAMPLE, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of the cells of an index: k-means by cosine over at most ``sample`` rows, those with the least hash of their vector.

    The sample is the only part of the table that the driver sees, and its size is the parameter's, whatever the table holds; so are the centres',
    of which there are by default as many as the root of the rows, 4096 at most.
    """
    known = table.filter(F.col(vector).isNotNull())
    n = known.count()
    rows = known.select(F.col(vector).alias("v")).orderBy(F.xxhash64("v", F.lit(seed))).limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    points = _unit([r.v for r in rows])
    k = min(cells or int(n**0.5) or 1, 4096, len(points))
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def assign(df: DataFrame, vector: str, centres: np.ndarray, name: str = "cells", most: int = 1) -> DataFrame:
    """Add ``name``, the numbers of the ``most`` nearest cells, nearest first; null for a null vector. Every row is assigned."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        known = np.flatnonzero(vectors.notna())
        if len(known):
            scores = _unit(vectors.iloc[known]) @ shared.value.T
            for i, row in zip(known, np.argsort(-scores, axis=1, kind="stable")[:, :most], strict=True):
                out[i] = row.astype(np.int32)
        return pd.Series(out, dtype=object)

    return df.withColumn(name, run(F.col(vector)))


def search(table: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 3, centres: np.ndarray | None = None, probes: int = 8, group: int = GROUP) -> DataFrame:
    """Approximate ``nearest`` by a partitioned index, for query sets of any size: one pass over table and queries, no driver loop.

    Rows lie in the cell of their nearest centre, a query looks into its ``probes`` nearest ones, and there all rows are ranked
    exactly. Rows and queries meet by cell; a cell of more than ``group`` rows or queries is split into parts of at most about so many, each part of the
    rows meeting each part of the queries, so no task holds a cell. A row that is not in a probed cell is missed: raise ``probes`` for recall; with as
    many as there are centres the result is exact.
    """
    spark = table.sparkSession
    centres = fit_cells(table, vector) if centres is None else centres
    if not len(centres):
        return spark.createDataFrame([], f"{query_key} long, {key} long, similarity double, rank long")
    cell = F.explode("_cells").alias("_cell")
    rows = assign(table.select(F.col(key).alias("_id"), F.col(vector).alias("_v")), "_v", centres, "_cells").select("_id", "_v", cell)
    asked = assign(queries.select(F.col(query_key).alias("_id"), F.col(query_vector).alias("_v")), "_v", centres, "_cells", probes).select("_id", "_v", cell)
    # One row a cell: at most 4096.
    parts = lambda df, name: df.groupBy("_cell").agg(F.ceil(F.count("*") / group).cast("int").alias(name))
    splits = F.broadcast(parts(rows, "_r").join(parts(asked, "_q"), "_cell"))
    pick = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.join(splits, "_cell").withColumn("_i", pick("_r")).withColumn("_j", each("_q")).drop("_r", "_q")
    asked = asked.join(splits, "_cell").withColumn("_j", pick("_q")).withColumn("_i", each("_r")).drop("_r", "_q")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            names, own, ids = left["_id"].to_numpy(), _unit(left["_v"]), right["_id"].to_numpy()
            for b in range(0, len(right), 512):
                scores = _unit(right["_v"].iloc[b : b + 512]) @ own.T
                for q, top in enumerate(_best(scores, names, k)):
                    out += [(ids[b + q], names[i], scores[q, i]) for i in top]
        return pd.DataFrame(out, columns=[query_key, key, "similarity"])

    where = ["_cell", "_i", "_j"]
    found = rows.groupBy(*where).cogroup(asked.groupBy(*where)).applyInPandas(meet, f"{query_key} long, {key} long, similarity double")
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), key)).cast("long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
