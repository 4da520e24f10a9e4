"""Exact and approximate nearest neighbours by cosine, query set against all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import unit

#: Rows in a block of data and in a block of queries; a task multiplies one by the other.
DATA_BLOCK, QUERY_BLOCK = 32_768, 4_096


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), np.float64)
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(lengths == 0, 1, lengths)


def _best(queries: pd.DataFrame, data: pd.DataFrame, k: int, leave_self: bool) -> pd.DataFrame:
    """The k best rows of `data` for each query, the lower id first among equals."""
    if queries.empty or data.empty:
        return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
    data = data.sort_values("id", kind="stable")
    ids, right, left = data["id"].to_numpy(), _units(data["v"]), _units(queries["v"])
    out = []
    for at in range(0, len(left), 512):
        scores = np.round(left[at : at + 512] @ right.T, 12)
        keys = queries["query_id"].to_numpy()[at : at + 512]
        if leave_self:
            scores[keys[:, None] == ids[None, :]] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(scores, order, 1)
        frame = pd.DataFrame({"query_id": np.repeat(keys, order.shape[1]), "id": ids[order.ravel()], "score": found.ravel()})
        out.append(frame[np.isfinite(frame["score"])])
    return pd.concat(out)


def _against(queries: pd.DataFrame, k: int, leave_self: bool):
    """Each task's k best rows of the data for each query of the same group."""
    groups = dict(list(queries.groupby("g", dropna=False)))

    def shortened(found: list[pd.DataFrame]) -> list[pd.DataFrame]:
        rows = pd.concat(found).sort_values(["query_id", "score", "id"], ascending=[True, False, True])
        return [rows.groupby("query_id", sort=False).head(k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[pd.DataFrame] = []
        for batch in batches:
            for g, rows in batch.groupby("g", dropna=False):
                if g in groups:
                    found.append(_best(groups[g], rows, k, leave_self))
            if len(found) >= 32:
                found = shortened(found)
        if found:
            yield shortened(found)[0]

    return run


def _blocks(df: DataFrame, count: int, size: int) -> int:
    return max(1, math.ceil(count / size))


def exact_topk(
    data: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", leave_self: bool = True, by: str | None = None
) -> DataFrame:
    """(query_id, id, score, rank): each query's k nearest rows, optionally within `by`.

    Up to QUERY_BLOCK queries go to the tasks that read the data, which leave at most k rows a query each, so
    no vector is shuffled. More queries meet the data in blocks; each meeting is one task of bounded size.
    Rows without a vector are no answers.
    """
    # Null is a group of its own.
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")) if by else F.lit("")
    data = data.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), group.alias("g"))
    queries = queries.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("v"), group.alias("g"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    few = queries.limit(QUERY_BLOCK + 1).toPandas()
    if len(few) <= QUERY_BLOCK:
        met = data.mapInPandas(_against(few, k, leave_self), "query_id long, id long, score double")
        return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    d, q = _blocks(data, data.count(), DATA_BLOCK), _blocks(queries, queries.count(), QUERY_BLOCK)
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q))).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    right = data.withColumn("db", F.pmod(F.xxhash64("id"), F.lit(d))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    casts = {"qb": F.col("qb").cast("int"), "db": F.col("db").cast("int")}

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best(a, b, k, leave_self)[["query_id", "id", "score"]]

    keys = ["g", "qb", "db"]
    met = left.withColumns(casts).groupBy(*keys).cogroup(right.withColumns(casts).groupBy(*keys)).applyInPandas(meet, "query_id long, id long, score double")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def fit_cells(data: DataFrame, vector_col: str, cells: int, sample: int = 20_000, seed: int = 7) -> np.ndarray:
    """Centres of `cells` cells of the unit vectors, fitted on at most about `sample` rows."""
    rows = data.filter(F.col(vector_col).isNotNull()).select(array_to_vector(unit(F.col(vector_col))).alias("features"))
    share = min(1.0, sample / max(1, rows.count()))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(rows.sample(share, seed) if share < 1 else rows)
    return np.array(model.clusterCenters())


def _cells_of(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            distances = ((_units(batch["v"])[:, None, :] - centres[None, :, :]) ** 2).sum(2) if len(batch) else np.zeros((0, len(centres)))
            near = np.argsort(distances, axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({"id": batch["id"].repeat(near.shape[1]).to_numpy(), "v": batch["v"].repeat(near.shape[1]).to_numpy(), "cell": near.ravel().astype("int32")})

    return run


def indexed_topk(data: DataFrame, queries: DataFrame, k: int, cells: int = 16, probes: int = 12, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) by an index of cells: every row is in its nearest cell, a query
    looks into its `probes` nearest. Approximate; see the measured recall."""
    centres = fit_cells(data, vector_col, cells)
    slim = lambda df: df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    schema = "id long, v array<float>, cell int"
    indexed = slim(data).mapInPandas(_cells_of(centres, 1), schema)
    looking = slim(queries).mapInPandas(_cells_of(centres, probes), schema).withColumnRenamed("id", "query_id")
    # A cell of many rows is spread over salts; a query meets each of them.
    salts = max(1, math.ceil(data.count() / (cells * DATA_BLOCK) * 4))
    indexed = indexed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    looking = looking.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best(a, b, k, True)[["query_id", "id", "score"]]

    met = looking.groupBy("cell", "salt").cogroup(indexed.groupBy("cell", "salt")).applyInPandas(meet, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall,): share of the true neighbours that were found."""
    pairs = truth.select("query_id", "id")
    hits = pairs.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").agg(F.count("*").alias("hits"))
    return hits.crossJoin(pairs.agg(F.count("*").alias("all"))).select((F.col("hits") / F.col("all")).alias("recall"))
