"""Vector queries: every row whose id is divisible by 100 asks, all rows answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import vector_search as S
from tessella.plans.registry import query
from tessella.session import table

K = 8
MIN_SCORE = 0.55
_PAIRS = """WITH p AS (SELECT q.vec_id AS query_id, d.vec_id AS id, d.label, q.label AS asked,
    round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))
      / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
      / sqrt(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))), 12) AS score
  FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id {}),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id{} ORDER BY score DESC, id) AS rank FROM p)"""


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.filter("vec_id % 100 = 0")


def _nearest(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return S.exact_topk(vectors, _queries(vectors), k)


@query(_PAIRS.format("", "") + f" SELECT query_id, id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}")
def vec_topk_exact(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query(_PAIRS.format("AND q.vec_id % 3 = d.vec_id % 3", "") + f" SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}")
def vec_topk_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours within one of three chunk sets."""
    vectors = table(spark, d, "embeddings").withColumn("strategy", F.col("vec_id") % 3)
    return S.exact_topk(vectors, _queries(vectors), K, by="strategy").select("query_id", "id", "rank")


@query(_PAIRS.format("", "") + " SELECT query_id, id, round(score, 4) AS score FROM r WHERE rank = 1 AND score >= 0.3")
def vec_nearest_entity(spark: SparkSession, d: str) -> DataFrame:
    """The nearest row of each query, if it is near enough to stand in for an unmatched name."""
    return _nearest(spark, d, 1).filter("score >= 0.3").select("query_id", "id", F.round("score", 4).alias("score"))


@query(_PAIRS.format("", "") + f""" SELECT query_id, round(max(score), 4) AS top_score, max(score) < {MIN_SCORE} AS fallback,
  CASE WHEN max(score) < {MIN_SCORE} THEN 'vector_low_score' END AS reason FROM r WHERE rank <= {K} GROUP BY query_id""")
def vec_min_score_fallback(spark: SparkSession, d: str) -> DataFrame:
    low = F.max("score") < MIN_SCORE
    return _nearest(spark, d).groupBy("query_id").agg(
        F.round(F.max("score"), 4).alias("top_score"), low.alias("fallback"), F.when(low, F.lit("vector_low_score")).alias("reason")
    )


@query(_PAIRS.format("", "") + f""", n AS (SELECT label, count(*) AS m FROM embeddings GROUP BY label)
  SELECT query_id, CAST(sum((r.label = asked)::INT) AS BIGINT) AS hits,
    round(sum((r.label = asked)::INT) / least({K}, any_value(n.m) - 1), 6) AS recall_at_8,
    round(coalesce(1.0 / min(CASE WHEN r.label = asked THEN rank END), 0), 6) AS mrr
  FROM r JOIN n ON n.label = asked WHERE rank <= {K} GROUP BY query_id""")
def recall_and_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval quality with the rows of a query's label as the ones to find."""
    vectors = table(spark, d, "embeddings")
    sizes = vectors.groupBy("label").agg(F.count("*").alias("m")).withColumnRenamed("label", "asked")
    labels = vectors.select(F.col("vec_id").alias("id"), "label")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    rows = _nearest(spark, d).join(labels, "id").join(asked, "query_id").join(sizes, "asked")
    hit = F.col("label") == F.col("asked")
    return rows.groupBy("query_id").agg(
        F.count_if(hit).alias("hits"),
        F.round(F.count_if(hit) / F.least(F.lit(K), F.first("m") - 1), 6).alias("recall_at_8"),
        F.round(F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
    )


@query("""SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS length,
  len(embedding) AS dims FROM embeddings""")
def vec_norm_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("length"), F.size("embedding").cast("long").alias("dims"))


@query()
def vec_topk_indexed(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return S.indexed_topk(vectors, _queries(vectors), 10)


@query("SELECT TRUE AS enough")
def vec_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index finds 0.9 of the exact ten nearest of every asking row."""
    vectors = table(spark, d, "embeddings")
    exact = S.exact_topk(vectors, _queries(vectors), 10)
    return S.recall(S.indexed_topk(vectors, _queries(vectors), 10), exact, 10).select((F.col("recall") >= 0.9).alias("enough"))
