"""Queries over questions and their routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import routing as R
from tessella.operators import telemetry
from tessella.operators import vector_search as S
from tessella.plans.registry import query
from tessella.plans.vectors import _PAIRS
from tessella.session import table

_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_WORD, _NAMES = R.WORD.replace("'", "''"), R.NAMES.replace("'", "''")
_CUES = f"""WITH g AS (SELECT DISTINCT id, question, lower(trim(type)) AS label FROM gold_items WHERE question IS NOT NULL),
  w AS (SELECT *, regexp_extract_all(question, '{_WORD}') AS words, list_transform(regexp_extract_all(question, '{_WORD}'), lambda x: lower(x)) AS lo FROM g),
  c AS (SELECT id, label, question,
    contains(' ' || array_to_string(lo, ' ') || ' ', ' or ')::INT AS or_choice,
    list_has_any(lo, ['both', 'either', 'neither'])::INT AS both_either,
    regexp_matches(array_to_string(lo, ' '), '\\b(same|in common|share[ds]?|different|similar)\\b')::INT AS shared,
    list_has_any(lo, {_list(R.COMPARATIVE)})::INT AS comparative,
    coalesce(list_contains({_list(R.AUXILIARY)}, lo[1]), FALSE)::INT AS yes_no,
    regexp_matches(question, '{_NAMES}')::INT AS and_names,
    (len(list_filter(range(3, len(lo) + 1), lambda i: list_contains({_list(R.RELATIVE)}, lo[i]) AND NOT list_contains({_list(R.PREPOSITIONS)}, lo[i - 1]))) > 0)::INT AS relative_clause,
    regexp_matches(question, '[\\p{{L}}\\p{{N}}_][''’]s\\b')::INT AS possessive,
    coalesce(list_contains({_list(R.WH)}, lo[1]) OR (list_contains({_list(R.PREPOSITIONS)}, lo[1]) AND list_contains(['which', 'what'], lo[2])), FALSE)::INT AS wh_start,
    round(least(len(regexp_extract_all(question, '(?i)\\bof (?:the|a|an)\\b')), 3) / 3, 6) AS of_chain,
    round(least(len(list_filter(words[2:], lambda x: regexp_matches(substr(x, 1, 1), '\\p{{Lu}}'))), 5) / 5, 6) AS names,
    round(least(len(words), 40) / 40, 6) AS length FROM w),
  v AS (SELECT *, or_choice + both_either + shared + and_names + comparative * greatest(or_choice, and_names) + yes_no * and_names AS comparison,
    relative_clause + possessive + (of_chain > 0)::INT + (round(length * 40) >= 15)::INT AS multi_hop FROM c),
  s AS (SELECT *, wh_start * (comparison = 0 AND multi_hop = 0 AND round(length * 40) < 12)::INT AS single_hop FROM v),
  b AS (SELECT *, CASE WHEN single_hop >= multi_hop AND single_hop >= comparison THEN 'single_hop' WHEN multi_hop >= comparison THEN 'multi_hop' ELSE 'comparison' END AS winner,
    least(3, list_sort([single_hop, multi_hop, comparison], 'DESC')[1] - list_sort([single_hop, multi_hop, comparison], 'DESC')[2]) AS margin FROM s)"""
_CUE_NAMES = ["or_choice", "both_either", "shared", "comparative", "yes_no", "and_names", "relative_clause", "possessive", "wh_start", "of_chain", "names", "length"]


def _questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gold_items").filter("question is not null").select("id", "question", F.lower(F.trim("type")).alias("label")).distinct()
    return rows.select("*", *(v.alias(k) for k, v in R.cues(F.col("question")).items()))


@query(_CUES + f" SELECT id, md5(question) AS print, {', '.join(_CUE_NAMES)} FROM c")
def cue_features(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("id", F.md5("question").alias("print"), *_CUE_NAMES)


@query(_CUES + " SELECT id, md5(question) AS print, single_hop, multi_hop, comparison, winner, margin FROM b")
def rule_votes(spark: SparkSession, d: str) -> DataFrame:
    return R.votes(_questions(spark, d)).select("id", F.md5("question").alias("print"), "single_hop", "multi_hop", "comparison", "winner", "margin")


@query(_CUES + " SELECT winner, margin, label, count(*) AS n FROM b GROUP BY ALL")
def rule_buckets(spark: SparkSession, d: str) -> DataFrame:
    return R.votes(_questions(spark, d)).groupBy("winner", "margin", "label").agg(F.count("*").alias("n"))


@query(_CUES + """, k AS (SELECT winner, margin, count(*) AS total, sum((label = winner)::INT) AS ok FROM b GROUP BY ALL),
  f AS (SELECT b.*, round((coalesce(ok, 0) + 1) / (total + 3), 6) AS confidence FROM b JOIN k ON b.winner = k.winner AND b.margin = k.margin)
  SELECT id, md5(question) AS print, winner, confidence, CASE WHEN confidence < 0.85 THEN 'hybrid' WHEN winner = 'single_hop' THEN 'vector' ELSE 'hybrid' END AS route FROM f""")
def decision_table(spark: SparkSession, d: str) -> DataFrame:
    """The initial route of each question by calibrated rules; relational ones go to hybrid."""
    voted = R.votes(_questions(spark, d))
    rows = R.calibrated(voted, voted)
    route = R.initial_route(F.col("winner"), F.col("confidence"), F.lit(True), 0.85, "hybrid")
    return rows.select("id", F.md5("question").alias("print"), "winner", "confidence", route.alias("route"))


_R = """r AS (SELECT DISTINCT question_id, run_id, nullif(lower(trim(route_taken)), '') AS route, nullif(lower(trim(gold_type)), '') AS label,
    CAST(f1 AS DOUBLE) AS f1, CAST(cost_usd AS DOUBLE) AS cost, CAST(mrr AS DOUBLE) AS top, CAST(recall_at_k AS DOUBLE) AS conf FROM eval_results),
  p AS (SELECT question_id, any_value(label) AS label, avg(conf) AS conf, avg(top) AS top, max(top) > 0.5 AS path,
    avg(f1) FILTER (route = 'vector') AS f_v, avg(f1) FILTER (route = 'graph') AS f_g, avg(f1) FILTER (route = 'hybrid') AS f_h,
    avg(cost) FILTER (route = 'vector') AS c_v, avg(cost) FILTER (route = 'graph') AS c_g, avg(cost) FILTER (route = 'hybrid') AS c_h
    FROM r WHERE label IS NOT NULL GROUP BY question_id HAVING count(DISTINCT label) = 1),
  q AS (SELECT * FROM p WHERE f_v IS NOT NULL AND f_g IS NOT NULL AND f_h IS NOT NULL AND c_v IS NOT NULL AND c_g IS NOT NULL AND c_h IS NOT NULL AND conf IS NOT NULL AND top IS NOT NULL),
  t AS (SELECT a.range AS i, b.range AS j, a.range * 0.1::DOUBLE AS mc, b.range * 0.1::DOUBLE AS ms FROM range(11) a, range(11) b),
  x AS (SELECT i, j, f_v, f_g, f_h, c_v, c_g, c_h, CASE WHEN conf < mc THEN 'hybrid' WHEN label = 'single_hop' THEN CASE WHEN top >= ms THEN 'vector' ELSE 'hybrid' END
    WHEN path THEN 'graph' ELSE 'hybrid' END AS route FROM q, t)"""


@query("WITH " + _R + """ SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, count(*) AS n,
  round(avg(CASE route WHEN 'vector' THEN f_v WHEN 'graph' THEN f_g ELSE f_h END), 6) AS f1,
  round(avg(CASE route WHEN 'vector' THEN c_v WHEN 'graph' THEN c_g ELSE c_h END), 10) AS cost,
  count(*) FILTER (route = 'vector') AS vector, count(*) FILTER (route = 'graph') AS graph FROM x GROUP BY i, j""")
def policy_replay_grid(spark: SparkSession, d: str) -> DataFrame:
    """What each of 121 pairs of thresholds would have scored, over the questions that all three
    routes answered; mean recall stands for confidence, mean reciprocal rank for the top score."""
    rows = telemetry.once(table(spark, d, "eval_results")).filter("gold_type is not null")
    number = lambda c: F.col(c).cast("double")
    of = lambda c, r: F.avg(F.when(F.col("route_taken") == r, number(c)))
    routes = ("vector", "graph", "hybrid")
    wide = rows.groupBy("question_id").agg(
        F.first("gold_type").alias("label"), F.count_distinct("gold_type").alias("labels"), F.avg(number("recall_at_k")).alias("conf"), F.avg(number("mrr")).alias("top"),
        (F.max(number("mrr")) > 0.5).alias("path"), *(of("f1", r).alias(f"f1_{r}") for r in routes), *(of("cost_usd", r).alias(f"cost_{r}") for r in routes),
    ).filter("labels = 1").dropna()
    grid = spark.range(121).select((F.col("id") % 11).cast("int").alias("j"), F.floor(F.col("id") / 11).cast("int").alias("i"))
    both = wide.crossJoin(F.broadcast(grid))  # 121 rows
    route = R.replayed_route(F.col("label"), F.col("conf"), F.col("top"), F.col("path"), F.col("i") * 0.1, F.col("j") * 0.1)
    both = both.withColumn("route", route)
    pick = lambda m: F.when(F.col("route") == "vector", F.col(f"{m}_vector")).when(F.col("route") == "graph", F.col(f"{m}_graph")).otherwise(F.col(f"{m}_hybrid"))
    return both.groupBy("i", "j").agg(
        F.count("*").alias("n"), F.round(F.avg(pick("f1")), 6).alias("f1"), F.round(F.avg(pick("cost")), 10).alias("cost"),
        F.count_if(F.col("route") == "vector").alias("vector"), F.count_if(F.col("route") == "graph").alias("graph"),
    )


@query("""WITH r AS (SELECT DISTINCT run_id, question_id, nullif(lower(trim(route_taken)), '') AS route, nullif(lower(trim(predicted_type)), '') AS label,
    CASE WHEN latency_ms >= 0 AND latency_ms < 2147483647 THEN latency_ms END AS tokens, recorded_at, trace_id FROM eval_results)
  SELECT CASE WHEN label IN ('multi_hop', 'comparison') THEN 'large' WHEN tokens > 2500 THEN 'large' ELSE 'small' END AS size, route, label, count(*) AS n
  FROM r WHERE route IS NOT NULL AND tokens IS NOT NULL GROUP BY ALL""")
def model_selector(spark: SparkSession, d: str) -> DataFrame:
    """Large or small model by label and length of context; latencies stand for token counts."""
    rows = telemetry.once(table(spark, d, "eval_results")).select("run_id", "question_id", "route_taken", "predicted_type", "latency_ms", "recorded_at", "trace_id").distinct()
    rows = rows.filter("route_taken is not null and latency_ms is not null")
    chosen = rows.withColumn("m", R.model_size(F.col("route_taken"), F.col("predicted_type"), F.col("latency_ms")))
    return chosen.groupBy(F.col("m.size").alias("size"), F.col("route_taken").alias("route"), F.col("predicted_type").alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT run_id, question_id, round(0.5 * CAST(sp_precision AS DOUBLE) + 0.5 * CASE nullif(lower(trim(route_taken)), '')
    WHEN 'hybrid' THEN (least(1.0, CAST(mrr AS DOUBLE) / 0.55) + CASE WHEN recall_at_k > 0.5 THEN 1.0 ELSE 0.3 END) / 2
    WHEN 'graph' THEN CASE WHEN recall_at_k > 0.5 THEN 1.0 ELSE 0.3 END ELSE least(1.0, CAST(mrr AS DOUBLE) / 0.55) END, 4) AS confidence
  FROM (SELECT DISTINCT * FROM eval_results) WHERE sp_precision IS NOT NULL AND mrr IS NOT NULL AND recall_at_k IS NOT NULL""")
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Sentence precision stands for citation coverage, reciprocal rank for the top score."""
    rows = telemetry.once(table(spark, d, "eval_results")).dropna(subset=["sp_precision", "mrr", "recall_at_k"])
    score = R.answer_confidence(F.col("sp_precision").cast("double"), F.col("mrr").cast("double"), F.col("recall_at_k") > 0.5, F.coalesce("route_taken", F.lit("vector")))
    return rows.select("run_id", "question_id", score.alias("confidence"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").withColumn("strategy", F.col("vec_id") % 3)
    asked = vectors.filter("vec_id % 100 = 0")
    one = S.exact_topk(vectors, asked, 8).select("query_id", F.lit(0).alias("list"), "id", "rank")
    return one.unionByName(S.exact_topk(vectors, asked, 8, by="strategy").select("query_id", F.lit(1).alias("list"), "id", "rank"))


@query(_PAIRS.format("", "").replace("r AS (SELECT *,", "r AS (SELECT *, row_number() OVER (PARTITION BY query_id, query_id % 3 = id % 3 ORDER BY score DESC, id) AS own,", 1) + """,
  l AS (SELECT query_id, 0 AS list, id, rank FROM r WHERE rank <= 8 UNION ALL SELECT query_id, 1, id, own FROM r WHERE query_id % 3 = id % 3 AND own <= 8),
  f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, count(*) AS n, min(list) AS one, min(list * 100 + rank) AS first FROM l GROUP BY ALL)
  SELECT query_id, id, score, CASE WHEN n > 1 THEN 'hybrid' WHEN one = 0 THEN 'vector' ELSE 'graph' END AS source,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS rank FROM f""")
def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    return R.fused(_lists(spark, d))


@query()
def mmr_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Fused hits, diversified."""
    vectors = table(spark, d, "embeddings")
    hits = R.fused(_lists(spark, d)).select("query_id", "id", "rank")
    hits = hits.join(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id", "left")
    hits = hits.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    return R.diversified(hits)


@query()
def logreg_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of dev and test questions by a multinomial regression on the cues, fitted on train."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.classification import LogisticRegression

    split = table(spark, d, "gold_items").select("id", F.lower(F.trim("split")).alias("split")).filter("split <> ''").distinct()
    rows = VectorAssembler(inputCols=_CUE_NAMES, outputCol="features").transform(_questions(spark, d).filter("label is not null").join(split, "id"))
    index = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc").fit(rows)
    train = index.transform(rows.filter("split = 'train'"))
    model = LogisticRegression(featuresCol="features", labelCol="target", regParam=0.001, maxIter=60).fit(train)
    said = model.transform(index.transform(rows.filter("split <> 'train'")))
    names = F.array(*map(F.lit, index.labels))
    return said.select("id", "label", F.get(names, F.col("prediction").cast("int")).alias("predicted"))


@query()
def logreg_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy of the regression by type."""
    return logreg_types(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 4).alias("accuracy"))
