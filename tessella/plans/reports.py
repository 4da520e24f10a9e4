"""Reports on runs, checks on gold items and documents, costs of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.models import billed_output, class_probabilities, list_cost
from tessella.functions.vectors import softmax
from tessella.operators import telemetry as T
from tessella.plans.evaluation import _R, FLOOR, _results
from tessella.plans.registry import query
from tessella.session import table

_MEANS = ", ".join(f"round(avg(CAST({m} AS DOUBLE)), 6) AS {m}" for m in T.METRICS)
_SCORES = ("faithfulness", "relevance", "completeness")


@query(_R + """, s AS (SELECT * FROM r WHERE gold_type IS NOT NULL AND predicted_type IS NOT NULL),
  l AS (SELECT gold_type AS label FROM s UNION SELECT predicted_type FROM s),
  f AS (SELECT label, (SELECT count(*) FROM s WHERE gold_type = label AND predicted_type = label) AS ok,
    (SELECT count(*) FROM s WHERE gold_type = label) + (SELECT count(*) FROM s WHERE predicted_type = label) AS both_sides FROM l)
  SELECT round(avg(2 * ok / both_sides), 6) AS macro_f1, count(*) AS n_labels FROM f""")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    """The mean F1 of all labels that are given or said; one row."""
    seen = _results(spark, d).filter("gold_type is not null and predicted_type is not null")
    right = (F.col("gold_type") == F.col("predicted_type")).cast("int")
    sides = seen.select(F.explode(F.array("gold_type", "predicted_type")).alias("label"), right.alias("right"))
    # A right answer stands on both sides: the sum is 2 x right.
    f1 = sides.groupBy("label").agg((F.sum("right") / F.count("*")).alias("f1"))
    return f1.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("n_labels"))


@query(_R + f""" SELECT run_id, gold_type, CASE WHEN grouping(gold_type) = 1 THEN 'run' ELSE 'type' END AS level, count(*) AS n, {_MEANS},
  count(*) - count(faithfulness) AS n_unjudged FROM r GROUP BY GROUPING SETS ((run_id), (run_id, gold_type))""")
def run_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of all metrics of each run and of its types, in one pass."""
    rows = _results(spark, d).groupingSets([["run_id"], ["run_id", "gold_type"]], "run_id", "gold_type").agg(
        F.grouping("gold_type").alias("all_types"), F.count("*").alias("n"), *(T.mean(m).alias(m) for m in T.METRICS),
        (F.count("*") - F.count("faithfulness")).alias("n_unjudged"),
    )
    return rows.withColumn("level", F.when(F.col("all_types") == 1, "run").otherwise("type")).drop("all_types")


@query(_R + """ SELECT run_id, question_id FROM r WHERE faithfulness IS NULL AND run_id IN (SELECT run_id FROM r WHERE faithfulness IS NOT NULL)""")
def judge_failures(spark: SparkSession, d: str) -> DataFrame:
    """Results without a score in runs that were judged."""
    rows = _results(spark, d).select("run_id", "question_id", "faithfulness")
    judged = rows.filter("faithfulness is not null").select("run_id").distinct()
    return rows.filter("faithfulness is null").join(judged, "run_id", "left_semi").select("run_id", "question_id")


@query(_R + """, s AS (SELECT run_id, gold_type, avg(CAST(f1 AS DOUBLE)) AS f1, avg(CAST(em AS DOUBLE)) AS em, avg(CAST(mrr AS DOUBLE)) AS mrr FROM r WHERE gold_type IS NOT NULL GROUP BY ALL),
  p AS (SELECT run_id, lag(run_id) OVER (PARTITION BY split, mode ORDER BY created_at, run_id) AS previous FROM eval_runs)
  SELECT p.run_id, p.previous, a.gold_type, round(a.f1 - b.f1, 6) AS f1_diff, round(a.em - b.em, 6) AS em_diff, round(a.mrr - b.mrr, 6) AS mrr_diff
  FROM p JOIN s a ON a.run_id = p.run_id JOIN s b ON b.run_id = p.previous AND b.gold_type = a.gold_type""")
def type_deltas(spark: SparkSession, d: str) -> DataFrame:
    """New minus old means by type, for types that both runs have."""
    names = ("f1", "em", "mrr")
    rows = _results(spark, d).filter("gold_type is not null")
    means = rows.groupBy("run_id", "gold_type").agg(*(F.avg(F.col(m).cast("double")).alias(m) for m in names))
    older = means.select(F.col("run_id").alias("previous"), "gold_type", *(F.col(m).alias(f"old_{m}") for m in names))
    both = T.previous_run(table(spark, d, "eval_runs")).select("run_id", "previous").join(means, "run_id").join(older, ["previous", "gold_type"])
    return both.select("run_id", "previous", "gold_type", *(F.round(F.col(m) - F.col(f"old_{m}"), 6).alias(f"{m}_diff") for m in names))


@query(_R + """, c AS (SELECT run_id, route_taken, count(*) AS n FROM r GROUP BY ALL)
  SELECT run_id, route_taken, n, round(n / sum(n) OVER (PARTITION BY run_id), 6) AS share FROM c""")
def route_shares(spark: SparkSession, d: str) -> DataFrame:
    counts = _results(spark, d).groupBy("run_id", "route_taken").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("run_id")), 6))


@query(_R + """ SELECT run_id, CASE WHEN predicted_type <> gold_type THEN 'misrouted' WHEN em = 1 THEN 'correct' WHEN f1 > 0 THEN 'partial' ELSE 'wrong' END AS outcome,
  count(*) AS n FROM r GROUP BY ALL""")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    """What became of the questions of each run; a null type or score decides nothing."""
    word = F.when(F.col("predicted_type") != F.col("gold_type"), "misrouted").when(F.col("em") == 1, "correct").when(F.col("f1") > 0, "partial").otherwise("wrong")
    return _results(spark, d).groupBy("run_id", word.alias("outcome")).agg(F.count("*").alias("n"))


@query(_R + f""" SELECT run_id, question_id, least(faithfulness, relevance, completeness) < {FLOOR}::FLOAT AS flagged FROM r
  WHERE faithfulness IS NOT NULL AND relevance IS NOT NULL AND completeness IS NOT NULL""")
def judgements_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Wholly judged results, and whether a score is under the floor."""
    rows = _results(spark, d).dropna(subset=list(_SCORES))
    return rows.select("run_id", "question_id", (F.least(*_SCORES) < F.lit(FLOOR).cast("float")).alias("flagged"))


@query(_R + """ SELECT run_id, question_id FROM (SELECT run_id, question_id, row_number() OVER (PARTITION BY run_id ORDER BY md5(run_id || '|' || question_id), question_id) AS p FROM r) WHERE p <= 10""")
def spot_check_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ten questions of each run in a fixed order; tasks keep ten each beforehand."""
    order = Window.partitionBy("run_id").orderBy(F.md5(F.concat_ws("|", "run_id", "question_id")), "question_id")
    rows = _results(spark, d).select("run_id", "question_id").withColumn("p", F.row_number().over(order))
    return rows.filter("p <= 10").select("run_id", "question_id")


@query("SELECT doc_id, md5('7|' || CAST(doc_id AS VARCHAR)) AS mark FROM documents WHERE len(sentences) >= 2 ORDER BY mark, doc_id LIMIT 100")
def picked_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred documents of at least two sentences in a fixed order."""
    docs = table(spark, d, "documents").filter(F.size("sentences") >= 2)
    return docs.select("doc_id", F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))).alias("mark")).orderBy("mark", "doc_id").limit(100)


@query("""WITH t AS (SELECT DISTINCT id, lower(trim(split)) AS split, unnest(supporting_titles) AS title FROM gold_items)
  SELECT id, count(*) AS n_titles FROM (SELECT DISTINCT id, title FROM t WHERE split = 'train' AND title IN (SELECT title FROM t WHERE split IN ('dev', 'test'))) GROUP BY id""")
def leaked_titles(spark: SparkSession, d: str) -> DataFrame:
    """Training items that rest on documents of dev or test items, and on how many."""
    rows = table(spark, d, "gold_items").select("id", F.lower(F.trim("split")).alias("split"), F.explode("supporting_titles").alias("title"))
    held = rows.filter(F.col("split").isin("dev", "test")).select("title").distinct()
    return rows.filter("split = 'train'").select("id", "title").distinct().join(held, "title", "left_semi").groupBy("id").agg(F.count("*").alias("n_titles"))


@query("""SELECT doc_id, doc_ref IN (SELECT split_part(chunk_id, ':', 1) FROM triples WHERE chunk_id IS NOT NULL) AS has_relations FROM documents WHERE doc_ref IS NOT NULL""")
def documents_with_relations(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "triples").filter("chunk_id is not null").select(F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("doc_ref")).distinct()
    docs = table(spark, d, "documents").filter("doc_ref is not null").select("doc_id", "doc_ref")
    return docs.join(cited.withColumn("hit", F.lit(True)), "doc_ref", "left").select("doc_id", F.col("hit").isNotNull().alias("has_relations"))


@query("""WITH s AS (SELECT doc_id, x.start_offset AS a, x.end_offset AS b FROM (SELECT doc_id, unnest(sentences) AS x FROM documents) WHERE x.end_offset > x.start_offset),
  p AS (SELECT DISTINCT doc_id, unnest([a, b]) AS pt FROM s), g AS (SELECT doc_id, pt, lead(pt) OVER (PARTITION BY doc_id ORDER BY pt) AS upto FROM p)
  SELECT doc_id, CAST(sum(upto - pt) AS BIGINT) AS covered FROM g
  WHERE EXISTS (SELECT 1 FROM s WHERE s.doc_id = g.doc_id AND s.a <= g.pt AND s.b >= g.upto) GROUP BY doc_id""")
def covered_characters(spark: SparkSession, d: str) -> DataFrame:
    """Characters that the given sentences of each document cover, those of several counted once."""
    spans = table(spark, d, "documents").select("doc_id", F.explode("sentences").alias("x")).select("doc_id", F.col("x.start_offset").alias("a"), F.col("x.end_offset").alias("b"))
    earlier = Window.partitionBy("doc_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("a", F.coalesce(F.max("b").over(earlier), F.col("a")))
    rows = spans.filter("b > a").withColumn("new", F.greatest(F.lit(0), F.col("b") - reached))
    return rows.groupBy("doc_id").agg(F.sum("new").alias("covered"))


@query("""WITH t AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS prompt, event_id % 50 AS completion FROM events),
  b AS (SELECT *, greatest(completion, prompt + event_id % 90 - prompt) AS billed FROM t)
  SELECT event_id, billed, CAST((prompt * 0.3::DOUBLE + billed * 2.5::DOUBLE) / 1e6 AS DECIMAL(12,8)) AS cost_usd FROM b""")
def billed_costs(spark: SparkSession, d: str) -> DataFrame:
    """Billed tokens and list price of each call; prompts are the events' k, the rest stands in from ids."""
    prompt, completion = F.get_json_object("props", "$.k").cast("long"), F.col("event_id") % 50
    billed = billed_output(prompt, completion, prompt + F.col("event_id") % 90)
    return table(spark, d, "events").select("event_id", billed.alias("billed"), list_cost(prompt, billed, 0.3, 2.5).alias("cost_usd"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding[1:3]) AS DOUBLE))) AS z FROM embeddings WHERE embedding IS NOT NULL)
  SELECT vec_id, round(z[1] / list_sum(z), 6) AS a, round(z[2] / list_sum(z), 6) AS b, round(z[3] / list_sum(z), 6) AS c FROM e""")
def softmax_shares(spark: SparkSession, d: str) -> DataFrame:
    """Class shares; the first three numbers of each vector stand in for class scores."""
    rows = table(spark, d, "embeddings").filter("embedding is not null").select("vec_id", softmax(F.slice("embedding", 1, 3)).alias("z"))
    return rows.select("vec_id", *(F.round(F.col("z")[i], 6).alias(n) for i, n in enumerate("abc")))


@query("""WITH v AS (SELECT run_id, greatest(coalesce(TRY_CAST(json_extract_string(summary, '$.f1') AS DOUBLE), 0), 0) AS a,
    greatest(coalesce(TRY_CAST(json_extract_string(summary, '$.em') AS DOUBLE), 0), 0) AS b, (json_extract_string(summary, '$.f1') IS NOT NULL AND TRY_CAST(json_extract_string(summary, '$.f1') AS DOUBLE) IS NULL)
    OR (json_extract_string(summary, '$.em') IS NOT NULL AND TRY_CAST(json_extract_string(summary, '$.em') AS DOUBLE) IS NULL) AS broken FROM eval_runs)
  SELECT run_id, round(CASE WHEN NOT broken AND a + b > 0 THEN a / (a + b) ELSE 0.5 END, 6) AS first_share FROM v""")
def class_shares(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities out of JSON replies; the summaries' f1 and em stand in for two classes."""
    shares = class_probabilities(F.col("summary"), ["f1", "em"])
    return table(spark, d, "eval_runs").select("run_id", F.round(shares["f1"], 6).alias("first_share"))
