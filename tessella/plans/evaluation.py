"""Queries over evaluation results and runs: quality, cost, latency, review, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import telemetry as T
from tessella.plans.registry import SQL, query
from tessella.session import table
from tessella.streaming import ledger

FLOOR = 0.6
_R = """WITH r AS (SELECT DISTINCT run_id, question_id, trace_id, nullif(lower(trim(gold_type)), '') AS gold_type,
    nullif(lower(trim(predicted_type)), '') AS predicted_type, nullif(lower(trim(route_taken)), '') AS route_taken,
    em, f1, recall_at_k, mrr, sp_precision, faithfulness, relevance, completeness, cost_usd,
    CASE WHEN latency_ms >= 0 AND latency_ms < 2147483647 THEN latency_ms END AS latency_ms, recorded_at FROM eval_results)"""
_STATS = """count(*) AS n, count(*) FILTER (cost_usd IS NULL OR latency_ms IS NULL) AS n_without_trace,
  round(avg(CASE WHEN latency_ms IS NOT NULL THEN CAST(cost_usd AS DOUBLE) END), 10) AS cost_per_query,
  round(quantile_cont(CASE WHEN cost_usd IS NOT NULL THEN CAST(latency_ms AS DOUBLE) END, 0.5), 4) AS p50_ms,
  round(quantile_cont(CASE WHEN cost_usd IS NOT NULL THEN CAST(latency_ms AS DOUBLE) END, 0.95), 4) AS p95_ms,
  round(avg(CAST(f1 AS DOUBLE)), 6) AS f1, round(avg(CAST(faithfulness AS DOUBLE)), 6) AS faithfulness"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    return T.once(table(spark, d, "eval_results"))


@query(_R + f" SELECT run_id, {_STATS} FROM r GROUP BY run_id")
def economics_by_run(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).groupBy("run_id").agg(*T.group_stats())


@query(_R + f""" SELECT CASE grouping(gold_type) * 2 + grouping(route_taken) WHEN 3 THEN 'run' WHEN 1 THEN 'type' ELSE 'route' END AS level,
  run_id, gold_type, route_taken, {_STATS} FROM r GROUP BY GROUPING SETS ((run_id), (run_id, gold_type), (run_id, route_taken))""")
def economics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return T.rollup(_results(spark, d))


@query(_R + f""", s AS (SELECT run_id, {_STATS} FROM r GROUP BY run_id)
  SELECT run_id, reason, CASE WHEN reason IS NULL AND cost_per_query > 0 THEN round(f1 / cost_per_query / 1000, 4) END AS f1_per_millidollar
  FROM (SELECT *, CASE WHEN faithfulness IS NULL THEN 'not judged' WHEN faithfulness < {FLOOR} THEN 'faithfulness under {FLOOR}' END AS reason FROM s)""")
def quality_per_cost(spark: SparkSession, d: str) -> DataFrame:
    stats = _results(spark, d).groupBy("run_id").agg(*T.group_stats())
    return T.quality_per_cost(stats, FLOOR).select("run_id", "reason", "f1_per_millidollar")


@query(_R + " SELECT run_id, gold_type, " + ", ".join(f"round(avg(CAST({m} AS DOUBLE)), 6) AS {m}" for m in T.METRICS) + """,
  quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM r GROUP BY run_id, gold_type""")
def report_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Means of all metrics over non-null values, nearest-rank latencies."""
    return _results(spark, d).groupBy("run_id", "gold_type").agg(
        *(T.mean(m).alias(m) for m in T.METRICS),
        T.nearest_rank("latency_ms", 0.5).alias("p50"), T.nearest_rank("latency_ms", 0.95).alias("p95"),
    )


@query(_R + """, c AS (SELECT gold_type, predicted_type, count(*) AS n FROM r WHERE gold_type IS NOT NULL AND predicted_type IS NOT NULL GROUP BY ALL)
  SELECT g.gold_type, p.predicted_type, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT gold_type FROM c) g
  CROSS JOIN (SELECT DISTINCT predicted_type FROM c) p LEFT JOIN c ON c.gold_type = g.gold_type AND c.predicted_type = p.predicted_type""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return T.confusion(_results(spark, d))


@query(_R + """, s AS (SELECT * FROM r WHERE gold_type IS NOT NULL AND predicted_type IS NOT NULL),
  l AS (SELECT gold_type AS label, count(*) AS gold, sum((gold_type = predicted_type)::INT) AS ok FROM s GROUP BY 1),
  p AS (SELECT predicted_type AS label, count(*) AS said FROM s GROUP BY 1)
  SELECT label, round(2 * ok / (gold + coalesce(said, 0)), 6) AS f1 FROM l LEFT JOIN p USING (label)""")
def label_f1(spark: SparkSession, d: str) -> DataFrame:
    return T.label_f1(T.confusion(_results(spark, d)))


@query(_R + """ SELECT run_id, question_id, gold_type, predicted_type, route_taken, round(CAST(f1 AS DOUBLE), 6) AS f1
  FROM r WHERE predicted_type <> gold_type""")
def misroutes(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d).filter("predicted_type <> gold_type")
    return rows.select("run_id", "question_id", "gold_type", "predicted_type", "route_taken", F.round(F.col("f1").cast("double"), 6).alias("f1"))


@query(_R + """, s AS (SELECT run_id, avg(CAST(f1 AS DOUBLE)) AS f1, avg(CAST(em AS DOUBLE)) AS em FROM r GROUP BY run_id),
  p AS (SELECT run_id, lag(run_id) OVER (PARTITION BY split, mode ORDER BY created_at, run_id) AS previous FROM eval_runs)
  SELECT p.run_id, p.previous, round(a.f1 - b.f1, 6) AS f1_diff, round(a.em - b.em, 6) AS em_diff
  FROM p LEFT JOIN s a ON a.run_id = p.run_id LEFT JOIN s b ON b.run_id = p.previous""")
def previous_run_diff(spark: SparkSession, d: str) -> DataFrame:
    means = _results(spark, d).groupBy("run_id").agg(F.avg(F.col("f1").cast("double")).alias("f1"), F.avg(F.col("em").cast("double")).alias("em"))
    runs = T.previous_run(table(spark, d, "eval_runs")).select("run_id", "previous")
    older = means.select(F.col("run_id").alias("previous"), F.col("f1").alias("old_f1"), F.col("em").alias("old_em"))
    rows = runs.join(means, "run_id", "left").join(older, "previous", "left")
    return rows.select("run_id", "previous", F.round(F.col("f1") - F.col("old_f1"), 6).alias("f1_diff"), F.round(F.col("em") - F.col("old_em"), 6).alias("em_diff"))


@query("SELECT split, mode, max_by(run_id, created_at) AS run_id, max(created_at) AS created_at FROM eval_runs GROUP BY split, mode")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_runs").groupBy("split", "mode").agg(F.max_by("run_id", "created_at").alias("run_id"), F.max("created_at").alias("created_at"))


@query("""SELECT run_id, run_id = strftime(created_at AT TIME ZONE 'UTC', '%Y%m%d-%H%M') || '-' || split || '-' || mode || '-' || variant AS well_formed,
  TRY_CAST(json_extract_string(summary, '$.f1') AS DOUBLE) AS said_f1 FROM eval_runs""")
def run_id_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_runs")
    made = F.concat_ws("-", F.date_format("created_at", "yyyyMMdd-HHmm"), "split", "mode", "variant")
    said = F.get_json_object("summary", "$.f1").try_cast("double")
    return rows.select("run_id", (F.col("run_id") == made).alias("well_formed"), said.alias("said_f1"))


@query(_R + f""", f AS (SELECT run_id, question_id, 'judge_below_threshold' AS reason, m AS metric, CAST(v AS DOUBLE) AS score FROM
    (SELECT run_id, question_id, unnest(['faithfulness', 'relevance', 'completeness']) AS m, unnest([faithfulness, relevance, completeness]) AS v FROM r)
    WHERE v < {FLOOR}::FLOAT
  UNION ALL SELECT run_id, question_id, 'misroute', 'classifier_confidence', 0.0 FROM r WHERE predicted_type <> gold_type)
  SELECT run_id, reason, metric, count(*) AS n, round(avg(score), 6) AS mean_score FROM f GROUP BY ALL""")
def review_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = T.review_flags(_results(spark, d), FLOOR)
    return rows.groupBy("run_id", "reason", "metric").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(_R + """, f AS (SELECT run_id, question_id FROM r WHERE faithfulness < 0.6::FLOAT), done AS (SELECT DISTINCT run_id, question_id FROM r WHERE relevance IS NOT NULL AND em >= 1)
  SELECT run_id, question_id FROM f WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.run_id = f.run_id AND done.question_id IS NOT DISTINCT FROM f.question_id)""")
def review_queue_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Flagged results not queued yet; those answered exactly stand for the queue."""
    rows = _results(spark, d)
    flagged = rows.filter(F.col("faithfulness") < F.lit(FLOOR).cast("float")).select("run_id", "question_id")
    queued = rows.filter("relevance is not null and em >= 1").select(F.col("run_id").alias("r"), F.col("question_id").alias("q")).distinct()
    return flagged.join(queued, (F.col("run_id") == F.col("r")) & F.col("question_id").eqNullSafe(F.col("q")), "left_anti")


@query("""SELECT g.id, r.run_id FROM (SELECT DISTINCT id FROM gold_items WHERE lower(trim(split)) = 'dev') g
  CROSS JOIN (SELECT max_by(run_id, created_at) AS run_id FROM eval_runs WHERE split = 'dev') r
  WHERE NOT EXISTS (SELECT 1 FROM eval_results e WHERE e.run_id = r.run_id AND e.question_id = g.id)""")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Dev questions that the latest dev run has no result of yet."""
    run = table(spark, d, "eval_runs").filter("split = 'dev'").agg(F.max_by("run_id", "created_at").alias("run_id"))  # one row
    todo = table(spark, d, "gold_items").filter(F.lower(F.trim("split")) == "dev").select("id").distinct().crossJoin(F.broadcast(run))
    done = table(spark, d, "eval_results").select("run_id", F.col("question_id").alias("id"))
    return todo.join(done, ["run_id", "id"], "left_anti").select("id", "run_id")


@query(_R + """ SELECT run_id, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS r, count(*) AS n
  FROM (SELECT run_id, CAST(f1 AS DOUBLE) AS a, CAST(faithfulness AS DOUBLE) AS b FROM r WHERE f1 IS NOT NULL AND faithfulness IS NOT NULL) GROUP BY run_id""")
def pearson_f1_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d).select("run_id", F.col("f1").cast("double").alias("a"), F.col("faithfulness").cast("double").alias("b")).dropna(subset=["a", "b"])
    good = (F.count("*") >= 3) & (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0)
    return rows.groupBy("run_id").agg(F.when(good, F.round(T.correlation(F.col("a"), F.col("b")), 6)).alias("r"), F.count("*").alias("n"))


@query(_R + """ SELECT run_id, count(*) AS n, round(avg(abs(a - b)), 6) AS mean_gap, round(avg((abs(a - b) <= 0.25 + 1e-9)::INT), 6) AS within_step,
  round(avg(((a < 0.6) = (b < 0.6))::INT), 6) AS same_flag
  FROM (SELECT run_id, CAST(faithfulness AS DOUBLE) AS a, CAST(completeness AS DOUBLE) AS b FROM r) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY run_id""")
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two scores of a result: gap, share within a step, same decision."""
    rows = _results(spark, d).select("run_id", F.col("faithfulness").cast("double").alias("a"), F.col("completeness").cast("double").alias("b")).dropna(subset=["a", "b"])
    gap = F.abs(F.col("a") - F.col("b"))
    return rows.groupBy("run_id").agg(
        F.count("*").alias("n"), F.round(F.avg(gap), 6).alias("mean_gap"), F.round(F.avg((gap <= 0.25 + 1e-9).cast("int")), 6).alias("within_step"),
        F.round(F.avg(((F.col("a") < FLOOR) == (F.col("b") < FLOOR)).cast("int")), 6).alias("same_flag"),
    )


@query(_R + """, g AS (SELECT CAST(range AS INTEGER) AS step, range * 0.05 AS w FROM range(21)),
  x AS (SELECT step, w, w * CAST(f1 AS DOUBLE) + (1 - w) * CAST(recall_at_k AS DOUBLE) AS score, CAST(faithfulness AS DOUBLE) AS f
    FROM r, g WHERE f1 IS NOT NULL AND recall_at_k IS NOT NULL AND faithfulness IS NOT NULL)
  SELECT step, round(corr(score, f), 6) AS r FROM x GROUP BY step""")
def weight_grid_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation with faithfulness of each of 21 weightings; the first largest is the best weight."""
    grid = spark.range(21).select(F.col("id").cast("int").alias("step"), (F.col("id") * 0.05).alias("w"))
    rows = _results(spark, d).select(*(F.col(c).cast("double").alias(c) for c in ("f1", "recall_at_k", "faithfulness"))).dropna()
    both = rows.crossJoin(F.broadcast(grid))  # 21 rows
    score = F.col("w") * F.col("f1") + (1 - F.col("w")) * F.col("recall_at_k")
    return both.groupBy("step").agg(F.round(T.correlation(score, F.col("faithfulness")), 6).alias("r"))


@query(_R + """, g AS (SELECT CAST(range AS INTEGER) AS step, (range + 1) * 0.05 AS t FROM range(19))
  SELECT step, round(avg(((CAST(f1 AS DOUBLE) < t) = (CAST(faithfulness AS DOUBLE) < 0.6))::INT), 6) AS agreement
  FROM r, g WHERE f1 IS NOT NULL AND faithfulness IS NOT NULL GROUP BY step""")
def threshold_grid_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often f1 under each of 19 thresholds goes with faithfulness under the floor."""
    grid = spark.range(19).select(F.col("id").cast("int").alias("step"), ((F.col("id") + 1) * 0.05).alias("t"))
    rows = _results(spark, d).select(F.col("f1").cast("double").alias("f1"), F.col("faithfulness").cast("double").alias("f")).dropna()
    same = (F.col("f1") < F.col("t")) == (F.col("f") < FLOOR)
    return rows.crossJoin(F.broadcast(grid)).groupBy("step").agg(F.round(F.avg(same.cast("int")), 6).alias("agreement"))  # 19 rows


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def rate_window_60s(spark: SparkSession, d: str) -> DataFrame:
    return T.rate(table(spark, d, "events"), "user_id", "ts", 60).select("event_id", "recent")


@query("""SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_calls, CAST(sum(CAST(value / 1000000 AS DECIMAL(12,8))) AS DECIMAL(22,8)) AS cost_usd,
  count(*) > 4 AS over_cap, bool_and(event_id % 5 = 0) AS all_cached FROM events GROUP BY ALL""")
def ledger_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A trace is a user's day: calls, cost, whether more than four, whether all were cached."""
    cost = (F.col("value") / 1_000_000).cast("decimal(12,8)")
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n_calls"), F.sum(cost).cast("decimal(22,8)").alias("cost_usd"), (F.count("*") > 4).alias("over_cap"), F.bool_and(F.col("event_id") % 5 == 0).alias("all_cached")
    )


@query("""SELECT event_type AS role, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95,
  CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1""")
def cost_by_role(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("role")).agg(
        F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 4).alias("p95"), F.sum(tokens).alias("tokens")
    )


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def ledger_windowed(spark: SparkSession, d: str) -> DataFrame:
    """The ledger as a stream: hourly counts and totals by type, run until the input is used up."""
    return ledger.hourly(spark, f"{d}/events.parquet")


@query("""SELECT 'results_sent_twice' AS what, (SELECT count(*) FROM eval_results) - (SELECT count(*) FROM (SELECT DISTINCT * FROM eval_results)) AS n
  UNION ALL SELECT 'results_without_run', count(*) FROM eval_results e WHERE NOT EXISTS (SELECT 1 FROM eval_runs r WHERE r.run_id = e.run_id)
  UNION ALL SELECT 'results_without_question', count(*) FROM eval_results e WHERE NOT EXISTS (SELECT 1 FROM gold_items g WHERE g.id = e.question_id)
  UNION ALL SELECT 'triples_without_document', count(*) FROM triples t WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_ref = split_part(t.chunk_id, ':', 1))
  UNION ALL SELECT 'labels_without_document', count(*) FROM subject_labels l WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = l.doc_id)""")
def integrity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Keys that a store would refuse, counted."""
    results, triples = table(spark, d, "eval_results"), table(spark, d, "triples")
    docs = table(spark, d, "documents")

    def missing(name: str, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(right, on, "left_anti").agg(F.lit(name).alias("what"), F.count("*").alias("n"))

    twice = results.agg(F.count("*").alias("all")).crossJoin(results.distinct().agg(F.count("*").alias("kept")))  # one row each
    out = twice.select(F.lit("results_sent_twice").alias("what"), (F.col("all") - F.col("kept")).alias("n"))
    return (
        out.unionByName(missing("results_without_run", results, table(spark, d, "eval_runs"), ["run_id"]))
        .unionByName(missing("results_without_question", results.withColumnRenamed("question_id", "id"), table(spark, d, "gold_items"), ["id"]))
        .unionByName(missing("triples_without_document", triples.withColumn("doc_ref", F.split_part("chunk_id", F.lit(":"), F.lit(1))), docs, ["doc_ref"]))
        .unionByName(missing("labels_without_document", table(spark, d, "subject_labels"), docs, ["doc_id"]))
    )


def _first_best(grid: DataFrame, value: str) -> DataFrame:
    """The row of a grid with the largest value, the first of equals."""
    return grid.agg(F.max_by("step", F.struct(F.col(value), -F.col("step"))).alias("step"), F.max(value).alias(value))


@query(SQL["weight_grid_correlation"].replace("SELECT step, round(corr(score, f), 6) AS r FROM x GROUP BY step", "SELECT step, r FROM (SELECT step, round(corr(score, f), 6) AS r FROM x GROUP BY step) ORDER BY r DESC, step LIMIT 1"))
def best_weight_corr(spark: SparkSession, d: str) -> DataFrame:
    return _first_best(weight_grid_correlation(spark, d), "r")


@query("SELECT step, agreement FROM (" + SQL["threshold_grid_agreement"] + ") ORDER BY agreement DESC, step LIMIT 1")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _first_best(threshold_grid_agreement(spark, d), "agreement")


_DRAWS = 200
_WEIGHT = "CASE WHEN u < 0.36788 THEN 0 WHEN u < 0.73576 THEN 1 WHEN u < 0.91970 THEN 2 WHEN u < 0.98101 THEN 3 WHEN u < 0.99634 THEN 4 ELSE 5 END"


@query(_R + f""", q AS (SELECT question_id, avg(CAST(f1 AS DOUBLE)) FILTER (route_taken = 'hybrid') - avg(CAST(f1 AS DOUBLE)) FILTER (route_taken = 'vector') AS diff
    FROM r GROUP BY question_id),
  b AS (SELECT d.range AS draw, diff, CAST('0x' || substr(md5(d.range || '|' || question_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM q, range({_DRAWS}) d WHERE diff IS NOT NULL),
  m AS (SELECT draw, sum(diff * {_WEIGHT}) / sum({_WEIGHT}) AS mean FROM b GROUP BY draw)
  SELECT (SELECT count(*) FROM q WHERE diff IS NOT NULL) AS n, (SELECT round(avg(diff), 6) FROM q) AS mean_diff,
    round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference of hybrid over vector by question, with a 95 % interval of 200 resamples.

    A resample takes each question 0, 1, 2... times as a hash of draw and question says, with the
    frequencies of a Poisson variable of mean 1; so draws need no order and no shared state.
    """
    of = lambda r: F.avg(F.when(F.col("route_taken") == r, F.col("f1").cast("double")))
    diffs = _results(spark, d).groupBy("question_id").agg((of("hybrid") - of("vector")).alias("diff")).filter("diff is not null")
    draws = spark.range(_DRAWS).withColumnRenamed("id", "draw")
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "draw", "question_id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    taken = diffs.crossJoin(F.broadcast(draws)).withColumn("u", u).withColumn("w", F.expr(_WEIGHT))  # 200 rows
    means = taken.groupBy("draw").agg((F.sum(F.col("diff") * F.col("w")) / F.sum("w")).alias("mean"))
    interval = means.agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))
    return diffs.agg(F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("mean_diff")).crossJoin(interval)  # one row each
