"""Runs, costs and latencies: rollups of evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("em", "f1", "recall_at_k", "mrr", "sp_precision", "faithfulness", "relevance", "completeness")
#: Fixed value: what stands for no latency.
SENTINEL = 2_147_483_647


def once(results: DataFrame) -> DataFrame:
    """Results without the rows sent twice, routes and types in one writing, bad latencies null."""
    tidy = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    good = (F.col("latency_ms") >= 0) & (F.col("latency_ms") < SENTINEL)
    return results.distinct().withColumns({
        "route_taken": tidy("route_taken"), "gold_type": tidy("gold_type"), "predicted_type": tidy("predicted_type"),
        "latency_ms": F.when(good, F.col("latency_ms")),
    })


def mean(c: str | Column, digits: int = 6) -> Column:
    """The mean of a single- or double-precision column over its non-null values, rounded."""
    return F.round(F.avg((F.col(c) if isinstance(c, str) else c).cast("double")), digits)


def group_stats() -> list[Column]:
    """Rows, rows without cost or latency, mean cost, percentiles interpolated between ranks, means."""
    traced = F.col("cost_usd").isNotNull() & F.col("latency_ms").isNotNull()
    latency = F.when(traced, F.col("latency_ms"))
    return [
        F.count("*").alias("n"),
        F.count_if(~traced).alias("n_without_trace"),
        F.round(F.avg(F.when(traced, F.col("cost_usd").cast("double"))), 10).alias("cost_per_query"),
        F.round(F.percentile(latency, F.lit(0.5)), 4).alias("p50_ms"),
        F.round(F.percentile(latency, F.lit(0.95)), 4).alias("p95_ms"),
        mean("f1").alias("f1"),
        mean("faithfulness").alias("faithfulness"),
    ]


def rollup(results: DataFrame) -> DataFrame:
    """Economics of each run, and of its types and routes, in one pass over grouping sets."""
    sets = [["run_id"], ["run_id", "gold_type"], ["run_id", "route_taken"]]
    level = F.grouping_id()
    rows = results.groupingSets(sets, "run_id", "gold_type", "route_taken").agg(level.alias("level"), *group_stats())
    return rows.withColumn("level", F.when(F.col("level") == 3, "run").when(F.col("level") == 1, "type").otherwise("route"))


def quality_per_cost(stats: DataFrame, floor: float) -> DataFrame:
    """Runs with f1 for each thousandth of a dollar, if their faithfulness allows to compare them."""
    reason = F.when(F.col("faithfulness").isNull(), "not judged").when(F.col("faithfulness") < floor, F.lit(f"faithfulness under {floor}"))
    good = reason.isNull() & (F.col("cost_per_query") > 0)
    return stats.withColumns({"reason": reason, "f1_per_millidollar": F.when(good, F.round(F.col("f1") / F.col("cost_per_query") / 1000, 4))})


def nearest_rank(values: str, share: float) -> Column:
    """The smallest value of a column with at least `share` of its values up to it, exact.

    Values are counted before they are shuffled; a group holds its different values, which whole
    milliseconds up to a time limit bound.
    """
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{values}`)")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of two columns; null where one of them doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def confusion(results: DataFrame) -> DataFrame:
    """(gold_type, predicted_type, n): all pairs of labels that stand in the results, 0 included."""
    seen = results.filter("predicted_type is not null and gold_type is not null")
    counts = seen.groupBy("gold_type", "predicted_type").agg(F.count("*").alias("n"))
    golds = counts.select("gold_type").distinct()
    return (
        golds.crossJoin(F.broadcast(counts.select("predicted_type").distinct()))  # question types: three
        .join(counts, ["gold_type", "predicted_type"], "left")
        .na.fill(0, ["n"])
    )


def label_f1(matrix: DataFrame) -> DataFrame:
    """(label, f1) from a confusion table; a label that is never right has 0."""
    gold = matrix.groupBy(F.col("gold_type").alias("label")).agg(
        F.sum("n").alias("gold"), F.sum(F.when(F.col("gold_type") == F.col("predicted_type"), F.col("n")).otherwise(0)).alias("right")
    )
    said = matrix.groupBy(F.col("predicted_type").alias("label")).agg(F.sum("n").alias("said"))
    f1 = F.coalesce(F.try_divide(2 * F.col("right"), F.col("gold") + F.col("said")), F.lit(0.0))
    return gold.join(said.na.fill(0), "label", "left").na.fill(0, ["said"]).select("label", F.round(f1, 6).alias("f1"))


def previous_run(runs: DataFrame) -> DataFrame:
    """Each run with the latest earlier one of its split and mode."""
    before = Window.partitionBy("split", "mode").orderBy("created_at", "run_id")
    return runs.withColumn("previous", F.lag("run_id").over(before))


def review_flags(results: DataFrame, floor: float) -> DataFrame:
    """(run_id, question_id, reason, metric, score): why a result needs a look."""
    judged = [F.when(F.col(m) < F.lit(floor).cast("float"), F.struct(F.lit("judge_below_threshold").alias("reason"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("score"))) for m in METRICS[5:]]
    misroute = F.when(
        F.col("predicted_type") != F.col("gold_type"),
        F.struct(F.lit("misroute").alias("reason"), F.lit("classifier_confidence").alias("metric"), F.lit(0.0).alias("score")),
    )
    flags = F.filter(F.array(*judged, misroute), lambda x: x.isNotNull())
    return results.select("run_id", "question_id", F.inline(flags))


def rate(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """`events` with the number of the key's events in the last `seconds`, this one included.

    A key is cut into spans of that length, each of which also sees the rows of the span before it,
    so a key with many events is the work of many tasks. A null time counts all rows without time.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    span = F.floor(micros / (seconds * 1_000_000))
    seen = events.withColumn("_at", micros).withColumn("_own", span).withColumn("_span", F.explode(F.when(span.isNull(), F.array(span)).otherwise(F.array(span, span + 1))))
    last = Window.partitionBy(key, "_span").orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    counted = seen.withColumn("recent", F.count("*").over(last))
    return counted.filter(F.col("_span").eqNullSafe(F.col("_own"))).drop("_at", "_own", "_span")
