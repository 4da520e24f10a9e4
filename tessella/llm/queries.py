"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import encoding, names, overlap, packing, percentiles, sampling, splitting, subjects
from tessella.session import table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The ordered pieces of every document."""
    return splitting.split_documents(table(spark, d, "documents"))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per document: whether its pieces, less the overlaps, are as long as the text."""
    docs = table(spark, d, "documents")
    return splitting.split_check(splitting.split_documents(docs).drop("piece"), docs).select("doc_id", "covered", "over_limit")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampled ids of gold_items."""
    return sampling.growing_sample(table(spark, d, "gold_items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ids: a dev or test question that stands in train too, exactly or almost."""
    return overlap.found(table(spark, d, "gold_items"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split and source."""
    return overlap.report(table(spark, d, "gold_items"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Latency percentiles per route, from the daily sketches combined."""
    daily = percentiles.daily_sketches(table(spark, d, "eval_results"))
    return percentiles.percentiles(percentiles.combine_days(daily), ["route"])


def p4_daily(spark: SparkSession, d: str) -> DataFrame:
    """Latency percentiles per route and day."""
    daily = percentiles.daily_sketches(table(spark, d, "eval_results"))
    return percentiles.percentiles(daily, ["route", "day"])


def p4_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Per route and percentile: whether its exact rank is within 0.5 % of n of the asked one."""
    results = table(spark, d, "eval_results")
    estimates = percentiles.percentiles(percentiles.combine_days(percentiles.daily_sketches(results)), ["route"])
    rows = percentiles.latency_rows(results).groupBy("route", "latency").agg(F.count("*").alias("m"))
    both = rows.join(F.broadcast(estimates), rows["route"].eqNullSafe(estimates["route"])).select(  # 7 rows a route
        estimates["route"], "quantile", "value", "latency", "m", "n"
    )
    ranks = both.groupBy("route", "quantile", "n").agg(
        F.sum(F.when(F.col("latency") < F.col("value"), F.col("m")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("latency") <= F.col("value"), F.col("m")).otherwise(0)).alias("upto"),
    )
    asked, slack = F.ceil(F.col("quantile") * F.col("n")), 0.005 * F.col("n")
    ok = (F.col("below") + 1 <= asked + slack) & (F.col("upto") >= asked - slack)
    return ranks.select("route", "quantile", "n", ok.alias("within"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    return names.found(table(spark, d, "triples"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encoding.encode_documents(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of each piece of those above the capacity."""
    return packing.pack_texts(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Whether every document is in containers, none over the capacity, and these are 0.95 full or nearly all but one are."""
    packed = p7_containers(spark, d)
    per = packing.containers(packed).agg(F.max("n_tokens").alias("most"), F.sum("n_tokens").alias("all"), F.count("*").alias("n"))
    docs = packed.agg(F.count_distinct("doc_id").alias("n_docs"))
    full = F.col("all") >= 0.95 * packing.CAPACITY * (F.col("n") - 1)
    return docs.crossJoin(per).select("n_docs", (F.col("most") <= packing.CAPACITY).alias("within"), full.alias("full"))  # a row each


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of every document."""
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents by area, language and source."""
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_pieces, p1_coverage, p2_sample, p3_found, p3_report, p4_percentiles, p4_daily, p4_within_bound, p5_found, p6_ids, p7_containers, p7_fill, p8_found, p8_composition)
}

SQL: dict[str, str] = {}

SQL["p7_fill"] = "SELECT count(DISTINCT doc_id) AS n_docs, TRUE AS within, TRUE AS full FROM documents"

SQL["p1_coverage"] = """
SELECT doc_id, TRUE AS covered, 0 AS over_limit FROM documents
"""

SQL["p2_sample"] = f"""
WITH clean AS (
  SELECT id, lower(trim(coalesce(split, ''))) AS split, coalesce(load_no, 1) AS load
  FROM gold_items WHERE id IS NOT NULL),
ids AS (
  SELECT id, max(split) AS split, min(load) AS first_load,
         min(CASE WHEN split <> '' THEN load END) AS assigned_load,
         CAST(('0x' || substr(md5(id), 1, 4)) AS INTEGER) AS bucket
  FROM clean GROUP BY id),
buckets AS (
  SELECT CAST(range AS INTEGER) AS bucket,
         row_number() OVER (ORDER BY md5('{sampling.SEED}|' || CAST(range AS VARCHAR)), range) AS place
  FROM range({sampling.BUCKETS})),
placed AS (SELECT * FROM ids JOIN buckets USING (bucket)),
seen AS (
  SELECT p.split, l.as_of, p.place, count(*) AS n
  FROM placed p JOIN (SELECT DISTINCT assigned_load AS as_of FROM ids WHERE split <> '') l
    ON p.assigned_load <= l.as_of
  WHERE p.split <> '' GROUP BY ALL),
reached AS (
  SELECT place, sum(n) OVER (PARTITION BY split, as_of ORDER BY place) - n AS before,
         sum(n) OVER (PARTITION BY split, as_of) AS whole
  FROM seen),
needed AS (
  SELECT greatest(coalesce(max(place), 0), {round(sampling.RATE * sampling.BUCKETS)}) AS listed
  FROM reached WHERE before < {sampling.LEAST_PER_SPLIT} AND whole >= {10 * sampling.LEAST_PER_SPLIT})
SELECT id, split, bucket, CAST(place AS INTEGER) AS place, first_load
FROM placed, needed WHERE place <= listed
"""

SQL["p4_within_bound"] = """
WITH v AS (
  SELECT DISTINCT run_id, question_id, nullif(lower(trim(route_taken)), '') AS route, recorded_at, latency_ms
  FROM eval_results WHERE latency_ms >= 0 AND latency_ms < 2147483647),
g AS (SELECT route, count(*) AS n FROM v GROUP BY route)
SELECT route, q.quantile, n, TRUE AS within
FROM g, (VALUES (0.05::DOUBLE), (0.25), (0.5), (0.75), (0.9), (0.95), (0.99)) AS q(quantile)
"""
