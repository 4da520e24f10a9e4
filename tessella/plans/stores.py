"""Queries on stored rows: manifests, scopes, request keys, replacements, replay sets, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import stores as S
from tessella.operators import telemetry as T
from tessella.plans.evaluation import _R, _results
from tessella.plans.graphs import _PAIRS, _alike
from tessella.plans.registry import query
from tessella.session import table


@query("""SELECT 'lost' AS side, doc_ref AS id FROM (SELECT doc_ref FROM documents WHERE doc_ref IS NOT NULL AND ingested_at < TIMESTAMPTZ '2026-03-01 00:00:00+00' EXCEPT SELECT substr(sha1(source || '|' || title), 1, 16) FROM documents WHERE title <> '')
  UNION ALL SELECT 'new', id FROM (SELECT substr(sha1(source || '|' || title), 1, 16) AS id FROM documents WHERE title <> '' AND source IS NOT NULL EXCEPT SELECT doc_ref FROM documents WHERE ingested_at < TIMESTAMPTZ '2026-03-01 00:00:00+00')""")
def manifest_differences(spark: SparkSession, d: str) -> DataFrame:
    """Ids written down (doc_ref) by the first of March against those of all titled documents now."""
    docs = table(spark, d, "documents")
    now = docs.filter("title <> '' and source is not null").select(F.substring(F.sha1(F.concat_ws("|", "source", "title")), 1, 16).alias("id"))
    written = docs.filter("doc_ref is not null and ingested_at < timestamp'2026-03-01 00:00:00+00:00'")
    return S.differences(written.select(F.col("doc_ref").alias("id")), now)


@query("""WITH g AS (SELECT DISTINCT unnest(supporting_titles) AS title FROM gold_items WHERE lower(trim(split)) = 'dev'),
  x AS (SELECT doc_ref, min(doc_id) AS doc_id FROM documents WHERE title IN (SELECT title FROM g) GROUP BY doc_ref)
  SELECT doc_ref || ':sentence:' || ord AS chunk_id FROM (SELECT d.doc_ref, generate_subscripts(d.sentences, 1) - 1 AS ord FROM documents d JOIN x USING (doc_id)) ORDER BY chunk_id""")
def scope_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunk ids of the documents that dev items rest on, sorted."""
    items = table(spark, d, "gold_items").filter(F.lower(F.trim("split")) == "dev")
    titles = items.select(F.explode("supporting_titles").alias("title")).distinct()
    docs = table(spark, d, "documents").join(titles, "title", "left_semi")
    first = docs.groupBy("doc_ref").agg(F.min("doc_id").alias("doc_id"))
    spans = docs.join(first.select("doc_id"), "doc_id", "left_semi").select("doc_ref", F.posexplode("sentences").alias("ord", "s"))
    return spans.select(F.concat_ws(":", "doc_ref", F.lit("sentence"), "ord").alias("chunk_id")).orderBy("chunk_id")


@query("""SELECT doc_id, ord, CASE WHEN text IS NOT NULL THEN md5(substr(text, s.start_offset + 1, s.end_offset - s.start_offset)) END AS digest, s.end_offset - s.start_offset AS n
  FROM (SELECT doc_id, text, unnest(sentences) AS s, CAST(generate_subscripts(sentences, 1) - 1 AS INTEGER) AS ord FROM documents) WHERE s.end_offset > s.start_offset AND s.start_offset >= 0""")
def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each given sentence's text out of its document, as a digest; each text is cut where it is read."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.posexplode("sentences").alias("ord", "s")).filter("s.end_offset > s.start_offset and s.start_offset >= 0")
    size = F.col("s.end_offset") - F.col("s.start_offset")
    return rows.select("doc_id", "ord", F.md5(F.substring("text", F.col("s.start_offset") + 1, size)).alias("digest"), size.alias("n"))


@query("""SELECT DISTINCT id, sha256('{"model":"small","question":' || CAST(to_json(question) AS VARCHAR) || ',"temperature":0}') AS request_key FROM gold_items WHERE question IS NOT NULL""")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    """Key of each question's request: SHA-256 of its JSON with sorted keys, other scripts kept."""
    parts = {"question": F.col("question"), "model": F.lit("small"), "temperature": F.lit(0)}
    return table(spark, d, "gold_items").filter("question is not null").select("id", S.request_key(parts).alias("request_key")).distinct()


@query("""WITH s AS (SELECT run_id, json_merge_patch(summary, '{"closed":"yes","n":"0"}') AS j FROM eval_runs WHERE summary IS NOT NULL AND json_valid(summary))
  SELECT run_id, json_extract_string(j, '$.closed') AS closed, json_extract_string(j, '$.n') AS n, len(json_keys(j)) AS n_keys FROM s""")
def summaries_merged(spark: SparkSession, d: str) -> DataFrame:
    """Summaries with a closing entry merged in; the later value of a key wins."""
    rows = table(spark, d, "eval_runs").select("run_id", S.merged(F.col("summary"), {"closed": "yes", "n": "0"}).alias("m")).filter("m is not null")
    return rows.select("run_id", F.col("m")["closed"].alias("closed"), F.col("m")["n"].alias("n"), F.size("m").cast("long").alias("n_keys"))


@query("""WITH t AS (SELECT DISTINCT id, question, unnest(supporting_titles) AS title FROM gold_items WHERE question IS NOT NULL),
  w AS (SELECT DISTINCT id, title, regexp_extract_all(lower(title), '[a-z]{3,}') AS tw, regexp_extract_all(lower(question), '[a-z]{3,}') AS qw FROM t)
  SELECT id, title, len(list_intersect(tw, qw)) > 0 AS named FROM (SELECT id, title, tw, flatten(list(qw)) AS qw FROM w GROUP BY ALL)""")
def subjects_named(spark: SparkSession, d: str) -> DataFrame:
    """Whether a question has a word of three letters or more of each title it rests on; over all versions of an item."""
    rows = table(spark, d, "gold_items").filter("question is not null").select("id", "question", F.explode("supporting_titles").alias("title"))
    return rows.groupBy("id", "title").agg(F.bool_or(S.names_subject(F.col("question"), F.col("title"))).alias("named"))


@query("""WITH i AS (SELECT id, any_value(lower(trim(type))) AS type, max(nullif(lower(trim(split)), '')) AS split, bool_or(answer IS NULL OR trim(answer) = '') AS broken FROM gold_items GROUP BY id),
  b AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) AS p FROM i WHERE split = 'dev' AND broken AND type IS NOT NULL),
  c AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) AS p FROM i WHERE split IS NULL AND NOT broken AND type IS NOT NULL)
  SELECT b.id, b.type, c.id AS replacement FROM b LEFT JOIN c USING (type, p)""")
def replacements(spark: SparkSession, d: str) -> DataFrame:
    """For each dev item without an answer, the next unused unassigned item of its type."""
    split, blank = F.lower(F.trim("split")), F.col("answer").isNull() | (F.trim("answer") == "")
    items = table(spark, d, "gold_items").groupBy("id").agg(
        F.max(F.lower(F.trim("type"))).alias("type"), F.max(F.when(split != "", split)).alias("split"), F.bool_or(blank).alias("broken")
    ).filter("type is not null")
    return S.replaced(items.filter("split = 'dev' and broken"), items.filter("split is null and not broken"))


@query("""WITH i AS (SELECT DISTINCT id, lower(trim(split)) AS split FROM gold_items WHERE lower(trim(split)) IN ('dev', 'test') AND (verified_by IS NULL OR trim(verified_by) = ''))
  SELECT id, split, CAST(row_number() OVER (PARTITION BY split ORDER BY id) AS INTEGER) AS number FROM i""")
def verification_walk(spark: SparkSession, d: str) -> DataFrame:
    """Items still to be verified, numbered within dev and test by a running count over ranges of ids."""
    items = table(spark, d, "gold_items").select("id", F.lower(F.trim("split")).alias("split"), "verified_by")
    still = items.filter(F.col("split").isin("dev", "test") & (F.col("verified_by").isNull() | (F.trim("verified_by") == "")))
    return S.numbered(still.select("id", "split").distinct(), "split", "id")


@query(_PAIRS + " SELECT kind, a, b FROM (SELECT kind, a, b FROM j ORDER BY md5('5|' || kind || '|' || a || '|' || b), kind, a, b LIMIT 50)")
def sampled_merges(spark: SparkSession, d: str) -> DataFrame:
    """Fifty merges to look at, in a fixed order of their hashes (the feature is the sample)."""
    order = F.md5(F.concat_ws("|", F.lit("5"), "kind", "a", "b"))
    return _alike(spark, d).select("kind", "a", "b").orderBy(order, "kind", "a", "b").limit(50)


@query(_R + """, s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY md5('3|' || run_id || '|' || question_id), question_id) AS p FROM r),
  c AS (SELECT run_id, gold_type, count(*) AS n, count(*) FILTER (f1 < 0.5) AS wrong FROM s WHERE p <= 14 GROUP BY ALL)
  SELECT run_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(wrong) AS BIGINT) AS n_wrong,
    concat_ws(', ', CASE WHEN sum(n) < 12 OR sum(n) > 16 THEN 'size' END, CASE WHEN count(*) FILTER (gold_type IS NOT NULL AND n >= 4) < 3 THEN 'types' END, CASE WHEN sum(wrong) < 2 THEN 'too few wrong' END) AS problems
  FROM c GROUP BY run_id""")
def replay_sets(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen questions of each run in a fixed order, and which rules of a replay set they break."""
    order = Window.partitionBy("run_id").orderBy(F.md5(F.concat_ws("|", F.lit("3"), "run_id", "question_id")), "question_id")
    rows = _results(spark, d).select("run_id", "question_id", "gold_type", "f1").withColumn("p", F.row_number().over(order)).filter("p <= 14")
    return S.set_problems(rows)


@query(_R + """, s AS (SELECT variant, r.* FROM r JOIN eval_runs USING (run_id) WHERE gold_type IS NOT NULL AND predicted_type IS NOT NULL),
  l AS (SELECT variant, gold_type AS label FROM s UNION SELECT variant, predicted_type FROM s),
  f AS (SELECT l.variant, label, 2 * count(*) FILTER (gold_type = label AND predicted_type = label) / (count(*) FILTER (gold_type = label) + count(*) FILTER (predicted_type = label)) AS f1
    FROM l JOIN s ON s.variant = l.variant GROUP BY ALL),
  m AS (SELECT variant, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY variant)
  SELECT variant, count(*) AS n, round(avg(CAST(gold_type = predicted_type AS INTEGER)), 6) AS accuracy, any_value(macro_f1) AS macro_f1,
    round(avg(CAST(cost_usd AS DOUBLE)), 10) AS cost, round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.5), 4) AS median_ms FROM s JOIN m USING (variant) GROUP BY variant""")
def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """Classification by each variant compared: accuracy, macro F1, cost, median latency."""
    runs = table(spark, d, "eval_runs").select("run_id", "variant")
    rows = _results(spark, d).filter("gold_type is not null and predicted_type is not null")
    return S.compared(rows.select("run_id", "gold_type", "predicted_type", "cost_usd", "latency_ms").join(F.broadcast(runs), "run_id"), "variant")


@query(_R + """, p AS (SELECT run_id, lag(run_id) OVER (PARTITION BY split, mode ORDER BY created_at, run_id) AS previous FROM eval_runs),
  x AS (SELECT p.run_id, CAST(a.f1 AS DOUBLE) - CAST(b.f1 AS DOUBLE) AS diff FROM p JOIN r a ON a.run_id = p.run_id JOIN r b ON b.run_id = p.previous AND b.question_id = a.question_id
    WHERE a.f1 IS NOT NULL AND b.f1 IS NOT NULL),
  i AS (SELECT run_id, count(*) AS n, avg(diff) AS mid, 1.96 * stddev_samp(diff) / sqrt(count(*)) AS half FROM x GROUP BY run_id)
  SELECT run_id, n, round(mid, 6) AS diff, CASE WHEN half IS NULL THEN 'too few' WHEN mid - half > 0 THEN 'better' WHEN mid + half < 0 THEN 'worse' ELSE 'no clear difference' END AS verdict FROM i""")
def interval_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What the 95 % interval of the paired F1 difference to the previous run says."""
    rows = _results(spark, d).filter("f1 is not null").select("run_id", "question_id", F.col("f1").cast("double").alias("f1"))
    older = rows.select(F.col("run_id").alias("previous"), "question_id", F.col("f1").alias("old"))
    pairs = rows.join(T.previous_run(table(spark, d, "eval_runs")).select("run_id", "previous"), "run_id").join(older, ["previous", "question_id"])
    return S.verdicts(pairs.select("run_id", (F.col("f1") - F.col("old")).alias("diff")))


@query(_R + """ SELECT run_id, round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.5), 4) AS p50_ms, round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.95), 4) AS p95_ms,
  round(avg(CAST(recall_at_k AS DOUBLE)), 6) AS recall FROM r GROUP BY run_id""")
def latency_rows(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated latencies beside recall; `percentile` counts different milliseconds, which the time limit bounds."""
    at = lambda p: F.round(F.percentile("latency_ms", p), 4)
    return _results(spark, d).groupBy("run_id").agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), F.round(F.avg(F.col("recall_at_k").cast("double")), 6).alias("recall"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 2)) AS w FROM embeddings WHERE embedding IS NOT NULL)
  SELECT vec_id, round(list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)), 8) AS cosine FROM e
  WHERE list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)) < 0.9999""")
def pin_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that differ from their stored form; the form rounded to two places stands in for the stored one."""
    rows = table(spark, d, "embeddings").filter("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return S.mismatches(rows.withColumn("w", F.transform("v", lambda x: F.round(x, 2))), 0.9999)


@query("SELECT vec_id, label, embedding[1] AS head FROM embeddings WHERE vec_id IN (SELECT triple_id FROM triples WHERE confidence > 0.9)")
def vectors_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the ids asked for: those of the surest triples."""
    asked = table(spark, d, "triples").filter("confidence > 0.9").select(F.col("triple_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(asked, "vec_id", "left_semi").select("vec_id", "label", F.get("embedding", F.lit(0)).alias("head"))


@query("""SELECT run_id, TRY_CAST(json_extract_string(summary, '$.f1') AS DOUBLE) AS f1, TRY_CAST(json_extract_string(summary, '$.em') AS DOUBLE) AS em FROM eval_runs""")
def summaries_typed(spark: SparkSession, d: str) -> DataFrame:
    """Summaries read with a schema; other keys are left out, what doesn't fit is null."""
    read = F.from_json("summary", "f1 string, em string")
    rows = table(spark, d, "eval_runs").select("run_id", read.alias("s"))
    return rows.select("run_id", *(F.expr(f"try_cast(s.{m} as double)").alias(m) for m in ("f1", "em")))
