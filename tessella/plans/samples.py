"""Queries that draw, split and batch by hashes, and check items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.registry import query
from tessella.session import table

SEED = "7"
_ITEMS = f"WITH g AS (SELECT id, any_value(lower(trim(type))) AS label FROM gold_items WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT lower(trim(type))) = 1), h AS (SELECT *, sha256('{SEED}|' || id) AS mark FROM g)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, mark): each id of one type, with its place in a fixed random order."""
    kind = F.lower(F.trim("type"))
    ids = table(spark, d, "gold_items").filter("id is not null").groupBy("id").agg(F.min(kind).alias("label"), F.count_distinct(kind).alias("n"))
    return ids.filter("n = 1").select("id", "label", F.sha2(F.concat(F.lit(SEED + "|"), F.col("id")), 256).alias("mark"))


@query(_ITEMS + " SELECT id, mark FROM h ORDER BY mark LIMIT 100")
def seeded_sample_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred ids of the fixed order: a smaller sample is a part of a larger."""
    return _items(spark, d).select("id", "mark").orderBy("mark").limit(100)


@query(_ITEMS + """ SELECT id, label, CASE WHEN p <= 20 THEN 'dev' WHEN p <= 50 THEN 'test' ELSE 'rest' END AS part
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mark, id) AS p FROM h)  WHERE p <= 50""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Twenty of each type for development, thirty for test; tasks keep fifty each beforehand."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("mark", "id"))
    rows = _items(spark, d).withColumn("p", place).filter("p <= 50")
    return rows.select("id", "label", F.when(F.col("p") <= 20, "dev").otherwise("test").alias("part"))


@query(_ITEMS + """, c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM h GROUP BY label),
  q AS (SELECT label, floor(40 * n / total) AS base, 40 * n / total - floor(40 * n / total) AS rest FROM c),
  r AS (SELECT label, base + (row_number() OVER (ORDER BY round(rest, 9) DESC, label) <= 40 - sum(base) OVER ())::INT AS quota FROM q)
  SELECT id, label FROM (SELECT h.id, h.label, quota, row_number() OVER (PARTITION BY h.label ORDER BY mark, id) AS p FROM h JOIN r USING (label)) WHERE p <= quota""")
def largest_remainder_subset(spark: SparkSession, d: str) -> DataFrame:
    """Forty ids in the proportions of their types, by largest remainders."""
    items = _items(spark, d)
    counts = items.groupBy("label").agg(F.count("*").alias("n"))  # one row a type
    everything = Window.partitionBy(F.lit(1))
    shares = counts.withColumn("exact", 40 * F.col("n") / F.sum("n").over(everything)).withColumn("base", F.floor("exact"))
    by_rest = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "label")
    more = (F.row_number().over(by_rest) <= 40 - F.sum("base").over(everything)).cast("int")
    quotas = shares.select("label", (F.col("base") + more).alias("quota"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("mark", "id"))
    first = items.withColumn("p", place).filter("p <= 40")
    return first.join(F.broadcast(quotas), "label").filter("p <= quota").select("id", "label")


@query("""WITH c AS (SELECT DISTINCT chunk_id, split_part(chunk_id, ':', 1) AS doc_ref FROM triples WHERE chunk_id IS NOT NULL)
  SELECT chunk_id, doc_ref, CAST(floor((row_number() OVER (PARTITION BY doc_ref ORDER BY chunk_id) - 1) / 4) AS BIGINT) AS batch FROM c""")
def plan_batches(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in batches of four within their document."""
    rows = table(spark, d, "triples").filter("chunk_id is not null").select("chunk_id", F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("doc_ref")).distinct()
    place = F.row_number().over(Window.partitionBy("doc_ref").orderBy("chunk_id"))
    return rows.withColumn("batch", F.floor((place - 1) / 4)).select("chunk_id", "doc_ref", "batch")


@query("""SELECT id, array_to_string(list_filter([CASE WHEN question IS NULL OR trim(question) = '' THEN 'no question' END,
    CASE WHEN answer IS NULL OR trim(answer) = '' THEN 'no answer' END, CASE WHEN lower(trim(type)) NOT IN ('single_hop', 'multi_hop', 'comparison') OR type IS NULL THEN 'type' END,
    CASE WHEN coalesce(len(supporting_titles), 0) = 0 THEN 'no titles' END,
    CASE WHEN verified_by IS NULL OR trim(verified_by) = '' THEN 'not verified' END], lambda x: x IS NOT NULL), ',') AS problems, load_no FROM gold_items""")
def gold_problems(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    kind = F.lower(F.trim("type"))
    found = F.array(
        F.when(blank("question"), "no question"), F.when(blank("answer"), "no answer"),
        F.when(~kind.isin("single_hop", "multi_hop", "comparison") | F.col("type").isNull(), "type"),
        F.when(F.coalesce(F.size("supporting_titles"), F.lit(0)) <= 0, "no titles"), F.when(blank("verified_by"), "not verified"),
    )
    return table(spark, d, "gold_items").select("id", F.array_join(F.filter(found, lambda x: x.isNotNull()), ",").alias("problems"), "load_no")


@query("""WITH t AS (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL)
  SELECT g.id, count(*) AS titles, count(t.title) AS known FROM (SELECT DISTINCT id, unnest(supporting_titles) AS title FROM gold_items) g LEFT JOIN t USING (title) GROUP BY g.id""")
def supporting_titles_known(spark: SparkSession, d: str) -> DataFrame:
    """How many of a question's titles are in the corpus."""
    asked = table(spark, d, "gold_items").select("id", F.explode("supporting_titles").alias("title")).distinct()
    known = table(spark, d, "documents").select("title", F.col("title").alias("have")).filter("title is not null").distinct()
    return asked.join(known, "title", "left").groupBy("id").agg(F.count("*").alias("titles"), F.count("have").alias("known"))


@query("""WITH x AS (SELECT title, min(doc_id) AS doc_id FROM documents GROUP BY title), g AS (SELECT DISTINCT id, unnest(supporting_sentences) AS s FROM gold_items),
  d AS (SELECT doc_id, title, sentences FROM documents JOIN x USING (doc_id, title))
  SELECT g.id, g.s.title AS title, g.s.idx AS idx, d.sentences[g.s.idx + 1].end_offset - d.sentences[g.s.idx + 1].start_offset AS size
  FROM g JOIN d ON d.title = g.s.title WHERE g.s.idx >= 0 AND g.s.idx < len(d.sentences)""")
def supporting_spans(spark: SparkSession, d: str) -> DataFrame:
    """Supporting sentences found by title and index, those past the end skipped."""
    docs = table(spark, d, "documents")
    first = docs.groupBy("title").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    spans = docs.join(first, "doc_id", "left_semi").select("title", F.posexplode("sentences").alias("idx", "s"))
    asked = table(spark, d, "gold_items").select("id", F.inline("supporting_sentences")).distinct()
    return asked.join(spans, ["title", "idx"]).select("id", "title", "idx", (F.col("s.end_offset") - F.col("s.start_offset")).alias("size"))


@query("""WITH a AS (SELECT DISTINCT id, trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) AS p, trim(regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g')) AS g
    FROM gold_items WHERE question IS NOT NULL AND answer IS NOT NULL),
  t AS (SELECT id, p, g, list_filter(string_split(p, ' '), lambda x: x <> '') AS pt, list_filter(string_split(g, ' '), lambda x: x <> '') AS gt FROM a),
  k AS (SELECT id, p, g, unnest(gt) AS w FROM t), n AS (SELECT id, p, g, w, count(*) AS c FROM k GROUP BY ALL),
  m AS (SELECT id, p, g, unnest(pt) AS w FROM t), o AS (SELECT id, p, g, w, count(*) AS c FROM m GROUP BY ALL),
  s AS (SELECT n.id, n.p, n.g, sum(least(n.c, o.c)) AS same FROM n JOIN o USING (id, p, g, w) GROUP BY ALL)
  SELECT t.id, md5(t.p || '|' || t.g) AS print, round(CASE WHEN (t.p IN ('yes', 'no', 'noanswer') OR t.g IN ('yes', 'no', 'noanswer')) AND t.p <> t.g THEN 0 WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2 * same / (len(pt) + len(gt)) END, 6) AS f1 FROM t LEFT JOIN s USING (id, p, g)""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    """Token F1 of each answer against its question, as of a prediction against a gold answer."""
    from tessella.operators.metrics import token_f1 as f1
    from tessella.operators.resolve import plain_name

    rows = table(spark, d, "gold_items").filter("question is not null and answer is not null")
    rows = rows.select("id", plain_name(F.col("question")).alias("p"), plain_name(F.col("answer")).alias("g")).distinct()
    return rows.select("id", F.md5(F.concat_ws("|", "p", "g")).alias("print"), F.round(f1(F.col("p"), F.col("g")), 6).alias("f1"))
