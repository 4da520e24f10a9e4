"""Queries from graph paths to hits, response blocks, facts and routed batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators import retrieval as R
from tessella.plans.graphs import _BFS, _paths, _relations
from tessella.plans.registry import query
from tessella.plans.vectors import _PAIRS, K, MIN_SCORE, _nearest
from tessella.session import table

_HITS = _BFS + """, c AS (SELECT qid, place, unnest(chunks) AS chunk_id, generate_subscripts(chunks, 1) AS pos FROM b),
  f AS (SELECT qid, chunk_id, min(place * 100 + pos) AS spot FROM c GROUP BY ALL),
  r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spot, chunk_id) AS rank FROM f) WHERE rank <= 8),
  x AS (SELECT DISTINCT doc_ref || ':sentence:' || ord AS chunk_id FROM (SELECT doc_ref, generate_subscripts(sentences, 1) - 1 AS ord FROM documents)),
  h AS (SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS rank FROM r WHERE chunk_id IN (SELECT chunk_id FROM x))"""
_EDGES = ", pe AS (SELECT DISTINCT qid, unnest(rels) AS rel_id FROM b), ge AS (SELECT pe.qid, rel.* FROM pe JOIN rel USING (rel_id))"


def _seeds(rels: DataFrame) -> DataFrame:
    asked = rels.filter("triple_id % 100 = 0")
    return asked.select(F.col("triple_id").alias("qid"), F.explode(F.array("subject_id", "object_id")).alias("node")).distinct()


def _hits(spark: SparkSession, d: str, paths: DataFrame) -> DataFrame:
    spans = table(spark, d, "documents").select("doc_ref", F.posexplode("sentences").alias("ord", "s"))
    chunks = spans.select(F.concat_ws(":", "doc_ref", F.lit("sentence"), "ord").alias("chunk_id"))
    return R.present_hits(G.provenance(paths, 8), chunks)


@query(_HITS + " SELECT qid, chunk_id, rank FROM h")
def graph_hits(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the best paths that are in the corpus, ranked anew after the cut."""
    return _hits(spark, d, _paths(spark, d))


@query(_BFS + _EDGES + """ SELECT n.qid, n.node, EXISTS (SELECT 1 FROM q WHERE q.qid = n.qid AND q.node = n.node) AS seed FROM
  (SELECT qid, subject_id AS node FROM ge UNION SELECT qid, object_id FROM ge UNION SELECT qid, node FROM q) n""")
def graph_block_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each answer's subgraph; seeds without a path stay."""
    rels = _relations(spark, d)
    return R.block_nodes(R.block_edges(_paths(spark, d), rels), _seeds(rels))


@query(_BFS + _EDGES + " SELECT qid, rel_id, subject_id, predicate, object_id, chunk_id FROM ge")
def graph_block_edges(spark: SparkSession, d: str) -> DataFrame:
    """Relations of each answer's subgraph, each once."""
    edges = R.block_edges(_paths(spark, d), _relations(spark, d))
    return edges.select("qid", "rel_id", "subject_id", "predicate", "object_id", "chunk_id")


@query(_HITS + _EDGES + """, nm AS (SELECT DISTINCT triple_id, subject, object FROM triples)
  SELECT DISTINCT qid, h.rank AS block, '[' || h.rank || '] ' || trim(subject) || ' ' || replace(predicate, '_', ' ') || ' ' || trim(object) AS fact
  FROM ge JOIN h USING (qid, chunk_id) JOIN nm USING (triple_id)""")
def graph_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the subgraph whose chunk is among the hits, cited by its number."""
    paths = _paths(spark, d)
    names = table(spark, d, "triples").select("triple_id", "subject", "object").distinct()
    edges = R.block_edges(paths, _relations(spark, d)).join(_hits(spark, d, paths), ["qid", "chunk_id"]).join(names, "triple_id")
    return R.facts(edges)


@query(_BFS.replace("WITH nf", "WITH vq AS (" + _PAIRS.format("", "") + f""" SELECT query_id AS qid, max(score) AS top FROM r WHERE rank <= {K} GROUP BY query_id), nf""", 1)
    + f""", g AS (SELECT qid, bool_or(joined OR score >= 0.2) AS path FROM b GROUP BY qid), z AS (SELECT qid, qid % 3 = 0 AS single, top, coalesce(path, FALSE) AS path FROM vq LEFT JOIN g USING (qid))
  SELECT qid, CASE WHEN single THEN 'vector' ELSE 'graph' END AS first_route,
    CASE WHEN single AND top >= {MIN_SCORE} THEN 'vector' WHEN NOT single AND path THEN 'graph' ELSE 'hybrid' END AS final_route, round(top, 4) AS top_score, path FROM z""")
def routed_batch(spark: SparkSession, d: str) -> DataFrame:
    """Asking vectors routed in one batch with one fallback; the triple of the same number gives the
    seeds, every third question stands in for a single hop. Each backend runs once for all."""
    tops = _nearest(spark, d).groupBy("query_id").agg(F.max("score").alias("top")).withColumnRenamed("query_id", "qid")
    reached = _paths(spark, d).groupBy("qid").agg(F.bool_or(F.col("joined") | (F.col("score") >= 0.2)).alias("path"))
    return R.routed(tops.join(reached, "qid", "left"), F.col("qid") % 3 == 0, MIN_SCORE).withColumnRenamed("top", "top_score")


@query("""WITH x AS (SELECT doc_ref, min(doc_id) AS doc_id FROM documents GROUP BY doc_ref),
  s AS (SELECT d.doc_ref, unnest(d.sentences) AS s, generate_subscripts(d.sentences, 1) - 1 AS ord FROM documents d JOIN x USING (doc_id)),
  t AS (SELECT DISTINCT triple_id, chunk_id, split_part(chunk_id, ':', 1) AS doc_ref, evidence_start, evidence_end FROM triples WHERE chunk_id IS NOT NULL),
  m AS (SELECT triple_id, ord, row_number() OVER (PARTITION BY triple_id ORDER BY least(evidence_end, s.end_offset) - greatest(evidence_start, s.start_offset) DESC, ord) AS p
    FROM t JOIN s USING (doc_ref) WHERE evidence_start >= 0 AND least(evidence_end, s.end_offset) > greatest(evidence_start, s.start_offset))
  SELECT t.triple_id, t.chunk_id AS old_chunk, t.doc_ref || ':sentence:' || m.ord AS new_chunk, m.ord IS NULL AS dropped
  FROM t LEFT JOIN m ON m.triple_id = t.triple_id AND m.p = 1""")
def relations_relinked(spark: SparkSession, d: str) -> DataFrame:
    """Each triple's chunk after relinking by its evidence; dropped where no sentence holds any of it."""
    docs = table(spark, d, "documents")
    first = docs.groupBy("doc_ref").agg(F.min("doc_id").alias("doc_id"))
    spans = docs.join(first.select("doc_id"), "doc_id", "left_semi").select("doc_ref", F.posexplode("sentences").alias("ord", "s")).select("doc_ref", "ord", "s.*")
    doc = F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("doc_ref")
    rows = table(spark, d, "triples").filter("chunk_id is not null").select("triple_id", "chunk_id", doc, "evidence_start", "evidence_end").distinct()
    moved = G.best_overlap(rows.filter("evidence_start >= 0"), spans, "doc_ref").select("triple_id", "ord")
    new = F.when(F.col("ord").isNotNull(), F.concat_ws(":", "doc_ref", F.lit("sentence"), "ord"))
    joined = rows.join(moved, "triple_id", "left")
    return joined.select("triple_id", F.col("chunk_id").alias("old_chunk"), new.alias("new_chunk"), F.col("ord").isNull().alias("dropped"))


@query("""SELECT DISTINCT triple_id, trim(subject) || ' ' || replace(trim(regexp_replace(lower(predicate), '[^a-z0-9]+', '_', 'g'), '_'), '_', ' ') || ' ' || trim(object) AS line
  FROM triples WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL""")
def relation_texts(spark: SparkSession, d: str) -> DataFrame:
    """The sentence to embed of each relation."""
    rows = table(spark, d, "triples").dropna(subset=["subject", "predicate", "object"])
    return rows.select("triple_id", R.relation_text(F.col("subject"), F.col("predicate"), F.col("object")).alias("line")).distinct()


@query("""WITH t AS (SELECT DISTINCT triple_id, chunk_id FROM triples)
  SELECT split_part(chunk_id, ':', 2) AS strategy, count(*) AS n FROM t WHERE split_part(chunk_id, ':', 2) <> 'fixed' GROUP BY ALL""")
def off_strategy_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations whose chunk isn't of the strategy that serves (fixed), by theirs."""
    strategy = F.split_part("chunk_id", F.lit(":"), F.lit(2)).alias("strategy")
    rows = table(spark, d, "triples").select("triple_id", strategy).distinct()
    return rows.filter("strategy <> 'fixed'").groupBy("strategy").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT doc_ref, min(doc_id) AS doc_id FROM documents GROUP BY doc_ref),
  s AS (SELECT d.doc_ref, unnest(d.sentences) AS s FROM documents d JOIN x USING (doc_id)),
  t AS (SELECT DISTINCT triple_id, split_part(chunk_id, ':', 1) AS doc_ref, evidence_start AS a, evidence_end AS b FROM triples WHERE evidence_start >= 0 AND evidence_end > evidence_start),
  k AS (SELECT t.triple_id, t.doc_ref, EXISTS (SELECT 1 FROM s WHERE s.doc_ref = t.doc_ref AND s.s.start_offset <= t.a AND s.s.end_offset >= t.b) AS whole FROM t)
  SELECT doc_ref, count(*) AS n, round(avg(CAST(whole AS INTEGER)), 6) AS retention FROM k GROUP BY doc_ref""")
def evidence_retention(spark: SparkSession, d: str) -> DataFrame:
    """The share of each document's evidence that stands wholly inside one given sentence."""
    docs = table(spark, d, "documents")
    first = docs.groupBy("doc_ref").agg(F.min("doc_id").alias("doc_id"))
    spans = docs.join(first.select("doc_id"), "doc_id", "left_semi").select("doc_ref", F.explode("sentences").alias("s")).select("doc_ref", "s.*")
    doc = F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("doc_ref")
    rows = table(spark, d, "triples").filter("evidence_start >= 0 and evidence_end > evidence_start")
    rows = rows.select("triple_id", doc, "evidence_start", "evidence_end").distinct()
    return R.retention(rows, spans, "doc_ref")


@query(_PAIRS.format("", "") + f""" SELECT query_id, string_agg(id || '=' || CAST(CAST(score AS DECIMAL(8,3)) AS VARCHAR), ' ' ORDER BY rank) AS hits, count(*) AS n FROM r WHERE rank <= {K} GROUP BY query_id""")
def retrieved_events(spark: SparkSession, d: str) -> DataFrame:
    """What a listener is shown of each retrieval: its best eight with their scores."""
    line = F.concat(F.col("id").cast("string"), F.lit("="), F.col("score").cast("decimal(8,3)").cast("string"))
    shown = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return _nearest(spark, d).groupBy("query_id").agg(F.array_join(F.transform(shown, lambda h: h["line"]), " ").alias("hits"), F.count("*").alias("n"))
