"""Queries over the relation graph and its names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators import resolve as R
from tessella.plans.registry import query
from tessella.session import table

_ID = "'e_' || substr(sha1(upper(trim({0}_type)) || '|' || {1}.norm), 1, 12)"
_NAMES = r"""WITH nf AS (SELECT name, string_split(trim(regexp_replace(strip_accents(lower(regexp_replace(replace(name, '&', ' and '), '[''’]s\b|[''’]', '', 'g'))), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
    FROM (SELECT subject AS name FROM triples UNION SELECT object FROM triples) WHERE name IS NOT NULL),
  nj AS (SELECT name, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 OR length(w[i]) = 1 AND length(w[i - 1]) = 1 THEN w[i] ELSE ' ' || w[i] END), '') AS j FROM nf),
  nn AS (SELECT name, regexp_replace(regexp_replace(j, '^(.+?)(?: (?:inc|incorporated|corp|corporation|co|company|ltd|limited|llc|plc))+$', '\1'), '^the (.+)$', '\1') AS norm FROM nj WHERE j <> '')"""
_REL = _NAMES + f""", t AS (SELECT {_ID.format('subject', 's')} AS subject_id, {_ID.format('object', 'o')} AS object_id,
    trim(regexp_replace(lower(predicate), '[^a-z0-9]+', '_', 'g'), '_') AS predicate, chunk_id, triple_id, evidence_start, evidence_end,
    coalesce(confidence, 0) AS confidence FROM triples JOIN nn s ON s.name = subject JOIN nn o ON o.name = object
    WHERE subject_type IS NOT NULL AND object_type IS NOT NULL),
  u AS (SELECT *, substr(sha1(subject_id || '|' || predicate || '|' || object_id || '|' || chunk_id), 1, 16) AS rel_id FROM t WHERE subject_id <> object_id),
  rel AS (SELECT * EXCLUDE (p) FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY confidence DESC, triple_id) AS p FROM u) WHERE p = 1)"""
_BFS = _REL + """, e AS (SELECT subject_id AS node, object_id AS other, rel_id, chunk_id, confidence * 0.5 AS s FROM rel
    UNION ALL SELECT object_id, subject_id, rel_id, chunk_id, confidence * 0.5 FROM rel),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY s DESC, rel_id) AS p FROM e) WHERE p <= 25),
  q AS (SELECT DISTINCT triple_id AS qid, subject_id AS node FROM rel WHERE triple_id % 100 = 0
    UNION SELECT triple_id, object_id FROM rel WHERE triple_id % 100 = 0),
  h1 AS (SELECT q.qid, q.node AS start, k.other AS last, [q.node, k.other] AS seen, [k.rel_id] AS rels, [k.chunk_id] AS chunks, k.s AS score
    FROM q JOIN k ON k.node = q.node WHERE k.other <> q.node),
  h2 AS (SELECT h.qid, h.start, k.other AS last, list_append(h.seen, k.other) AS seen, list_append(h.rels, k.rel_id) AS rels,
    list_append(h.chunks, k.chunk_id) AS chunks, h.score * k.s AS score FROM h1 h JOIN k ON k.node = h.last WHERE NOT list_contains(h.seen, k.other)),
  p AS (SELECT h.*, EXISTS (SELECT 1 FROM q WHERE q.qid = h.qid AND q.node <> h.start AND list_contains(h.seen, q.node)) AS joined
    FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) h),
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, list_sort(rels) ORDER BY score DESC, joined DESC, rels DESC) AS c FROM p) WHERE c = 1),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY joined DESC, score DESC, rels) AS place FROM o) WHERE place <= 8)"""


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return G.relations(table(spark, d, "triples"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Each triple whose id is divisible by 100 asks, with its two names as seeds."""
    rels = _relations(spark, d)
    asked = rels.filter("triple_id % 100 = 0")
    seeds = asked.select(F.col("triple_id").alias("qid"), F.explode(F.array("subject_id", "object_id")).alias("node"))
    return G.paths(seeds, G.edges(rels))


@query(_REL + " SELECT rel_id, subject_id, predicate, object_id, chunk_id, confidence FROM rel")
def relation_dedup_best(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d).select("rel_id", "subject_id", "predicate", "object_id", "chunk_id", "confidence")


@query(_REL + """ SELECT node, count(*) AS degree, round(max(confidence) * 0.5, 6) AS best FROM
  (SELECT subject_id AS node, confidence FROM rel UNION ALL SELECT object_id, confidence FROM rel) GROUP BY node""")
def graph_edges_undirected(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(_relations(spark, d)).groupBy("node").agg(F.count("*").alias("degree"), F.round(F.max("score"), 6).alias("best"))


@query(_BFS + " SELECT qid, CAST(place AS INTEGER) AS place, array_to_string(rels, ',') AS rels, round(score, 8) AS score, joined FROM b")
def graph_bfs_depth2(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("qid", "place", F.array_join("rels", ",").alias("rels"), F.round("score", 8).alias("score"), "joined")


@query(_BFS + " SELECT qid, bool_or(joined OR score >= 0.2) AS path_found, count(*) AS n_paths FROM b GROUP BY qid")
def graph_path_found(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).groupBy("qid").agg(F.bool_or(F.col("joined") | (F.col("score") >= 0.2)).alias("path_found"), F.count("*").alias("n_paths"))


@query(_BFS + """, c AS (SELECT qid, place, unnest(chunks) AS chunk_id, generate_subscripts(chunks, 1) AS pos FROM b),
  f AS (SELECT qid, chunk_id, min(place * 100 + pos) AS spot FROM c GROUP BY ALL)
  SELECT qid, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spot, chunk_id) AS rank FROM f) WHERE rank <= 8""")
def graph_provenance(spark: SparkSession, d: str) -> DataFrame:
    return G.provenance(_paths(spark, d), 8)


@query("""WITH x AS (SELECT doc_ref, min(doc_id) AS doc_id FROM documents GROUP BY doc_ref),
  s AS (SELECT d.doc_ref, unnest(d.sentences) AS s, generate_subscripts(d.sentences, 1) - 1 AS ord FROM documents d JOIN x USING (doc_id)),
  t AS (SELECT DISTINCT triple_id, split_part(chunk_id, ':', 1) AS doc_ref, evidence_start, evidence_end FROM triples WHERE evidence_start >= 0),
  m AS (SELECT triple_id, ord, least(evidence_end, s.end_offset) - greatest(evidence_start, s.start_offset) AS shared FROM t JOIN s USING (doc_ref))
  SELECT triple_id, CAST(ord AS INTEGER) AS ord, shared FROM (SELECT *, row_number() OVER (PARTITION BY triple_id ORDER BY shared DESC, ord) AS p FROM m WHERE shared > 0) WHERE p = 1""")
def relink_best_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The given sentence that each triple's evidence shares most with."""
    docs = table(spark, d, "documents")
    first = docs.groupBy("doc_ref").agg(F.min("doc_id").alias("doc_id"))
    spans = docs.join(first.select("doc_id"), "doc_id", "left_semi").select("doc_ref", F.posexplode("sentences").alias("ord", "s")).select("doc_ref", "ord", "s.*")
    doc = F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("doc_ref")
    evidence = table(spark, d, "triples").filter("evidence_start >= 0").select("triple_id", doc, "evidence_start", "evidence_end").distinct()
    return G.best_overlap(evidence, spans, "doc_ref").select("triple_id", "ord", "shared")


_PLAIN = "trim(regexp_replace(lower(surface), '[^a-z0-9]+', ' ', 'g'))"
_MENTIONS = f"""WITH r AS (SELECT DISTINCT * FROM triples),
  e AS (SELECT upper(trim(subject_type)) AS kind, trim(subject) AS surface FROM r UNION ALL SELECT upper(trim(object_type)), trim(object) FROM r),
  m AS (SELECT kind, {_PLAIN} AS norm, surface, count(*) AS n FROM e WHERE {_PLAIN} <> '' AND kind IS NOT NULL GROUP BY ALL)"""
_PAIRS = _MENTIONS + """, g AS (SELECT kind, norm, list_distinct(flatten(list_transform(string_split(norm, ' '),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS grams FROM (SELECT DISTINCT kind, norm FROM m)),
  p AS (SELECT a.kind, a.norm AS a, b.norm AS b, len(list_intersect(a.grams, b.grams)) AS x, len(a.grams) + len(b.grams) AS y
    FROM g a JOIN g b ON a.kind = b.kind AND split_part(a.norm, ' ', 1) = split_part(b.norm, ' ', 1) AND a.norm < b.norm),
  j AS (SELECT kind, a, b, x / (y - x) AS sim FROM p WHERE x / (y - x) >= 0.8)"""


@query(_MENTIONS + " SELECT kind, norm, surface, n FROM m")
def er_mentions(spark: SparkSession, d: str) -> DataFrame:
    return R.mentions(table(spark, d, "triples"))


@query(_MENTIONS + """ SELECT kind, norm, surface AS name, CAST(total AS BIGINT) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY kind, norm) AS total,
  row_number() OVER (PARTITION BY kind, norm ORDER BY n DESC, length(surface) DESC, surface) AS p FROM m) WHERE p = 1""")
def er_canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return R.canonical_names(R.mentions(table(spark, d, "triples")))


def _alike(spark: SparkSession, d: str) -> DataFrame:
    return R.alike_pairs(R.mentions(table(spark, d, "triples")).select("kind", "norm").distinct(), 0.8)


@query(_PAIRS + " SELECT kind, a, b, round(sim, 6) AS sim FROM j")
def er_blocking_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _alike(spark, d).withColumn("sim", F.round("sim", 6))


@query(_PAIRS.replace("WITH r", "WITH RECURSIVE r", 1) + """, ed AS (SELECT kind || '|' || a AS u, kind || '|' || b AS v FROM j UNION SELECT kind || '|' || b, kind || '|' || a FROM j),
  c(node, root) AS (SELECT u, u FROM ed UNION SELECT ed.v, c.root FROM c JOIN ed ON ed.u = c.node)
  SELECT node, min(root) AS root FROM c GROUP BY node""")
def er_name_merge_components(spark: SparkSession, d: str) -> DataFrame:
    """Names alike, through any chain: the cluster of each; `er_merge_rule_components` has the merge rule."""
    pairs = _alike(spark, d).select(F.concat_ws("|", "kind", "a").alias("a"), F.concat_ws("|", "kind", "b").alias("b"))
    return G.components(pairs)


@query()
def er_merge_rule_components(spark: SparkSession, d: str) -> DataFrame:
    """Names in documents merged by the rule (0.92; persons by document or neighbour): the entity of each."""
    found = G.components(R.merge_edges(table(spark, d, "triples")))
    return found.filter("node like 'n|%'")


@query()
def alias_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Names of all types in the questions: aliases similar to a run of the question; score
    confidence x similarity of at least 0.45, aliases inside better longer ones dropped."""
    rows = table(spark, d, "triples")
    names = rows.select(F.trim("subject").alias("alias"), "confidence").unionByName(rows.select(F.trim("object").alias("alias"), "confidence"))
    names = names.filter("alias <> ''").groupBy("alias").agg(F.max("confidence").alias("confidence"))
    asked = table(spark, d, "gold_items").filter("question is not null").select("id", "question").distinct()
    return R.alias_seeds(names, asked, 0.45).select("id", "alias", F.round("score", 6).alias("score"))
