"""From paths to hits, response blocks, facts and routes of whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import snake_case


def present_hits(provenance: DataFrame, chunks: DataFrame) -> DataFrame:
    """`provenance` (qid, chunk_id, rank) of chunks that exist; dropped after the cut, ranks without gaps."""
    order = Window.partitionBy("qid").orderBy("rank")
    kept = provenance.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return kept.select("qid", "chunk_id", F.row_number().over(order).alias("rank"))


def block_edges(paths: DataFrame, rels: DataFrame) -> DataFrame:
    """(qid, relation): the different relations of each question's paths."""
    return paths.select("qid", F.explode("rels").alias("rel_id")).distinct().join(rels, "rel_id")


def block_nodes(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(qid, node, seed): ends of the edges, and all seeds, alone or not."""
    ends = edges.select("qid", F.explode(F.array("subject_id", "object_id")).alias("node"), F.lit(False).alias("seed"))
    return ends.unionByName(seeds.select("qid", "node", F.lit(True).alias("seed"))).groupBy("qid", "node").agg(F.bool_or("seed").alias("seed"))


def relation_text(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws(" ", F.trim(subject), F.replace(snake_case(predicate), F.lit("_"), F.lit(" ")), F.trim(object_))


def facts(edges: DataFrame) -> DataFrame:
    """(qid, block, fact): lines on (subject, predicate, object) that cite the hit of their chunk; each once."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), relation_text(F.col("subject"), F.col("predicate"), F.col("object")))
    return edges.select("qid", F.col("rank").alias("block"), line.alias("fact")).distinct()


def routed(found: DataFrame, single: Column, least: float) -> DataFrame:
    """`found` (qid, top, path) with the first and the final route: one fallback, to both backends.

    A null top score or path counts as not found.
    """
    path = F.coalesce("path", F.lit(False))
    final = F.when(single & (F.col("top") >= least), "vector").when(~single & path, "graph").otherwise("hybrid")
    return found.select("qid", F.when(single, "vector").otherwise("graph").alias("first_route"), final.alias("final_route"), F.round("top", 4).alias("top"), path.alias("path"))


def retention(evidence: DataFrame, spans: DataFrame, doc: str) -> DataFrame:
    """(doc, n, retention): the share of a document's evidence that one of its spans holds wholly."""
    around = (F.col("start_offset") <= F.col("evidence_start")) & (F.col("end_offset") >= F.col("evidence_end"))
    inside = evidence.join(spans, doc).filter(around).select("triple_id").distinct().withColumn("whole", F.lit(1))
    marked = evidence.join(inside, "triple_id", "left")
    return marked.groupBy(doc).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("whole", F.lit(0))), 6).alias("retention"))
