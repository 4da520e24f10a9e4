"""A property graph in tables: entities, relations, bounded traversal, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import match_form, normalized_name, snake_case
from tessella.session import cut


def entity_id(kind: Column, name: Column) -> Column:
    """An entity's id by its type and normalized name: spellings that differ in form only are one node."""
    key = F.concat_ws("|", F.upper(F.trim(kind)), normalized_name(name))
    return F.concat(F.lit("e_"), F.substring(F.sha1(key), 1, 12))


def relations(triples: DataFrame) -> DataFrame:
    """(rel_id, subject_id, predicate, object_id, chunk_id, confidence, ...) of usable triples.

    Rows sent twice count once, a relation that several rows state keeps the most confident;
    self loops and rows without a type or a name of letters or digits are left out. A null confidence counts as 0.
    """
    rows = triples.filter("subject_type is not null and object_type is not null")
    rows = rows.filter((match_form(F.col("subject")) != "") & (match_form(F.col("object")) != ""))
    predicate = snake_case(F.col("predicate"))
    rows = rows.select(
        entity_id(F.col("subject_type"), F.col("subject")).alias("subject_id"), predicate.alias("predicate"),
        entity_id(F.col("object_type"), F.col("object")).alias("object_id"), "chunk_id", "triple_id", "evidence_start", "evidence_end",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    ).filter("subject_id <> object_id")
    rel_id = F.substring(F.sha1(F.concat_ws("|", "subject_id", "predicate", "object_id", "chunk_id")), 1, 16)
    best = F.max_by(F.struct("confidence", "triple_id", "evidence_start", "evidence_end"), F.struct("confidence", -F.col("triple_id")))
    kept = rows.groupBy(rel_id.alias("rel_id"), "subject_id", "predicate", "object_id", "chunk_id").agg(best.alias("b"))
    return kept.select("rel_id", "subject_id", "predicate", "object_id", "chunk_id", "b.*")


def edges(rels: DataFrame) -> DataFrame:
    """(node, other, rel_id, chunk_id, score): each relation from both its ends."""
    score = (F.col("confidence") * 0.5).alias("score")  # no cosine known: conf x (0.5 + 0.5 x 0)
    ahead = rels.select(F.col("subject_id").alias("node"), F.col("object_id").alias("other"), "rel_id", "chunk_id", score)
    return ahead.unionByName(rels.select(F.col("object_id").alias("node"), F.col("subject_id").alias("other"), "rel_id", "chunk_id", score))


def best_edges(both: DataFrame, fanout: int) -> DataFrame:
    """Each node's `fanout` best edges; tasks keep that many before the shuffle."""
    order = Window.partitionBy("node").orderBy(F.desc("score"), "rel_id")
    return both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= fanout).drop("place")


def paths(seeds: DataFrame, both: DataFrame, depth: int = 2, fanout: int = 25, most: int = 8) -> DataFrame:
    """(qid, rels, chunks, score, joined, place): the best paths from each question's seeds.

    `seeds` has (qid, node). A path never comes back to a node, its score is the product of its
    edges'; the same relations walked from the other end are one path. Paths that join seeds
    come first, then the better ones.
    """
    kept = best_edges(both, fanout)
    targets = seeds.groupBy("qid").agg(F.collect_set("node").alias("targets"))
    grown = seeds.distinct().join(targets, "qid").select(
        "qid", "targets", F.col("node").alias("start"), F.col("node").alias("end"), F.array("node").alias("seen"),
        F.expr("cast(array() as array<string>)").alias("rels"), F.expr("cast(array() as array<string>)").alias("chunks"), F.lit(1.0).alias("score"),
    )
    found = None
    for _ in range(depth):
        step = grown.join(kept.withColumnRenamed("score", "s"), grown["end"] == kept["node"]).filter(~F.array_contains("seen", F.col("other")))
        grown = step.select(
            "qid", "targets", "start", F.col("other").alias("end"), F.array_append("seen", F.col("other")).alias("seen"),
            F.array_append("rels", F.col("rel_id")).alias("rels"), F.array_append("chunks", F.col("chunk_id")).alias("chunks"), (F.col("score") * F.col("s")).alias("score"),
        )
        joined = F.size(F.array_intersect(F.array_except("seen", F.array("start")), "targets")) > 0
        now = grown.select("qid", "rels", "chunks", "score", joined.alias("joined"))
        found = now if found is None else found.unionByName(now)
    once = found.groupBy("qid", F.array_sort("rels").alias("key")).agg(
        F.max_by(F.struct("rels", "chunks", "score", "joined"), F.struct("score", "joined", "rels")).alias("p")
    )
    order = Window.partitionBy("qid").orderBy(F.desc("joined"), F.desc("score"), "rels")
    return once.select("qid", "p.*").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def provenance(found: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, rank): chunks of the best paths, in the order of paths, then of edges."""
    rows = found.select("qid", "place", F.posexplode("chunks").alias("pos", "chunk_id"))
    first = rows.groupBy("qid", "chunk_id").agg(F.min(F.struct("place", "pos")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at", "chunk_id")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "chunk_id", "rank")


def best_overlap(evidence: DataFrame, spans: DataFrame, doc: str) -> DataFrame:
    """`evidence` rows with `ord`, the span of their document that they share most with.

    The earlier of equals; none where nothing is shared.
    """
    shared = F.least("evidence_end", "end_offset") - F.greatest("evidence_start", "start_offset")
    met = evidence.join(spans, doc).withColumn("shared", shared).filter("shared > 0")
    return met.groupBy(*evidence.columns).agg(F.max_by("ord", F.struct("shared", -F.col("ord"))).alias("ord"), F.max("shared").alias("shared"))


def components(pairs: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, root): connected components of (a, b); the root is the smallest node.

    Labels move along edges and to their labels' labels; a component of diameter d is done after
    about log2(d) rounds. Each round is checkpointed.
    """
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(rounds):
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("node").alias("over"), F.col("root").alias("further"))
        moved = cut(
            labels.join(around, labels["node"] == around["a"])
            .join(jump, F.col("root") == F.col("over"), "left")
            .select("node", F.least("root", "near", "further").alias("new"), F.col("root").alias("old"))
        )
        labels = moved.select("node", F.col("new").alias("root"))
        if moved.filter("new <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
