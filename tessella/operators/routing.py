"""Choosing a route for a question: cues, votes, decision rules, replays over thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The words that the cues look for.
COMPARATIVE = (
    "older younger oldest youngest first last earlier later earliest latest more most fewer less larger smaller bigger "
    "higher lower longer shorter taller closer further farther"
).split()
AUXILIARY = "are is was were do does did has have had can".split()
WH = "what who whom when where which why how whose".split()
RELATIVE = "who whom whose which that where".split()
PREPOSITIONS = "in of on at by for from to with about during among".split()
LABELS = ("single_hop", "multi_hop", "comparison")
WORD = r"[\p{L}\p{N}_'’-]+"
NAMES = r"\b[A-Z][\p{L}\p{N}_'’.-]*(?: [A-Z][\p{L}\p{N}_'’.-]*)* and [A-Z]"


def _in(word: Column, words: list[str]) -> Column:
    return F.coalesce(word.isin(*words), F.lit(False))


def cues(question: Column) -> dict[str, Column]:
    """The twelve cues of a question; flags as 0 or 1, shares in 0..1."""
    words = F.regexp_extract_all(question, F.lit(WORD), F.lit(0))
    lower = F.transform(words, lambda w: F.lower(w))
    text = F.array_join(lower, " ")
    first, second = F.try_element_at(lower, F.lit(1)), F.try_element_at(lower, F.lit(2))
    has = lambda listed: F.arrays_overlap(lower, F.array(*map(F.lit, listed)))
    nested = F.exists(
        F.transform(lower, lambda w, i: (i >= 2) & w.isin(*RELATIVE) & ~_in(F.get(lower, i - 1), PREPOSITIONS)), lambda x: x
    )
    capital = F.filter(F.slice(words, 2, 1000), lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}"))
    chain = F.size(F.regexp_extract_all(question, F.lit(r"(?i)\bof (?:the|a|an)\b"), F.lit(0)))
    flags = {
        "or_choice": F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(" or ")),
        "both_either": has(["both", "either", "neither"]),
        "shared": text.rlike(r"\b(same|in common|share[ds]?|different|similar)\b"),
        "comparative": has(COMPARATIVE),
        "yes_no": _in(first, AUXILIARY),
        "and_names": question.rlike(NAMES),
        "relative_clause": nested,
        "possessive": question.rlike(r"[\p{L}\p{N}_]['’]s\b"),
        "wh_start": _in(first, WH) | (_in(first, PREPOSITIONS) & _in(second, ["which", "what"])),
    }
    shares = {
        "of_chain": F.least(chain, F.lit(3)) / 3,
        "names": F.least(F.size(capital), F.lit(5)) / 5,
        "length": F.least(F.size(words), F.lit(40)) / 40,
    }
    return {k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in flags.items()} | {k: F.round(v, 6) for k, v in shares.items()}


def votes(df: DataFrame) -> DataFrame:
    """`df` (with the cues) with single_hop, multi_hop and comparison votes, winner and margin."""
    c = F.col
    comparison = c("or_choice") + c("both_either") + c("shared") + c("and_names") + c("comparative") * F.greatest("or_choice", "and_names") + c("yes_no") * c("and_names")
    n = F.round(c("length") * 40)
    multi = c("relative_clause") + c("possessive") + (c("of_chain") > 0).cast("int") + (n >= 15).cast("int")
    df = df.withColumns({"comparison": comparison, "multi_hop": multi})
    plain = (c("comparison") == 0) & (c("multi_hop") == 0) & (n < 12)
    df = df.withColumn("single_hop", c("wh_start") * plain.cast("int"))
    # Ties go to the label that comes first; the array's third field orders them.
    ranked = F.array_sort(F.array(*(F.struct((-c(x)).alias("v"), F.lit(i).alias("i"), F.lit(x).alias("label")) for i, x in enumerate(LABELS))))
    margin = F.least(ranked[1]["v"] - ranked[0]["v"], F.lit(3))
    return df.withColumns({"winner": ranked[0]["label"], "margin": margin})


def calibrated(df: DataFrame, known: DataFrame) -> DataFrame:
    """`df` with `confidence`: the winner's share among known labels of its bucket, one added each."""
    counts = known.groupBy("winner", "margin").agg(F.count("*").alias("total"), F.count_if(F.col("label") == F.col("winner")).alias("right"))
    joined = df.join(F.broadcast(counts), ["winner", "margin"], "left")  # nine buckets at most
    share = (F.coalesce("right", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + 3)
    return joined.withColumn("confidence", F.round(share, 6)).drop("total", "right")


def initial_route(label: Column, confidence: Column, seeds: Column, least: float, relational: str) -> Column:
    """Unsure: hybrid; a single hop: vector; else the relational route, vector without seeds."""
    relation = F.when(F.lit(relational == "graph") & ~seeds, "vector").otherwise(relational)
    return F.when(confidence < least, "hybrid").when(label == "single_hop", "vector").otherwise(relation)


def replayed_route(label: Column, confidence: Column, top: Column, path: Column, least: Column, score: Column) -> Column:
    """The route after fallbacks, for thresholds that may be columns."""
    single = F.when(top >= score, "vector").otherwise("hybrid")
    return F.when(confidence < least, "hybrid").when(label == "single_hop", single).when(path, "graph").otherwise("hybrid")


def fused(lists: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, score, source, rank) of reciprocal rank fusion.

    `lists` has (query_id, list, id, rank), list 0 being seen first. A repeated id counts once
    in a list, at its best rank; equal scores keep the order in which ids were first seen.
    """
    best = lists.groupBy("query_id", "list", "id").agg(F.min("rank").alias("rank"))
    part = best.withColumn("share", 1.0 / (k + F.col("rank")))
    merged = part.groupBy("query_id", "id").agg(
        F.round(F.sum("share"), 12).alias("score"), F.countDistinct("list").alias("lists"), F.min("list").alias("one"), F.min(F.struct("list", "rank")).alias("first")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    source = F.when(F.col("lists") > 1, "hybrid").when(F.col("one") == 0, "vector").otherwise("graph")
    return merged.select("query_id", "id", "score", source.alias("source"), F.row_number().over(order).alias("rank"))


def diversified(hits: DataFrame, weight: float = 0.7, k: int = 8) -> DataFrame:
    """(query_id, id, rank) by maximal marginal relevance; `hits` has (query_id, id, rank, q, v).

    Hits without a vector come last, in their order. A query has few hits.
    """
    import numpy as np
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        known, rest = rows[rows["v"].notna()], rows[rows["v"].isna()]
        picked: list[int] = []
        if len(known):
            m, ids = np.array(known["v"].tolist(), float), known["id"].tolist()
            relevance, repeated, left = m @ np.array(known["q"].iloc[0], float), np.zeros(len(m)), list(range(len(m)))
            while left and len(picked) < k:
                at = left.pop(int(np.argmax(weight * relevance[left] - (1 - weight) * repeated[left])))
                picked.append(ids[at])
                repeated = np.maximum(repeated, m @ m[at])
        ranked = (picked + rest["id"].tolist())[:k]
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "id": ranked, "rank": range(1, len(ranked) + 1)})

    return hits.groupBy("query_id").applyInPandas(pick, "query_id long, id long, rank int")


def model_size(route: Column, label: Column, tokens: Column, limit: int = 2_500) -> Column:
    """struct(size, reason): large for relational labels and for long contexts."""
    long_context = F.concat(F.lit("large:context "), tokens.cast("string"), F.lit(f" tokens > {limit}"))
    small = F.concat(F.lit("small:route "), route, F.lit(", label "), F.coalesce(label, F.lit("none")), F.lit(", "), tokens.cast("string"), F.lit(" tokens"))
    reason = F.when(label.isin("multi_hop", "comparison"), F.concat(F.lit("large:label "), label)).when(tokens > limit, long_context).otherwise(small)
    return F.struct(F.split_part(reason, F.lit(":"), F.lit(1)).alias("size"), reason.alias("reason"))


def answer_confidence(coverage: Column, top: Column, path: Column, source: Column, least: float = 0.55) -> Column:
    """Half citation coverage, half retrieval strength, four decimals."""
    vector, graph = F.least(F.lit(1.0), top / least), F.when(path, 1.0).otherwise(0.3)
    strength = F.when(source == "hybrid", (vector + graph) / 2).when(source == "graph", graph).otherwise(vector)
    return F.round(0.5 * coverage + 0.5 * strength, 4)
