"""Answer and retrieval metrics as column expressions, and unions of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_match(prediction: Column, gold: Column) -> Column:
    """1.0 if the two normalized answers are equal, else 0.0."""
    return (prediction == gold).cast("double")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the two normalized answers' words, repeats counted; yes and no must be equal."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    p, g = words(prediction), words(gold)
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    same = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda s, w: s + F.least(count(p, w), count(g, w)))
    f1 = F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))
    closed = prediction.isin("yes", "no", "noanswer") | gold.isin("yes", "no", "noanswer")
    return F.when(closed & (prediction != gold), 0.0).otherwise(f1)


def recall_at_k(titles: Column, gold: Column, k: int) -> Column:
    """Share of the different gold titles among the first k of a ranked array."""
    found = F.size(F.array_intersect(F.slice(titles, 1, k), gold))
    return F.coalesce(F.try_divide(found, F.size(F.array_distinct(gold))), F.lit(0.0))


def reciprocal_rank(titles: Column, gold: Column) -> Column:
    first = F.array_min(F.filter(F.transform(gold, lambda t: F.array_position(titles, t)), lambda i: i > 0))
    return F.coalesce(1.0 / first, F.lit(0.0))


def covered(spans: DataFrame, key: str, start: str = "start_offset", end: str = "end_offset") -> DataFrame:
    """(key, covered): how many characters a key's spans cover, overlaps counted once."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    from_ = F.greatest(F.col(start), F.coalesce(F.max(end).over(before), F.col(start)))
    new = spans.filter(F.col(end) > F.col(start)).withColumn("new", F.greatest(F.lit(0), F.col(end) - from_))
    return new.groupBy(key).agg(F.sum("new").alias("covered"))
