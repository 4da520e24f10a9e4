"""Chunks of documents: fixed word windows, packed sentences, breaks by meaning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import sentence_spans_of, squeeze


def words_of(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def fixed_windows(docs: DataFrame, key: str, text: str, size: int = 64, overlap: int = 16) -> DataFrame:
    """(key, ord, words): windows of `size` words that share `overlap` with the one before.

    The last may be short; none only repeats the overlap. Texts without words have none.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    step = size - overlap
    rows = docs.select(F.col(key), words_of(F.col(text)).alias("all")).filter(F.size("all") > 0)
    count = F.greatest(F.lit(1), F.ceil((F.size("all") - overlap) / step)).cast("int")
    rows = rows.withColumn("ord", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.select(key, "ord", F.slice("all", F.col("ord") * step + 1, F.lit(size)).alias("words"))


def packed_spans(text: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, words) of runs of whole sentences of at most `most` words; longer ones alone."""
    chunks: list[tuple[int, int, int]] = []
    for start, end in sentence_spans_of(text):
        n = len(text[start:end].split())
        if chunks and chunks[-1][2] + n <= most:
            chunks[-1] = (chunks[-1][0], end, chunks[-1][2] + n)
        else:
            chunks.append((start, end, n))
    return chunks


def sentence_chunks(docs: DataFrame, key: str, text: str, most: int = 96) -> DataFrame:
    """(key, ord, start_offset, end_offset, n_words): packed sentences."""

    @F.pandas_udf("array<struct<start_offset:int,end_offset:int,n_words:int>>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("start_offset", "end_offset", "n_words"), c)) for c in packed_spans(t or "", most)])

    rows = docs.select(F.col(key), F.posexplode(pack(F.col(text))).alias("ord", "c"))
    return rows.select(key, "ord", "c.*")


def meaning_breaks(steps: DataFrame, key: str, order: str, distance: str, percentile: float = 0.9) -> DataFrame:
    """`steps` with `segment`: a new one begins after each distance above the key's percentile."""
    whole = Window.partitionBy(key)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    limit = F.percentile(F.col(distance), F.lit(percentile)).over(whole)
    broken = steps.withColumn("broken", F.coalesce((F.col(distance) > limit).cast("int"), F.lit(0)))
    return broken.withColumn("segment", F.coalesce(F.sum("broken").over(before), F.lit(0))).drop("broken")


def check_offsets(chunks: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Chunks whose text isn't the document's text between their offsets."""
    joined = chunks.join(docs.select(key, F.col("text").alias("whole")), key)
    cut = F.substring(F.col("whole"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return joined.filter(~cut.eqNullSafe(F.col("chunk"))).drop("whole")
