"""Model answers as data: context blocks, citations bound to hits, coverage, judge and rerank replies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.functions.text import marker_numbers, split_answer

#: Fixed value: the answer where the context doesn't hold one.
NOT_ENOUGH = "Not enough context."
_MARKER = r"\[[0-9]+(?:\s*,\s*[0-9]+)*\]"


def context_blocks(hits: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, context): the blocks '[n] title, text' of each question in the order of rank."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit("\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


@F.pandas_udf(StringType())
def _only_valid(text: pd.Series, blocks: pd.Series) -> pd.Series:
    """Markers without the numbers that point at no block; empty ones go, with the blank before a stop."""

    def one(t: str | None, n: int) -> str | None:
        if t is None:
            return None
        kept = re.sub(_MARKER, lambda m: "[" + ", ".join(x for x in re.findall(r"\d+", m.group()) if 1 <= int(x) <= n) + "]", t)
        return re.sub(r"\s+([.,;])", r"\1", kept.replace("[]", "")).strip()

    return pd.Series([one(t, int(n)) for t, n in zip(text, blocks)])


def bound(answers: DataFrame, raw: str = "raw", blocks: str = "n_blocks") -> DataFrame:
    """`answers` with short, text, citations (valid block numbers, once, in order) and invalid.

    A reply that says there is not enough context, or that has no blocks, has the fixed text
    and no citations.
    """
    folded = F.translate(F.coalesce(F.col(raw), F.lit("")), "【】［］", "[][]")
    rows = answers.withColumn("_s", split_answer(folded))
    short = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("_s.short", _MARKER, "")), r"^[\s*_\"']+|[\s*_\"']+$", ""), r"\.+\s*$", "")
    none = F.lower(short).startswith(NOT_ENOUGH.rstrip(".").lower()) | (F.col(blocks) < 1)
    told = _only_valid(F.col("_s.explanation"), F.col(blocks))
    rows = rows.withColumns({"short": F.when(none, NOT_ENOUGH).otherwise(F.trim(short)), "_told": F.when(none, "").otherwise(told)})
    text = F.when(none, NOT_ENOUGH).when(F.col("_told") == "", F.col("short")).otherwise(F.concat_ws(". ", "short", "_told"))
    n = F.col(blocks)
    wrong = F.size(F.filter(marker_numbers(folded), lambda x: (x < 1) | (x > n)))
    rows = rows.withColumns({"text": text, "citations": F.array_distinct(marker_numbers(F.col("_told"))), "invalid": wrong})
    return rows.drop("_s", "_told")


def coverage(text: Column, citations: Column) -> Column:
    """Share of the explanation's sentences with a valid marker; the explanation begins after the
    first '. ', and a marker after a full stop belongs to the sentence before it."""
    at = F.locate(". ", text)
    told = F.when(at > 0, F.substr(text, at + 2)).otherwise("")
    moved = F.regexp_replace(told, rf"([.!?])\s*((?:{_MARKER}\s*)*{_MARKER})\s*", " $2$1 ")
    parts = F.filter(F.split(F.trim(moved), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    cited = F.filter(parts, lambda s: F.arrays_overlap(marker_numbers(s), citations))
    return F.coalesce(F.try_divide(F.size(cited), F.size(parts)), F.lit(0.0))


def judge_scores(reply: str) -> Column:
    """struct(faithfulness, relevance, completeness) in 0..1 from whole numbers 1..5, null if any
    is missing, no whole number (true, 4.0, "4") or out of range, or the reply is no JSON."""
    payload = rf"regexp_replace({reply}, '(?s)<thought>.*?</thought>|^\\s*```[a-z]*\\s*|\\s*```\\s*$', '')"
    names = ("faithfulness", "relevance", "completeness")
    value = lambda m: f"try_variant_get(try_parse_json({payload}), '$.{m}', 'variant')"
    good = " and ".join(f"coalesce(schema_of_variant({value(m)}) = 'BIGINT' and try_variant_get({value(m)}, '$', 'int') between 1 and 5, false)" for m in names)
    scores = ", ".join(f"'{m}', (try_variant_get({value(m)}, '$', 'int') - 1) / 4.0D" for m in names)
    return F.expr(f"case when {good} then named_struct({scores}) end")


def rerank_order(reply: Column, blocks: Column) -> Column:
    """The order a model gives, as different numbers of blocks; null if there is none in it."""
    listed = F.from_json(F.regexp_extract(reply, r"\[[^\]]*\]", 0), "array<int>")
    order = F.array_distinct(F.filter(listed, lambda x: (x >= 1) & (x <= blocks)))
    return F.when(F.size(order) > 0, order)
