"""Triples out of model replies: parsed, checked against their passage, split into kept and rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import match_form, occurs

REPLY = (
    "triples array<struct<chunk:int,subject:string,subject_type:string,predicate:string,object:string,"
    "object_type:string,evidence:string,confidence:double>>"
)
TYPES = ("PERSON", "ORG", "PLACE", "WORK", "EVENT", "DATE", "OTHER")


def parsed(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """`replies` with one row for each item of the reply; a reply that is no JSON has reason bad_json."""
    payload = F.regexp_replace(F.col(reply), r"(?s)<thought>.*?</thought>|^\s*```[a-z]*\s*|\s*```\s*$", "")
    rows = replies.withColumn("_r", F.from_json(payload, REPLY, {"mode": "PERMISSIVE"}))
    bad = F.col("_r").isNull() | F.col("_r.triples").isNull()
    items = rows.withColumn("reason", F.when(bad, "bad_json")).withColumn("item", F.explode_outer(F.col("_r.triples")))
    return items.drop("_r").filter("item is not null or reason is not null")


def screened(items: DataFrame, text: str = "text", least: float = 0.5, ratio: float = 0.9) -> DataFrame:
    """`items` with `reason`, the first that applies: a bad schema, an empty part, a self loop, a
    subject or object that isn't in the passage, low confidence; null for the kept."""

    i = lambda f: F.col("item").getField(f)
    bare = lambda f: match_form(i(f))
    schema = ~i("subject_type").isin(*TYPES) | ~i("object_type").isin(*TYPES) | ~F.coalesce(i("confidence"), F.lit(-1.0)).between(0, 1)
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.coalesce(schema, F.lit(True)), "bad_schema")
        .when((bare("subject") == "") | (bare("object") == "") | (F.trim(F.coalesce(i("predicate"), F.lit(""))) == ""), "empty")
        .when(bare("subject") == bare("object"), "self_loop")
        .when(~occurs(i("subject"), F.col(text), ratio), "subject_not_in_source")
        .when(~occurs(i("object"), F.col(text), ratio), "object_not_in_source")
        .when(i("confidence") < least, "low_confidence")
    )
    return items.withColumn("reason", reason)


def summary(checked: DataFrame) -> DataFrame:
    """(kept, rejected, reject_rate, bad_replies): the rate leaves out whole replies that failed."""
    kept = F.count_if(F.col("reason").isNull())
    rejected = F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "bad_json"))
    return checked.agg(
        kept.alias("kept"), rejected.alias("rejected"), F.round(F.try_divide(rejected, kept + rejected), 4).alias("reject_rate"),
        F.count_if(F.col("reason") == "bad_json").alias("bad_replies"),
    )


def evidence_span(evidence: str, text: str) -> Column:
    """struct(start, end) of the evidence in the text, whatever the case; else of the whole text."""
    at = F.expr(f"locate(lower({evidence}), lower({text}))")
    found = (at > 0) & (F.length(evidence) > 0)
    return F.struct(
        F.when(found, at - 1).otherwise(0).alias("start"), F.when(found, at - 1 + F.length(evidence)).otherwise(F.length(text)).alias("end")
    )
