"""Sources and sinks: question records, gold items, multi-kind corpus files, keyed appends."""

from __future__ import annotations

import base64
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from tessella.functions.text import squeeze

RECORD = (
    "_id string, question string, answer string, type string, level string, "
    "supporting_facts array<array<string>>, context array<array<string>>"
)
GOLD = (
    "id string, question string, answer string, type string, split string, supporting_titles array<string>, "
    "supporting_sentences array<struct<title:string,idx:int>>, source string, verified_by string, notes string"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Question records of a JSON array: facts as (title, sent), context as (title, sentences); `position` is their order."""
    raw = spark.read.schema(RECORD).json(path, multiLine=True).withColumn("position", F.monotonically_increasing_id())
    facts = F.transform("supporting_facts", lambda f: F.struct(f[0].alias("title"), f[1].cast("int").alias("sent")))
    context = F.transform("context", lambda c: F.struct(c[0].alias("title"), F.from_json(c[1], "array<string>").alias("sentences")))
    return raw.withColumns({"supporting_facts": facts, "context": context})


def zip_context(rows: DataFrame, titles: str, sentences: str) -> Column:
    """Columns of lists (a mirror's layout) as an array of (title, sentences)."""
    return F.transform(F.arrays_zip(titles, sentences), lambda x: F.struct(x[titles].alias("title"), x[sentences].alias("sentences")))


def joined_sentences(sentences: Column) -> Column:
    """struct(text, sentences): squeezed sentences joined by one blank, and the span of each.

    An empty sentence keeps its place with a span of no length; it adds no blank.
    """
    clean = F.transform(sentences, lambda s: squeeze(s))
    start = F.struct(F.lit("").alias("text"), F.expr("cast(array() as array<struct<start_offset:int,end_offset:int>>)").alias("sentences"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.when((F.length(acc["text"]) > 0) & (F.length(s) > 0), " ").otherwise("")
        text = F.concat(acc["text"], gap, s)
        span = F.struct((F.length(text) - F.length(s)).cast("int").alias("start_offset"), F.length(text).cast("int").alias("end_offset"))
        return F.struct(text.alias("text"), F.array_append(acc["sentences"], span).alias("sentences"))

    return F.aggregate(clean, start, add)


def documents_of(records: DataFrame, source: str) -> DataFrame:
    """(doc_ref, source, title, text, sentences): each title once, as its first record has it."""
    rows = records.select("position", F.posexplode("context").alias("pos", "c")).select("position", "pos", "c.title", "c.sentences")
    first = rows.groupBy("title").agg(F.min_by("sentences", F.struct("position", "pos")).alias("sentences"))
    joined = first.select("title", joined_sentences(F.col("sentences")).alias("j"))
    ref = F.substring(F.sha1(F.concat_ws("|", F.lit(source), "title")), 1, 16)
    return joined.select(ref.alias("doc_ref"), F.lit(source).alias("source"), "title", "j.text", "j.sentences")


def gold_of(records: DataFrame) -> DataFrame:
    """Records as gold items: types mapped, titles once in their order."""
    kind = F.when(F.col("type") == "comparison", "comparison").otherwise("multi_hop")
    titles = F.array_distinct(F.transform("supporting_facts", lambda f: f["title"]))
    spans = F.transform("supporting_facts", lambda f: F.struct(f["title"].alias("title"), f["sent"].alias("idx")))
    return records.select(
        F.concat(F.lit("hp_"), "_id").alias("id"), "question", "answer", kind.alias("type"), F.lit("").alias("split"),
        titles.alias("supporting_titles"), spans.alias("supporting_sentences"),
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).json(path)


def write_corpus(kinds: dict[str, DataFrame], path: str) -> None:
    """Rows of several kinds in one folder of gzip JSON lines, with a count of each kind."""
    merged = None
    for kind, rows in kinds.items():
        line = rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        merged = line if merged is None else merged.unionByName(line)
    counts = merged.groupBy("kind").count()
    meta = counts.select(F.lit("meta").alias("kind"), F.to_json(F.struct(F.col("kind").alias("of"), F.col("count").alias("n"))).alias("row"))
    merged.unionByName(meta).write.mode("errorifexists").option("compression", "gzip").json(path)


def read_corpus(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The rows of each kind; raises if a kind has not as many as were written."""
    lines = spark.read.schema("kind string, row string").json(path)
    meta = lines.filter("kind = 'meta'").select(F.from_json("row", "of string, n long").alias("m")).select("m.*")
    counts = lines.filter("kind <> 'meta'").groupBy(F.col("kind").alias("of")).agg(F.count("*").alias("found"))
    wrong = meta.join(counts, "of", "full").filter("not (n <=> found)")
    if not wrong.isEmpty():
        raise ValueError(f"counts differ from those written in {path}")
    return {k: lines.filter(F.col("kind") == k).select(F.from_json("row", s).alias("r")).select("r.*") for k, s in schemas.items()}


def content_hash(rows: DataFrame) -> DataFrame:
    """(n, print): the same for the same rows in any order or partitioning, repeats counted."""
    mark = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(mark, at, 12), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("n"), F.concat_ws("-", *(F.coalesce(part(at), F.lit(0)).cast("string") for at in (1, 13, 25))).alias("print"))


@F.pandas_udf(StringType())
def encoded_vector(v: pd.Series) -> pd.Series:
    """A float vector as base64 of its little-endian bytes."""
    return v.map(lambda x: None if x is None else base64.b64encode(struct.pack(f"<{len(x)}f", *x)).decode())


@F.pandas_udf(ArrayType(FloatType()))
def decoded_vector(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else list(struct.unpack(f"<{len(base64.b64decode(t)) // 4}f", base64.b64decode(t))))


def absent(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key isn't stored yet, the smallest row of each key: what an append may write."""
    order = Window.partitionBy(*key).orderBy(*new.columns)
    once = new.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")
    return once.join(stored.select(*key), key, "left_anti")


def filled(rows: DataFrame, vectors: DataFrame, key: str, column: str) -> DataFrame:
    """`rows` with `column` from `vectors` where that has one."""
    new = vectors.select(key, F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def table_cells(lines: DataFrame, cells: int) -> DataFrame:
    """Rows of Markdown tables with `cells` cells of which the first is a number."""
    parts = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return lines.select(parts.alias("cells")).filter((F.size("cells") == cells) & F.col("cells")[0].rlike("^[0-9]+$"))
