"""Queries over documents: identities, normal forms, sentences, chunks, markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking
from tessella.plans.registry import query
from tessella.session import table

_SQUEEZED = f"trim(regexp_replace(text, '{T.SPACE}+', ' ', 'g'))"
_WORDS = f"list_filter(string_split({_SQUEEZED}, ' '), lambda w: w <> '')"


@query("SELECT doc_id, substr(sha1(source || '|' || title), 1, 16) AS ref, substr(sha1(source || '|' || title), 1, 16) = doc_ref AS same FROM documents")
def doc_ids_sha1(spark: SparkSession, d: str) -> DataFrame:
    ref = F.substring(F.sha1(F.concat_ws("|", "source", "title")), 1, 16)
    return table(spark, d, "documents").select("doc_id", ref.alias("ref"), (ref == F.col("doc_ref")).alias("same"))


@query("SELECT id, CAST(CAST('0x' || substr(sha1(id), 1, 8) AS BIGINT) % 4 AS INTEGER) AS slice FROM gold_items")
def slice_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_items").select("id", T.sha_slice(F.col("id"), 4).alias("slice"))


@query(f"SELECT doc_id, md5({_SQUEEZED.replace('text', 'nfc_normalize(text)', 1)}) AS print FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.squeeze(T.nfc(F.col("text")))).alias("print"))


@query(f"SELECT doc_id, len({_WORDS}) AS n_words FROM documents WHERE text IS NOT NULL")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query("""SELECT regexp_replace(regexp_replace(lower(predicate), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name,
  count(*) AS n FROM triples GROUP BY 1""")
def snake_case_predicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triples").groupBy(T.snake_case(F.col("predicate")).alias("name")).agg(F.count("*").alias("n"))


_PUNCT = T.PUNCTUATION.replace("'", "''")
_ANSWER = f"trim(regexp_replace(regexp_replace(translate(lower(answer), '{_PUNCT}', ''), '\\b(a|an|the)\\b', ' ', 'g'), '{T.SPACE}+', ' ', 'g'))"


@query(f"SELECT id, {_ANSWER} AS answer FROM gold_items")
def answer_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_items").select("id", T.normalize_answer(F.col("answer")).alias("answer"))


@query("SELECT source, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY source")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text is not null")
    return rows.groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).cast("long").alias("tokens"))


@query("""WITH m AS (SELECT doc_id, list_transform(flatten(list_transform(
    regexp_extract_all(translate(text, '【】［］', '[][]'), '\\[([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1),
    lambda g: string_split(g, ','))), lambda x: CAST(trim(x) AS BIGINT)) AS numbers FROM documents)
  SELECT doc_id, numbers, len(list_filter(numbers, lambda x: x < 1 OR x > 8)) AS invalid FROM m WHERE len(numbers) > 0""")
def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers of each text, and how many point past eight blocks."""
    rows = table(spark, d, "documents").select("doc_id", T.marker_numbers(F.col("text")).alias("numbers")).filter(F.size("numbers") > 0)
    wrong = F.size(F.filter("numbers", lambda n: (n < 1) | (n > 8)))
    return rows.select("doc_id", "numbers", wrong.cast("long").alias("invalid"))


@query("""WITH s AS (SELECT doc_id, source, length(text) AS size, unnest(sentences) AS s FROM documents)
  SELECT source, count(*) AS n,
    count(*) FILTER (s.start_offset < 0 OR s.end_offset > coalesce(size, 0) OR s.end_offset < s.start_offset) AS outside,
    count(*) FILTER (s.end_offset = s.start_offset) AS empty FROM s GROUP BY source""")
def sentence_span_check(spark: SparkSession, d: str) -> DataFrame:
    """Given sentences per source: those outside their text, those of no length."""
    rows = table(spark, d, "documents").select("source", F.length("text").alias("size"), F.inline("sentences"))
    outside = (F.col("start_offset") < 0) | (F.col("end_offset") > F.coalesce("size", F.lit(0))) | (F.col("end_offset") < F.col("start_offset"))
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(outside).alias("outside"), F.count_if(F.col("start_offset") == F.col("end_offset")).alias("empty")
    )


@query()
def sentences_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """The sentences that the rule finds in each text."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentence_spans(F.col("text"))).alias("ord", "s"))
    return rows.select("doc_id", "ord", "s.*")


@query(f"""WITH w AS (SELECT doc_id, doc_ref, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
  o AS (SELECT *, unnest(range(CAST(greatest(1, ceil((len(words) - 16) / 48)) AS BIGINT))) AS ord FROM w WHERE len(words) > 0)
  SELECT doc_id, CAST(ord AS INTEGER) AS ord, doc_ref || ':fixed:' || ord AS chunk_id,
    len(words[ord * 48 + 1 : ord * 48 + 64]) AS n_words, md5(array_to_string(words[ord * 48 + 1 : ord * 48 + 64], ' ')) AS print FROM o""")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("key", F.struct("doc_id", "doc_ref"))
    rows = chunking.fixed_windows(docs, "key", "text")
    return rows.select(
        "key.doc_id", "ord", F.concat_ws(":", "key.doc_ref", F.lit("fixed"), "ord").alias("chunk_id"),
        F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("print"),
    )


@query()
def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_chunks(table(spark, d, "documents"), "doc_id", "text")


@query(f"""SELECT doc_id, 0 AS wrong, CAST(len({_WORDS}) AS BIGINT) AS n_words FROM documents
  WHERE text IS NOT NULL AND len({_WORDS}) > 0""")
def chunk_offsets_check(spark: SparkSession, d: str) -> DataFrame:
    """Sentence chunks of each text: none above the size unless of one sentence, all words kept."""
    docs = table(spark, d, "documents")
    chunks = chunking.sentence_chunks(docs, "doc_id", "text").join(docs.select("doc_id", "text"), "doc_id")
    piece = F.substring(F.col("text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return chunks.groupBy("doc_id").agg(
        F.max((T.word_count(piece) != F.col("n_words")).cast("int")).alias("wrong"), F.sum("n_words").alias("n_words")
    )


@query("""WITH s AS (SELECT doc_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS ord FROM documents),
  l AS (SELECT doc_id, ord, s.end_offset - s.start_offset AS size,
    abs(lead(s.end_offset - s.start_offset) OVER (PARTITION BY doc_id ORDER BY ord) - (s.end_offset - s.start_offset)) AS distance FROM s),
  b AS (SELECT *, CASE WHEN distance > quantile_cont(distance, 0.9) OVER (PARTITION BY doc_id) THEN 1 ELSE 0 END AS broken FROM l)
  SELECT doc_id, CAST(ord - 1 AS INTEGER) AS ord, CAST(coalesce(sum(broken) OVER (
    PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM b""")
def chunk_by_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Segments broken where neighbouring sentences differ most; the difference is in length here,
    as there are no vectors of sentences."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode("sentences").alias("ord", "s"))
    size = F.col("s.end_offset") - F.col("s.start_offset")
    after = F.lead(size).over(chunking.Window.partitionBy("doc_id").orderBy("ord"))
    steps = rows.withColumn("distance", F.abs(after - size).cast("double"))
    return chunking.meaning_breaks(steps, "doc_id", "ord", "distance").select("doc_id", "ord", "segment")


@query("""SELECT source, lang, count(*) AS n_docs, count(text) AS n_texts, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest
  FROM documents GROUP BY source, lang""")
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("n_docs"), F.count("text").alias("n_texts"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest")
    )


@query("""SELECT source, title, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY source, title HAVING count(*) > 1""")
def first_seen_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles fetched again: the first document counts."""
    rows = table(spark, d, "documents").groupBy("source", "title").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    return rows.filter("n > 1")
