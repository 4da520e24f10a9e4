"""Problem 6: token ids of a whole corpus by a public byte-level BPE.

Method: overlapping chunk encoding. Long texts are cut into overlapping chunks that are
pre-tokenised in parallel; two neighbouring chunks are stitched at the first pre-token
boundary both of them have in their overlap. The pre-tokeniser scans from left to right and
looks back at nothing, so from a common boundary on both scans are the same scan: cutting
there changes no id. Pieces between stitches are encoded and their ids concatenated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of this public vocabulary.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(text: str) -> list[int]:
    """Ends of the pre-tokens of `text` (offsets in characters)."""
    return [m.end() for m in _pattern().finditer(text)]


def _encode_batches(path: str, keep: list[str], counts_only: bool):
    """mapInArrow: the columns `keep`, and the ids (or only their number) of column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            rows = [enc.encode_ordinary(t) if t else [] for t in texts]
            sizes = np.fromiter((len(r) for r in rows), np.int32, len(rows))
            if counts_only:
                out = pa.array(sizes, pa.int64())
                yield pa.RecordBatch.from_arrays([*cols, out], names=[*keep, "n_tokens"])
                continue
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            flat = np.fromiter((i for r in rows for i in r), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*cols, ids], names=[*keep, "ids"])

    return run


def _edges(overlap: int):
    """mapInArrow over chunks: pre-token boundaries (document offsets) in both overlaps.

    A chunk's last boundary may be due to its end, so those within one character of the end
    are left out; so are those after white space, as a pre-token of white space depends on what
    follows it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            heads, tails = [], []
            for text, at, step in zip(
                cols["text"].to_pylist(), cols["at"].to_pylist(), cols["step"].to_pylist()
            ):
                ends = boundaries(text)
                safe = [e for e in ends if e < len(text) - 1 and not text[e - 1].isspace()]
                heads.append([at + e for e in safe if e <= overlap])
                tails.append([at + e for e in safe if e >= step])
            yield pa.RecordBatch.from_arrays(
                [
                    cols["key"], cols["at"],
                    pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64())),
                ],
                names=["key", "at", "head", "tail"],
            )

    return run


def stitch_points(edges: DataFrame) -> DataFrame:
    """(key, at, cut): where the chunk starting at `at` takes over; null: no common boundary."""
    before = Window.partitionBy("key").orderBy("at")
    common = F.array_min(F.array_intersect(F.col("head"), F.col("before")))
    return (
        edges.withColumn("before", F.lag("tail").over(before))
        .select("key", "at", F.when(F.col("at") == 0, F.lit(0)).otherwise(common).alias("cut"))
    )


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = TOKENIZER_PATH,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    counts_only: bool = False,
) -> DataFrame:
    """(id_col, ids), or with counts_only (id_col, n_tokens), one row for each row of `docs`.

    Null, empty and short texts: a null or empty text has the empty list of ids. Strings that
    look like special tokens are ordinary text. Repeated rows come out as often as they stand, but
    texts over `chunk_chars` once for each id and text. Other columns are ignored, whatever
    their names. Texts over `chunk_chars` characters go through chunks; where two chunks have
    no common boundary (one run of letters fills the overlap) the document is one piece.
    """
    if overlap >= chunk_chars:
        raise ValueError("the overlap must be smaller than a chunk")
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    result = "n_tokens long" if counts_only else "ids array<int>"
    key_type = slim.schema["key"].dataType.simpleString()
    size = F.length("text")
    whole_run = _encode_batches(path, ["key"], counts_only)
    short = slim.filter(F.col("text").isNull() | (size <= chunk_chars))
    short = short.mapInArrow(whole_run, f"key {key_type}, {result}")

    step = chunk_chars - overlap
    long_docs = slim.filter(size > chunk_chars).select(
        F.struct("key", F.xxhash64("text").alias("print")).alias("key"), "text"
    )
    long_type = long_docs.schema["key"].dataType.simpleString()
    chunks = long_docs.select(
        "key", "text",
        F.explode(F.sequence(F.lit(0), F.greatest(size - overlap - 1, F.lit(0)), F.lit(step))).alias("at"),
    ).select("key", "at", F.substring("text", F.col("at") + 1, F.lit(chunk_chars)).alias("text"))
    edges = chunks.withColumn("step", F.lit(step)).mapInArrow(
        _edges(overlap), f"key {long_type}, at int, head array<long>, tail array<long>"
    )
    stitched = stitch_points(edges.dropDuplicates(["key", "at"]))
    onward = Window.partitionBy("key").orderBy("at")
    all_of = Window.partitionBy("key")
    spans = stitched.select(
        "key", "at", "cut",
        F.lead("cut").over(onward).alias("until"),
        F.min(F.col("cut").isNotNull()).over(all_of).alias("joined"),
    )
    pieces = (
        chunks.join(spans.filter("joined"), ["key", "at"])
        .select(
            "key", "at",
            F.expr(
                "substring(text, int(cut - at) + 1, "
                "coalesce(int(until - cut), length(text)))"
            ).alias("text"),
        )
        .mapInArrow(_encode_batches(path, ["key", "at"], counts_only), f"key {long_type}, at int, {result}")
        .distinct()
    )
    if counts_only:
        stitched_ids = pieces.groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        ordered = F.sort_array(F.collect_list(F.struct("at", "ids")))
        stitched_ids = pieces.groupBy("key").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
    unjoined = spans.filter("not joined").select("key").distinct()
    glued = (
        long_docs.join(unjoined, "key", "left_semi")
        .mapInArrow(whole_run, f"key {long_type}, {result}")
        .distinct()
    )
    long_ids = stitched_ids.unionByName(glued).withColumn("key", F.col("key.key"))
    return short.unionByName(long_ids).withColumnRenamed("key", id_col)


def decode(ids: list[int], path: str = TOKENIZER_PATH) -> str:
    """The text of `ids`: their raw bytes one after another."""
    return encoder(path).decode_bytes(ids).decode("utf-8")
