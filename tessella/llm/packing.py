"""Problem 7: documents into containers of a fixed token capacity with little space unused.

Method: sum-of-squares packing. With N(g) the number of open containers that have a gap of g
tokens, an item goes where the sum of N(g)^2 over all gaps becomes smallest: into an open container
or a new one. Items come in the fixed random order of their hashes, which is what the
method's bound on unused space asks for. The work is spread over shards by hash; each is packed
on its own and leaves a few containers partly filled, well under one in a hundred of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.encoding import TOKENIZER_PATH, encode_documents
from tessella.session import cut

CAPACITY = 2_048
#: Containers that a shard fills, about.
SHARD_CONTAINERS = 2_048
_NEVER = np.iinfo(np.int64).max


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, in the given order; every size is at most `capacity`."""
    count = np.zeros(capacity + 1, np.int64)
    open_by_gap: dict[int, list[int]] = {}
    container = np.empty(len(sizes), np.int64)
    made = 0
    for i, size in enumerate(sizes):
        size = int(size)
        if size == 0:
            container[i] = 0  # takes no space: the shard's first container
            continue
        left = capacity - size
        cost, gap = (2 * count[left] + 1 if left else 0), capacity
        # A container of gap g in size..capacity-1 becomes one of gap g - size, or full.
        now = count[size:capacity]
        if len(now):
            change = 2 * (count[: capacity - size] - now) + 2
            change[0] = 1 - 2 * now[0]
            change[now == 0] = _NEVER
            best = int(np.argmin(change))
            if now[best] and change[best] <= cost:
                gap = size + best
        if gap == capacity:
            container[i], made = made, made + 1
        else:
            container[i] = open_by_gap[gap].pop()
            count[gap] -= 1
        if gap > size:
            open_by_gap.setdefault(gap - size, []).append(int(container[i]))
            count[gap - size] += 1
    return container


def pack_documents(
    sizes: DataFrame,
    id_col: str = "doc_id",
    size_col: str = "n_tokens",
    capacity: int = CAPACITY,
    shard_containers: int = SHARD_CONTAINERS,
) -> DataFrame:
    """(id_col, piece_no, n_pieces, first_token, n_tokens, container): where each document goes.

    No container holds more than `capacity` tokens. A document within the capacity is one
    piece in one container. A larger one is cut into pieces of `capacity` tokens, each filling a
    container, and a rest that is packed like a document. Null and negative sizes count as 0;
    documents of no tokens go to a container that is there anyway. Repeated rows are packed
    as often as they stand, and spread over shards like others, as are rows without an id. The result depends on ids and sizes only. No rows: no containers.
    """
    clean = sizes.select(
        F.col(id_col).alias("key"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("size")
    )
    total = clean.agg(F.sum("size")).first()[0] or 0
    # Rows of one key and size are numbered in two steps, so that no row holds a long array.
    copies = clean.groupBy("key", "size").agg(F.count("*").alias("copies"))
    blocks = copies.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr("(copies - 1) div 65536"))))
    first = F.col("block") * 65_536
    clean = blocks.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("copies") - 1, first + 65_535)))).drop("copies", "block")
    shards = max(1, -(-total // (capacity * shard_containers)))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    items = (
        clean.withColumn("n_pieces", pieces)
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("first_token", F.col("piece_no").cast("long") * capacity)
        .withColumn("n_tokens", F.least(F.lit(capacity), F.col("size") - F.col("first_token")))
        .withColumn("mark", F.xxhash64(F.col("key").cast("string"), "piece_no", "copy", "size"))
        .withColumn("shard", F.pmod("mark", F.lit(shards)).cast("int"))
        .drop("size", "copy")
    )
    key_type = items.schema["key"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mark", "key", "piece_no", "n_tokens"], kind="stable")
        inside = pack(rows["n_tokens"].to_numpy(), capacity)
        rows["container"] = rows["shard"].astype("int64") * (1 << 32) + inside
        return rows[["key", "piece_no", "n_pieces", "first_token", "n_tokens", "container"]]

    packed = items.groupBy("shard").applyInPandas(
        run, f"key {key_type}, piece_no int, n_pieces int, first_token long, n_tokens long, container long"
    )
    return packed.withColumnRenamed("key", id_col)


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER_PATH, capacity: int = CAPACITY) -> DataFrame:
    """`pack_documents` of texts by their number of tokens; the sizes are made once."""
    sizes = cut(encode_documents(docs, id_col, text_col, path, counts_only=True))
    return pack_documents(sizes, id_col, capacity=capacity)


def containers(packed: DataFrame) -> DataFrame:
    """(container, n_items, n_tokens): how full each container is."""
    return packed.groupBy("container").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
