"""Problem 2: a sample that stays the same on reruns and keeps its members as data grows.

Method: nested hash buckets. A key belongs for ever to one of 65,536 buckets, the buckets have
a fixed order, and the sample is the keys of the first buckets of that order. The list of
buckets is only ever appended to: its length is the largest that the rate, or any load so far,
called for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 65_536
SEED = "tessella-1"
RATE = 0.05
#: Sampled ids that a split has at least, if it has that many.
LEAST_PER_SPLIT = 50


def bucket_of(key: Column) -> Column:
    """0..65535, from the first four hexadecimal digits of the key's md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int")


def bucket_order(spark, seed: str = SEED) -> DataFrame:
    """(bucket, place): the fixed permutation, places 1..65536 by md5 of seed and bucket."""
    ids = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    mark = F.md5(F.concat(F.lit(seed + "|"), F.col("bucket").cast("string")))
    order = Window.orderBy(mark, "bucket")  # over the 65,536 buckets, whatever the data
    return ids.withColumn("place", F.row_number().over(order))


def growing_sample(
    items: DataFrame,
    id_col: str = "id",
    split_col: str = "split",
    load_col: str = "load_no",
    rate: float = RATE,
    least: int = LEAST_PER_SPLIT,
    seed: str = SEED,
) -> DataFrame:
    """(id, split, bucket, place, first_load): the sampled ids, once each.

    An id's split is the one it is assigned to (lower case, without blanks around), or '' while
    it has none. The list of buckets begins with the share `rate`; at each load it is extended
    until every split that then has at least 10 x `least` ids has `least` sampled ones. What an
    earlier load called for stays, so no id is ever dropped; ids, loads and buckets decide, not
    partitioning or order. Rows with a null id belong to no sample; a null load counts as the
    first. No rows: no sample.
    """
    clean = items.select(
        F.col(id_col).cast("string").alias("id"),
        F.lower(F.trim(F.coalesce(F.col(split_col), F.lit("")))).alias("split"),
        F.coalesce(F.col(load_col), F.lit(1)).alias("load"),
    ).filter(F.col("id").isNotNull())
    ids = clean.groupBy("id").agg(
        F.max("split").alias("split"),
        F.min("load").alias("first_load"),
        F.min(F.when(F.col("split") != "", F.col("load"))).alias("assigned_load"),
    )
    placed = ids.withColumn("bucket", bucket_of(F.col("id"))).join(
        F.broadcast(bucket_order(items.sparkSession, seed)), "bucket"  # 65,536 rows always
    )
    # Ids by split, load and place: at most splits x loads x 65,536 rows, however many ids. More ids never move
    # the place of the `least`-th one back, so of all loads the first that has enough ids calls for most.
    counts = placed.filter("split != ''").groupBy("split", F.col("assigned_load").alias("load"), "place").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("split").orderBy("load")
    totals = counts.groupBy("split", "load").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(so_far))
    first = totals.filter(F.col("all") >= 10 * least).groupBy("split").agg(F.min("load").alias("as_of"))
    seen = counts.join(first, "split").filter("load <= as_of").groupBy("split", "place").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("split").orderBy("place")
    before = F.sum("n").over(along) - F.col("n")
    needed = seen.withColumn("before", before).filter(F.col("before") < least).agg(F.max("place").alias("needed"))
    length = F.greatest(F.coalesce("needed", F.lit(0)), F.lit(int(round(rate * BUCKETS))))
    return (
        placed.crossJoin(F.broadcast(needed.select(length.alias("listed"))))  # one row
        .filter("place <= listed")
        .select("id", "split", "bucket", "place", "first_load")
    )
