"""The call ledger as a stream: windowed totals with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import shared_folder


def windowed(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of a batch or stream of events."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """The windows of the events under `path`, streamed until the input is used up in one batch for a file.

    Where the input comes in several batches, events over two hours behind the watermark are left out.

    Each micro-batch writes its changed windows; of each window the last version counts.
    The sink and the progress lie in the shared folder spark.checkpoint.dir.
    """
    base = shared_folder(spark)
    out = f"{base}/ledger-{uuid.uuid4().hex}"
    batch = spark.read.parquet(path)
    naive = dict(batch.dtypes)["ts"] == "timestamp_ntz"
    ts = F.col("ts").cast("timestamp").alias("ts") if naive else F.col("ts")
    reader = spark.readStream.schema(batch.schema)
    folder, _, name = path.rpartition("/")
    if any(f.rsplit("/", 1)[-1] == name for f in batch.inputFiles()):  # a single file: its folder, filtered to it
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = reader.parquet(path)
    keep = windowed(stream.select(ts, "event_type", "value"))

    def write(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")

    running = keep.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    running.awaitTermination()
    schema = "start timestamp, event_type string, n long, total double, epoch int"
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/data")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("x"))
    return last.select("start", "event_type", "x.n", "x.total")
