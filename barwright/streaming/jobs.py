"""Structured Streaming forms of what is otherwise polled.

Late data beyond the watermark is dropped by design; keyed state is bounded per key (an open
window, a position, an account's day).
"""

import os
import uuid

from pyspark.sql import functions as F

from barwright.functions.numeric import safe_div
from barwright.session import scratch_dir

LATE = "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_ticks(spark, path, schema, per_trigger=None):
    """Landed event files as a stream of ticks."""
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(path)


def stream_bars(ticks, every="5 minutes", late=LATE):
    """Tumbling OHLCV bars, emitted once closed."""
    at = F.struct("ts", "event_id")
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("size").alias("volume")
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_last30(ticks, late=LATE):
    """Sliding half-hour summary every five minutes."""
    at = F.struct("ts", "event_id")
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", "30 minutes", "5 minutes").alias("w")).agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("ticks")
    ).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "high", "low", "close", "ticks")


def stream_session(ticks, late=LATE):
    """Session-to-date VWAP, high and low; run it in update mode for running values."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(
        safe_div(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.sum("size").alias("volume")
    ).select("symbol", F.to_date(F.to_utc_timestamp("w.start", F.current_timezone())).alias("session"), "vwap", "high", "low", "volume")


def stream_journal(orders, late="1 day"):
    """Journal entries deduplicated on order_id within the watermark."""
    return orders.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["order_id"])


def stream_alerts(positions, path, checks, checkpoint):
    """Run batch alert checks on every micro-batch and append what they find as JSON lines.

    ``checks`` are functions DataFrame -> alerts. The batch id names the output folder, so a
    replayed batch overwrites itself.
    """
    def write(batch, batch_id):
        batch = batch.persist()
        for i, check in enumerate(checks):
            check(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").json(f"{path}/batch={batch_id}/check={i}")
        batch.unpersist()

    return positions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scratch(spark, name):
    """A fresh folder that driver and executors share."""
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def land_by_time(df, spark, name, order, slices=4, files=4):
    """Write a bounded table as event files in slices of rising ``order``, the way they would land; returns the folder.

    A stream that takes ``files`` files a trigger reads one slice a batch.
    """
    path = scratch(spark, name)
    share = [i / slices for i in range(1, slices)]
    cuts = [None, *df.agg(F.percentile_approx(order, share)).first()[0], None] if slices > 1 else [None, None]
    for low, high in zip(cuts, cuts[1:]):
        part = df if low is None else df.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        part.repartition(files).write.mode("append").parquet(path)
    return path


def drain(stream, spark, name, mode="append", keyed=False):
    """Run a stream over all that is available into a table and read that table back.

    Append mode writes parquet (exactly once by the file sink). Update mode keeps every batch's
    rows with its number; the newest batch of a key is its value.
    """
    out, ck = scratch(spark, name), scratch(spark, name + "-ck")
    if keyed:
        # processors with timers keep their state in RocksDB; the setting is read when the stream starts
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    w = stream.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    if keyed:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    q.awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(out)
